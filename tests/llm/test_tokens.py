import hashlib
import random
import struct

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_helpers import SMALL, rows_of
from rollbook.llm import bpe, queries, token_counts

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def greedy(symbols, rank, merged):
    """Plain BPE: the leftmost pair of lowest rank, again and again."""
    out = list(symbols)
    while True:
        best = min(((rank.get(a << 20 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(out, out[1:]))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return out
        out[best[1]:best[1] + 2] = [merged[best[0]]]


def test_segment_tree_is_greedy_bpe():
    v = bpe.Vocabulary(bpe.read_vocabulary(BYTE))
    random.seed(3)
    words = [bytes(random.choices(b"aeinorst th", k=n)) for n in [*range(1, 60), 500] for _ in range(5)]
    expected = [greedy([v.inner[b] for b in w], v.rank, v.merged) for w in words]
    assert [bpe.merge([v.inner[b] for b in w], v.rank, v.merged) for w in words] == expected
    assert [x.tolist() for x in bpe.merge_words(words, v)] == expected


def test_fuzz_against_library():
    random.seed(5)
    alphabet = [*"abcdeABCZ  '\n\t.,!?12390-_éΣßÉİ\x1c\x85\xa0 　你好😀‍ﬁ٣²Ⅷ́\x00", "'s", "'ll", "'RE", "<|endoftext|>", "<|startoftext|>", "   ", "\r\n"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(4000)]
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    encoder = bpe.WordEncoder(bpe.Vocabulary(bpe.read_vocabulary(WORD)), most=500)  # the cache overflows
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode_many(texts)] == [e.ids for e in word.encode_batch(texts, add_special_tokens=False)]
    v = bpe.Vocabulary(bpe.read_vocabulary(BYTE))
    counter = token_counts.TokenCounter(v, token_counts.whole_tokens(v), most=500)
    assert [n for i in range(0, 4000, 400) for n in counter.count_many(texts[i:i + 400])] == [len(e.ids) for e in byte.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_proved():
    v = bpe.Vocabulary(bpe.read_vocabulary(BYTE))
    whole = token_counts.whole_tokens(v)
    library = Tokenizer.from_file(BYTE)
    assert " the" in whole and "<|endoftext|>" not in whole
    some = sorted(w for w in whole if w.strip().isalpha() and w.lstrip(" ") == w.strip())[::50]
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in some)


def expected_round_trip(text):
    t = Tokenizer.from_file(WORD)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_query_op3_against_library(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_bpe_round_trip(spark, SMALL).collect()}
    assert got == {i: expected_round_trip(t) for i, t in rows_of(SMALL, columns="doc_id, text")}


def test_query_op7_against_library(spark):
    t = Tokenizer.from_file(BYTE)
    expected = {}
    for i, x in rows_of(SMALL, columns="doc_id, text"):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        expected[i] = (len((x or "").encode()), n, n > 512)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op7_token_counts(spark, SMALL).collect()} == expected


def test_odd_rows(odd, empty):
    texts = sorted((r.text or "") for r in odd.select("text").collect())
    encoded = bpe.encode(odd, WORD)
    out = bpe.decode(encoded, WORD).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("a"), F.sha2("decoded", 256).alias("b")).collect()
    assert sorted((r.n_tokens, r.a, r.b) for r in out) == sorted(map(expected_round_trip, texts))
    both = bpe.round_trip(odd, WORD).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("a"), F.sha2("decoded", 256).alias("b")).collect()
    assert sorted((r.n_tokens, r.a, r.b) for r in both) == sorted((r.n_tokens, r.a, r.b) for r in out)
    t = Tokenizer.from_file(BYTE)
    counts = token_counts.token_counts(odd, BYTE).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in counts) == sorted((len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for x in texts)
    assert bpe.encode(empty, WORD).count() == token_counts.token_counts(empty, BYTE).count() == 0


def test_decode_unknown_ids(spark):
    frame = spark.createDataFrame([(1, bytearray(struct.pack("<3I", 320, 2 ** 31, 49407))), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decode(frame, WORD).collect()}
    assert got == {1: Tokenizer.from_file(WORD).decode([320, 49407], skip_special_tokens=False), 2: ""}
