"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token starts as a sequence of base symbols.  Leaf ``i`` of the tree
holds the merge rank of the pair that starts at symbol ``i`` (``NONE`` if the
pair has no merge), each inner node the smaller of its children, so the root
tells the lowest rank and a descent that prefers the left child finds its
leftmost place.  A merge changes three leaves, each updated in logarithmic
time, and it ends when the root is ``NONE``.  Equal pre-tokens are merged once
per task (a bounded cache), so the common words cost one look-up.

The vocabulary file is read on the driver and broadcast (its size is fixed by
the vocabulary, a few MB); executors need no file.

Defined results: a null text counts as the empty one; the empty text has no
ids, ``n_tokens`` 0 and the empty decoded text.  Every input row gives one
output row, repeated rows and null ids included.  Only ``id_col`` and
``text_col`` are read, so other columns can have any name.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from rollbook.llm.common import small_batches, text_of

NONE = 1 << 30

# Characters that the vocabularies' patterns count as white space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the others are numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """The contents of a tokenizer file; plain data that can be broadcast."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Vocabulary:
    """Symbols, pair ranks and special tokens of a tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        chars = byte_symbols()
        self.inner = [ids[c] for c in chars]
        self.last = [ids[c + self.suffix] for c in chars]
        self.rank, self.merged = {}, []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[ids[a] << 20 | ids[b]] = r
            self.merged.append(ids[a + b])
        keys = np.array(list(self.rank), dtype=np.int64)
        self.order = np.argsort(keys)  # rank of the i-th smallest pair key
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}


def merge(symbols: list[int], rank: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges to ``symbols``: always the leftmost pair of lowest rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    get = rank.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(symbols[i] << 20 | symbols[i + 1], NONE)
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left <= right else right
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            left, right = tree[2 * i], tree[2 * i + 1]
            low = left if left <= right else right
            if tree[i] == low:
                break
            tree[i] = low

    while (low := tree[1]) < NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        i -= size
        gone = after[i]
        symbols[i] = merged[low]
        symbols[gone] = -1
        after[i] = k = after[gone]
        if gone < n - 1:
            put(gone, NONE)
        if k < n:
            before[k] = i
            put(i, get(symbols[i] << 20 | symbols[k], NONE))
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            put(h, get(symbols[h] << 20 | symbols[i], NONE))
    return [s for s in symbols if s >= 0]


def _pair_ranks(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> np.ndarray:
    key = left.astype(np.int64) << 20 | right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.order[at], NONE).astype(np.int32)


def _merge_rows(symbols: np.ndarray, n: np.ndarray, v: Vocabulary) -> np.ndarray:
    """``merge`` for many short words at a time, one tree per row: each round
    takes the root's merge of every row that still has one.  ``symbols`` is
    words x (leaves + 1), row i using its first n[i] places; merged-away and
    unused places come back as -1."""
    count, size = len(n), symbols.shape[1] - 1
    levels = size.bit_length() - 1
    place = np.arange(size + 1)
    symbols = np.where(place < n[:, None], symbols, -1)
    tree = np.full((count, 2 * size), NONE, dtype=np.int32)
    pairs = place[:-1] < n[:, None] - 1
    tree[:, size:][pairs] = _pair_ranks(symbols[:, :-1][pairs], symbols[:, 1:][pairs], v)
    for level in range(levels - 1, -1, -1):
        a, b = 1 << level, 2 << level
        tree[:, a:b] = np.minimum(tree[:, b:2 * b:2], tree[:, b + 1:2 * b:2])
    after = np.tile(np.arange(1, size + 2), (count, 1))
    before = np.tile(np.arange(-1, size), (count, 1))
    merged = np.array(v.merged)

    def put(r, leaf, value):
        i = leaf + size
        tree[r, i] = value
        for _ in range(levels):
            i >>= 1
            tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

    r = np.flatnonzero(tree[:, 1] < NONE)
    while len(r):
        low = tree[r, 1]
        i = np.ones(len(r), dtype=np.int64)
        for _ in range(levels):
            i *= 2
            i += tree[r, i] != low
        i -= size
        gone = after[r, i]
        symbols[r, i] = merged[low]
        symbols[r, gone] = -1
        k = after[r, gone]
        after[r, i] = k
        inner = gone < size  # the last place starts no pair
        put(r[inner], gone[inner], NONE)
        more = k < n[r]
        before[r[more], k[more]] = i[more]
        value = np.full(len(r), NONE, dtype=np.int32)
        value[more] = _pair_ranks(symbols[r[more], i[more]], symbols[r[more], k[more]], v)
        put(r, i, value)
        h = before[r, i]
        prior = h >= 0
        put(r[prior], h[prior], _pair_ranks(symbols[r[prior], h[prior]], symbols[r[prior], i[prior]], v))
        r = r[tree[r, 1] < NONE]
    return symbols


def merge_words(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The ids of each (non-empty) pre-token, given as bytes."""
    if not words:
        return []
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    first = np.cumsum(n) - n
    inner, last = np.array(v.inner), np.array(v.last)
    out: list = [None] * len(words)
    low = 0
    for size in (2, 4, 8, 16, 32):
        rows = np.flatnonzero((n > low) & (n <= size + 1))
        low = size + 1
        for start in range(0, len(rows), 8192):
            part = rows[start:start + 8192]
            length = n[part]
            at = np.minimum(first[part, None] + np.arange(size + 1), len(raw) - 1)
            symbols = inner[raw[at]]
            symbols[np.arange(len(part)), length - 1] = last[raw[first[part] + length - 1]]
            symbols = _merge_rows(symbols, length, v)
            kept = symbols >= 0
            ends = np.cumsum(kept.sum(1)).tolist()
            flat, begin = symbols[kept], 0
            for row, end in zip(part.tolist(), ends):
                out[row] = flat[begin:end]
                begin = end
    for row in np.flatnonzero(n > low).tolist():
        w = words[row]
        out[row] = np.array(merge([v.inner[b] for b in w[:-1]] + [v.last[w[-1]]], v.rank, v.merged))
    return out


class WordEncoder:
    """Encoder for vocabularies with word ends: NFC, lower case, white space
    dropped; special strings in a text become their own ids.  The ids of a
    stretch without white space are kept for later texts, in a cache of at
    most ``most`` stretches."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        v = self.vocabulary = vocabulary
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^%s\p{L}\p{N}]+" % SPACES)
        self.blank = regex.compile("[%s]+" % SPACES)
        self.known: dict[str, bytes] = {}
        self.most = most

    def _words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Lower case character by character: no context rule for final sigma.
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        # str.split() also cuts at \x1c-\x1f, which are no white space here.
        return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w for w in self.blank.split(text) if w]

    def _learn(self, chunks: list[str]) -> None:
        pieces = [self.pieces.findall(c) for c in chunks]
        distinct = list({p for ps in pieces for p in ps})
        ids = dict(zip(distinct, (x.astype("<u4").tobytes() for x in merge_words([p.encode() for p in distinct], self.vocabulary))))
        for c, ps in zip(chunks, pieces):
            self.known[c] = ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        special, parts = self.vocabulary.special, []
        for t in texts:
            if self.cut is not None and any(s in t for s in special):
                parts.append([struct.pack("<I", special[p]) if p in special else self._words(p) for p in self.cut.split(t)])
            else:
                parts.append([self._words(t)])
        new = {w for ps in parts for p in ps if type(p) is list for w in p}.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = {w for ps in parts for p in ps if type(p) is list for w in p}
        self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join([p if type(p) is bytes else b"".join(map(get, p)) for p in ps]) for ps in parts]


def in_portions(texts, chars: int = 2_000_000):
    """Lists of consecutive texts of about ``chars`` characters together."""
    portion, held = [], 0
    for t in texts:
        portion.append(t)
        held += len(t)
        if held >= chars:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: ``id_col``, ``n_tokens`` long and ``ids``, the
    ids as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        encoder = WordEncoder(Vocabulary(shared.value))
        for batch in batches:
            start = 0
            for part in in_portions(map(pa.StringScalar.as_py, batch.column(1))):
                ids = encoder.encode_many(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "n_tokens", "ids"])
                start += len(ids)

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col), text_of(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


class Decoder:
    """The tokens' strings joined by spaces, as for files that name no
    decoder; ids outside the vocabulary are left out."""

    def __init__(self, strings: dict[int, str]):
        self.table = np.empty(max(strings) + 2, dtype=object)  # the last place: unknown
        for i, s in strings.items():
            self.table[i] = s

    def decode(self, ids: bytes | None) -> str:
        at = np.minimum(np.frombuffer(ids or b"", dtype="<u4"), len(self.table) - 1)
        found = self.table[at].tolist()
        return " ".join(found if None not in found else [s for s in found if s is not None])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids stand for in ``out_col`` (an
    existing column of that name is replaced).  Null ids give the empty text."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_vocabulary(path)).strings)
    rest = [c for c in encoded.columns if c != out_col]
    at = rest.index(ids_col)

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            out = [decoder.decode(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded_text"])

    frame = encoded.select(*rest)
    schema = T.StructType([*frame.schema.fields, T.StructField("decoded_text", T.StringType())])
    names = [f"c{i}" for i in range(len(rest))]
    return (frame.toDF(*names)
            .mapInArrow(run, T.StructType([T.StructField(n, f.dataType) for n, f in zip([*names, "decoded_text"], schema.fields)]))
            .toDF(*rest, out_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: ``id_col``,
    ``n_tokens``, ``ids`` and ``decoded``, the text that the ids stand for."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        encoder, decoder = WordEncoder(vocabulary), Decoder(vocabulary.strings)
        for batch in batches:
            start = 0
            for part in in_portions(map(pa.StringScalar.as_py, batch.column(1))):
                ids = encoder.encode_many(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(map(decoder.decode, ids), pa.string())], names=["id", "n_tokens", "ids", "decoded"])
                start += len(ids)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(F.col(id_col), text_of(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
