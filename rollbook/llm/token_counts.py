"""Token counts with a whole-token shortcut.

Offline, on the driver, every string of the vocabulary is merged from its
bytes: those that come out as the one id of the string itself are proved whole
tokens.  A pre-token in that set counts as one without any merge; only the
rest is merged (``bpe.merge_words``), repeated stretches of text once.  Set and
merges are broadcast; both are bounded by the vocabulary.

Defined results: null text counts as empty; the empty text has ``n_bytes`` 0
and ``n_tokens`` 0.  One output row per input row, repeated rows and null ids
included.  Only ``id_col`` and ``text_col`` are read, so other columns can
have any name.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from rollbook.llm.bpe import SPACES, Vocabulary, byte_symbols, in_portions, merge, merge_words, read_vocabulary
from rollbook.llm.common import small_batches, text_of


def whole_tokens(vocabulary: Vocabulary) -> set[str]:
    """The texts that, alone, are proved to encode as one token: the merges
    turn their bytes into exactly the id of the vocabulary's string."""
    byte = {c: b for b, c in enumerate(byte_symbols())}
    out = set()
    for i, s in vocabulary.strings.items():
        if s in vocabulary.special:
            continue
        raw = bytes(byte[c] for c in s)
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # part of a character: never a pre-token
            continue
        if merge([vocabulary.inner[b] for b in raw], vocabulary.rank, vocabulary.merged) == [i]:
            out.add(text)
    return out


class TokenCounter:
    """Counts the tokens of a text for a byte-level vocabulary."""

    def __init__(self, vocabulary: Vocabulary, whole: set[str], most: int = 300_000):
        self.vocabulary, self.whole = vocabulary, whole
        self.special = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        s = SPACES
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+" % (s, s, s, s))
        self.unsafe = re.compile(" [%s]" % s)
        self.before_word = re.compile("(?= [^%s])" % s)
        self.known: dict[str, int] = {}
        self.most = most

    def _stretches(self, text: str) -> list[str]:
        # A space before a non-space always starts a pre-token, so a text can
        # be cut there and equal stretches counted once.
        if self.unsafe.search(text):
            return self.before_word.split(text)
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.before_word.split(text)

    def _learn(self, stretches: list[str]) -> None:
        whole = self.whole
        pieces = [self.pieces.findall(s) for s in stretches]
        rest = list({p for ps in pieces for p in ps if p not in whole})
        count = dict(zip(rest, map(len, merge_words([p.encode() for p in rest], self.vocabulary))))
        for s, ps in zip(stretches, pieces):
            self.known[s] = sum([1 if p in whole else count[p] for p in ps])

    def count_many(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for t in texts:
            special = self.cut is not None and any(s in t for s in self.special)
            extra.append(len(self.cut.findall(t)) if special else 0)
            parts.append([s for p in self.cut.split(t) for s in self._stretches(p)] if special else self._stretches(t))
        new = {s for p in parts for s in p}.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = {s for p in parts for s in p}
        self._learn(list(new))
        get = self.known.__getitem__
        return [n + sum(map(get, p)) for n, p in zip(extra, parts)]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (``n_tokens > limit``) of every whole text."""
    small_batches(docs.sparkSession)
    spec = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(Vocabulary(spec))))

    def run(batches):
        spec, whole = shared.value
        counter = TokenCounter(Vocabulary(spec), whole)
        for batch in batches:
            counts = [n for part in in_portions(map(pa.StringScalar.as_py, batch.column(2))) for n in counter.count_many(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return (docs.select(F.col(id_col), F.octet_length(text_of(text_col)).cast("long"), text_of(text_col))
            .mapInArrow(run, schema).withColumnRenamed("id", id_col)
            .withColumn("over_limit", F.col("n_tokens") > limit))
