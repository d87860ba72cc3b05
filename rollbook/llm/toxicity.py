"""Toxicity by class-conditional Kneser-Ney models of characters.

A text becomes its lower-cased words (runs of word characters), one space
apart, after four spaces.  Toxic and ordinary texts get a model each of a
character after the four before it, with absolute discounting:

    P_c(z | u v x y) = max(n_c(u v x y z) - D, 0) / n_c(u v x y .) + L_c(u v x y) P_c(z | v x y)

The models of three and two characters before have the same form, with
continuation counts in place of counts: how many different characters stand
before v x y z in class c.  Below that both classes share one model of z after
y, on continuation counts over *all* documents of the corpus, so a rare
expression falls back on the same chances in both classes and says little.
D is n1 / (n1 + 2 n2) from the counts of counts, L the mass it sets free.

A text's evidence is its mean log P_toxic - log P_ordinary over its
characters.  As each character is judged within its surroundings, the
evidence hardly depends on the text's language or topic.  What a model says
of an expression unseen in both classes differs from the shorter one's answer
by the ratio of the masses alone; so a text is scored by look-ups of known
expressions, longest first.

Labelled texts are a bounded sample: of each class at most ``max_docs``
training documents, by the hash of the id, and at most ``max_chars``
characters; a document that would go beyond that is passed over.  Hence the
broadcast tables have at most ``2 * max_chars`` expressions of each length.
One in five sampled documents is kept out of the counts.  On their evidence
the cut is placed where the share of toxic documents above it, less ``alarm``
times the share of ordinary ones, is greatest; the score is logistic around
it.  Spark counts the expressions of the sample and, over the whole corpus,
the different triples of characters.

Defined results: a null text counts as empty; a text without words has the
evidence 0.  A null id is held out.  Repeated rows get equal scores, but count
once in the sample (of the texts under one id, the one with the smallest
digest).  Without examples of both classes every score is 0.  Very long texts
are scored whole.  Inputs of a score come from the text alone.  An empty table
gives no rows, and further columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rollbook.llm.common import small_batches, stored, text_of
from rollbook.llm.quality import held_out

WORD = re.compile(r"\w+")
ORDER = 5  # characters of the longest expression
OWN = 3  # shortest expressions that each class counts for itself
MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    return " " * (ORDER - 1) + " ".join(WORD.findall(text.lower())) + " "


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def portions(texts, most: int = 1 << 20):
    """The plain texts in lists of about ``most`` characters, or of one longer text."""
    part, size = [], 0
    for t in map(plain, texts):
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def mixed(columns) -> np.ndarray:
    """One 64-bit number for the characters in each place of the columns."""
    key = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        key = (key ^ c) * MIX
        key ^= key >> np.uint64(31)
    return key


class Table:
    """Values by the number of an expression."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value (0 if there is none), and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(asked)), np.zeros(len(asked), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        known = self.keys[at] == asked
        return np.where(known, self.values[at], 0.0), known


@dataclass
class Model:
    full: dict = field(default_factory=dict)  # by length: log ratio of known expressions
    free: dict = field(default_factory=dict)  # by length: log ratio of the free masses after known beginnings
    cut: float = 0.0
    slope: float = 1.0

    def evidence(self, texts) -> np.ndarray:
        """Mean log ratio of each text."""
        return np.concatenate([np.zeros(0), *map(self._evidence, portions(texts))])

    def _evidence(self, texts: list[str]) -> np.ndarray:
        c = codes("".join(texts)).astype(np.uint64)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        # Every place but the spaces put before a text ends an expression; those that reach into
        # the text before are left out below.
        columns = [c[i:len(c) - ORDER + 1 + i] for i in range(ORDER)]
        out = np.zeros(len(c))
        todo = np.arange(len(columns[0]))
        for n in range(ORDER, OWN - 1, -1):
            window = [columns[i][todo] for i in range(ORDER - n, ORDER)]
            value, known = self.full[n].find(mixed(window))
            out[todo + ORDER - 1] += value
            todo, rest = todo[~known], [w[~known] for w in window[:-1]]
            if not len(todo):
                break
            out[todo + ORDER - 1] += self.free[n].find(mixed(rest))[0]
        sums = np.concatenate([[0.0], np.cumsum(out)])
        begin = starts + ORDER - 1
        # A text of no words is the spaces alone.
        return np.where(ends - begin > 1, (sums[ends] - sums[begin]) / (ends - begin), 0.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.full:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.evidence(texts) - self.cut), -50, 50)))


# ---- Counting -----------------------------------------------------------

def sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxic, spare, text) of the sampled training documents, written once."""
    marked = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
              .where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic")))
    picked = None
    for kind in (1, 0):
        part = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(max_docs)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # At most 2 * max_docs ids are broadcast, and come back with their sizes.
    found = stored(texts.join(F.broadcast(picked), "id").withColumn("digest", F.sha2("text", 256)), "toxicity-labelled")
    sizes = found.groupBy("id", "toxic").agg(F.min(F.struct("digest", F.char_length("text").alias("n"))).alias("m")).select("id", "toxic", "m.digest", "m.n", F.xxhash64("id").alias("h")).collect()
    chosen, room = [], {0: max_chars, 1: max_chars}
    for r in sorted(sizes, key=lambda r: (r.h, r.id)):
        if r.n <= room[r.toxic]:
            room[r.toxic] -= r.n
            chosen.append((r.id, r.digest))
    kept = docs.sparkSession.createDataFrame(chosen, "id long, digest string")
    spare = F.pmod(F.xxhash64(F.lit("spare"), "id"), F.lit(5)) == 0
    return found.join(F.broadcast(kept), ["id", "digest"]).select("id", "toxic", spare.alias("spare"), "text").dropDuplicates(["id"])


def _dense(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different characters, all texts' characters as places in them, and
    the places where an expression of ``ORDER`` characters lies within a text."""
    c = codes("".join(texts))
    alphabet, places = np.unique(c, return_inverse=True)
    inside = np.ones(max(len(c) - ORDER + 1, 0), dtype=bool)
    for end in np.cumsum([len(t) for t in texts])[:-1]:
        inside[max(end - ORDER + 1, 0):end] = False
    return alphabet, places.astype(np.int64), np.flatnonzero(inside)


def _spelled(alphabet: np.ndarray, code: np.ndarray, n: int) -> pa.Array:
    """Strings of ``n`` characters from numbers in base ``len(alphabet)``."""
    out = np.empty((len(code), n), dtype=np.uint32)
    for i in range(n - 1, -1, -1):
        out[:, i] = alphabet[code % len(alphabet)]
        code = code // len(alphabet)
    text = out.tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i:i + n] for i in range(0, len(text), n)], pa.string())


def _expressions(batches):
    """(class, expression, number) of a batch's expressions of ``ORDER`` characters."""
    for batch in batches:
        kinds = batch.column(0).to_pylist()
        for kind in (0, 1):
            for part in portions(t.as_py() for t, k in zip(batch.column(1), kinds) if k == kind):
                alphabet, c, at = _dense(part)
                # The alphabet may be too large for one number of ORDER digits: number the pairs and triples first.
                front, f = np.unique(c[at] * len(alphabet) + c[at + 1], return_inverse=True)
                back, b = np.unique((c[at + 2] * len(alphabet) + c[at + 3]) * len(alphabet) + c[at + 4], return_inverse=True)
                whole, n = np.unique(f * len(back) + b, return_counts=True)
                heads, tails = _spelled(alphabet, front, 2).to_pylist(), _spelled(alphabet, back, 3).to_pylist()
                names = [heads[w // len(back)] + tails[w % len(back)] for w in whole.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(whole), pa.int32()), pa.array(names), pa.array(n.astype(np.int64))], names=["toxic", "g", "n"])


def _triples(batches):
    """The different triples of characters of a batch."""
    for batch in batches:
        for part in portions(t.as_py() for t in batch.column(0)):
            alphabet, c, at = _dense(part)
            m, last = len(alphabet), at + ORDER - 3
            code = (c[last] * m + c[last + 1]) * m + c[last + 2]
            if m ** 3 <= 1 << 24:
                seen = np.zeros(m ** 3, dtype=bool)
                seen[code] = True
                code = np.flatnonzero(seen)
            else:
                code = np.unique(code)
            yield pa.RecordBatch.from_arrays([_spelled(alphabet, code, 3)], names=["g"])


@dataclass
class Shared:
    """The corpus's chances of a character after another, at the sample's pairs."""
    discount: float
    characters: Table  # chance of a character, by its code
    pairs: Table  # continuation count of a pair
    totals: Table  # by first character: sum of the pairs' counts
    types: Table  # by first character: number of pairs

    def chance(self, rows: np.ndarray) -> np.ndarray:
        y, z = rows[:, -2], rows[:, -1]
        total, types = np.maximum(self.totals.find(y)[0], 1), self.types.find(y)[0]
        return (np.maximum(self.pairs.find(mixed([y, z]))[0] - self.discount, 0) + self.discount * types * self.characters.find(z)[0]) / total


def shared_counts(texts: DataFrame, grams: np.ndarray) -> Shared:
    """Continuation counts over all ``texts`` (one column), of which only those
    of the sample's pairs and characters (``grams``, bounded with it) leave Spark."""
    spark = texts.sparkSession
    triples = texts.mapInArrow(_triples, "g string").distinct()
    pairs = stored(triples.groupBy(F.substring("g", 2, 2).alias("g")).agg(F.count("*").alias("n")), "toxicity-pairs")
    counts = {r["n"]: r["count"] for r in pairs.where(F.col("n") <= 2).groupBy("n").count().collect()}
    one, two = counts.get(1, 0), counts.get(2, 0)
    asked = sorted({chr(k >> 32) + chr(k & 0xFFFFFFFF) for k in np.unique(grams[:, -2] << np.uint64(32) | grams[:, -1]).tolist()})
    letters = sorted({c for g in asked for c in g})

    def of(rows: DataFrame, wanted: list[str]) -> dict:
        # Bounded by the sample.
        got = rows.join(F.broadcast(spark.createDataFrame([(w,) for w in wanted], "g string")), "g").toArrow().to_pydict()
        return {k: v if k == "g" else np.array(v, dtype=float) for k, v in got.items()}

    first = of(pairs.groupBy(F.substring("g", 1, 1).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("k")), letters)
    last = of(pairs.groupBy(F.substring("g", 2, 1).alias("g")).agg(F.count("*").alias("k")), letters)
    pair = of(pairs, asked)
    heads, ends = (_grams(x["g"])[:, 0] for x in (first, last))
    return Shared(min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5, Table(ends, last["k"] / pairs.count()),
                  Table(mixed(_columns(_grams(pair["g"]), 0, 2)), pair["n"]), Table(heads, first["n"]), Table(heads, first["k"]))


# ---- Smoothing ----------------------------------------------------------

def _discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), kept away from 0 and 1."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


def _spread(keys: np.ndarray, amounts: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked key the sum of amounts, and the number of positive ones, under it."""
    known, place = np.unique(keys, return_inverse=True)
    total = Table(known, np.bincount(place, amounts, len(known)))
    types = Table(known, np.bincount(place, amounts > 0, len(known)).astype(float))
    return total.find(asked)[0], types.find(asked)[0]


def _grams(names) -> np.ndarray:
    """Expressions of equal length as rows of characters."""
    n = len(names[0]) if len(names) else 1
    return codes("".join(names)).reshape(-1, n).astype(np.uint64)


def _columns(rows: np.ndarray, first: int, last: int) -> list[np.ndarray]:
    return [rows[:, i] for i in range(first, last)]


def smooth(longest: np.ndarray, counts: dict[str, np.ndarray], shared: Shared, model: Model) -> None:
    """Fill in the model's tables.  ``longest`` are the sample's expressions,
    ``counts`` their numbers in the classes "t" and "o"."""
    # Each class's counts by length: as they are for the longest, then continuation counts.
    levels = {ORDER: (longest, counts)}
    for n in range(ORDER - 1, OWN - 1, -1):
        rows, up = levels[n + 1]
        _, one, place = np.unique(mixed(_columns(rows, 1, n + 1)), return_index=True, return_inverse=True)
        levels[n] = (rows[one, 1:], {c: np.bincount(place, up[c] > 0, len(one)) for c in up})
    chances: dict[str, Table] = {}
    for n in range(OWN, ORDER + 1):
        rows, now = levels[n]
        head, keys = mixed(_columns(rows, 0, n - 1)), mixed(_columns(rows, 0, n))
        begin = np.unique(head)
        tail = mixed(_columns(rows, 1, n))
        here, free = {}, {}
        for c, k in now.items():
            k = k.astype(float)
            dc = _discount(k)
            low = shared.chance(rows) if n == OWN else chances[c].find(tail)[0]
            total, types = _spread(head, k, head)
            here[c] = np.where(total > 0, (np.maximum(k - dc, 0) + dc * types * low) / np.maximum(total, 1), low)
            total, types = _spread(head, k, begin)
            free[c] = np.where(total > 0, dc * types / np.maximum(total, 1), 1.0)
        chances = {c: Table(keys, p) for c, p in here.items()}
        model.full[n] = Table(keys, np.log(here["t"] / here["o"]))
        model.free[n] = Table(begin, np.log(free["t"] / free["o"]))


def place_cut(x: np.ndarray, toxic: np.ndarray, alarm: float) -> tuple[float, float]:
    """The cut, and the slope of the score around it."""
    if not toxic.any() or toxic.all():
        return float(x.max(initial=0.0)) + 0.05, 60.0
    order = np.lexsort((toxic, x))
    x, toxic = x[order], toxic[order]
    gain = toxic / toxic.sum() - alarm * ~toxic / (~toxic).sum()
    above = np.concatenate([np.cumsum(gain[::-1])[::-1], [0.0]])  # by the first place that lies above the cut
    apart = np.concatenate([[True], np.diff(x) > 0, [True]])
    best = np.flatnonzero(apart & (above >= above[apart].max() - 1e-12))
    edges = np.concatenate([[x[0] - 0.05], x, [x[-1] + 0.05]])
    at = best[np.argmax(edges[best + 1] - edges[best])]
    cut = float((edges[at] + edges[at + 1]) / 2)
    beyond = np.median(x[at:]) - cut if at < len(x) else 0.05
    return cut, float(3 / max(beyond, 1e-3))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 5000, max_chars: int = 8_000_000, alarm: float = 3.0,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count both classes' models, smooth them and place the cut."""
    small_batches(docs.sparkSession)
    model = Model()
    texts = stored(sample(docs, labels, max_docs, max_chars, id_col, text_col), "toxicity-sample")
    counted = (texts.where(~F.col("spare")).select("toxic", "text").mapInArrow(_expressions, "toxic int, g string, n long").groupBy("g")
               .agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "t"), (0, "o"))))).toArrow()
    counts = {c: counted.column(c).to_numpy() for c in ("t", "o")}
    if not (len(counted) and counts["t"].sum() and counts["o"].sum()):
        return model
    grams = _grams(counted.column("g").to_pylist())
    smooth(grams, counts, shared_counts(docs.select(text_of(text_col)), grams), model)
    full, free = model.full, model.free

    def run(batches):
        m = Model(full, free)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.evidence(t.as_py() for t in batch.column(1)), pa.float64())], names=["toxic", "x"])

    got = texts.where("spare").select("toxic", "text").mapInArrow(run, "toxic int, x double").toArrow()  # a fifth of the sample
    model.cut, model.slope = place_cut(got.column("x").to_numpy(), got.column("toxic").to_numpy() == 1, alarm)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from
    ``threshold`` on) of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            s = model.scores([t.as_py() for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["id", "held_out", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return (docs.select(F.col(id_col), held_out(id_col), text_of(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
