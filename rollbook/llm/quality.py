"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled texts are drawn
from all documents, whatever their label.  A linear model on the text's form
minimises the non-negative unbiased risk

    R = prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss l.  The class prior is estimated first, also without
negative labels: a plain positive-against-unlabelled model is fitted on one
half of the samples, and the prior is the smallest share of unlabelled over
positive scores above any threshold on the other half, with a margin for
sample size (best-bin estimate).

The fit uses at most ``max_positive`` labelled and ``max_unlabelled``
unlabelled documents (those with the smallest id hashes of the training
folds), whole texts each; their sparse features go to the driver, the model (a
few thousand weights) is broadcast, and every document is scored in parallel.

Defined results: null text counts as empty; the empty text has only the
model's constant as its score.  A null id belongs to the held-out fold.  Rows
are scored one by one, so repeated rows get equal scores.  With no positive or
no unlabelled sample every score is 0.5.  Inputs of a score come from the text
alone; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rollbook.llm.common import small_batches, text_of

KINDS = 20  # classes of bytes in the form trigrams
WORD_STATS = 10


def byte_kinds() -> np.ndarray:
    """The class of each byte: letter, capital, digit, white space, line end,
    and classes of punctuation.  Bytes of other scripts count as letters."""
    kind = np.zeros(256, dtype=np.int64)
    for i, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".", ",", ";:", "!?", "\"'`", "-_", "|", "#", "$", "%", "&", "*", "<>=/\\", "()[]{}", "@+~^"), 1):
        for c in chars.encode():
            kind[c] = i
    return kind


def word_stats(words: list[bytes], size: int) -> list[float]:
    """Shares between 0 and about 1 that tell prose from junk."""
    n = len(words)
    if not n:
        return [0.0] * WORD_STATS
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    longest = max(map(len, words))
    letters = sum(map(bytes.isalpha, words))
    return [
        1.0, distinct / n, pairs / max(n - 1, 1), sum(map(bytes.__eq__, words, words[1:])) / n,
        min(size / n / 20, 3.0), min(longest / 50, 3.0), letters / n,
        sum([len(w) <= 3 for w in words]) / n, sum(map(bytes.istitle, words)) / n, min(np.log1p(n) / 10, 1.5)]


def form(text: str, kinds: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Codes of the byte-class trigrams, and the word statistics."""
    raw = text.encode()
    k = kinds[np.frombuffer(raw, dtype=np.uint8)]
    codes = (k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:] if len(k) > 2 else k[:0]
    return codes, word_stats(raw.split(), len(raw))


def features(text: str, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: places and values."""
    codes, stats = form(text, kinds)
    places, counts = np.unique(codes, return_counts=True)
    places = np.concatenate([places, KINDS ** 3 + np.arange(WORD_STATS)])
    return places, np.concatenate([np.sqrt(counts / max(len(codes), 1)), stats])


@dataclass
class Model:
    weights: np.ndarray
    constant: float
    prior: float

    def scores(self, texts) -> np.ndarray:
        kinds, out = byte_kinds(), []
        trigrams, rest = self.weights[:KINDS ** 3], self.weights[KINDS ** 3:]
        for t in texts:
            codes, stats = form(t, kinds)
            g = self.constant + float(rest @ np.array(stats))
            if len(codes):
                counts = np.bincount(codes, minlength=KINDS ** 3)
                at = np.flatnonzero(counts)
                g += float(np.sqrt(counts[at] / len(codes)) @ trigrams[at])
            out.append(g)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def held_out(id_col: str = "doc_id") -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def _descend(positive, unlabelled, prior: float | None, rounds: int, decay: float):
    """Weights and constant that minimise the non-negative risk; with no
    prior, the logistic loss of positives against unlabelled."""
    width = positive.shape[1]
    w, m, s = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        gp, gu = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]
        up, uu = 1 / (1 + np.exp(-np.clip(gp, -50, 50))), 1 / (1 + np.exp(-np.clip(gu, -50, 50)))
        # Derivatives of the mean losses by g: of l(g) on positives, and of l(-g).
        if prior is None:
            dp, du = (up - 1) / len(gp), uu / len(gu)
        else:
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                dp, du = (prior * (up - 1) - prior * up) / len(gp), uu / len(gu)
            else:  # the unlabelled part is overfitted: step back on it alone
                dp, du = prior * up / len(gp), -uu / len(gu)
        grad = np.append(positive.T @ dp + unlabelled.T @ du + decay * w[:-1], dp.sum() + du.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return w[:-1], w[-1]


def estimate_prior(positive, unlabelled, rounds: int = 150) -> float:
    """Share of positives among the unlabelled, by the best bin."""
    p, u = len(positive) // 2, len(unlabelled) // 2
    if p < 20 or u < 20:
        return 0.5
    w, c = _descend(positive[:p], unlabelled[:u], None, rounds, 1e-3)
    gp, gu = np.sort(positive[p:] @ w + c), np.sort(unlabelled[u:] @ w + c)
    cuts = np.unique(gp)
    above_p = 1 - np.searchsorted(gp, cuts, "left") / len(gp)
    above_u = 1 - np.searchsorted(gu, cuts, "left") / len(gu)
    margin = np.sqrt(np.log(20) / 2 / len(gp)) + np.sqrt(np.log(20) / 2 / len(gu))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def fit_samples(positive: list, unlabelled: list, rounds: int = 400, decay: float = 1e-3) -> Model:
    """The model for lists of sparse features."""
    width = KINDS ** 3 + WORD_STATS
    if not positive or not unlabelled:
        return Model(np.zeros(width), 0.0, 0.5)
    seen = np.zeros(width, dtype=np.int64)
    for places, _ in [*positive, *unlabelled]:
        seen[places] += 1
    used = np.flatnonzero(seen >= min(5, len(unlabelled)))
    column = np.full(width, -1)
    column[used] = np.arange(len(used))

    def dense(rows):
        out = np.zeros((len(rows), len(used)), dtype=np.float32)
        for i, (places, values) in enumerate(rows):
            at = column[places]
            out[i, at[at >= 0]] = values[at >= 0]
        return out

    p, u = dense(positive), dense(unlabelled)
    middle, scale = u.mean(0), np.maximum(u.std(0), 0.02)
    p, u = (p - middle) / scale, (u - middle) / scale
    prior = estimate_prior(p, u)
    w, c = _descend(p, u, prior, rounds, decay)
    weights = np.zeros(width)
    weights[used] = w / scale
    return Model(weights, float(c - (w / scale) @ middle), prior)


def _sparse(batches):
    kinds = byte_kinds()
    for batch in batches:
        rows = [features(t.as_py(), kinds) for t in batch.column(2)]
        packed = [p.astype("<u2").tobytes() + v.astype("<f4").tobytes() for p, v in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "kind", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the training folds (rows that are not ``held_out``): at most
    ``max_positive`` documents that ``labels`` (doc_id, quality) marks 1 and
    ``max_unlabelled`` documents of any label."""
    small_batches(docs.sparkSession)

    def sample(ids: DataFrame, most: int, kind: int) -> DataFrame:
        picked = ids.where(F.col("id").isNotNull() & ~held_out("id")).select("id").distinct()
        return picked.orderBy(F.xxhash64("id"), "id").limit(most).withColumn("kind", F.lit(kind))

    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id"))
    chosen = sample(trusted, max_positive, 1).unionByName(sample(ids, max_unlabelled, 0))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # At most max_positive + max_unlabelled ids are broadcast; repeated ids give one row.
    rows = (texts.join(F.broadcast(chosen), "id").select("id", "kind", "text")
            .mapInArrow(_sparse, "id long, kind int, x binary").groupBy("id", "kind").agg(F.min("x").alias("x")).collect())
    groups: dict[int, list] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r.kind, r.id)):
        n = len(r.x) // 6
        groups[r.kind].append((np.frombuffer(r.x, "<u2", n).astype(np.int64), np.frombuffer(r.x, "<f4", n, 2 * n)))
    order = np.random.default_rng(0)
    positive, unlabelled = ([groups[k][i] for i in order.permutation(len(groups[k]))] for k in (1, 0))
    return fit_samples(positive, unlabelled)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from
    ``threshold``) of every document."""
    small_batches(docs.sparkSession)
    weights, constant, prior = model.weights, model.constant, model.prior

    def run(batches):
        m = Model(weights, constant, prior)
        for batch in batches:
            s = m.scores(map(pa.StringScalar.as_py, batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["id", "held_out", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return (docs.select(F.col(id_col), held_out(id_col), text_of(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more."""
    weights, constant, prior = model.weights, model.constant, model.prior
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        m = Model(weights, constant, prior)
        for batch in batches:
            s = m.scores((t.as_py() or "") for t in batch.column(at))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
