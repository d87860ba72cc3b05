"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks every line of a text as content
or boilerplate; Viterbi decoding finds the best labels of the whole sequence,
and a document is kept if enough of its word characters lie in content lines
(and the base rules do not fail it).

The field is trained on sequences joined from short pieces of good and bad
documents, each line labelled by the document it comes from, so that it sees
content and boilerplate follow each other.  Labels are read only of documents
with crc32(id as text) mod 5 not 0.  At most ``max_documents`` labelled documents
of each class (those with the smallest id hashes) give a stretch of at most
``max_lines`` consecutive lines each, from a place set by the id; so at most
``2 * max_documents * max_lines`` lines of 14 numbers go to the driver, and a few
dozen weights are broadcast.  Every text is judged whole.

Defined results: a null or empty text has no words, fails the base rules and
has content share 0.  Lines without words are labelled but weigh nothing.
Every row is judged on its own, repeated rows and null ids included.  Without
training documents of both classes every line is content.  Only ``id_col`` and
``text_col`` are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rollbook.llm.common import small_batches, text_of

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
CONTENT = 1
FEATURES = 14


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the word characters in each."""
    rows, sizes, seen = [], [], set()
    for raw in text.encode().split(b"\n"):
        words = raw.split()
        n = len(words)
        if not n:
            rows.append([1.0] + [0.0] * (FEATURES - 2) + [1.0])
            sizes.append(0)
            continue
        size = sum(map(len, words))
        again = raw in seen
        seen.add(raw)
        rows.append([
            1.0, min(np.log1p(n) / 5, 1.5), min(5 * (len(raw) - len(raw.translate(None, SYMBOLS))) / size, 2.0),
            words.count(b"|") / n, sum(map(bytes.__eq__, words, words[1:])) / n, len(set(words)) / n,
            float(raw.rstrip()[-1:] in (b".", b"!", b"?")), min(size / n / 10, 3.0), sum([len(w) <= 3 for w in words]) / n,
            min(5 * (len(raw) - len(raw.translate(None, b"0123456789"))) / size, 2.0),
            sum(map(bytes.istitle, words)) / n, float(words[0][:1].isupper()), float(again), 0.0])
        # Code points: continuation bytes of UTF-8 do not count.
        sizes.append(len(b"".join(words).decode()))
    return np.array(rows), np.array(sizes, dtype=np.int64)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label sequence for scores ``emit`` (lines x 2), ``move`` (2 x 2)."""
    a, b = emit[0]
    back = []
    (m00, m01), (m10, m11) = move.tolist()
    for e0, e1 in emit[1:].tolist():
        stay0, from1 = a + m00, b + m10
        from0, stay1 = a + m01, b + m11
        back.append((from1 > stay0, stay1 >= from0))
        a, b = max(stay0, from1) + e0, max(from0, stay1) + e1
    label = int(b >= a)
    out = [label]
    for to0, to1 in reversed(back):
        label = int(to1 if label else to0)
        out.append(label)
    return np.array(out[::-1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradient(w: np.ndarray, move: np.ndarray, steps: list[np.ndarray], labels: list[np.ndarray]):
    """Gradient of the mean log-likelihood per line.  ``steps[t]`` holds the
    t-th line's features of all texts that are longer than t, ``labels[t]`` their
    labels; texts come longest first."""
    emit = [x @ w for x in steps]
    forward = [emit[0]]
    for e in emit[1:]:
        forward.append(_log_sum(forward[-1][:len(e), :, None] + move, 1) + e)
    back, ahead = [np.zeros_like(e) for e in emit], None
    for t in range(len(emit) - 2, -1, -1):
        n = len(emit[t + 1])
        back[t][:n] = _log_sum(move + (emit[t + 1] + back[t + 1])[:, None, :], 2)
    total = _log_sum(forward[0] + back[0], 1)
    gw, gm, truth = np.zeros_like(w), np.zeros_like(move), [np.eye(2)[y] for y in labels]
    for t, x in enumerate(steps):
        n = len(x)
        gw += x.T @ (truth[t] - np.exp(forward[t] + back[t] - total[:n, None]))
        if t:
            both = forward[t - 1][:n, :, None] + move + (emit[t] + back[t])[:, None, :] - total[:n, None, None]
            gm += truth[t - 1][:n].T @ truth[t] - np.exp(both).sum(0)
    lines = sum(map(len, steps))
    return gw / lines, gm / lines


def spliced(texts: list[np.ndarray], labels: list[int], longest: int = 8, most: int = 8, seed: int = 10):
    """The texts' lines, cut into pieces of one to ``longest`` lines, in
    sequences of one to ``most`` pieces in random order, and each line's label."""
    random = np.random.default_rng(seed)
    pieces = []
    for x, y in zip(texts, labels):
        at = 0
        while at < len(x):
            piece = x[at:at + random.integers(1, longest + 1)]
            pieces.append((piece, np.full(len(piece), y)))
            at += len(piece)
    order, at, out = random.permutation(len(pieces)), 0, []
    while at < len(order):
        some = [pieces[i] for i in order[at:at + random.integers(1, most + 1)]]
        out.append((np.concatenate([x for x, _ in some]), np.concatenate([y for _, y in some])))
        at += len(some)
    return out


def train(texts: list[np.ndarray], labels: list[int], rounds: int = 120, decay: float = 1e-3):
    """Weights (features x 2) and moves (2 x 2) for line features of texts."""
    w, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    if len(set(labels)) < 2:
        w[0, CONTENT] = 1.0
        return w, move
    sequences = sorted(spliced(texts, labels), key=lambda s: -len(s[1]))
    steps, y = [], []
    for t in range(len(sequences[0][1])):
        sequences = [s for s in sequences if len(s[1]) > t]
        steps.append(np.stack([x[t] for x, _ in sequences]))
        y.append(np.array([z[t] for _, z in sequences]))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, move)]
    for step in range(1, rounds + 1):
        for x, g, (m, s) in zip((w, move), _gradient(w, move, steps, y), state):
            g = g - decay * x
            m[:] = 0.9 * m + 0.1 * g
            s[:] = 0.99 * s + 0.01 * g * g
            x += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return w, move


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 1500, max_lines: int = 100, id_col: str = "doc_id", text_col: str = "text"):
    """Train on ``max_lines`` lines of at most ``max_documents`` labelled documents of each quality."""
    def sample(quality: int) -> DataFrame:
        ids = labels.where(F.col("quality") == quality).select(F.col("doc_id").cast("long").alias("id")).where("id is not null").where(F.crc32(F.col("id").cast("string")) % 5 != 0).distinct()
        return ids.orderBy(F.xxhash64("id"), "id").limit(max_documents).withColumn("label", F.lit(quality))

    def stretch(i: int, text: str) -> bytes:
        x = line_features(text)[0]
        first = i * 2654435761 % max(len(x) - max_lines + 1, 1)
        return x[first:first + max_lines].astype("<f4").tobytes()

    def run(batches):
        for batch in batches:
            packed = [stretch(i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "label", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    chosen = sample(0).unionByName(sample(1))  # at most twice max_documents ids are broadcast
    rows = (texts.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(run, "id long, label int, x binary")
            .groupBy("id", "label").agg(F.min("x").alias("x")).collect())
    rows.sort(key=lambda r: (r.id, r.label))
    return train([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(float) for r in rows], [r.label for r in rows])


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    place = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    k = len(ids)
    if k ** 3 < 1 << 62:
        _, inverse, counts = np.unique((place[:-2] * k + place[1:-1]) * k + place[2:], return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
    else:
        windows = list(zip(words, words[1:], words[2:]))
        found = Counter(windows)
        twice = np.array([found[x] > 1 for x in windows])
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i:n - 2 + i] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def judge(docs: DataFrame, model, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base counts, ``base_failed``, ``content_lines`` (numbers
    of the lines marked content, from 0), ``content_share`` and ``kept``."""
    small_batches(docs.sparkSession)
    w, move = model

    def run(batches):
        for batch in batches:
            counts, lines, shares = [], [], []
            for text in map(pa.StringScalar.as_py, batch.column(1)):
                counts.append(base_counts(text))
                x, sizes = line_features(text)
                content = viterbi(x @ w, move) == CONTENT
                lines.append(np.flatnonzero(content).astype(np.int32))
                shares.append(float(sizes[content].sum() / max(sizes.sum(), 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(lines, pa.list_(pa.int32())), pa.array(shares, pa.float64())],
                names=[f.name for f in schema])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                           T.StructField("content_lines", T.ArrayType(T.IntegerType())), T.StructField("content_share", T.DoubleType())])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (docs.select(F.col(id_col), text_of(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
            .withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= min_share)))
