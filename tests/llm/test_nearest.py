import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import SMALL, rows_of
from rollbook.llm import ann, queries


def brute(rows, asked, k):
    """The k nearest of each query, by (score, id)."""
    out = {}
    for q, v in rows:
        if asked(q):
            scored = sorted((-float(np.dot(np.array(v), np.array(o))), i) for i, o in rows if i != q and len(o) == len(v))
            out[q] = scored[:k]
    return out


def test_query_recall(spark):
    rows = [(i, v) for i, v in rows_of(SMALL, "embeddings", "vec_id, embedding")]
    expected = brute(rows, lambda q: q % 20 == 0, 20)
    got = {}
    for r in queries.op6_nearest(spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(expected)
    vectors = dict(rows)
    hits = 0
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - np.dot(np.array(vectors[q]), np.array(vectors[r.vec_id]))) < 1e-9 for r in found)
        hits += len({r.vec_id for r in found} & {i for _, i in expected[q]})
    assert hits >= 0.95 * 20 * len(expected)


def test_error_bound_holds_mostly():
    random = np.random.default_rng(3)
    vectors = random.standard_normal((3000, 64)) * random.uniform(0.5, 3, (3000, 1))
    packed, scalars, lengths = ann.codes(vectors)
    query = random.standard_normal(64)
    signs = np.unpackbits(packed, axis=1) * 2.0 - 1
    estimate = signs @ (ann.rotation(64) @ query) / 8 * lengths / scalars
    error = 1.9 * lengths * np.linalg.norm(query) * np.sqrt(1 - scalars ** 2) / scalars / np.sqrt(63)
    assert (np.abs(estimate - vectors @ query) <= error).mean() > 0.9
    off = estimate - vectors @ query
    assert abs(off.mean()) < 3 * off.std() / np.sqrt(len(off))  # unbiased, up to the sample's own spread


@pytest.mark.parametrize("block", [40, 16_384])
def test_ties_odd_vectors_and_blocks(spark, monkeypatch, request, block):
    # Keep the shuffle partitions apart, so that groups must really meet.
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    random = np.random.default_rng(5)
    rows = [(i, random.standard_normal(5).tolist()) for i in range(120)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(120, 300)]
    odd = [(None, [1.0] * 5), (400, None), (401, []), (402, [0.0] * 5), (403, [1.0, None, 1.0, 1.0, 1.0]), (404, [float("nan")] * 5), (405, [float("inf")] * 5), (420, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "q", "v") for r in rows + odd], "vec_id long, embedding array<float>, q string, v string")
    exact = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
    expected = brute(exact, lambda q: q % 20 == 0, 20)
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(expected)  # 420 has no candidate
    same = sum(len(set(got[q]) & {i for _, i in expected[q]}) for q in got)
    assert same >= 0.95 * sum(map(len, expected.values()))
    assert got[120] == list(range(121, 141))  # equal vectors: smaller ids first
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert len(ann.nearest(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()) == 2
