"""Toxicity: the smoothed chances against their definition, held-out labels, odd rows."""
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_helpers import rows_of
from rollbook.llm import queries, toxicity
from rollbook.llm.quality import held_out

TEN = "/root/testdata/sf0.01"


def by_definition(texts, corpus):
    """log P_t - log P_o of a character after the four before it, straight from the formulas."""
    def grams(t, n):
        t = toxicity.plain(t)
        return [t[i - n:i] for i in range(5, len(t) + 1)]  # those that end where a longest one does

    def discount(counts):
        one, two = (sum(v == k for v in counts.values()) for k in (1, 2))
        return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5

    def continuation(counts):
        out = defaultdict(set)
        for g, n in counts.items():
            if n:
                out[g[1:]].add(g[0])
        return {g: len(s) for g, s in out.items()}

    triples = {g for t in corpus for g in grams(t, 3)}
    pairs = continuation(dict.fromkeys(triples, 1))
    single = continuation(pairs)
    levels = {}
    for c, ts in texts.items():
        levels[c] = {5: dict(Counter(g for t in ts for g in grams(t, 5)))}
        for n in (4, 3):
            levels[c][n] = continuation(levels[c][n + 1])

    def step(counts, d, g, low):
        total = sum(v for k, v in counts.items() if k[:-1] == g[:-1])
        if not total:
            return low
        types = sum(v > 0 for k, v in counts.items() if k[:-1] == g[:-1])
        return (max(counts.get(g, 0) - d, 0) + d * types * low) / total

    def chance(c, g, n=5):
        if n == 2:
            return step(pairs, discount(pairs), g[-2:], single.get(g[-1], 0) / sum(single.values()))
        return step(levels[c][n], discount(levels[c][n]), g[-n:], chance(c, g, n - 1))

    return lambda g: math.log(chance("t", g) / chance("o", g))


def test_chances_follow_the_definition(spark):
    toxic = ["you are an idiot, an idiot", "such a loser you are", "Ächz, idiots 你好"]
    plain = ["you are a good friend", "an idea of such a day", "the lot was a loss, you are not", "ächz und ä"]
    rest = ["an idol of days, quite unseen qx", ""]
    corpus = toxic + plain + rest
    rows = [(i, 1, t) for i, t in enumerate(toxic)] + [(10 + i, 0, t) for i, t in enumerate(plain)]
    frame = spark.createDataFrame([(k, t) for _, k, t in rows], "toxic int, text string").repartition(3)
    got = defaultdict(lambda: [0, 0])
    for r in frame.mapInArrow(toxicity._expressions, "toxic int, g string, n long").collect():
        got[r.g][r.toxic] += r.n
    grams = toxicity._grams(list(got))
    texts = spark.createDataFrame([(t,) for t in corpus], "text string").repartition(4)
    model = toxicity.Model()
    n = np.array(list(got.values()))
    toxicity.smooth(grams, {"t": n[:, 1], "o": n[:, 0]}, toxicity.shared_counts(texts, grams), model)
    exact = by_definition({"t": toxic, "o": plain}, corpus)
    asked = corpus[:-1] + ["an idle idiot, you friend"]
    asked = [t for t in asked if set(toxicity.plain(t)) <= set("".join(map(toxicity.plain, toxic + plain)))]
    assert len(asked) >= 8
    for t, x in zip(asked, model.evidence(asked)):
        p = toxicity.plain(t)
        assert x == pytest.approx(np.mean([exact(p[i:i + 5]) for i in range(len(p) - 4)]), abs=1e-9), t


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{TEN}/labels.parquet")


@pytest.fixture(scope="module")
def ten(spark):
    return spark.read.parquet(f"{TEN}/documents.parquet")


def test_query_on_held_out_documents(spark):
    rows = queries.op13_toxicity(spark, "/root/testdata/sf0.1").collect()
    truth = dict(rows_of("/root/testdata/sf0.1", "labels", "doc_id, toxic"))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = {r.doc_id: r.predicted for r in rows if r.held_out and r.doc_id in truth}
    clean = [p for i, p in held.items() if not truth[i]]
    # Some documents are labelled toxic without a toxic word; what can be learnt is about half of them.
    found = [p for i, p in held.items() if truth[i]]
    assert sum(clean) <= 0.02 * len(clean) and sum(found) >= 0.5 * len(found)


def test_reads_no_held_out_label(ten, labels):
    flipped = labels.where(held_out("doc_id")).selectExpr("doc_id", "quality", "1 - toxic AS toxic").unionByName(labels.where(~held_out("doc_id")))
    a, b = (toxicity.fit(ten, x, 200, 300_000) for x in (labels, flipped))
    assert (a.cut, a.slope) == (b.cut, b.slope) and np.array_equal(a.full[5].keys, b.full[5].keys)


def test_sample_is_bounded(ten, labels):
    rows = toxicity.sample(ten, labels, 20, 9_000).collect()
    for kind in (0, 1):
        part = [r for r in rows if r.toxic == kind]
        assert 0 < len(part) <= 20 and sum(len(r.text) for r in part) <= 9_000


def test_portions_do_not_change_evidence(ten, labels, monkeypatch):
    model = toxicity.fit(ten, labels, 200, 300_000)
    texts = [t for _, t in rows_of(TEN, columns="doc_id, text")][:60] + ["", " \n", "one", "x" * 5000]
    whole = model.evidence(texts)
    assert np.allclose(whole, [model.evidence([t])[0] for t in texts], atol=1e-9) and whole[60] == whole[61] == 0


def test_odd_rows(odd, empty, ten, labels):
    model = toxicity.fit(ten, labels, 200, 300_000)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in rows if r.doc_id == 5}) == 1
    assert toxicity.score(empty, model).count() == 0
    for none in (toxicity.fit(empty, labels), toxicity.fit(ten, labels.where("toxic = 0")), toxicity.fit(ten, labels.limit(0))):
        assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    marked = odd.selectExpr("doc_id", "1 AS quality", "doc_id % 2 AS toxic")
    toxicity.score(odd, toxicity.fit(odd, marked)).collect()


def test_cut():
    x = np.array([0.0, 0.1, 0.2, 0.9, 1.0])
    assert toxicity.place_cut(x, x > 0.5, 3.0)[0] == pytest.approx(0.55)
    assert toxicity.place_cut(x, x > 5, 3.0)[0] > 1
    assert toxicity.place_cut(np.zeros(0), np.zeros(0, dtype=bool), 3.0)[1] > 0
