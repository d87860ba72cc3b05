"""Trained operators: held-out accuracy, exact parts, odd rows."""
import collections
import re
import zlib

import numpy as np
import pytest

from llm_helpers import rows_of, words_of
from rollbook.llm import licenses, line_crf, quality, queries

TEN = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{TEN}/labels.parquet")


@pytest.fixture(scope="module")
def ten(spark):
    return spark.read.parquet(f"{TEN}/documents.parquet")


def test_quality_on_held_out_labels(spark):
    rows = queries.op2_quality(spark, TEN).collect()
    truth = dict(rows_of(TEN, "labels", "doc_id, quality"))
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.predicted for r in held if truth[r.doc_id]) >= 0.98 * sum(truth[r.doc_id] for r in held)


def test_quality_reads_no_held_out_label(ten, labels):
    other = labels.where(~quality.held_out("doc_id"))
    a, b = quality.fit(ten, labels, 50, 100), quality.fit(ten, other, 50, 100)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_prior_estimate():
    random = np.random.default_rng(1)
    p = random.normal(2, 1, (2000, 3))
    u = np.concatenate([random.normal(2, 1, (1200, 3)), random.normal(-2, 1, (800, 3))])[random.permutation(2000)]
    assert abs(quality.estimate_prior(p, u) - 0.6) < 0.1


def test_quality_odd_rows(odd, empty, ten, labels):
    model = quality.fit(ten, labels, 100, 200)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty_text = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(empty_text) == 1 and len({r.score for r in rows if r.doc_id == 5}) == 1
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.score(empty, model).count() == quality.keep_good(empty, model).count() == 0
    nothing = quality.fit(empty, labels.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}
    quality.fit(odd, labels)


def brute_base(text):
    w = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_line_labels_base_and_verdict(spark):
    texts = dict(rows_of(TEN, columns="doc_id, text"))
    truth = dict(rows_of(TEN, "labels", "doc_id, quality"))
    rows = queries.op10_line_labels(spark, TEN).collect()
    assert len(rows) == len(texts)
    right = []
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in truth and not r.base_failed:
            right.append(r.kept == truth[r.doc_id])
    assert sum(right) >= 0.97 * len(right)


def test_viterbi_and_gradient():
    random = np.random.default_rng(2)
    move = random.normal(size=(2, 2))
    emit = random.normal(size=(9, 2))
    paths = [[p >> i & 1 for i in range(9)] for p in range(512)]
    score = lambda p: sum(emit[i, y] for i, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
    assert line_crf.viterbi(emit, move).tolist() == max(paths, key=score)
    texts = sorted((random.normal(size=(n, 3)) for n in (1, 4, 2)), key=len, reverse=True)
    steps = [np.stack([x[t] for x in texts if len(x) > t]) for t in range(4)]
    labels, w = [random.integers(0, 2, len(x)) for x in texts], random.normal(size=(3, 2))
    by_step = [np.array([y[t] for y in labels if len(y) > t]) for t in range(4)]

    def likelihood(w, move):
        total = 0.0
        for x, y in zip(texts, labels):
            e = x @ w
            every = [sum(e[i, s] for i, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in ([c >> i & 1 for i in range(len(x))] for c in range(2 ** len(x)))]
            total += sum(e[i, s] for i, s in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:])) - np.log(np.exp(every).sum())
        return total / 7

    gw, gm = line_crf._gradient(w, move, steps, by_step)
    for g, x in ((gw, w), (gm, move)):
        for at in np.ndindex(x.shape):
            x[at] += 1e-5
            up = likelihood(w, move)
            x[at] -= 2e-5
            assert abs((up - likelihood(w, move)) / 2e-5 - g[at]) < 1e-4
            x[at] += 1e-5


def test_content_between_boilerplate(ten, labels, spark):
    """The learnt field changes its label within a text, and is right on labels it has not read."""
    model = line_crf.fit(ten, labels)
    sentences = [f"The quick river carried {n} small boats toward the harbour where merchants waited for news." for n in "two three four five six seven eight nine".split()]
    menu = ["home | about | contact | news"] * 3
    text = "\n".join(menu + sentences[:4] + menu + sentences[4:] + menu)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert line_crf.judge(frame, model).first().content_lines == [3, 4, 5, 6, 10, 11, 12, 13]
    truth = {i: q for i, q in rows_of(TEN, "labels", "doc_id, quality") if zlib.crc32(str(i).encode()) % 5 == 0}
    judged = {r.doc_id: r for r in line_crf.judge(ten, model).collect()}
    right = [(judged[i].content_share >= 0.5) == (q == 1) for i, q in truth.items() if i in judged]
    assert sum(right) >= 0.9 * len(right)


def test_line_labels_odd_rows(odd, empty, ten, labels):
    model = line_crf.fit(ten, labels, 60)
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_crf.judge(odd, model).collect())
    assert got == sorted(brute_base(r.text) for r in odd.select("text").collect())
    assert line_crf.judge(empty, model).count() == 0
    w, move = line_crf.fit(empty, labels.limit(0))
    assert all(r.content_share in (0.0, 1.0) for r in line_crf.judge(odd, (w, move)).collect())


def test_licenses(spark):
    texts = dict(rows_of(TEN, columns="doc_id, text"))
    names = {"GNU General Public": "gpl", "CC BY-NC": "cc-by-nc", "MIT License": "mit", "Apache License": "apache", "All rights reserved": "proprietary"}
    rows = queries.op8_licenses(spark, TEN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.families == ",".join(sorted({f for k, f in names.items() if k in text}))
        assert r.n_paragraphs == sum(bool(x.strip()) for x in text.split("\n"))
        for span in filter(None, r.spans.split(",")):
            family, start, end = span.split(":")
            assert any(f == family and k in text[int(start):int(end)] for k, f in names.items())


def test_license_families_and_unknown():
    model = licenses.train(["plain words of a text number %d, nothing more" % i for i in range(50)])
    scanner = licenses.Scanner(model)
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            found = scanner.scan(f"before\n  {t}\nafter", 0.5, 0.6)
            assert [(n, f) for n, _, _, f, _, s in found if s >= 0.6] == [(2, family)], t
    for text in ("he lost his driving license in the fall", "permission to speak, sir", "a free software engineer left", "no copyright in that song"):
        assert not [x for x in scanner.scan(text, 0.5, 0.6) if x[5] >= 0.6]


def test_licenses_odd_rows(odd, empty):
    model = licenses.fit(odd)
    rows = licenses.scan(odd, model).collect()
    assert len(rows) == odd.count() and all(r.found == [] for r in rows)
    assert [r.n_paragraphs for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    licenses.fit(empty)
    assert licenses.scan(empty, model).count() == 0
