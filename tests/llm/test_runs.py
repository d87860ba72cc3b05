"""Periodic runs against brute force."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from llm_helpers import SMALL, rows_of, words_of
from rollbook.llm import queries, runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            part = w[start:start + length]
            if length >= max(12, 2 * q) and all(any(a != b for a, b in zip(part, part[p:])) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def answer(doc_id, text):
    w = planted(doc_id, words_of(text))
    found = brute_runs(w)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *top, top[1] * 1000 // top[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark):
    texts = {i: t for i, t in rows_of(SMALL, columns="doc_id, text") if len(words_of(t)) < 1200}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_runs(spark, SMALL).collect()}
    assert len(got) == len(rows_of(SMALL)) and sum(r[0] > 0 for r in got.values()) > 10
    for i, t in texts.items():
        assert got[i] == answer(i, t), i


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    r = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(1, 6)):
            n, kinds = r.choice([0, 1, 5, 11, 12, 13, 30, 80, 150]), r.choice([1, 2, 3, 5, 50])
            w = [str(r.randrange(kinds)).encode() for _ in range(n)]
            for _ in range(r.randint(0, 3) if n > 3 else 0):  # nested and neighbouring repetitions
                a, p = r.randrange(n), r.randint(1, max(1, n // 3))
                for i in range(a, min(n, a + p * r.randint(1, 5) + r.randint(0, 3))):
                    w[i] = w[a + (i - a) % p]
            texts.append(w)
        assert runs.all_runs(*runs._numbered(texts)) == [brute_runs(w) for w in texts]


def test_many_nested_runs_and_long_texts():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    assert runs.all_runs(*runs._numbered([b])) == [brute_runs(b)]
    assert runs.all_runs(*runs._numbered([[b"a"] * 50_000])) == [[(0, 50_000, 1)]]
    assert runs.all_runs(*runs._numbered([[b"%d" % (i % 997) for i in range(20_000)]])) == [[(0, 20_000, 997)]]


@pytest.mark.parametrize("size", [8, 64])
def test_transform_and_matches(size):
    t, r = runs.Transform(size), np.random.default_rng(0)
    a, b = r.integers(0, runs.PRIME, (2, 3, size))
    expected = [[sum(int(x[i]) * int(y[(k - i) % size]) for i in range(size)) % runs.PRIME for k in range(size)] for x, y in zip(a, b)]
    assert t.back(t.forward(a) * t.forward(b) % runs.PRIME).tolist() == expected
    assert t.back(t.forward(a)).tolist() == a.tolist()


def test_zero_modulo_the_prime_is_no_match():
    # One difference whose square is a multiple of the prime (the numbers lie that far apart).
    x = np.arange(200, dtype=np.int64)
    x[::2] = 7
    x[1::2] = np.where(np.arange(100) % 2, 9, 9 + runs.PRIME)
    assert runs.all_runs(np.append(x, runs.PRIME * 3), np.array([0, 201])) == [[(0, 200, 4)]]


def test_odd_rows(odd, empty):
    rows = runs.find_runs(odd).collect()
    text = sorted((str(r.doc_id), r.text or "") for r in odd.select("doc_id", "text").collect())
    assert len(rows) == len(text)
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
    assert {len(r.runs) for r in rows if r.doc_id == 8} == {1}  # 20,000 times one word
    by_id = dict(text)
    assert all(" ".join(words_of(by_id[str(r.doc_id)])) == r.collapsed for r in rows if not r.runs and r.doc_id in (5, 7, 9))
    assert len([r for r in rows if r.doc_id == 5]) == 2
    assert runs.find_runs(empty).count() == 0
