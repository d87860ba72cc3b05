import random

from llm_helpers import SMALL, brute_components, rows_of
from rollbook.llm import components, minhash, queries


def test_query_against_brute_force(spark):
    expected = brute_components(rows_of(SMALL, columns="doc_id, text"), 4, 80)
    rows = queries.op9_near_dedup(spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def planted(seed=4):
    """Groups of near copies at different distances: stars whose leaves are far
    from each other, chains, copies, and one large group."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    texts = []
    for group in range(25):
        words = [word() for _ in range(100)]
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for _ in range(random.choice([1, 3, 4])):
                copy[random.randrange(100)] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain = chain[2:] + [word(), word()]
        texts.append(" ".join(chain))
    hot = [word() for _ in range(200)]
    for _ in range(150):
        copy = list(hot)
        copy[random.randrange(200)] = word()
        texts.append(" ".join(copy).upper())
    texts += [" ".join(hot)] * 150 + ["few words", "Few  words", "", None]
    random.shuffle(texts)
    return list(enumerate(texts))


def test_planted_groups(spark):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, words=4).collect()}
    assert got == brute_components(rows, 4, 80)
    kept = {r.doc_id for r in minhash.keep_one(frame, words=4).collect()}
    assert kept == {c for _, c in got.values()}


def family(pages=300, pairs=100, seed=7):
    """Pages of one template, each about 0.7 like any other, and near copies of
    some of them that are no leaders."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    template, texts = [word() for _ in range(330)], []
    for i in range(pages):
        own = [word() for _ in range(70)]
        texts.append(" ".join(template + own))
        if i < pairs:
            own[30:] = [word() for _ in range(40)]
            texts.append(" ".join(template + own))
    random.shuffle(texts)
    return list(enumerate(texts))


def test_pairs_inside_a_templated_family(spark):
    rows = family()
    expected = brute_components(rows, 4, 80)
    assert len({c for _, c in expected.values()}) == 300
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, words=4).collect()} == expected


def test_components(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(0, 200) if i % 50 != 49] + [(300, x) for x in range(400, 500)] + [(9, 9), (None, 3)] + [(7, 8)] * 3
    random.shuffle(links)
    links = [(b, a) if random.random() < 0.5 else (a, b) for a, b in links]
    got = {r.id: r.c for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == i // 50 * 50 for i in range(200)) and all(got[i] == 300 for i in [300, *range(400, 500)])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd, words=4).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id is None and r.kept for r in by[None])
    assert [(r.n_shingles, r.component_id, r.kept) for i in (1, 2, 3) for r in by[i]] == [(0, i, True) for i in (1, 2, 3)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in by[5]] == [(3, 5, True)] * 2
    assert len(by[6]) == 2 and by[7][0].n_shingles == 1
    kept = minhash.keep_one(odd, words=4)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1  # a row twice
    assert minhash.near_duplicates(empty).count() == minhash.keep_one(empty).count() == 0


def test_meeting_probability():
    assert minhash.least_matches(32, 0.8) == 15


def assembled(pages, seed=11):
    """Pages of one template and ten optional blocks."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    template, blocks, texts = [word() for _ in range(220)], [[word() for _ in range(22)] for _ in range(10)], []
    for _ in range(pages):
        chosen = [b for b in blocks if random.random() < 0.5]
        texts.append(" ".join(template + [w for b in chosen for w in b] + [word() for _ in range(30)]))
    return list(enumerate(texts))


def test_pages_assembled_from_blocks(spark):
    rows = assembled(250)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, words=4).collect()} == brute_components(rows, 4, 80)


def test_steep_tables_leave_out_most_pairs_below_the_similarity(spark):
    """Pages at 0.59 of each other rarely meet, near copies at 0.81 do."""
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    template, texts = [word() for _ in range(300)], []
    for i in range(200):
        own = [word() for _ in range(100)]
        texts += [" ".join(template + own), " ".join(template + own[:60] + [word() for _ in range(40)])]
    rows = [(i, i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, c long, text string")
    keys = frame.mapInArrow(lambda batches: minhash._steep_keys(batches, 4), "key long, id long, c long")
    pairs = {(r.a, r.b) for r in minhash._across(keys).collect()}
    assert all((i, i + 1) in pairs for i in range(0, 400, 2))  # at 0.81
    assert len(pairs) < 0.12 * 400 * 399 / 2


def altered(pages, least, most, seed=3):
    """Copies of one page, which is not among them, with some words replaced."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    page, texts = [word() for _ in range(150)], []
    for _ in range(pages):
        copy = list(page)
        for p in random.sample(range(150), random.randint(least, most)):
            copy[p] = word()
        texts.append(" ".join(copy))
    texts += [f"{texts[i]} {word()}" for i in range(0, pages, 20)]
    random.shuffle(texts)
    return list(enumerate(texts))


def test_compared_pairs_of_far_copies_grow_with_their_number(spark, monkeypatch):
    """Altered copies that are mostly below the similarity of each other."""
    plain, compared = minhash._confirmed, []
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    rows = altered(1000, 5, 8)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, words=4).collect()}
    assert got == brute_components(rows, 4, 80)
    assert sum(compared[2:]) < len(rows)  # beside those with leaders


def test_rarest_shingles_find_all_links_of_sets_of_different_sizes(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    page, texts = [word() for _ in range(200)], [" ".join(word() for _ in range(5))]
    for _ in range(150):
        start = random.randrange(20)
        copy = page[start:start + random.randint(5, 140)]
        texts.append(" ".join(w if random.random() < 0.99 else word() for w in copy))
    rows = [(i, i, t, i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, c long, text string, tk long")
    sets = frame.select("id", "c", "text", "tk").mapInArrow(lambda batches: minhash._sets(batches, 4), "id long, c long, tk long, n long, s array<long>")
    prefixes = minhash._prefixes(sets, 80)
    whole = [set(r.s) for r in sets.orderBy("id").collect()]
    links = {(a, b) for b in range(len(whole)) for a in range(b) if 100 * len(whole[a] & whole[b]) >= 80 * len(whole[a] | whole[b])}
    assert len(links) > 100
    for keyed in (prefixes.drop("most"), minhash._finer(prefixes)):
        assert links <= {(r.a, r.b) for r in minhash._meeting(minhash._crossing(keyed), 80).collect()}


def test_one_row_stays_of_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (None, "only here and nowhere else at all", "e"),
            (None, "only here and nowhere else at all", "e"), (3, "", "f"), (3, "", "f"), (4, None, "g"), (None, None, "h"), (None, "", "i"),
            (5, near, "j"), (6, near + " w60", "k"), (6, near + " w60", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id_ string")
    kept = minhash.keep_one(frame, words=5)
    assert kept.columns == frame.columns
    got = sorted((r.doc_id or 0, r.text or "", r.id_) for r in kept.collect())
    assert [x for x in got if x[0] == 1] in ([(1, text, "a")], [(1, text, "b")])
    assert [x[2] for x in got if x[0] != 1] == ["h", "i", "e", "f", "g", "j"]
    assert minhash.keep_one(frame.limit(0)).count() == 0


def test_nothing_sized_too_low_is_broadcast(spark):
    """Exploded and compressed tables are larger than Spark guesses: no broadcast may exceed what Spark holds for small."""
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    texts = []
    for _ in range(1500):
        words = [word() for _ in range(30)]
        texts += [" ".join(words), " ".join([*words, word()])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    limits = {"spark.sql.autoBroadcastJoinThreshold": "128k", "spark.sql.maxBroadcastTableSize": "8m"}  # Spark takes up to 4 MB for a few rows
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, words=4).collect()}
        kept = minhash.keep_one(frame, words=4).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 2 for i in range(3000)} and kept == 1500
