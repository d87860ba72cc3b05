import collections

import duckdb
from pyspark.sql import functions as F

from llm_helpers import SMALL
from rollbook.llm import mixing, queries


def earliest_deadline_first(shares):
    """(pool, k) of every slot of a period, one after the other."""
    period, done, out = sum(shares.values()), collections.Counter(), []
    for t in range(period):
        ready = [((done[p] + 1) * period // s + ((done[p] + 1) * period % s > 0), p) for p, s in sorted(shares.items()) if done[p] < s and done[p] * period // s <= t]
        _, p = min(ready)
        out.append((p, done[p]))
        done[p] += 1
    return out


def period_of(spark, shares):
    frame = mixing.one_period(spark.createDataFrame(list(shares.items()), "pool string, share long"))
    return [(r.pool, r.k) for r in frame.orderBy("slot").collect()]


def test_schedule_keeps_every_source_within_one_block(spark):
    for shares in ({"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 333, "b": 200, "c": 97, "d": 1, "e": 55}, {f"s{i}": i % 9 + 1 for i in range(40)}):
        got = period_of(spark, shares)
        assert got == earliest_deadline_first(shares)
        period, done = sum(shares.values()), collections.Counter()
        for t, (pool, k) in enumerate(got, 1):
            assert done[pool] == k
            done[pool] += 1
            assert all(abs(done[p] - t * s / period) < 1 for p, s in shares.items())


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    rows = queries.op4_mix(spark, SMALL)
    expected = con.sql(f"SELECT {', '.join(rows.columns)} FROM ({queries.OP4_SQL})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(expected)


def check(placed, docs, block):
    """Every row once, blocks filled in order, no place given twice."""
    rows = placed.collect()
    assert len(rows) == docs.count()
    places = [(r["__slot"], r["__place"]) for r in rows]
    assert len(set(places)) == len(places)
    for pool, n in collections.Counter(r["__pool"] for r in rows).items():
        numbers = sorted(r["__block"] * block + r["__place"] for r in rows if r["__pool"] == pool)
        assert numbers == list(range(n))


def test_given_weights(docs):
    placed = mixing.place(docs, weights={"src1": 3.0, "src2": 1.0, "src3": 0.0, "absent": 1.0}, block=2, resolution=10)
    check(placed, docs, 2)
    first = [r["__pool"] for r in placed.where("`__place` = 0").orderBy("__slot").limit(9).collect()]
    assert set(first) <= {"src1", "src2", "<rest>"} and first.count("src1") > first.count("src2")


def test_mixed_order(docs):
    placed = mixing.place(docs)
    order = [r.doc_id for r in placed.orderBy("__slot", "__place").select("doc_id").collect()]
    assert [r.doc_id for r in mixing.mixed(docs).select("doc_id").collect()] == order


def many(spark, sizes):
    rows = [(i, f"s{i:05d}") for i, n in enumerate(sizes) for _ in range(n)]
    return spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "doc_id long, source string")


def test_any_number_of_sources_take_turns(spark):
    """In every prefix each of 1,500 equal sources is less than one block from its weight."""
    docs = many(spark, [3] * 1500)
    rows = sorted(mixing.place(docs, block=1).collect(), key=lambda r: r["__slot"])
    assert [r["__slot"] for r in rows] == list(range(4500))
    done = collections.Counter()
    for t, r in enumerate(rows, 1):
        done[r["source"]] += 1
        if t % 500 == 0 or t % 1500 == 1:
            assert all(abs(done[f"s{i:05d}"] - t / 1500) < 1 for i in range(1500))
    assert set(done.values()) == {3}


def test_many_light_sources_beside_heavy_ones(spark):
    """20,000 light sources of two sizes and two heavy ones: own schedules by their shares, each light one
    within one block of its class's common weight."""
    sizes = [4000, 2000] + [1] * 12_000 + [2] * 8_000
    docs = many(spark, sizes)
    placed = mixing.place(docs, power=1.0, block=1).collect()
    assert len(placed) == sum(sizes) and len({(r["__slot"], r["__place"]) for r in placed}) == len(placed)
    pools = collections.Counter(r["__pool"] for r in placed)
    assert set(pools) >= {"s00000", "s00001"} and len(pools) == 4 and sum(p.startswith("<rest:") for p in pools) == 2
    members = {p: {r["source"] for r in placed if r["__pool"] == p} for p in pools}
    assert sorted(map(len, members.values())) == [1, 1, 8000, 12_000]
    for p, own in members.items():
        first = [r for r in placed if r["__pool"] == p and r["__block"] < len(own)]
        assert len({r["source"] for r in first}) == len(own)  # one block each before anyone's second
    shares = {p: sum(r["__slot"] < 1000 for r in placed if r["__pool"] == p) for p in pools}
    total = sum(sizes)
    for p, own in members.items():
        weight = sum(sizes[int(s[1:])] for s in own) / total
        assert abs(shares[p] - 1000 * weight) <= 2


def test_light_sources_against_sql(spark, tmp_path):
    docs = many(spark, [1 + i % 7 for i in range(1300)] + [900]).unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "<rest>")], "doc_id long, source string"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = queries.op4_mix(spark, str(tmp_path))
    expected = con.sql(f"SELECT {', '.join(rows.columns)} FROM ({queries.OP4_SQL})").fetchall()
    assert sorted(map(tuple, rows.select(*rows.columns).collect()), key=str) == sorted(expected, key=str)


def test_columns_named_like_the_result(spark, docs):
    named = docs.select("doc_id", "source").withColumn("__slot", F.lit("x")).withColumn("__pool", F.lit(1)).withColumn("single", F.lit(2))
    mixed = mixing.mixed(named)
    assert mixed.columns == named.columns and mixed.select("`__slot`").distinct().collect()[0][0] == "x"
    assert [r.doc_id for r in mixed.collect()] == [r.doc_id for r in mixing.mixed(docs).select("doc_id").collect()]
    assert mixing.place(named).columns == ["doc_id", "source", "single", "__pool", "__block", "__slot", "__place"]


def test_odd_rows(odd, empty):
    check(mixing.place(odd, block=2), odd, 2)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.exceptAll(odd).count() == odd.exceptAll(mixed).count() == 0
    assert {r["__pool"] for r in mixing.place(odd).where(F.col("source").isNull()).collect()} == {"<none>"}
    assert mixing.place(empty).count() == mixing.mixed(empty).count() == 0
    check(mixing.place(odd, weights={}), odd, 16)
