"""Dense id assignment: ids follow the order column across many partitions."""

from pyspark.sql import functions as F

from rollbook.plans.ids import current_max, number_rows


def test_dense_ids_in_order(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7 % 5000).alias("seq"))
    out = number_rows(df, ["seq"], "new_id", 100)
    rows = sorted((r["seq"], r["new_id"]) for r in out.collect())
    assert [i for _, i in rows] == list(range(101, 5101))


def test_empty_and_max(spark):
    empty = spark.range(0).select(F.col("id").alias("seq"))
    assert number_rows(empty, ["seq"], "new_id", 0).count() == 0
    assert current_max(empty, "seq") == 0
    assert current_max(spark.range(10), "id") == 9


def test_numbering_within_groups(spark):
    from rollbook.plans.ids import current_maxes, number_rows_by_group
    df = spark.range(0, 3000, 1, 7).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 5 == 0, "b").otherwise("c").alias("g"))
    out = number_rows_by_group(df, "g", ["seq"], "new_id", {"a": 10, "b": 0, "c": 500})
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append((r["seq"], r["new_id"]))
    for g, start in (("a", 10), ("b", 0), ("c", 500)):
        ids = [i for _, i in sorted(got[g])]
        assert ids == list(range(start + 1, start + 1 + len(ids)))
    m = current_maxes({"x": (spark.range(5), "id"), "y": (spark.range(0), "id")})
    assert m == {"x": 4, "y": 0}


def test_sizing_scales_with_input():
    from rollbook.session import sizing
    small = sizing(37_000_000, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"          # two per core at least
    big = sizing(100 << 40, 8000)                                 # 100 TB, 1000 executors x 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (128 << 20)
    assert big["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(128 << 20)


def test_deferred_outputs_run_only_what_is_read(spark):
    import datetime as dt
    from conftest import table
    from rollbook.operators import changes
    from rollbook.plans import ids
    calls = []
    original = ids.number_rows

    def counting(*a, **k):
        calls.append(1)
        return original(*a, **k)

    import rollbook.operators.changes.users as users_mod
    users_mod.number_rows = counting
    try:
        users = table(spark, "users", [])
        empty = {n: table(spark, n, []) for n in ("students", "teachers", "management")}
        b = spark.createDataFrame([(1, "a", "pw", "teacher", "N", "e", None, None, None, None)],
                                  "seq long, domain_id string, password string, role string, name string, "
                                  "email string, phone_number string, department string, address string, "
                                  "roll_number string")
        out, rej = changes.create_users(users, empty["students"], empty["teachers"], empty["management"], b,
                                        dt.datetime(2025, 1, 15))
        assert rej.count() == 0 and calls == []        # rejects need no id assignment
        out["users"].count()
        out["created"].count()
        assert calls == [1]                            # shared step runs once
    finally:
        users_mod.number_rows = original


def test_prefix_sums_over_many_partitions(spark):
    """20,000 partitions: two levels of blocks, no literal per partition."""
    import time
    from rollbook.plans.ids import prefix_sums
    old = spark.conf.get("spark.sql.shuffle.partitions")
    counts = spark.range(20_000).select(F.col("id").cast("int").alias("_part"), (F.col("id") % 7).alias("_n"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20000")
        start = time.time()
        planned = prefix_sums(counts, [])
        assert time.time() - start < 10
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        got = {r["_part"]: r["_before"] for r in planned.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    running = 0
    for p in range(20_000):
        assert got[p] == running
        running += p % 7


def test_shared_folder_is_required_on_a_cluster():
    import pytest
    from rollbook import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_clear_scratch(spark):
    from rollbook.plans import materialize as m
    import os
    df = m.materialize(spark.range(3), "gone")
    path = m._WRITTEN[-1].replace("file:", "")
    kept, m._WRITTEN[:] = m._WRITTEN[:-1], m._WRITTEN[-1:]
    assert df.count() == 3 and os.path.isdir(path)
    assert m.clear_scratch(spark) == 1 and not os.path.exists(path)
    m._WRITTEN[:] = kept
