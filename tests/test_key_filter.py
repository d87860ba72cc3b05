"""Key sets tested by bitmap before the exact join."""

import random

import pytest
from conftest import frame

from rollbook.plans import batches


def test_no_key_is_lost_and_few_others_stay(spark):
    r = random.Random(1)
    rows = [(r.choice([None, r.randrange(10**12)]), f"k{i}") for i in range(20_000)]
    wanted = [x for x in rows if x[0] is not None][:500]
    table, keys = frame(spark, "a long, b string", rows), frame(spark, "a long, b string", wanted)
    kept = {tuple(x) for x in batches.key_filtered(table, ["a", "b"], keys, 0).collect()}
    assert set(wanted) <= kept <= set(rows) and len(kept) < 500 + 20_000 / 8
    assert batches.key_filtered(table, ["a", "b"], keys) is table  # too few keys to need it


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_existing_keys_with_and_without(spark, n):
    r = random.Random(n)
    table = frame(spark, "id long, x string", [(r.choice([None, r.randrange(4000)]), "x") for _ in range(5000)])
    asked = frame(spark, "seq long, key long", [(i, r.choice([None, r.randrange(8000)])) for i in range(n)])
    plain, filtered = (sorted(x.key for x in batches.existing_keys(table, asked, ["id"], ["key"], filter_from=f).collect()) for f in (None, 0))
    assert plain == filtered


def test_filter_stands_below_the_shuffle_of_the_table(spark, tmp_path):
    frame(spark, "id long, x string", [(i, "x" * 20) for i in range(50_000)]).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    asked = frame(spark, "seq long, key long", [(i, i * 50) for i in range(1000)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # key sets too large to broadcast
    try:
        shuffled = {}
        for f in (None, 0):
            run = batches.existing_keys(table, asked, ["id"], ["key"], filter_from=f)
            found = []

            def walk(node):
                name = node.nodeName()
                if name == "AdaptiveSparkPlan":
                    return walk(node.executedPlan())
                if "QueryStage" in name:
                    return walk(node.plan())
                if name == "Exchange":
                    found.append(node.metrics().apply("shuffleRecordsWritten").value())
                for i in range(node.children().size()):
                    walk(node.children().apply(i))

            assert len(run.collect()) == 1000
            walk(run._jdf.queryExecution().executedPlan())
            shuffled[f] = max(found)
            plan = run._jdf.queryExecution().executedPlan().toString()
            assert ("bitmap_construct_agg" in plan) == (f == 0)
        assert shuffled[None] >= 50_000 and shuffled[0] <= 50_000 / 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
