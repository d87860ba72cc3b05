import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from llm_helpers import SMALL, rows_of
from rollbook.llm import lines, queries

UPPER = dict(zip(map(ord, lines.UPPER), lines.LOWER))


def brute(rows, min_chars=40, min_docs=5):
    """(id, text, n_lines, n_dropped) of rows (id, text), a null id lowest."""
    holders = defaultdict(set)
    key = lambda x: x.strip(lines.STRIPPED).translate(UPPER)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(k := key(x)) >= min_chars and len(holders[k]) >= min_docs and i != max(holders[k], key=lambda d: (d is not None, d)))]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


def got(frame, **options):
    return sorted(((r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in lines.dedup_lines(frame, **options).collect()), key=str)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = sorted(con.sql(queries.OP5_SQL).fetchall())
    assert sorted(map(tuple, queries.op5_line_dedup(spark, SMALL).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == expected


def test_against_brute_force(spark):
    random.seed(2)
    pool = ["  Line number %d is quite long, longer than forty characters " % i for i in range(30)] + ["short", ""]
    rows = [(i, "\n".join(random.choice(pool).swapcase() if random.random() < 0.2 else random.choice(pool) for _ in range(random.randint(1, 12)))) for i in range(60)]
    rows += [(None, pool[0]), (None, pool[0] + "\n" + pool[1]), (3, rows[3][1]), (7, pool[2]), (8, None), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame) == brute(rows)


def test_hot_line_over_many_partitions(spark):
    """One line in every document: its run covers most range partitions."""
    hot = "this very line stands in each and every document there is"
    rows = [(i, f"{hot}\nown line of document number {i}, not short\n{hot.upper()}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame) == brute(rows)


def test_runs_that_end_with_a_partition():
    """The same stream cut anywhere gives the same drops."""
    records = [(h, 0, d, 0, p) for h in range(6) for d in range(h, -1, -1) for p in range(2)]
    import pyarrow as pa

    def stream(part):
        columns = [pa.array(c, pa.int64()) for c in zip(*part)] if part else []
        batches = [pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc", "tk", "pos"])] if part else []
        return [r for b in lines._stream(batches, 3) for r in zip(*(c.to_pylist() for c in b.columns))]

    expected = {(h, d, p) for h in range(2, 6) for d in range(h) for p in range(2)}
    for cut in range(len(records) + 1):
        rows = stream(records[:cut]) + stream(records[cut:])
        totals = defaultdict(lambda: [0, -1])
        # A document's records are never parted: the range key holds it.
        if 0 < cut < len(records) and records[cut][:3] == records[cut - 1][:3]:
            continue
        for kind, h1, h2, doc, tk, pos, n in rows:
            if kind == lines.TOTAL:
                totals[h1] = [totals[h1][0] + n, max(totals[h1][1], doc)]
        dropped = [(h1, doc, pos) for kind, h1, _, doc, _, pos, _ in rows if kind == lines.DROP or kind == lines.OPEN and totals[h1][0] >= 3 and doc != totals[h1][1]]
        assert sorted(dropped) == sorted(expected)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(odd) == brute(rows)
    assert got(odd, min_docs=1, min_chars=1) == brute(rows, 1, 1)
    assert lines.dedup_lines(odd).columns[:len(odd.columns)] == odd.columns
    assert lines.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("gone", [[0], [7], [8], [0, 1, 2, 15]])
def test_bitmaps(spark, gone):
    text = "\n".join(map(str, range(20)))
    bitmaps = spark.createDataFrame([(1, gone)], "doc long, gone array<int>").select("doc", lines._packed("gone").alias("keep"))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    from pyspark.sql import functions as F
    out = lines.apply_bitmaps(frame, bitmaps.crossJoin(frame.select(F.xxhash64("text").alias("tk")))).first()
    assert out.text.split("\n") == [str(i) for i in range(20) if i not in gone]


def test_columns_named_like_the_result(spark, docs):
    named = docs.withColumn("__n_lines", F.lit("x")).withColumn("__n_dropped", F.lit(1)).withColumn("c0", F.lit(2))
    cut = lines.cut(named, min_docs=2)
    assert cut.columns == named.columns and cut.select("__n_lines").distinct().collect()[0][0] == "x"
    plain = lines.dedup_lines(docs, min_docs=2)
    assert sorted(cut.select("doc_id", "text").collect()) == sorted(plain.select("doc_id", "text").collect())
    assert lines.dedup_lines(named).columns == [*docs.columns, "c0", "__n_lines", "__n_dropped"]
