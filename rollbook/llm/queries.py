"""Registered queries of the training-data operators.

Each takes ``(spark, sf_dir)``, applies its operator with production
parameters to the whole table, and derives the result columns from the
operator's own outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollbook.llm import ann, bpe, licenses, line_crf, lines, minhash, mixing, pii, quality, runs, token_counts, toxicity, whitening
from rollbook.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.digest(F.concat(*pii.PATTERNS)), 256).alias("base_sha256"), pii.digest(F.concat(*pii.KINDS)).alias("spans"),
        F.size("term").cast("long").alias("n_term"), F.size("removed").cast("long").alias("n_removed"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.place(docs).withColumnsRenamed({"__pool": "pool", "__block": "block", "__slot": "slot", "__place": "place"})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs))

    def joined(items):
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    confirmed = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_predicted"), F.size(confirmed).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x["family"]))), ",").alias("families"),
        joined(confirmed).alias("spans"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.fit(docs, table(spark, sf_dir, "labels"))).drop("content_lines")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = whitening.fit(whitening.whole(table(spark, sf_dir, "embeddings")), components=4)
    return whitening.apply(rows, model).withColumn("deviation", F.col("deviation").cast("long"))


def repeated_tail(h: int, n: int) -> tuple[int, int] | None:
    """Where the documents that op12 plants a repetition in have it, and its period."""
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(table(spark, sf_dir, "documents"), repeated_tail, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    longest = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"]))
                           .when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int"))
    lines_ = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.withColumn("top", F.get(longest, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"), F.sha2(lines_, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_quality, op3_bpe_round_trip, op4_mix, op5_line_dedup, op6_nearest, op7_token_counts, op8_licenses, op9_near_dedup, op10_line_labels,
                                    op11_whitening, op12_runs, op13_toxicity)}


OP4_SQL = """
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '<none>') AS src, count(*) AS n FROM documents GROUP BY 1
), weighed AS (
  SELECT src, sqrt(n) * 1000 / (SELECT sum(sqrt(n)) FROM counts) AS slots FROM counts
), own AS (
  SELECT src, slots, CASE WHEN slots >= 1 THEN CASE WHEN regexp_matches(src, '^<+rest') THEN '<' || src ELSE src END
                          ELSE '<rest:' || greatest(-128, CAST(floor(log2(slots) * 4 + 1e-9) AS INTEGER)) || '>' END AS pool FROM weighed
), turns AS (
  SELECT src, slots, pool, CASE WHEN slots >= 1 THEN 0 ELSE row_number() OVER (PARTITION BY pool ORDER BY md5(src), src) - 1 END AS r,
         CASE WHEN slots >= 1 THEN 1 ELSE count(*) OVER (PARTITION BY pool) END AS n
  FROM own
), shares AS (
  SELECT pool, greatest(1, CAST(round(sum(slots)) AS BIGINT)) AS share FROM own GROUP BY pool
), total AS (
  SELECT CAST(sum(share) AS BIGINT) AS period FROM shares
), run AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS pick, CAST(NULL AS BIGINT) AS k,
         (SELECT map(list(pool ORDER BY pool), list(CAST(0 AS BIGINT) ORDER BY pool)) FROM shares) AS done
  UNION ALL
  SELECT t + 1, c.pool, c.k,
         map(map_keys(done), list_transform(map_entries(done), lambda e: CASE WHEN e.key = c.pool THEN e.value + 1 ELSE e.value END))
  FROM run, LATERAL (
    SELECT s.pool, d.k FROM shares s, total, LATERAL (SELECT done[s.pool] AS k) d
    WHERE d.k < s.share AND (d.k * period) // s.share <= t
    ORDER BY ((d.k + 1) * period + s.share - 1) // s.share, s.pool LIMIT 1) c
  WHERE t < (SELECT period FROM total)
), numbered AS (
  SELECT doc_id, source, pool, share, r, n, row_number() OVER (PARTITION BY src ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS number
  FROM documents JOIN turns ON turns.src = coalesce(source, '<none>') JOIN shares USING (pool)
), blocks AS (
  SELECT *, (number // 16) * n + r AS block FROM numbered
)
SELECT doc_id, source, b.pool, block, (block // share) * period + run.t - 1 AS slot, number % 16 AS place
FROM blocks b, total JOIN run ON run.pick = b.pool AND run.k = block % share
"""

OP5_SQL = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), dup AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE top IS NOT NULL AND top <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN dup USING (key) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mix": OP4_SQL, "op5_line_dedup": OP5_SQL}
