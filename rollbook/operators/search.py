"""Contains-search through a table of trigrams.

``%term%`` over several columns reads every row.  A postings table holds, for
each searched value, its different trigrams (lower-cased, three characters in a
row) with the row's id and the column's name, sorted by trigram, so that
Parquet's row-group ranges leave out all but the asked ones.  A row can match
only if one of its columns holds *all* trigrams of the term's literal parts
(what stands between its ``%`` and ``_``); these rows are the candidates, and
the exact ``ilike`` decides among them.  Only ASCII stretches of the term give
trigrams, since other letters may change their number when lower-cased.  A term
without a stretch of three characters has none: then the plain scan answers.

A posting is one row per different trigram of a value, so a trigram that a
third of all rows share is that many narrow rows spread over many files; its
candidates are counted by (column, id), combined map-side, never collected
whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.keys import only_keys

GRAM = 3
POSTINGS = "gram string, field string, id long"
LISTED = 1000  # candidates up to this number reach the scan as a list of ids


def directory_values(users: DataFrame, students: DataFrame, teachers: DataFrame, management: DataFrame) -> DataFrame:
    """``(id, field, value)`` of the seven columns that the user search looks at."""
    out = users.select(F.col("user_id").alias("id"), F.lit("domain_id").alias("field"), F.col("domain_id").alias("value"))
    for tag, t in (("student", students), ("teacher", teachers), ("management", management)):
        for c in ("name", "email"):
            out = out.unionByName(t.select(F.col("user_id").alias("id"), F.lit(f"{tag}.{c}").alias("field"), F.col(c).alias("value")))
    return out


def course_values(courses: DataFrame) -> DataFrame:
    """``(id, field, value)`` of the columns that the course search looks at."""
    return courses.select(F.col("course_id").alias("id"), F.explode(F.create_map(
        F.lit("course_code"), F.col("course_code"), F.lit("course_name"), F.col("course_name"))).alias("field", "value"))


def postings_of(values: DataFrame) -> DataFrame:
    """``(gram, field, id)``, one row for each different trigram of each value.
    NULL ids, and values that are NULL or shorter than a trigram, have none."""
    low = F.lower("value")
    grams = F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM)))))
    return (values.where(F.col("id").isNotNull()).select("id", "field", F.explode(grams).alias("gram"))
            .select("gram", "field", F.col("id").cast("long").alias("id")))


def write_postings(values: DataFrame, path: str) -> DataFrame:
    """Write the postings of ``values`` to a new path, sorted by trigram, and return them."""
    (postings_of(values).repartitionByRange("gram", "field", "id").sortWithinPartitions("gram", "field", "id")
     .write.mode("errorifexists").option("parquet.block.size", 8 << 20).parquet(path))
    return read_postings(values.sparkSession, path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(path)


def literal_grams(term: str) -> list[str]:
    """The trigrams that every match of ``%term%`` holds."""
    found = set()
    for part in re.findall(r"[\x00-\x7f]{3,}", re.sub("[%_]", " ", term)):
        part = part.lower()
        found |= {part[i:i + GRAM] for i in range(len(part) - GRAM + 1)}
    return sorted(found)


def candidates(postings: DataFrame, term: str) -> DataFrame | None:
    """``(id)`` of the rows that may match; None if the term has no trigram.

    A field that is given twice for one id (rows that repeat an id) counts its
    different trigrams together, which only adds candidates."""
    grams = literal_grams(term)
    if not grams:
        return None
    hits = postings.where(F.col("gram").isin(grams)).groupBy("field", "id")
    if len(grams) == 1:
        return hits.agg(F.lit(1)).select("id").distinct()
    seen = F.bit_or(F.element_at(F.create_map(*[x for i, g in enumerate(grams[:62]) for x in (F.lit(g), F.lit(1 << i).cast("long"))]), F.col("gram")))
    # Of a very long term 62 trigrams are enough to name candidates.
    return hits.agg(seen.alias("seen")).where(F.col("seen") == (1 << min(len(grams), 62)) - 1).select("id").distinct()


def narrowed(tables: list[tuple[DataFrame, str]], ids: DataFrame) -> list[DataFrame]:
    """Each (table, key) restricted to the ids: by a list that reaches the
    scan's filters if there are at most ``LISTED``, else by a semi join."""
    few = [r["id"] for r in ids.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return [t.where(F.col(k).isin(few)) if few else t.where(F.lit(False)) for t, k in tables]
    return [only_keys(t, ids.withColumnRenamed("id", k), k) for t, k in tables]
