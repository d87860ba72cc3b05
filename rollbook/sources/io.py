"""Table scans, snapshot writes, change-request reads and result writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.schema import MSG_BAD_BODY, MSG_BAD_FIELDS, MSG_BAD_JSON, TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one canonical table with its explicit schema (no inference).

    Filters and projections applied later reach the Parquet scan as
    ``PushedFilters`` / a pruned ``ReadSchema``.
    """
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select a table's columns in canonical order and types (no-op when
    the frame already has exactly that schema)."""
    want = [(f.name, f.dataType) for f in TABLES[name].fields]
    if [(f.name, f.dataType) for f in df.schema.fields] == want:
        return df
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])


def write_snapshot(df: DataFrame, path: str, partitions: int | None = None) -> str:
    """Write a complete new snapshot to a path that must not exist yet.

    The caller switches readers to the new path only after this returns,
    so a failed job leaves the current snapshot untouched, and a snapshot
    is never overwritten while it is being read.
    """
    out = df.repartition(partitions) if partitions else df
    out.write.mode("errorifexists").parquet(path)
    return path


def read_changes(spark: SparkSession, path: str, schema: T.StructType,
                 patch_column: str | None = None) -> DataFrame:
    """Read change requests (JSON lines) with an explicit schema.

    ``patch_column`` names a JSON-object field holding a partial update;
    it is kept as ``map<string,string>`` so that a key given as null stays
    distinguishable from a key left out.
    """
    if patch_column is None:
        return spark.read.schema(schema).json(path)
    fields = [f if f.name != patch_column else T.StructField(f.name, T.StringType(), True)
              for f in schema.fields]
    raw = spark.read.schema(T.StructType(fields)).json(path)
    return raw.withColumn(patch_column,
                          F.from_json(F.col(patch_column), T.MapType(T.StringType(), T.StringType())))


def read_requests(spark: SparkSession, path: str, schema: T.StructType,
                  patch_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Read change requests (JSON lines): ``(requests, rejects)``.

    Every line is either a request or one row of ``rejects(file, line,
    reason)``, ``line`` being its text: one that is no JSON, whose body is not an
    object, or one of whose fields has a value of another type than ``schema``
    says (a field that is missing or null is null).  Requests have the columns
    of ``schema``; ``patch_column`` names an object field kept as
    ``map<string,string>``, as in ``read_changes``, and its values may be of
    any plain type.  Integral fields take whole numbers and texts of such
    (``"12"``), text fields anything plain, arrays and objects only their like.
    Each line is parsed once as a whole and once by the schema, in one scan.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    # The parser stops after the first value; so the line is read as a field of an object that must
    # go on with a field named after the line's hash.
    mark = F.concat(F.lit("t"), F.hex(F.xxhash64("line")))
    framed = F.try_parse_json(F.concat(F.lit('{"v":'), F.col("line"), F.lit(',"'), mark, F.lit('":1}')))
    whole = F.try_variant_get("framed", F.concat(F.lit("$."), mark), "int") == 1
    body = F.try_variant_get("framed", "$.v", "variant")
    # Fields of a plain type are taken by a cast of their own, so that one bad field spoils no other.
    nested = [f for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType)) and f.name != patch_column]
    parsed = lines.withColumn("framed", framed).withColumn("body", F.when(whole, body)).withColumn("kind", F.schema_of_variant("body"))
    if nested:
        shape = T.StructType([*nested, T.StructField("_unreadable", T.StringType())])
        parsed = parsed.withColumn("nested", F.from_json("line", shape, {"columnNameOfCorruptRecord": "_unreadable"}))
    values, wrong = [], []
    for f in schema.fields:
        path_of = "$." + f.name if f.name.isidentifier() else f"$['{f.name}']"
        raw = F.try_variant_get("body", path_of, "variant")
        given = raw.isNotNull() & (F.schema_of_variant(raw) != "VOID")
        of = F.schema_of_variant(raw)
        if f.name == patch_column:
            value = F.from_json(F.when(of.startswith("OBJECT"), F.to_json(raw)), T.MapType(T.StringType(), T.StringType()))
        elif f in nested:
            # The parser leaves out elements that do not fit; a record with any is marked unreadable.
            like = of.startswith("ARRAY" if isinstance(f.dataType, T.ArrayType) else "OBJECT")
            value = F.when(like & F.col("nested._unreadable").isNull(), F.col(f"nested.{f.name}"))
        elif isinstance(f.dataType, T.StringType):
            value = F.when(~of.startswith("OBJECT") & ~of.startswith("ARRAY"), F.try_variant_get("body", path_of, "string"))
        else:
            text = F.when(of.isin("BIGINT", "STRING") | of.startswith("DECIMAL") | of.isin("DOUBLE", "FLOAT", "BOOLEAN"), F.try_variant_get("body", path_of, "string"))
            if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                text = F.when(text.rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$"), F.regexp_replace(text, r"\.0*\s*$", ""))
            if isinstance(f.dataType, T.BooleanType):
                text = F.when(of == "BOOLEAN", text)
            value = text.try_cast(f.dataType)
        values.append(value.alias(f.name))
        wrong.append((f.name, given & value.isNull()))
    parsed = parsed.withColumn("wrong", F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in wrong])))
    reason = (F.when(F.col("kind").isNull(), F.lit(MSG_BAD_JSON))
              .when(~F.col("kind").startswith("OBJECT"), F.lit(MSG_BAD_BODY))
              .when(F.size("wrong") > 0, F.concat(F.lit(MSG_BAD_FIELDS), F.array_join("wrong", ", "))))
    judged = parsed.withColumn("reason", reason)
    return (judged.where(F.col("reason").isNull()).select(*values),
            judged.where(F.col("reason").isNotNull()).select("file", "line", "reason"))


def explode_records(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per element of an array-of-struct request field."""
    return (df.select(*keep, F.posexplode_outer(column).alias("record_pos", "record"))
              .select(*keep, "record_pos", "record.*"))


def write_result(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Emit a result as JSON lines (or Parquet) to a new path."""
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """Write a snapshot as a bucketed, sorted table at ``path`` and return it.

    Two snapshots bucketed on the same key with the same bucket count join
    (and aggregate on that key) without a shuffle: for tables joined again
    and again on one key, e.g. enrollments and students on ``student_id``.
    """
    (df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("errorifexists")
       .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
