"""Building blocks for change batches (requests applied in ``seq`` order).

* ``first_claim``: per key, the smallest ``seq`` among requests that would
  succeed -- later requests for the same key lose ("first valid wins").
  It is a grouped aggregate joined back on the key, so a key that holds a
  third of the batch is combined map-side instead of landing whole in one
  task (which a key-partitioned window would do).
* ``reason_of``: the first failing check gives the reason, in check order.
* ``split``: accepted requests and ``rejects(seq, reason)``.

Intermediates that are read more than once (a claim table and its
candidates, an annotated batch feeding several outputs) are written once as
a table in the shared checkpoint folder, so the checks never run twice and
a retried task sees the same decisions.  Key sets for lookups are taken
from the original batch, so chained checks do not re-derive each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.plans.materialize import materialize


def reason_of(checks: list[tuple[Column, str]]) -> Column:
    """CASE over (failed-condition, message) pairs in order; NULL when all pass.

    A NULL condition counts as passed.
    """
    expr = None
    for failed, msg in checks:
        cond = F.coalesce(failed, F.lit(False))
        expr = F.when(cond, F.lit(msg)) if expr is None else expr.when(cond, F.lit(msg))
    return expr


def first_claim(requests: DataFrame, keys: list[str], candidate: Column,
                out: str = "first_seq") -> DataFrame:
    """Add ``out`` = min(seq) over requests with the same keys where ``candidate`` holds.

    The requests (with their candidate flag) are materialized first, since
    both the aggregate and the join back read them.
    """
    flagged = materialize(requests.withColumn("_candidate", candidate), "claims")
    firsts = (flagged.where(F.col("_candidate"))
              .groupBy(*keys).agg(F.min("seq").alias(out)))
    return flagged.join(firsts, keys, "left").drop("_candidate")


def split(annotated: DataFrame, reason_col: str = "reason", pin: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, rejects).  With ``pin`` the annotated batch is
    materialized once, so both outputs (and anything built on them) read
    the same settled decisions."""
    if pin:
        annotated = materialize(annotated, "checked")
    ok = annotated.where(F.col(reason_col).isNull()).drop(reason_col)
    rejects = annotated.where(F.col(reason_col).isNotNull()).select("seq", F.col(reason_col).alias("reason"))
    return ok, rejects


def last_value(value: Column, when: Column, seq: str = "seq") -> Column:
    """Aggregate: the value of the highest-``seq`` row where ``when`` holds.

    Returns a struct ``(seq, v)`` (NULL when no row qualifies), so a value
    that was deliberately set to NULL stays distinguishable from no value.
    """
    return F.max(F.when(when, F.struct(F.col(seq).alias("seq"), value.alias("v"))))


def wanted(requests: DataFrame, cols: list[str], as_cols: list[str] | None = None) -> DataFrame:
    """Distinct non-NULL key values a batch asks for (renamed to ``as_cols``)."""
    as_cols = as_cols or cols
    sel = requests.select(*[F.col(c).alias(a) for c, a in zip(cols, as_cols)])
    for a in as_cols:
        sel = sel.where(F.col(a).isNotNull())
    return sel.distinct()


#: A batch's keys are tested by bitmap before a join from this many on (below, Spark broadcasts
#: them as they are), and up to as many as give bitmaps of 32 MB.
FILTER_FROM, FILTER_TO = 200_000, 16_000_000
BITS_A_KEY, BITMAP = 16, 32_768


def key_filtered(table: DataFrame, cols: list[str], keys: DataFrame, at_least: int | None = None) -> DataFrame:
    """The rows of ``table`` whose key may be among ``keys`` (same columns, distinct).

    Each key sets one of 16 bits a key by its hash; the bits, in bitmaps of 4 KB,
    are broadcast (32 MB at most), and rows whose bit is not set go before any
    shuffle.  One row in sixteen of the others stays, so an exact join has to
    follow.  Key sets too small to need it, or too large for it, leave the table
    as it is.
    """
    n = keys.limit(FILTER_TO + 1).count()
    if not (FILTER_FROM if at_least is None else at_least) <= n <= FILTER_TO:
        return table
    return _with_bit(table, cols, keys, n).where("_may").select(*table.columns)


def _with_bit(table: DataFrame, cols: list[str], keys: DataFrame, n: int) -> DataFrame:
    """``table`` with ``_may``: the row's key may be among the ``n`` keys."""
    bits = 1 << max(15, (n * BITS_A_KEY - 1).bit_length())
    place = F.pmod(F.xxhash64(*cols), F.lit(bits).cast("long"))
    maps = keys.select(place.alias("_place")).groupBy(F.floor(F.col("_place") / BITMAP).alias("_slot")) \
        .agg(F.bitmap_construct_agg(F.col("_place") % BITMAP).alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast((_place % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    return (table.withColumn("_place", place).withColumn("_slot", F.floor(F.col("_place") / BITMAP)).join(F.broadcast(maps), "_slot", "left")
            .withColumn("_may", F.expr(f"coalesce(({byte} & shiftleft(1, cast(_place % 8 as int))) <> 0, false)")))


def without_keys(table: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of ``table`` whose ``column`` is not among ``keys`` (written,
    distinct), in two frames: those that no shuffle is needed to tell, and the
    others.  With few keys Spark broadcasts them; with more, the rows whose bit
    is not set stay without a join; with too many for that, all are joined."""
    n = keys.limit(FILTER_TO + 1).count()
    if n < FILTER_FROM:
        return table.join(keys, column, "left_anti"), None
    if n > FILTER_TO:
        return None, table.join(keys, column, "left_anti")
    flagged = _with_bit(table, [column], keys, n)
    return flagged.where("NOT _may").select(*table.columns), flagged.where("_may").select(*table.columns).join(keys, column, "left_anti")


def existing_keys(table: DataFrame, requests: DataFrame, table_cols: list[str],
                  request_cols: list[str] | None = None, flag: str = "exists", filter_from: int | None = None) -> DataFrame:
    """``(request_cols..., flag=True)`` for the requested keys present in ``table``.

    The table is first narrowed to the requested keys by a semi join (a
    broadcast filter when the batch's key set is small), so a batch never
    makes the whole table shuffle or aggregate; only the matches are
    de-duplicated.  ``filter_from`` says from how many keys on the table's rows
    are tested by bitmap first (``key_filtered``); None: never.
    """
    request_cols = request_cols or table_cols
    keys = wanted(requests, request_cols, table_cols)
    rows = table.select(*table_cols)
    kind = "left_semi"
    if filter_from is not None:
        keys = materialize(keys, "keys")
        rows = key_filtered(rows, table_cols, keys, filter_from)
        kind = "inner"  # a semi join would be moved below the filter's join; the keys are distinct
    hits = rows.join(keys, table_cols, kind).distinct()
    return hits.select(*[F.col(t).alias(r) for t, r in zip(table_cols, request_cols)]) \
               .withColumn(flag, F.lit(True))


def flag_existing(requests: DataFrame, table: DataFrame, table_cols: list[str],
                  request_cols: list[str] | None = None, flag: str = "exists",
                  keys_from: DataFrame | None = None, filter_from: int | None = None) -> DataFrame:
    """Add boolean-or-NULL ``flag``: the request's key exists in ``table``.

    ``keys_from`` is the frame the key set is read from (the original batch
    with its computed key columns); default: ``requests`` itself.
    """
    request_cols = request_cols or table_cols
    src = requests if keys_from is None else keys_from
    return requests.join(existing_keys(table, src, table_cols, request_cols, flag, filter_from),
                         request_cols, "left")


def gone_before(requests: DataFrame, table: DataFrame, key: str, message: str) -> DataFrame:
    """Rejects of deletions: requests for a key that is not in ``table``, or
    that an earlier request has deleted (a null ``seq`` counts as earlier than
    none, and rejects nobody).  The first request of each key that exists is an
    aggregate of the batch, joined back; nothing is written."""
    firsts = (requests.groupBy(key).agg(F.min("seq").alias("_first"))
              .join(existing_keys(table, requests, [key], flag="_exists"), key, "left"))
    late = F.col("_exists").isNull() | (F.col("seq") > F.col("_first"))
    return requests.select("seq", key).join(firsts, key, "left").where(late).select("seq", F.lit(message).alias("reason"))
