"""Column-expression helpers (all built-in Spark functions, no UDFs)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.schema import MONEY


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """Empty string counts as missing, like a falsy value in the application."""
    return F.nullif(col(c), F.lit(""))


def present_str(c) -> Column:
    """True when a string value is truthy: not NULL and not ''."""
    c = col(c)
    return c.isNotNull() & (c != F.lit(""))


def present_num(c) -> Column:
    """True when a number is truthy: not NULL and not 0."""
    c = col(c)
    return c.isNotNull() & (c != F.lit(0))


def all_of(conds: Iterable[Column]) -> Column | None:
    """AND of the given optional conditions; None when there are none."""
    conds = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, conds) if conds else None


def where_all(df, conds: Iterable[Column]):
    cond = all_of(conds)
    return df if cond is None else df.where(cond)


def contains_pattern(term: str) -> str:
    """``%term%`` with the term's own ``%``/``_`` left as wildcards.

    Spark's LIKE escape character is the backslash, so a literal backslash
    in the term is doubled to stay literal.
    """
    return "%" + term.replace("\\", "\\\\") + "%"


def contains_any(cols: Iterable, term: str) -> Column:
    """Case-insensitive contains-search over several columns, OR-ed.

    A NULL column does not match; the OR stays NULL-safe by coalescing.
    """
    pat = contains_pattern(term)
    return reduce(lambda a, b: a | b, [F.coalesce(col(c).ilike(pat), F.lit(False)) for c in cols])


def pct(part, total) -> Column:
    """``(part / total) * 100`` in double, 0.0 when the total is 0."""
    part, total = col(part), col(total)
    return (F.when(total > 0, (part.cast("double") / total.cast("double")) * F.lit(100.0))
            .otherwise(F.lit(0.0)))


def count_if_eq(c, value: str) -> Column:
    """Strict, case-sensitive status count; NULL or unknown counts nowhere."""
    return F.count(F.when(col(c) == F.lit(value), F.lit(1)))


def money(c) -> Column:
    return col(c).cast(MONEY)


def money_sum(c, cond: Column | None = None) -> Column:
    """Exact sum of money (decimal), optionally only where ``cond`` holds."""
    v = money(c)
    if cond is not None:
        v = F.when(cond, v)
    return F.sum(v)


def money_out(c) -> Column:
    """A summed money column as the double the application returns; NULL -> 0."""
    return F.coalesce(col(c), F.lit(0).cast(MONEY)).cast("double")


def not_equal_null_safe(c, value) -> Column:
    """``NOT (c <=> value)``: NULL counts as different."""
    return ~col(c).eqNullSafe(F.lit(value))


def ts_ntz(value) -> Column:
    """A timestamp_ntz literal built from text, so no time zone is applied."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value) -> Column:
    """A date literal from a date (or the date part of a datetime)."""
    d = value.date() if hasattr(value, "date") else value
    return F.lit(d.isoformat()).cast("date")


def number_text(c) -> Column:
    """A double as the application's pages print it: the shortest digits that
    read back as the number, plain from 1e-6 up to below 1e21 and with an
    exponent beyond (``1``, ``0.00001``, ``1.5e-7``, ``1e+21``); never ``.0``."""
    x = F.col(c) if isinstance(c, str) else c
    size, java = F.abs(x), F.abs(x).cast("string")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    # Java's digits are plain from 0.001 up to below 10,000,000, and have a point; from 1e-6 on they are d.dddE-n.
    plain = F.concat(sign, F.rtrim(F.rtrim(java, F.lit("0")), F.lit(".")))
    zeros = F.when(size < 1e-5, F.lit("0.00000")).when(size < 1e-4, F.lit("0.0000")).otherwise(F.lit("0.000"))
    small = F.concat(sign, zeros, F.rtrim(F.replace(F.substring_index(java, "E", 1), F.lit("."), F.lit("")), F.lit("0")))
    return (F.when((size >= 1e-3) & (size < 1e7), plain).when((size >= 1e-6) & (size < 1e-3), small)
            .otherwise(F.concat(sign, _any_number_text(x))))


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _any_number_text(x: Column) -> Column:
    """``number_text`` of any size, without the sign."""
    def split(java):  # d.dddE-n, or plain digits
        mantissa = F.substring_index(java, "E", 1)
        return F.struct(F.substring_index(mantissa, ".", 1).alias("before"),
                        F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("").alias("after"),
                        F.when(java.contains("E"), F.substring_index(java, "E", -1)).otherwise("0").try_cast("int").alias("exponent"))

    def place(p):  # the number is 0.<digits> times ten to the power of ``point``
        every = F.concat(p["before"], p["after"])
        some = F.ltrim(every, F.lit("0"))
        return F.struct(F.rtrim(some, F.lit("0")).alias("digits"),
                        (F.length(p["before"]) + p["exponent"] - (F.length(every) - F.length(some))).alias("point"))

    def text(p):
        digits, point = p["digits"], p["point"]
        n, zeros = F.length(digits), lambda k: F.repeat(F.lit("0"), k)
        power = F.concat(F.when(point > 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(point - 1).cast("string"))
        return (F.when((n <= point) & (point <= 21), F.concat(digits, zeros(point - n)))
                .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
                .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
                .when(n == 1, F.concat(digits, power))
                .otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n), power)))

    found = _named(F.abs(x).cast("string"), lambda java: _named(split(java), lambda p: _named(place(p), text)))
    return (F.when(F.isnan(x), F.lit("NaN")).when(F.abs(x) == float("inf"), F.lit("Infinity")).when(x == 0, F.lit("0"))
            .otherwise(found))


def one_decimal(c) -> Column:
    """A double from 0 up to 1e15 with one decimal, rounded by its exact value,
    halves up (0.35, which is a little less, gives ``0.3``; 12.25 gives ``12.3``)."""
    x = F.col(c) if isinstance(c, str) else c
    # 20 x as a rounded sum and its exact error: 16 x and 4 x are exact.
    big, small = x * 16, x * 4
    total = big + small
    error = small - (total - big)
    down = F.floor(total) - F.when((F.floor(total) == total) & (error < 0), 1).otherwise(0)
    tenths = F.floor((down + 1) / 2).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
