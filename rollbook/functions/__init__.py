"""Expression helpers: truthiness, contains-search, ratios and exact money sums."""

from rollbook.functions.expr import (  # noqa: F401
    all_of, blank_to_null, contains_any, contains_pattern, count_if_eq, money, money_out, number_text, one_decimal,
    money_sum, not_equal_null_safe, pct, present_num, present_str, where_all, ts_ntz, date_lit,
)
