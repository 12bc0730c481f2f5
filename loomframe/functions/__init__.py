"""Column expressions with the missing-value rules the operators rely on."""

from loomframe.functions.missing import (
    all_true,
    any_missing,
    case_when,
    if_else,
    max_of,
    mean_of,
    min_of,
    missing_share,
    n_complete,
    n_distinct,
    nan_to_null,
    row_min,
    safe_div,
    standard_score,
    sum_of,
)
from loomframe.functions.scalars import (
    as_integer,
    change_ratio,
    month_sequence,
    paste,
    set_difference_size,
    str_detect,
    str_extract,
    str_squish,
)

__all__ = [
    "all_true",
    "any_missing",
    "as_integer",
    "case_when",
    "change_ratio",
    "if_else",
    "max_of",
    "mean_of",
    "min_of",
    "missing_share",
    "month_sequence",
    "n_complete",
    "n_distinct",
    "nan_to_null",
    "paste",
    "row_min",
    "safe_div",
    "set_difference_size",
    "standard_score",
    "str_detect",
    "str_extract",
    "str_squish",
    "sum_of",
]
