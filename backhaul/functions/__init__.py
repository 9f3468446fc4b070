from .dates import (
    current_ym,
    derive_return_month,
    derive_return_year,
    iso_date,
    parse_date,
    parse_date_serial,
    parse_date_text,
    week_number,
    week_of,
    year_month,
    year_text,
)
from .hashing import row_hash
from .numbers import (
    count_label,
    high_rate_flag,
    js_number_text,
    money_label,
    order_quantity,
    page_count,
    parse_num,
    percent_text,
    return_quantity,
    safe_ratio_pct,
    whole_units,
)
from .text import (
    first_nonblank,
    is_blank,
    label_disposition,
    label_month,
    label_underscores,
    non_blank,
    not_placeholder,
    trimmed,
)

__all__ = [
    "count_label",
    "current_ym",
    "derive_return_month",
    "derive_return_year",
    "first_nonblank",
    "high_rate_flag",
    "is_blank",
    "iso_date",
    "js_number_text",
    "label_disposition",
    "label_month",
    "label_underscores",
    "money_label",
    "non_blank",
    "not_placeholder",
    "order_quantity",
    "page_count",
    "parse_date",
    "parse_date_serial",
    "parse_date_text",
    "parse_num",
    "percent_text",
    "return_quantity",
    "row_hash",
    "safe_ratio_pct",
    "whole_units",
    "trimmed",
    "week_number",
    "week_of",
    "year_month",
    "year_text",
]
