from .attribution import attribute_returns
from .cleanup import (
    dedup_orders,
    dedup_returns,
    drop_bad_orders,
    drop_blank_dispositions,
    maintenance_counts,
)
from .keep import first_by_hash, insert_ignore, keep_first, repeated_hashes, repeated_rows
from .normalize import normalize, normalize_orders, normalize_returns
from .search import (
    export_returns,
    facet_months,
    facet_values,
    filter_options,
    filtered_count,
    page_totals,
    returns_page,
    search_returns,
)
from .upsert import (
    action_counts,
    ingest_actions,
    upsert_actions,
    upsert_counts,
    upsert_disposition,
)

__all__ = [
    "action_counts",
    "attribute_returns",
    "dedup_orders",
    "dedup_returns",
    "drop_bad_orders",
    "drop_blank_dispositions",
    "export_returns",
    "facet_months",
    "facet_values",
    "filter_options",
    "filtered_count",
    "first_by_hash",
    "repeated_hashes",
    "repeated_rows",
    "ingest_actions",
    "insert_ignore",
    "keep_first",
    "maintenance_counts",
    "normalize",
    "normalize_orders",
    "normalize_returns",
    "page_totals",
    "returns_page",
    "search_returns",
    "upsert_actions",
    "upsert_counts",
    "upsert_disposition",
]
