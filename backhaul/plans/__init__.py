from . import rollups
from .audit import diagnostic_samples, returns_audit, returns_by_year, returns_diagnostic
from .exports import export_monthly, export_weekly
from .load import Tables, load_payload, load_sheet, load_sheet_file, load_workbook, open_tables
from .maintain import maintain
from .periods import (
    period_disposition_names,
    period_dispositions,
    period_months,
    period_order_units,
    period_returns,
    period_stats,
    period_table,
)
from .summary import (
    breakdowns,
    daily_orders,
    dashboard_cards,
    distinct_years,
    monthly_orders,
    monthly_returns,
    monthly_summary,
    order_stats,
    rate_series,
    recent_months,
    return_stats,
    returns_by_brand,
    returns_by_disposition,
    returns_by_gender,
    returns_by_reason,
    summary,
    top_reasons,
    weekly_for_year,
    weekly_orders,
    weekly_returns,
    weekly_summary,
)

__all__ = [
    "Tables",
    "breakdowns",
    "daily_orders",
    "dashboard_cards",
    "diagnostic_samples",
    "distinct_years",
    "export_monthly",
    "export_weekly",
    "load_payload",
    "load_sheet",
    "load_sheet_file",
    "load_workbook",
    "maintain",
    "monthly_orders",
    "monthly_returns",
    "monthly_summary",
    "open_tables",
    "order_stats",
    "period_disposition_names",
    "period_dispositions",
    "period_months",
    "period_order_units",
    "period_returns",
    "period_stats",
    "period_table",
    "rate_series",
    "recent_months",
    "return_stats",
    "returns_audit",
    "returns_by_brand",
    "returns_by_disposition",
    "returns_by_gender",
    "returns_by_reason",
    "returns_by_year",
    "returns_diagnostic",
    "rollups",
    "summary",
    "top_reasons",
    "weekly_for_year",
    "weekly_orders",
    "weekly_returns",
    "weekly_summary",
]
