from .files import content_digest, content_hash, file_md5, fingerprint, line_sums, list_files
from .log import append_upload, upload_history
from .payload import read_orders_payload, read_returns_payload
from .sheets import Sheet, detect_kind, read_sheet, read_typed_sheet, read_workbook, route
from .sinks import write_csv
from .tables import SnapshotTable

__all__ = [
    "Sheet",
    "SnapshotTable",
    "append_upload",
    "content_digest",
    "content_hash",
    "detect_kind",
    "file_md5",
    "fingerprint",
    "line_sums",
    "list_files",
    "read_orders_payload",
    "read_returns_payload",
    "read_sheet",
    "read_typed_sheet",
    "read_workbook",
    "route",
    "upload_history",
    "write_csv",
]
