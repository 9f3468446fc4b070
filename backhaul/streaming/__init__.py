from .ingest import stream_ingest, stream_rows

__all__ = ["stream_ingest", "stream_rows"]
