"""backhaul: order-line and customer-return analytics as Spark DataFrame functions.

Packages
--------
``functions``  column expressions (numbers, dates, text, hashes, rates)
``sources``    sheet and JSON readers, snapshot tables, load log, CSV sinks
``operators``  normalize, keep-first, insert-ignore, upsert, cleanup, search
``plans``      reports composed from the operators
``streaming``  incremental ingest of arriving files
"""

__version__ = "0.1.0"
