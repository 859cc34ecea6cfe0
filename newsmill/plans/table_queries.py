"""Registered changes and reads of typed tables, which each run writes into a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsmill.operators import lifecycle as Y, reader_state as R
from newsmill.plans import fixtures as X, lifecycle_queries  # noqa: F401  (its SQL is used below)
from newsmill.plans.reader_queries import _marks
from newsmill.plans.registry import ORACLES, query
from newsmill.session import shared_folder
from newsmill.sources.tables import NEWS, PARSING_LOGS, READ_STATUS, DayTable, KeyedTable


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


@query("table_status")
def table_status(spark, d):
    """The state change of ``status_update``, committed to the table of articles."""
    table = KeyedTable(spark, _folder(spark), NEWS, n_buckets=16)
    table.overwrite(X.news(spark, d))
    ready = table.read().filter("status = 'translated'").select("id")
    table.update(ready, lambda old, ids: Y.set_status(old, ids, "published", X.now()))
    return table.read().select("id", "status", "updated_at", "platform_published_at")


@query("table_read_marks")
def table_read_marks(spark, d):
    """The marks of ``mark_read``, committed to the table of read articles."""
    table = KeyedTable(spark, _folder(spark), READ_STATUS, n_buckets=16)
    table.overwrite(X.read_status(spark, d))
    table.update(_marks(spark, d), lambda old, marks: R.mark_read(old, marks, X.now()))
    return table.read()


@query("table_logs_of_days", "select id, source_id, status, error_message, created_at from parsing_logs_fx where created_at >= timestamp '2024-01-05 00:00:00' and created_at < timestamp '2024-01-13 00:00:00'")
def table_logs_of_days(spark, d):
    """Eight days of the log, appended in three batches."""
    table = DayTable(spark, _folder(spark), PARSING_LOGS)
    logs = X.parsing_logs(spark, d)
    for batch in range(3):
        table.append(batch, logs.filter(F.col("source_id") % 3 == batch))
    return table.read("2024-01-05", "2024-01-12").select("id", "source_id", "status", "error_message", "created_at")


ORACLES["table_status"] = ORACLES["status_update"]
ORACLES["table_read_marks"] = ORACLES["mark_read"]
