"""Continuous re-indexing: change events to debounced sessions, and snapshot comparison for each micro-batch.

The file source sees new paths only, so a stream of events (or of ticks) triggers a comparison of the whole snapshot
with the recorded files, which also finds edits and deletions. A streaming query runs one batch at a time; what comes in
meanwhile is one following batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import changes
from marlstone.operators.classify import is_index_candidate
from marlstone.operators.store import Table

QUIET = "2 seconds"


def relevant(events: DataFrame, path: str = "path") -> DataFrame:
    """Events on paths that an index would hold."""
    return events.where(is_index_candidate(F.col(path)))


def debounce(events: DataFrame, project: str = "project", ts: str = "ts", quiet: str = QUIET) -> DataFrame:
    """(project, start, end, n): bursts of events with pauses shorter than quiet; batch or streaming (with a watermark)."""
    session = F.session_window(F.col(ts), quiet)
    return events.groupBy(F.col(project).alias("project"), session.alias("w")).agg(F.count("*").alias("n")).select(
        "project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def dirty_projects(events: DataFrame, project: str = "project", keep: Column | None = None) -> DataFrame:
    """The projects a batch of events touches, each once."""
    return (events if keep is None else events.where(keep)).select(project).distinct()


def sync_batch(snapshot: DataFrame, files: Table, index: Callable[[DataFrame], None], remove: Callable[[DataFrame], None]) -> dict[str, int]:
    """One comparison: removed and changed paths are deleted, added and changed ones indexed, then the files recorded.

    Run again after a failure it does the same, since files are recorded last.
    """
    new = snapshot.select("file_path", "digest")
    old = files.read() if files.exists() else new.limit(0)
    found = changes.detect(old, new).cache()
    counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
    if set(counts) - {"unchanged"}:
        remove(changes.to_delete(found).select("file_path"))
        index(snapshot.join(changes.to_index(found).select("file_path"), "file_path", "left_semi"))
        files.overwrite(new)
    found.unpersist()
    return counts


def watch(events: DataFrame, on_projects: Callable[[list[str]], None], checkpoint: str, project: str = "project"):
    """Starts a query that hands the dirty projects of each batch to on_projects."""

    def run(batch: DataFrame, _: int) -> None:
        names = sorted(r[0] for r in dirty_projects(batch, project).collect())  # as many as there are projects
        if names:
            on_projects(names)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
