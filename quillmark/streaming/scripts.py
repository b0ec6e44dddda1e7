"""Scripts as they arrive, matched with a fixed catalog. Each script stands for itself, so there is no state; the match
ends with windows over a script's rows, which a stream runs per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators.analyze import analyze_scripts
from quillmark.operators.catalog import Catalog
from quillmark.operators.match import report_lines


def match_stream(scripts: DataFrame, catalog: Catalog, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that hands the report lines of each batch of ``scripts`` (script_id, source) to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        analyzed = analyze_scripts(rows, catalog.min_statements).persist()
        try:
            sink(report_lines(analyzed, catalog), number)
        finally:
            analyzed.unpersist()

    writer = scripts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
