"""Structured Streaming into a Model. The graph is a set, so a batch that is replayed after a failure changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalog import graph_name
from ..model import Model
from ..sources import ntriples


def stream_ntriples(model: Model, folder: str, checkpoint: str, graph: str | None = None, **trigger) -> StreamingQuery:
    """Files of N-Triples that appear in ``folder``. Blank labels are scoped to the stream."""

    def add(batch: DataFrame, _: int) -> None:
        for (p, st, ot), df, unlike in ntriples.split(ntriples.parse(batch, "_s")):
            model.catalog.insert((graph_name(graph), p, st, ot), df, unlike=unlike)

    lines = model.spark.readStream.text(folder)
    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_template(model: Model, template: str, rows: DataFrame, checkpoint: str, graph: str | None = None, **trigger) -> StreamingQuery:
    """Rows of a streaming table, mapped by a template as they come."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            model.map(template, batch, graph)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
