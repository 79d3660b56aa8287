"""Incremental indexing: a stream of documents appended to a saved index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..fixtures import text_impacts
from ..operators.index import WINDOW, windowed, write_forward, write_postings


def ingest(documents: DataFrame, path: str, checkpoint: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Start appending, to an index that save() wrote or to a new one.

    Each micro-batch overwrites its own folders, so a replay adds nothing twice.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        vectors = text_impacts(batch, id_col, text_col).persist()
        write_postings(windowed(vectors, window), path, epoch, "overwrite", "dynamic")
        write_forward(vectors, path, epoch, "overwrite", "dynamic")
        vectors.unpersist()

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
