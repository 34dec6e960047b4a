"""Incremental indexing: files are chunked, embedded and stored as they arrive, and again when they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.embed import Embedder, embed
from quarry.functions.languages import language
from quarry.operators.chunking import chunk_lines
from quarry.operators.index import by_key, chunk_id, stamped, upsert


def chunks_of(files: DataFrame, by: Embedder) -> DataFrame:
    """Index rows of files (index_name, path, name, text, source_digest)."""
    rows = chunk_lines(by_key(files).withColumn("language", F.coalesce(language(F.col("name")), F.lit("unknown"))), ["index_name", "path", "language", "source_digest"])
    rows = rows.withColumns({"chunk_type": F.lit("text"), "chunk_id": chunk_id(F.col("index_name"), F.col("path"), F.col("chunk_no"))})
    return stamped(embed(rows, by))


def index_stream(files: DataFrame, index_name: str, by: Embedder, root: str, checkpoint: str) -> StreamingQuery:
    """Index a stream of files (path, name, text) until it has no more. A file that comes again with another text takes
    the place of its chunks; one with the text that is stored, or a batch that runs again, changes nothing."""

    def add(batch: DataFrame, _: int) -> None:
        upsert(batch.withColumn("index_name", F.lit(index_name)), root, lambda new: chunks_of(new, by), complete=False)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
