"""Score files as a stream: every new file is parsed once and lands as sequence, error or both counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stavewright.operators.tokens import encode
from stavewright.sources.corpus import parse_scores


def stream_files(spark: SparkSession, root: str, name_filter: str = "*") -> DataFrame:
    """``(path, modificationTime, length, content)`` of files as they appear below ``root``."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", name_filter)
        .option("recursiveFileLookup", "true")
        .load(root)
    )


def start_ingest(files: DataFrame, fmt: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse, encode and append to ``out/tokens`` and ``out/errors``.

    A batch writes its own folders ``batch=<n>`` in overwrite mode, so a batch that is
    repeated after a failure replaces what it wrote: each file counts once.
    """

    def write(batch: DataFrame, n: int) -> None:
        made = encode(parse_scores(batch, "path", F.lit(fmt))).persist()
        made.where("tokens is not null").select("score_key", "tokens").write.mode("overwrite").parquet(f"{out}/tokens/batch={n}")
        made.where("error is not null").select("score_key", "error.code", "error.detail").write.mode("overwrite").parquet(f"{out}/errors/batch={n}")
        made.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
