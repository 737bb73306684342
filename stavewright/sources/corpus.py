"""From score files to a corpus: scans, parsing, index, random access."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stavewright.functions.fixed import vocabulary
from stavewright.functions.names import base_name
from stavewright.functions.schema import SCORE, Refusal
from stavewright.operators.sampling import byte_offsets, pack_u16, unpack_u16
from stavewright.operators.tokens import encode
from stavewright.sources.listing import glob_to_regex
from stavewright.storage import filesystem, materialize, ship


def scan(spark: SparkSession, root: str, name_filter: str | None = None) -> DataFrame:
    """``(path, content)`` of the files below ``root``; ``name_filter`` is a glob on file names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(root).select("path", "content")


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for an explicit list of files."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def subset(listed: DataFrame, existing: DataFrame, line: str = "value", path: str = "path") -> DataFrame:
    """The listed scores that exist, a row for each mention: ``./data/x.json`` means ``mxl/x.mxl``.

    The list decides alone; the source's glob plays no part. A line listed twice comes
    out twice, so this is a semi-join from the list's side.
    """
    mapped = listed.where(F.col(line) != "").withColumn(path, F.regexp_replace(F.regexp_replace(line, r"^\./data/", "mxl/"), r"\.json$", ".mxl"))
    return mapped.join(existing.select(path).distinct(), path, "left_semi").select(path)


def source_files(spark: SparkSession, root: str, glob: str, subset_list: str | None = None) -> DataFrame:
    """``(path, content)`` of what a row of the catalogue asks for below ``root``: the files ``glob`` matches or, with a list, each mention in it.

    ``glob`` and ``subset_list`` are relative to ``root``. Other files are pruned by their
    names before any is read; with a list those whose extension it never mentions are, and
    the rest go by an equi-join. Spark's listing never shows names that begin with a dot
    or an underscore.
    """
    fs, p = filesystem(spark, root)
    base = fs.makeQualified(p).toString().rstrip("/") + "/"
    below = lambda x: F.substring(x, len(base) + 1, 1 << 30)
    # Only filters on the metadata prune files. Its path is a URL, in which a plus stands for itself.
    listed = below(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    files = scan(spark, root)
    if subset_list is None:
        return files.where(F.rlike(listed, F.lit(glob_to_regex(glob))))
    wanted = subset(spark.read.text(f"{root}/{subset_list}"), files.select(below(F.col("path")).alias("path"))).select(F.col("path").alias("wanted"))
    ending = lambda x: F.regexp_extract(x, r"(\.[^./]*)?$", 0)
    endings = [r.e for r in wanted.select(ending(F.col("wanted")).alias("e")).distinct().collect()]
    return files.where(ending(listed).isin(endings)).join(wanted, below(F.col("path")) == F.col("wanted")).select("path", "content")


def pending(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs without a result yet."""
    return jobs.join(done.select(key), key, "left_anti")


def conversion_jobs(found: DataFrame, converted: DataFrame) -> DataFrame:
    """``(source_path, target_path)`` of the mscx files below ``found.path`` that no MusicXML file of ``converted.path`` stands for yet."""
    jobs = found.where(F.endswith("path", F.lit(".mscx"))).select(F.col("path").alias("source_path"), F.concat(F.lit("musicxml/"), F.regexp_replace(base_name(F.col("path")), r"\.mscx$", ".musicxml")).alias("target_path"))
    return pending(jobs, converted.select(F.col("path").alias("target_path")), "target_path")


def download(row, raw: str = "data/raw") -> str:
    """Fetch one row of the catalogue to the driver's disk: ``ok``, or the typed reason why not. A helper, not a Spark job."""
    import subprocess
    from pathlib import Path

    target = Path(raw, row["source"])
    if row["repository"] is None:
        return "ok" if target.is_dir() else "manual_download_required"
    if (target / ".git").is_dir():
        return "already_downloaded"
    ran = subprocess.run(["git", "clone", "--depth", "1", row["repository"], str(target)], stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
    return "ok" if ran.returncode == 0 else f"git_clone_failed {ran.returncode}: {ran.stdout.strip()}"


def _parse_one(kind: str, key: str, content: bytes | str) -> dict:
    from stavewright.sources import kern, musicxml

    if kind == "kern":
        return kern.parse(content.decode() if isinstance(content, bytes) else content)
    content = content.encode() if isinstance(content, str) else content
    return musicxml.parse(musicxml.unzip(content, key) if kind == "mxl" else content)


def parse_scores(files: DataFrame, key: str, kind: Column, content: str = "content") -> DataFrame:
    """One row of SCORE a file of ``kind`` ``kern``, ``musicxml`` or ``mxl``; what can't be held has an ``error``.

    A file that breaks the parser is a row with code ``crash``; the job goes on. NULL
    content is an ``empty`` file, another kind ``unknown_format``. Files are parsed in
    Arrow batches, each in one task: a file is read as a whole, a corpus never is.
    """
    ship(files.sparkSession)
    schema = T.StructType.fromDDL(SCORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for name, what, body in zip(*(c.to_pylist() for c in batch.columns)):
                row = {"score_key": name, "title": None, "composer": None, "parts": None, "error": None}
                try:
                    if body is None:
                        raise Refusal("empty")
                    if what not in ("kern", "musicxml", "mxl"):
                        raise Refusal("unknown_format", what)
                    row |= _parse_one(what, name, body)
                except Refusal as e:
                    row["error"] = {"code": e.code, "detail": e.detail}
                except Exception as e:  # noqa: BLE001 (a statistic, not a failure of the job)
                    row["error"] = {"code": "crash", "detail": type(e).__name__}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select(F.col(key).cast("string").alias("score_key"), kind.alias("kind"), F.col(content)).mapInArrow(run, schema)


def ingest(scores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sequences, entries, errors)`` of parsed scores: ids, the index with byte offsets in key order, the typed refusals."""
    # Written once: three tables come of it, and files are parsed one time.
    made = materialize(encode(scores).select("score_key", "tokens", "error"), "encoded")
    sequences = made.where("tokens is not null").select("score_key", base_name(F.col("score_key")).alias("key"), "tokens")
    entries = byte_offsets(sequences.select("score_key", "key", F.size("tokens").cast("bigint").alias("tokens")), [], ["score_key"])
    errors = made.where("error is not null").select("score_key", base_name(F.col("score_key")).alias("key"), "error.code", "error.detail")
    return sequences, entries, errors


def write_corpus(scores: DataFrame, out: str, fmt: str) -> None:
    """Shards sorted by key, index, errors and metadata as Parquet below ``out``; a rebuild replaces all of it."""
    sequences, entries, errors = ingest(scores)
    sequences.repartitionByRange("score_key").sortWithinPartitions("score_key").write.mode("overwrite").parquet(f"{out}/tokens")
    entries.write.mode("overwrite").parquet(f"{out}/entries")
    errors.write.mode("overwrite").parquet(f"{out}/errors")
    spark = scores.sparkSession
    spark.createDataFrame([(1, len(vocabulary()), fmt)], "version int, vocab_size int, format string").write.mode("overwrite").parquet(f"{out}/meta")


def load_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/entries")


def read_sequence(spark: SparkSession, out: str, score_key: str) -> DataFrame:
    """One sequence: shards are sorted by key, so all row groups but one are skipped."""
    return spark.read.parquet(f"{out}/tokens").where(F.col("score_key") == score_key)


def packed_bytes(sequences: DataFrame) -> DataFrame:
    """``(score_key, content)``: each sequence as it lies in a byte-compatible shard."""
    return sequences.select("score_key", pack_u16(F.col("tokens")).alias("content"))


def unpacked(content: DataFrame) -> DataFrame:
    return content.select("score_key", unpack_u16(F.col("content")).alias("tokens"))
