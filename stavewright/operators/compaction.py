"""Partition-local compaction of a partitioned Parquet table.

A table lives under one root::

    <root>/data/<column>=<value>/part-*                         landing: any writer appends here at any time
    <root>/compacted/_snapshot=<n>/<column>=<value>/part-*      what compaction n made
    <root>/versions/<n>.claim|.inputs|.outcome                  snapshot n: who makes it, of what, how it ended

Files are never changed, only added and, once replaced, deleted one by one, so an
append is safe whenever it happens: nothing ever overwrites or empties the folder it
lands in. :func:`compact` looks for partitions with too many small files and rewrites
only those:

1. claim version n+1 by creating its file, which succeeds for one writer only;
2. list the chosen partitions; exactly these files are the inputs, and are written down;
3. rewrite them in well-sized files by dynamic partition overwrite below
   ``_snapshot=<n+1>``, which touches no folder but the claim's own, so a repeated
   attempt replaces what it wrote;
4. compare rows and content checksums of both sides;
5. look at the inputs again: one that is gone or has changed is a conflict;
6. decide the version: ``complete`` or ``aborted``, again by creating one file. This
   instant replaces the inputs by the outputs for every reader;
7. delete the inputs by name. What was appended in the meantime isn't among them.

A driver that dies before 6 leaves a claim that :meth:`Table.recover` aborts (a writer
that still lives then fails at 6); one that dies after 6 leaves inputs that readers
skip and ``recover`` deletes. File creation must be exclusive, as in HDFS, POSIX and
object stores with conditional writes.
"""

from __future__ import annotations

import json
import math
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stavewright.storage import delete, filesystem

_NULL = "__HIVE_DEFAULT_PARTITION__"


class CompactionConflict(RuntimeError):
    """Another writer holds the version, decided it, or changed an input in the meantime."""


class CompactionMismatch(RuntimeError):
    """The rows written are not the rows that were read."""


def checksum(columns: list[str]) -> Column:
    """An order-free sum over whole rows that can't overflow."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)]).cast("decimal(38,0)"))


def _value(folder: str) -> str | None:
    value = unquote(folder.partition("=")[2])
    return None if value == _NULL else value


@dataclass
class Table:
    """A partitioned table at ``root``. ``schema`` fixes the columns, the partition's being text; without it the files are asked."""

    spark: SparkSession
    root: str
    partition: str
    schema: T.StructType | None = None
    small_bytes: int = 64 << 20

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        if self.schema is None:
            self.schema = self.spark.read.option("basePath", self.data).parquet(self.data).schema
        # Else Spark takes a partition named 01 for the number 1 and would write it elsewhere.
        self.schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == self.partition else f for f in self.schema])
        self.tag = "_snapshot"
        while self.tag in self.schema.names:
            self.tag += "_"

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    @property
    def compacted(self) -> str:
        return f"{self.root}/compacted"

    # --- versions

    def _names(self, folder: str) -> list[str]:
        fs, p = filesystem(self.spark, folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _file(self, n: int, kind: str) -> str:
        return f"{self.root}/versions/{n:012d}.{kind}"

    def _create(self, path: str, text: str) -> bool:
        """Create a file; False if it exists."""
        fs, p = filesystem(self.spark, path)
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, path: str) -> str:
        fs, p = filesystem(self.spark, path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def log(self) -> dict[int, str]:
        """By version ``claimed``, ``aborted``, ``complete`` (its inputs are still there) or ``purged``."""
        names = set(self._names(f"{self.root}/versions"))
        state = {}
        for n in sorted(int(x[:-6]) for x in names if x.endswith(".claim")):
            outcome = self._text(self._file(n, "outcome")) if f"{n:012d}.outcome" in names else ""
            state[n] = "purged" if outcome == "complete" and f"{n:012d}.inputs" not in names else outcome or "claimed"
        return state

    def decide(self, n: int, outcome: str) -> bool:
        """Settle version ``n``; False if it is settled already."""
        return self._create(self._file(n, "outcome"), outcome)

    # --- files and rows

    def _folders(self, log: dict[int, str], parts: list[str] | None) -> tuple[list[str], list[str]]:
        """The folders of landing and of complete versions that exist, all of them or only partitions ``parts``."""
        done = [f"{self.compacted}/{self.tag}={n}" for n, s in log.items() if s in ("complete", "purged")]
        landing, done = ([x if parts is None else f"{x}/{p}" for x in xs for p in parts or [""]] for xs in ([self.data], done))
        exists = lambda path: (lambda fs, p: fs.exists(p))(*filesystem(self.spark, path))
        return [x for x in landing if exists(x)], [x for x in done if exists(x)]

    def _replaced(self, log: dict[int, str]) -> DataFrame | None:
        """Files that complete versions replaced and nobody has deleted yet."""
        left = [self._file(n, "inputs") for n, s in log.items() if s == "complete"]
        return self.spark.read.text(left).select(F.col("value").alias("_gone")) if left else None

    def _rows(self, parts: list[str] | None) -> tuple[list[DataFrame], DataFrame | None]:
        while True:
            log = self.log()
            landing, done = self._folders(log, parts)
            tagged = T.StructType([*self.schema.fields, T.StructField(self.tag, T.StringType())])
            found = []
            if landing:
                found.append(self.spark.read.schema(self.schema).option("basePath", self.data).parquet(*landing))
            if done:
                found.append(self.spark.read.schema(tagged).option("basePath", self.compacted).parquet(*done))
            # Folders are listed by now; had a version been settled or purged meanwhile, the list might not be of one snapshot.
            if self.log() == log:
                return found, self._replaced(log)

    def _live(self, found: list[DataFrame], gone: DataFrame | None) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in self.schema.names]

        def rest(df: DataFrame) -> DataFrame:
            if gone is not None:
                df = df.join(gone, df.metadataColumn("_metadata")["file_path"] == gone["_gone"], "left_anti")
            return df.select(*columns)

        return reduce(DataFrame.unionByName, map(rest, found)) if found else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the newest complete snapshot and whatever has landed since. A file deleted during the read fails it, loudly."""
        return self._live(*self._rows(None))

    def files(self, parts: list[str] | None = None) -> DataFrame:
        """``(file, folder, bytes, changed)`` of the live files, from listings alone: no footer is opened."""
        log = self.log()
        folders = [x for xs in self._folders(log, parts) for x in xs]
        if not folders:
            return self.spark.createDataFrame([], "file string, folder string, bytes bigint, changed timestamp")
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folders)
        listed = listed.select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))
        gone = self._replaced(log)
        return listed if gone is None else listed.join(gone, F.col("file") == F.col("_gone"), "left_anti")

    def _stats(self) -> dict[str, dict]:
        grouped = self.files().groupBy("folder").agg(F.count("*").alias("files"), F.count_if(F.col("bytes") < self.small_bytes).alias("small"), F.sum("bytes").alias("bytes"))
        return {r.folder: r.asDict() for r in grouped.collect()}  # one row a partition

    def stats(self) -> dict[str | None, dict]:
        """By partition: files, small files, bytes."""
        return {_value(k): v for k, v in self._stats().items()}

    def append(self, df: DataFrame) -> None:
        """Write ``df`` as it comes: this is where small files are born. Any other writer may do the same, at any time."""
        df.select(*[F.col(f"`{c}`") for c in self.schema.names]).write.mode("append").partitionBy(self.partition).parquet(self.data)

    def purge(self, n: int) -> None:
        """Delete the files that complete version ``n`` replaced, by name, and the list of them last."""
        fs, p = filesystem(self.spark, self._file(n, "inputs"))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        uri = self.spark._jvm.java.net.URI
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: fs.delete(path(uri(x)), False), self._text(self._file(n, "inputs")).splitlines()))
        fs.delete(p, False)

    def recover(self) -> bool:
        """End what a dead driver left: abort a claim without outcome, delete the inputs of a complete version."""
        did = False
        for n, state in self.log().items():
            if state == "claimed" and self.decide(n, "aborted"):
                delete(self.spark, f"{self.compacted}/{self.tag}={n}")
                did = True
            elif state == "complete":
                self.purge(n)
                did = True
        return did


def compact(table: Table, *, max_small_files: int = 4, target_bytes: int = 256 << 20, purge: bool = True, at=None) -> dict:
    """Rewrite the partitions that hold more than ``max_small_files`` files under ``table.small_bytes``.

    A chosen partition of B bytes becomes ceil(B / ``target_bytes``) files; a hot
    partition is therefore spread over as many tasks as it gets files. Partitions
    below the limit, an empty table and a table that was never compacted are fine.
    Rows are neither lost nor doubled, whoever appends meanwhile: rows and checksums of
    every partition are compared before the new files count, and only files that were
    read are replaced. Repeated rows stay repeated; NULL partition values are a
    partition of their own (and so is the empty text, which Parquet directories can't
    tell from NULL). Columns may have any names. Without ``purge`` the replaced files
    stay for readers of the former snapshot until :meth:`Table.purge`.

    Returns ``{"version", "rewritten": [partition values], "files_before", "files_after"}``.
    Raises :class:`CompactionConflict` or :class:`CompactionMismatch` with the table's rows untouched.
    ``at`` is called with the name of each step (tests use it to play another writer).
    """
    spark, part, at = table.spark, table.partition, at or (lambda step: None)
    log = table.log()
    if held := [n for n, s in log.items() if s == "claimed"]:
        raise CompactionConflict(f"version {held[-1]} is being written; recover() ends it if its writer is gone")
    now = table._stats()
    chosen = {k: v for k, v in sorted(now.items()) if v["small"] > max_small_files}
    files = sum(v["files"] for v in now.values())
    report = {"version": max(log, default=0), "rewritten": sorted(map(_value, chosen), key=str), "files_before": files, "files_after": files}
    if not chosen:
        return report
    n = report["version"] + 1
    if not table._create(table._file(n, "claim"), json.dumps({"partitions": list(chosen)})):
        raise CompactionConflict(f"version {n} of {table.root} is taken")
    at("claimed")
    try:
        _rewrite(table, n, chosen, target_bytes, at)
    except BaseException:
        if table.decide(n, "aborted") or table.log()[n] == "aborted":
            delete(spark, f"{table.compacted}/{table.tag}={n}")
        raise
    at("decided")
    if purge:
        table.purge(n)
    return report | {"version": n, "files_after": table.files().count()}


def _rewrite(table: Table, n: int, chosen: dict[str, dict], target_bytes: int, at) -> None:
    spark, part = table.spark, table.partition
    names = [F.col(f"`{c}`") for c in table.schema.names]
    found, gone = table._rows(list(chosen))
    rows = table._live(found, gone)
    # The relations above keep the listing they were made with: these files and no others are read.
    replaced = {r[0] for r in gone.collect()} if gone is not None else set()
    # The metadata column writes local files with one slash.
    inputs = sorted({re.sub("^file:/+", "file:/", x) for df in found for x in df.inputFiles()} - replaced)
    if not table._create(table._file(n, "inputs"), "\n".join(inputs)):
        raise CompactionConflict(f"version {n} has inputs already")
    at("listed")

    listed = spark.read.text(table._file(n, "inputs")).select(F.col("value").alias("file"))

    def fingerprint() -> tuple:
        return tuple(table.files(list(chosen)).join(listed, "file", "left_semi").agg(F.count("*"), F.sum(F.xxhash64("file", "bytes", F.unix_micros("changed")).cast("decimal(38,0)"))).first())

    before = fingerprint()
    if before[0] != len(inputs):
        raise CompactionConflict(f"{len(inputs) - before[0]} inputs are gone")
    plan, first = [], 0
    for folder, v in chosen.items():
        count = max(1, math.ceil(v["bytes"] / target_bytes))
        plan.append((_value(folder), first, count))
        first += count
    plan_df = spark.createDataFrame(plan, "part string, first int, files int").alias("plan")  # one row a chosen partition
    columns = [F.col(f"rows.`{c}`") for c in table.schema.names]
    planned = rows.alias("rows").join(plan_df, F.col(f"rows.`{part}`").eqNullSafe(F.col("plan.part")))
    number = F.col("plan.first") + F.pmod(F.xxhash64(*columns), F.col("plan.files")).cast("int")
    out = planned.repartitionById(first, number).select(*columns, F.lit(n).cast("string").alias(table.tag))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(table.tag, part).parquet(table.compacted)
    at("written")

    def sums(df: DataFrame) -> dict:
        return {r[0]: (r[1], str(r[2])) for r in df.groupBy(f"`{part}`").agg(F.count("*"), checksum(table.schema.names)).collect()}  # one row a chosen partition

    made = spark.read.schema(table.schema).option("basePath", f"{table.compacted}/{table.tag}={n}").parquet(f"{table.compacted}/{table.tag}={n}")
    if sums(rows.select(*names)) != sums(made):
        raise CompactionMismatch("the rows written differ from the rows read")
    if fingerprint() != before:
        raise CompactionConflict("inputs changed while they were rewritten")
    at("checked")
    if not table.decide(n, "complete"):
        raise CompactionConflict(f"version {n} was aborted by someone else")
