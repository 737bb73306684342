"""Problem 1: the wanted files of every source, compacted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavewright.operators.compaction import Table, compact
from stavewright.sources.listing import wanted_files
from stavewright.storage import materialize, new_path


def landed(spark: SparkSession, d: str) -> Table:
    """A table of the wanted files of all sources as they came: a small file a source and month of delivery."""
    rows = wanted_files(spark.read.parquet(f"{d}/raw_files.parquet"), spark.read.parquet(f"{d}/sources.parquet"))
    table = Table(spark, new_path(spark, "files"), "source", rows.schema)
    month = F.coalesce(F.year("listed_at") * 12 + F.month("listed_at"), F.lit(0))
    rows = materialize(rows.withColumn("_month", month), "wanted")
    low, high = rows.agg(F.coalesce(F.min("_month"), F.lit(0)), F.coalesce(F.max("_month"), F.lit(0))).first()
    table.append(rows.repartitionById(high - low + 1, F.col("_month") - low).drop("_month"))
    return table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The wanted files of all sources, once each, as they lie in the compacted table. Empty inputs give an empty result."""
    table = landed(spark, d)
    compact(table)
    return table.read().select("file_id")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """What the compacted table holds of each source."""
    table = landed(spark, d)
    compact(table)
    return table.read().groupBy("source").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def p1_compaction(spark: SparkSession, d: str) -> DataFrame:
    """What compaction did to each source: Parquet files before and after, whether it was rewritten, and what it holds, checksummed by file ids and by lengths of content."""
    table = landed(spark, d)
    before = materialize(table.files().groupBy("folder").agg(F.count("*").alias("files_before")), "before")
    rewritten = compact(table)["rewritten"]
    source = F.regexp_extract("folder", "=(.*)$", 1)
    after = table.files().groupBy("folder").agg(F.count("*").alias("files_after"))
    files = before.join(after, "folder", "full").select(source.alias("source"), "files_before", "files_after", source.isin(rewritten).alias("rewritten"))
    held = table.read().groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("file_id").alias("sum_ids"), F.sum(F.length("content")).alias("sum_lengths"))
    return files.join(held, "source", "full")


# DuckDB; the catalogue's globs are restated as regular expressions by hand.
_WANTED = r"""
with recursive pats("glob", pat) as (values
  ('kern/*.krn', '^kern/[^/.][^/]*\.krn$'), ('krn/op?/*.krn', '^krn/op[^/]/[^/.][^/]*\.krn$'),
  ('{fugues,preludes}/*.krn', '^(fugues|preludes)/[^/.][^/]*\.krn$'), ('**/*.krn', '^(.+/)?[^/.][^/]*\.krn$'),
  ('books/**/*.krn', '^books/(.+/)?[^/.][^/]*\.krn$'), ('musicxml/*.musicxml', '^musicxml/[^/.][^/]*\.musicxml$'),
  ('scores/*/*.musicxml', '^scores/[^/.][^/]*/[^/.][^/]*\.musicxml$'), ('**/*.{xml,musicxml}', '^(.+/)?[^/.][^/]*\.(music)?xml$'),
  ('mxl/**/*.mxl', '^mxl/(.+/)?[^/.][^/]*\.mxl$'), ('mxl/[0-9]*/*.mxl', '^mxl/[0-9][^/]*/[^/.][^/]*\.mxl$'),
  ('*.mxl', '^[^/.][^/]*\.mxl$'), ('omr/*.mxl', '^omr/[^/.][^/]*\.mxl$')),
pats2 as (select source, pat from sources join pats using ("glob")),
flat as (
  select file_id, source, listed_at, size_bytes, '/' || replace(path, '\', '/') || '/' as p from raw_files where path is not null),
steps as (
  select file_id, source, listed_at, size_bytes, p, 0 as i from flat
  union all
  select file_id, source, listed_at, size_bytes,
         case when contains(p, '//') then replace(p, '//', '/')
              when contains(p, '/./') then replace(p, '/./', '/')
              else regexp_replace(p, '/[^/]+/\.\./', '/') end, i + 1
  from steps where contains(p, '//') or contains(p, '/./') or contains(p, '/../')),
canon as (
  select file_id, source, size_bytes, listed_at, trim(case when starts_with(q, '/data/raw/' || source || '/') then substr(q, length('/data/raw/' || source || '/')) else q end, '/') as f
  from (select file_id, any_value(source) as source, any_value(size_bytes) as size_bytes, any_value(listed_at) as listed_at, max_by(p, i) as q from steps group by file_id)),
wanted as (
  select c.* from canon c join pats2 using (source)
  where regexp_matches(f, pat)),
kept as (
  select * from wanted qualify row_number() over (partition by source, f order by listed_at desc nulls last, file_id desc) = 1)
"""

QUERIES = {"p1_found": p1_found, "p1_files": p1_files, "p1_compaction": p1_compaction}
ORACLES = {
    "p1_found": _WANTED + "select file_id from kept",
    "p1_files": _WANTED + "select source, count(*) as n_files, cast(sum(size_bytes) as bigint) as n_bytes from kept group by source",
    # A source that came in more than four files is rewritten as one.
    "p1_compaction": _WANTED + """
, held as (select k.source, date_trunc('month', r.listed_at) as m, r.file_id, length(r.content) as n from kept k join raw_files r using (file_id)),
per as (select source, count(distinct coalesce(m, timestamptz '1900-01-01')) as files_before, count(*) as n_rows, cast(sum(file_id) as bigint) as sum_ids, cast(sum(n) as bigint) as sum_lengths from held group by source)
select source, files_before, case when files_before > 4 then 1 else files_before end as files_after, files_before > 4 as rewritten, n_rows, sum_ids, sum_lengths from per
""",
}
