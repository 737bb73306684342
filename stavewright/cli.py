"""``python -m stavewright.cli instruments|corpus ..``: thin views of the dimensions and of a built corpus."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavewright.functions import pitch
from stavewright.operators.stats import corpus_stats, coverage, failure_histogram
from stavewright.sources import corpus, dimensions
from stavewright.storage import filesystem


def by_family(roster: DataFrame, family: str) -> DataFrame:
    return roster.where(F.col("family") == family)


def transposing(roster: DataFrame) -> DataFrame:
    return roster.where("transposition is not null")


def matches(needle: str) -> Column:
    """A substring of id, name or an alias, whatever its case."""
    has = lambda x: F.contains(F.lower(x), F.lit(needle.lower()))
    return has(F.col("instrument")) | has(F.col("name")) | F.exists("aliases", has)


def instrument_table(roster: DataFrame) -> DataFrame:
    """What the listing prints: transposition by name, the key C major is written in, the range by note names."""
    d, c = F.col("diatonic"), F.col("chromatic")
    return roster.select(
        "ord", "instrument", "name", "family", "clef",
        F.coalesce(pitch.interval_name(d, c), F.lit("concert")).alias("sounds"),
        F.coalesce(pitch.key_name(pitch.transpose_key(F.lit(0), -d, -c)), F.lit("C major")).alias("c_major_is_written"),
        F.concat_ws("-", pitch.midi_name(F.col("low_midi")), pitch.midi_name(F.col("high_midi"))).alias("range"),
    ).orderBy("ord")


def _has(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def status(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """The catalogue with where each source stands: ``missing``, ``downloaded`` or ``built``, and what a built corpus holds."""
    rows = dimensions.sources(spark).drop("raw_dir", "corpus_dir").collect()  # ten
    told = []
    for r in rows:
        built = _has(spark, f"{out}/{r.source}/meta")
        counted = corpus.load_index(spark, f"{out}/{r.source}").agg(F.count("*"), F.sum("tokens")).first() if built else (None, None)
        told.append((*r, "built" if built else "downloaded" if _has(spark, f"{raw}/{r.source}") else "missing", *counted))
    return spark.createDataFrame(told, "source string, format string, glob string, subset string, repository string, note string, status string, files bigint, tokens bigint")


def built_stats(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Of a built corpus: ``(one row of statistics with coverage, refusals by code)``."""
    errors = spark.read.parquet(f"{out}/errors")
    stats = corpus_stats(corpus.load_index(spark, out).withColumn("corpus", F.lit(out)), errors.withColumn("corpus", F.lit(out)), ["corpus"])
    return stats.withColumn("percent", coverage(F.col("files_ok"), F.col("files_ok") + F.col("files_failed"))), failure_histogram(errors, F.col("code"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="stavewright")
    sub = p.add_subparsers(dest="what", required=True)
    i = sub.add_parser("instruments")
    i.add_argument("--family")
    i.add_argument("--transposing", action="store_true")
    i.add_argument("--search")
    c = sub.add_parser("corpus")
    c.add_argument("source", nargs="?")
    c.add_argument("--raw", default="data/raw")
    c.add_argument("--out", default="data/corpus")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("stavewright").getOrCreate()
    if args.what == "instruments":
        roster = dimensions.instruments(spark)
        if args.family:
            families = [r.family for r in roster.select("family").distinct().collect()]
            if args.family not in families:
                p.error(f"no family {args.family!r}; there are {', '.join(sorted(families))}")
            roster = by_family(roster, args.family)
        roster = transposing(roster) if args.transposing else roster
        roster = roster.where(matches(args.search)) if args.search else roster
        instrument_table(roster).drop("ord").show(200, truncate=False)
        return
    if not args.source:
        status(spark, args.raw, args.out).show(truncate=False)
        return
    row = dimensions.sources(spark).where(F.col("source") == args.source).first()
    if row is None:
        p.error(f"no source {args.source!r}")
    files = corpus.source_files(spark, f"{args.raw}/{args.source}", row.glob, row.subset)
    corpus.write_corpus(corpus.parse_scores(files, "path", F.lit(row.format)), f"{args.out}/{args.source}", row.format)
    for table in built_stats(spark, f"{args.out}/{args.source}"):
        table.show(100, truncate=False)


if __name__ == "__main__":
    main()
