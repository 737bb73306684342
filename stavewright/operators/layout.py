"""Order within measures: voice groups, renumbering, cursors, gaps, tuplet brackets.

Each works on a table that is already keyed (``keys``: score, part, measure) and
ordered (``order``); a window never spans more than one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavewright.functions.duration import from_divisions


def voice_groups(df: DataFrame, keys: list[str], order: list[str], voice: str) -> DataFrame:
    """Add ``group_no`` (0..): runs of one voice in order; a voice that comes back begins another group. NULL is a voice of its own."""
    run = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(voice)).over(run)
    begins = F.when(before.isNull() | ~F.col(voice).eqNullSafe(before[voice]), 1).otherwise(0)
    return df.withColumn("_begins", begins).withColumn("group_no", F.sum("_begins").over(run) - 1).drop("_begins")


def renumber_by_appearance(df: DataFrame, keys: list[str], order: str, voice: str) -> DataFrame:
    """Add ``dense_voice`` (1..): voices numbered as they first appear."""
    first = df.withColumn("_first", F.min(order).over(W.partitionBy(*keys, voice)))
    return first.withColumn("dense_voice", F.dense_rank().over(W.partitionBy(*keys).orderBy("_first"))).drop("_first")


def renumber_ascending(df: DataFrame, keys: list[str], voice: str) -> DataFrame:
    """Add ``dense_voice`` (1..): voices numbered upward without holes."""
    return df.withColumn("dense_voice", F.dense_rank().over(W.partitionBy(*keys).orderBy(voice)))


def cursor(df: DataFrame, keys: list[str], order: list[str], kind: str, length: str) -> DataFrame:
    """Add ``position`` and ``starts_at`` to rows of kind ``note``, ``chord``, ``backup``, ``forward``.

    A note or forward moves the cursor by its length, a backup back; chord members and
    anything else don't. ``starts_at`` is the row's position, for chord members that of
    the note before them (0 if there is none).
    """
    run = W.partitionBy(*keys).orderBy(*order)
    delta = F.when(F.col(kind).isin("note", "forward"), F.col(length)).when(F.col(kind) == "backup", -F.col(length)).otherwise(0).cast("bigint")
    placed = df.withColumn("_delta", delta).withColumn("position", F.coalesce(F.sum("_delta").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
    own = F.last(F.when(F.col(kind) == "note", F.col("position")), ignorenulls=True).over(run)
    return placed.withColumn("starts_at", F.when(F.col(kind) == "chord", F.coalesce(own, F.lit(0).cast("bigint"))).otherwise(F.col("position"))).drop("_delta")


def gaps(df: DataFrame, keys: list[str], order: list[str], start: str, length: str, chord: Column) -> DataFrame:
    """Add ``gap`` to the rows of one voice each key: how far a row begins after the one before it ended.

    Positive: rests are missing; negative: an overlap to refuse; chord members have 0.
    The first row is expected at 0; what is missing at the end is nobody's.
    """
    run = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    end = F.last(F.when(~chord, F.col(start) + F.col(length)), ignorenulls=True).over(run)
    return df.withColumn("gap", F.when(chord, F.lit(0)).otherwise(F.col(start) - F.coalesce(end, F.lit(0))).cast("bigint"))


def tuplet_marks(events: Column) -> Column:
    """``array<string>``: where brackets begin and end in an ordered ``array<struct<ratio string, sounding bigint>>``.

    ``sounding`` is 0 for chord members. Events of one ratio belong together until
    their sum is a plain written value; another ratio or none ends them before. The
    first of a bracket is ``start``, the last ``stop``, a single one ``both``, others NULL.
    """
    # A fold that numbers brackets: the open one's ratio and sum, and each event's bracket (0: none).
    seed = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("last"), F.lit(None).cast("string").alias("ratio"), F.lit(0).cast("bigint").alias("sum"))

    def step(acc: Column, e: Column) -> Column:
        goes_on = acc["ratio"].isNotNull() & acc["ratio"].eqNullSafe(e["ratio"])
        number = F.when(e["ratio"].isNull(), F.lit(0)).when(goes_on, acc["last"]).otherwise(acc["last"] + 1)
        total = F.when(goes_on, acc["sum"]).otherwise(F.lit(0)) + e["sounding"]
        done = e["ratio"].isNull() | ((total > 0) & from_divisions(total).isNotNull())
        return F.struct(
            F.concat(acc["ids"], F.array(number.cast("int"))).alias("ids"), F.greatest(acc["last"], number).cast("int").alias("last"),
            F.when(~done, e["ratio"]).alias("ratio"), F.when(done, F.lit(0)).otherwise(total).cast("bigint").alias("sum"),
        )

    ids = F.aggregate(events, seed, step)["ids"]

    def mark(n: Column, i: Column) -> Column:
        before, after = F.get(ids, i - 1), F.get(ids, i + 1)
        first, last = ~n.eqNullSafe(before), ~n.eqNullSafe(after)
        return F.when(n == 0, F.lit(None)).when(first & last, F.lit("both")).when(first, F.lit("start")).when(last, F.lit("stop"))

    return F.transform(ids, mark)
