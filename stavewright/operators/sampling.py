"""What a training loop reads: windows, batches, samples, packed shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavewright.operators.ranking import prefix_sums


def next_token_windows(sequences: DataFrame, length: int, key: str = "seq_id") -> DataFrame:
    """``(key, start, inputs, targets)``: every run of ``length`` ids and the same run one later; shorter sequences have none."""
    n = F.size("tokens") - length
    starts = sequences.where(F.size("tokens") > length).select(key, "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    return starts.select(key, "start", F.slice("tokens", F.col("start") + 1, length).alias("inputs"), F.slice("tokens", F.col("start") + 2, length).alias("targets"))


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Add the 0-based place of each row in ``order``."""
    return prefix_sums(df, [], order, F.lit(1), name)


def cyclic_batches(indexed: DataFrame, n_rows: int, batch: int, steps: int, name: str = "idx") -> DataFrame:
    """``(step, slot, ..row)``: step s takes rows s*batch .. s*batch+batch-1, starting over at the end."""
    spark = indexed.sparkSession
    slots = spark.range(batch * steps).select(F.floor(F.col("id") / batch).cast("int").alias("step"), (F.col("id") % batch).cast("int").alias("slot"), (F.col("id") % max(n_rows, 1)).alias(name))
    return slots.join(indexed, name)


def sample_with_replacement(df: DataFrame, order: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows drawn uniformly with replacement, the same for the same seed; fails on an empty table."""
    indexed = dense_index(df, order)
    total = indexed.count()
    if not total:
        raise ValueError("cannot sample from an empty corpus")
    # A hash of the draw's number, not rand(): a task that is run again draws the same.
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("idx"))
    return draws.join(indexed, "idx").drop("idx")


def byte_offsets(entries: DataFrame, keys: list[str], order: list[str], tokens: str = "tokens", name: str = "byte_offset") -> DataFrame:
    """Add where each entry begins in its shard: two bytes for every id before it; NULL tokens take no room."""
    return prefix_sums(entries, keys, order, F.col(tokens) * 2, name)


def packed_windows(entries: DataFrame, order: list[str], window: int, tokens: str = "tokens") -> DataFrame:
    """Add ``first_window``, ``offset`` and ``last_window`` of each sequence when all are laid end to end and cut every ``window`` ids."""
    placed = prefix_sums(entries, [], order, F.col(tokens), "_at")
    n = F.coalesce(F.col(tokens), F.lit(0))
    div = lambda x: F.call_function("div", x, F.lit(window).cast("bigint"))
    return placed.select(*entries.columns, div(F.col("_at")).alias("first_window"), (F.col("_at") % window).alias("offset"), div(F.col("_at") + F.greatest(n, F.lit(1)) - 1).alias("last_window"))


def clean_first(df: DataFrame, group: list[str], tainted: Column, order: list[Column]) -> DataFrame:
    """One row a group: one that isn't ``tainted`` if there is any, else the best of the rest. NULL taints."""
    rank = F.struct(F.coalesce(tainted, F.lit(True)).alias("_tainted"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    return df.groupBy(*group).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in group]), rank).alias("_r")).select(*group, "_r.*")


def pack_u16(tokens: Column) -> Column:
    """The ids as little-endian 16-bit binary; NULL for NULL, and where an id is NULL or has more than 16 bits."""

    @F.pandas_udf("binary")
    def pack(lists: pd.Series) -> pd.Series:
        def one(ids) -> bytes | None:
            if ids is None or ids.dtype.kind != "i" and len(ids) or len(ids) and not 0 <= ids.min() <= ids.max() < 1 << 16:
                return None
            return ids.astype("<u2").tobytes()

        return lists.map(one)

    return pack(tokens)


def unpack_u16(content: Column) -> Column:
    """The ids of little-endian 16-bit binary; an odd last byte is none."""

    @F.pandas_udf("array<int>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<u2", count=len(b) // 2).astype(np.int32))

    return unpack(content)
