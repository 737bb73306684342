"""Problem 3: mixing sources to target weights.

A member that must contribute T tokens and has S is taken floor(T / S) times in full
(at most ``max_repeats``), and the rest by balanced sampling: every sequence has the
inclusion probability that is left over, and the cube method moves these
probabilities through the null space of two constraints, the tokens and the number
of documents, until all but a few are 0 or 1. Only those few are then rounded, along
the one constraint of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavewright.storage import materialize, ship

# How the index spells the formats.
SPELLINGS = {"kern": "kern", "krn": "kern", "musicxml": "musicxml", "xml": "musicxml", "mxl": "mxl"}
_SURE = 1e-9


def plain_format(spelt: Column) -> Column:
    """One spelling of a format; unknown ones keep their letters, NULL and blank are NULL."""
    letters = F.regexp_replace(F.lower(spelt), "[^a-z0-9]", "")
    known = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.when(letters != "", F.coalesce(F.try_element_at(known, letters), letters))


def member_sequences(tokens_bin: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``(by_field, member, seq_id, n)``: each sequence once for its source and once for its format.

    A format the index lacks is the source's. ``n`` is the number of ids stored (0 for
    NULL and empty); what the index says of tokens is not believed. Sequences that
    only one of the two tables has are left out.
    """
    given = sources.groupBy("source").agg(F.min("format").alias("given"))
    listed = entries.where("seq_id is not null").select("seq_id", "source", "format").join(given, "source", "left")
    members = listed.select("seq_id", F.explode(F.array(F.struct(F.lit("source").alias("by_field"), F.col("source").alias("member")), F.struct(F.lit("format").alias("by_field"), F.coalesce(plain_format(F.col("format")), plain_format(F.col("given"))).alias("member")))).alias("m"))
    members = members.select("seq_id", "m.*").where("member is not null").distinct()
    sizes = tokens_bin.select("seq_id", F.coalesce(F.when(F.col("tokens").isNotNull(), F.size("tokens")), F.lit(0)).cast("bigint").alias("n"))
    sizes = sizes.groupBy("seq_id").agg(F.max("n").alias("n"))  # a row that occurs twice is one sequence
    return members.join(sizes, "seq_id").select("by_field", "member", "seq_id", "n")


def flight(p: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` to 0s and 1s, keeping sum(p) and sum(p * n), until at most two are left between.

    Three undecided units a, b, c span one direction that keeps both sums:
    (n_b - n_c, n_c - n_a, n_a - n_b), or (1, -1, 0) if their sizes are equal. A step
    along it, to one side or the other so that probabilities stay what they were on
    average, decides at least one of them; the next unit takes its place.
    """
    p = p.astype(float).tolist()
    n = n.astype(float).tolist()
    waiting = iter([i for i, x in enumerate(p) if _SURE < x < 1 - _SURE])
    held: list[int] = []
    draws: Iterator[float] = iter(())
    while True:
        while len(held) < 3 and (i := next(waiting, None)) is not None:
            held.append(i)
        if len(held) < 3:
            return np.array(p)
        a, b, c = held
        u = (n[b] - n[c], n[c] - n[a], n[a] - n[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u) if x)
        if (draw := next(draws, None)) is None:
            draws = iter(rng.random(1024).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for i, x in zip(held, u):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] <= _SURE or p[i] >= 1 - _SURE:
                p[i] = round(p[i])
        held = [i for i in held if 0 < p[i] < 1]


def land(p: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the few that are left: the number of documents is let go first, the tokens last.

    Two undecided units still span a direction that keeps their tokens, (n_b, -n_a);
    along it one is decided. Only the last one is drawn, so the tokens are off by less
    than that one unit.
    """
    p = p.copy()
    left = [i for i in range(len(p)) if _SURE < p[i] < 1 - _SURE]
    while len(left) > 1:
        a, b = left[:2]
        u = (float(n[b]), -float(n[a])) if n[a] or n[b] else (1.0, -1.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip((a, b), u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip((a, b), u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip((a, b), u):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
        left = [i for i in left if _SURE < p[i] < 1 - _SURE]
    for i in left:
        p[i] = float(rng.random() < p[i])
    return np.round(p)


def _decide(units: DataFrame, blocks: Column, last: bool, seed: int, turn: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Large ones first: what is left at the end, and landed, is small.
        pdf = pdf.sort_values(["n", "seq_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, turn, int(key[0]), int(key[2]), *str(key[1]).encode()])
        p = flight(pdf["p"].to_numpy(), pdf["n"].to_numpy(), rng)
        return pdf.assign(p=land(p, pdf["n"].to_numpy(), rng) if last else p)[["mix_id", "member", "seq_id", "n", "p", "blocks"]]

    salted = units.withColumn("block", F.pmod(F.xxhash64("seq_id", F.lit(seed + turn)), blocks))
    return salted.groupBy("mix_id", "member", "block").applyInPandas(run, "mix_id int, member string, seq_id bigint, n bigint, p double, blocks bigint")


def mix(targets: DataFrame, members: DataFrame, *, block: int = 8192, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(selection, report)`` of every mix in ``targets``.

    ``targets``: ``mix_id, by_field, member, target_share, max_repeats,
    budget_tokens``; ``members`` as from :func:`member_sequences`. ``selection``:
    ``mix_id, member, seq_id, n, copies`` (only copies above 0). ``report``: a row a
    target with ``n_docs, n_tokens`` (the member's size), ``used_tokens``,
    ``actual_share`` (of the mix as it came out; NULL if that is empty), ``reachable``,
    ``mix_tokens`` and ``short_tokens`` (what the whole mix has, and lacks of its
    budget: what members lack that can't reach their share isn't given to others).

    A member that isn't in ``members`` has size 0. A member that can't reach its share
    is used ``max_repeats`` times in full. NULL shares, budgets or repeats count as 0.
    Equal rows of ``targets`` are one.

    Sampling runs in salted blocks of about ``block`` units, so a member with a third
    of all rows is many groups; what each block leaves undecided (two units at most)
    is sampled again, in ever fewer blocks, and only a group's last block is landed.
    Every draw depends on seed, group and sorted units alone: a lost task repeats it.
    """
    spark = targets.sparkSession
    ship(spark)
    zero = {"target_share": 0.0, "max_repeats": 0, "budget_tokens": 0}
    wanted = targets.select(F.col("mix_id").cast("int").alias("mix_id"), "by_field", "member", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"), F.col("budget_tokens").cast("bigint").alias("budget_tokens")).fillna(zero).distinct()
    members = materialize(members, "members")
    sizes = members.groupBy("by_field", "member").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
    plan = (
        wanted.join(sizes, ["by_field", "member"], "left").fillna({"n_docs": 0, "n_tokens": 0})
        .withColumn("target_tokens", F.col("target_share") * F.col("budget_tokens"))
        .withColumn("reachable", ~(F.col("max_repeats") * F.col("n_tokens") < F.col("target_tokens")))
        .withColumn("times", F.when(F.col("n_tokens") > 0, F.col("target_tokens") / F.col("n_tokens")).otherwise(F.lit(0.0)))
        .withColumn("full", F.least(F.floor("times"), F.col("max_repeats")))
        .withColumn("p", F.when(F.col("full") < F.col("max_repeats"), F.col("times") - F.col("full")).otherwise(F.lit(0.0)))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("bigint"))
    )
    plan = materialize(plan, "plan")  # a row a target
    units = members.join(plan.select("mix_id", "by_field", "member", "full", "p", "blocks").where("full > 0 or p > 0"), ["by_field", "member"])
    full = units.where("full > 0").select("mix_id", "member", "seq_id", "n", F.col("full").alias("copies"))
    open_ = units.where(f"p > {_SURE}").select("mix_id", "member", "seq_id", "n", "p", "blocks")
    most = plan.agg(F.max("blocks")).first()[0] or 1
    chosen, turn = [], 0
    while True:
        last = most == 1
        state = materialize(_decide(open_, F.col("blocks"), last, seed, turn), f"cube{turn}")
        chosen.append(state.where(f"p > {1 - _SURE}").select("mix_id", "member", "seq_id", "n", F.lit(1).cast("bigint").alias("copies")))
        if last:
            break
        # At most two units a block go on.
        open_ = state.where(f"p > {_SURE} and p < {1 - _SURE}").withColumn("blocks", F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / block)).cast("bigint"))
        most, turn = max(1, -(-2 * most // block)), turn + 1
    once = chosen[0]
    for c in chosen[1:]:
        once = once.unionByName(c)
    selection = full.unionByName(once).groupBy("mix_id", "member", "seq_id").agg(F.max("n").alias("n"), F.sum("copies").alias("copies"))
    selection = materialize(selection, "selection")
    used = selection.groupBy("mix_id", "member").agg(F.sum(F.col("n") * F.col("copies")).alias("used_tokens"))
    total = selection.groupBy("mix_id").agg(F.sum(F.col("n") * F.col("copies")).alias("mix_tokens"))
    report = plan.join(used, ["mix_id", "member"], "left").join(total, "mix_id", "left").fillna({"used_tokens": 0, "mix_tokens": 0}).withColumn("short_tokens", F.col("budget_tokens") - F.col("mix_tokens")).withColumn("actual_share", F.try_divide(F.col("used_tokens").cast("double"), F.col("mix_tokens").cast("double")))
    return selection, report.select("mix_id", "by_field", "member", "target_share", "max_repeats", "budget_tokens", "n_docs", "n_tokens", "used_tokens", "actual_share", "reachable", "mix_tokens", "short_tokens")
