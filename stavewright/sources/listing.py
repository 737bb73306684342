"""Listings of score files: canonical paths, source globs, the row to keep for each file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavewright.storage import ship


def glob_to_regex(glob: str) -> str:
    """The Java and Python regular expression (anchored) for a source glob.

    ``**/`` is any number of directories or none, ``*`` and ``?`` stay within one
    name and match no leading dot, ``{a,b}`` are alternatives and ``[0-9]`` a class
    (``[!0-9]`` its complement). Everything else stands for itself.
    """
    out, i, depth = [], 0, 0
    name_start = True
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and name_start:
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        hidden = r"(?!\.)" if name_start else ""
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out.append(hidden + "[^/]*")
        elif c == "?":
            out.append(hidden + "[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            negated = body[:1] in "!^"
            body = body[1:] if negated else body
            out.append(hidden + "(?!/)[" + ("^" if negated else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = end
        elif c == "{" and "}" in glob[i:]:
            out.append("(?:")
            depth += 1
            i += 1
            continue  # an alternative at the start of a name is still at its start
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
            i += 1
            continue
        else:
            out.append(re.escape(c))
        name_start = c == "/"
        i += 1
    return "^" + "".join(out) + "$"


def canonical_path(path: Column, source: Column) -> Column:
    """``path`` below ``data/raw/<source>``, however it was written; NULL if it leads out of there.

    Backslashes count as slashes, empty and ``.`` segments vanish, ``..`` takes the
    segment before it away, and a leading ``data/raw/<source>/`` is dropped.
    """
    segments = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", "."))
    # ".." at the root stays as a mark, which makes the result NULL.
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    flat = F.array_join(walked, "/")
    prefix = F.concat(F.lit("data/raw/"), source, F.lit("/"))
    flat = F.when(F.startswith(flat, prefix), F.substring(flat, F.length(prefix) + 1, 1 << 30)).otherwise(flat)
    return F.when((F.get(walked, F.lit(0)) == "..") | (flat == ""), F.lit(None)).otherwise(flat)


def source_patterns(sources: DataFrame) -> DataFrame:
    """``(source, pattern)``: one regular expression for all globs of a source."""
    ship(sources.sparkSession)

    @F.pandas_udf("string")
    def convert(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: None if g is None else glob_to_regex(g))

    each = sources.where("source is not null and glob is not null").select("source", F.concat(F.lit("(?:"), convert("glob"), F.lit(")")).alias("p"))
    return each.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("p")), "|").alias("pattern"))


def wanted_files(listing: DataFrame, sources: DataFrame) -> DataFrame:
    """The row to keep for each file that its source's globs ask for.

    ``listing`` has ``file_id, source, path, listed_at`` and any further columns;
    ``sources`` has ``source, glob``. Adds ``file_path`` (canonical; it replaces a column
    of that name). Of rows for one
    file the greatest ``listed_at`` wins (NULL is the least), then the greatest
    ``file_id``. Rows with NULL ``file_id``, ``source`` or ``path`` name no file and
    are left out; sources missing from the catalogue ask for nothing.

    The catalogue is joined as Spark sees fit (its statistics decide whether it is
    broadcast). The choice per file is an aggregate over ``(source, file_path)``,
    combined before the shuffle, so neither a hot source nor a file listed a million
    times gathers in one task; only ids and paths travel, and whole rows come back
    through a join on the unique id.
    """
    named = listing.select(F.col("file_id").alias("i"), F.col("source").alias("s"), canonical_path(F.col("path"), F.col("source")).alias("p"), F.col("listed_at").alias("t")).where("i is not null and s is not null and p is not null")
    patterns = source_patterns(sources).select(F.col("source").alias("w"), F.col("pattern").alias("r"))
    wanted = named.join(patterns, F.expr("s = w")).where("p rlike r")
    best = wanted.groupBy("s", "p").agg(F.max(F.struct("t", "i")).alias("b")).select(F.col("b.i").alias("i"), "p")
    kept = listing.alias("l").join(best.alias("k"), F.expr("l.file_id = k.i"))
    return kept.select(*[F.col(f"l.`{c}`") for c in listing.columns if c != "file_path"], F.col("k.p").alias("file_path"))
