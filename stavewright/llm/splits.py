"""Problem 5: splits that keep related records together.

What ties two rows is an attribute they share (a composer, a catalogue number, a
key). Groups are the connected components, found by Boruvka-style contraction: every
component picks its least edge, these edges join the spanning forest, components
contract, and the edges that remain between components go on. Components at least
halve each round. Whole groups are then dealt systematically to the splits, one size
band after the other.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavewright.operators.ranking import prefix_sums
from stavewright.storage import materialize

# What stands in a composer field when nobody is named.
PLACEHOLDERS = ["", "unknown", "traditional", "trad", "anon", "anonymous", "anonym", "na", "n a", "composer", "unbekannt", "various", "none", "null", "nobody", "not known", "tbd"]
# Words of five letters that stand before a number in titles and are no siglum.
FORMS = (
    "canon fugue fugen march suite dance tanze motet polka waltz valse etude study rondo ronde round gigue galop tango samba mambo blues reels carol chant hymns psalm songs lieds music piece arias opera "
    "octet nonet trios duets kyrie credo mater missa masse messe laude noels elegy idyll ballo scale drill grade level cycle entry intro tempo largo lento grave motto theme scene score parts verse books "
    "livre folio tomus teile hefte seite blatt table plate group track staff satze april album piano organ orgel viola cello flute horns brass tenor canto basso voice choir "
    "major minor sharp circa about after until"
).split()
# Letters with a stroke and the like, which have no decomposition, and those that stand for two.
STROKED = "øłđðħŧıɨƀɉ"
STROKED_AS = "olddhtiibj"
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe"}


def _base(c: str) -> str | None:
    """The letter that is left of ``c`` without its marks, if there are any."""
    first, *rest = unicodedata.normalize("NFD", c)
    first = dict(zip(STROKED, STROKED_AS)).get(first, first)
    return first if first != c and all(unicodedata.category(x)[0] == "M" for x in rest) else None


_BASES = {c: b for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) in ("Ll", "Lo") and (b := _base(c))}
ACCENTED, PLAIN = "".join(_BASES), "".join(_BASES.values())


def _folded(x: Column) -> Column:
    # Marks that stand alone go first, then letters that carry one.
    plain = F.translate(F.regexp_replace(F.lower(x), r"\p{M}+", ""), ACCENTED, PLAIN)
    return reduce(lambda y, c: F.replace(y, F.lit(c), F.lit(DOUBLE[c])), DOUBLE, plain)


def composer_ties(composer: Column) -> Column:
    """``array<struct<attr, short>>``: what a composer field ties by.

    "Given Family", "Family, Given", years in brackets and "composed by" are read; up
    to any number of names divided by ``/ & ;`` or "and". In either order the family is
    its last word: "Given van X", "van X, Given" and "X, Given van" are one. The whole given name ties as
    ``f|family|given``, an initial as ``i|family|x`` with ``short`` true. Whole names
    also offer their initial (``short`` false): it ties only where somebody wrote it short.
    """
    plain = F.trim(F.regexp_replace(_folded(composer), r"[\s ]+", " "))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)|\[[^\]]*\]", " "), r"^\s*(?:composed by|composer:|music by)\s+", "")
    nobody = F.trim(F.regexp_replace(F.regexp_replace(_folded(composer), r"[^\p{L}]+", " "), " +", " ")).isin(PLACEHOLDERS)

    def one(name: Column) -> Column:
        turned = F.trim(F.when(F.contains(name, F.lit(",")), F.concat(F.regexp_extract(name, r"^[^,]*,(.*)$", 1), F.lit(" "), F.regexp_extract(name, r"^([^,]*),", 1))).otherwise(name))
        words_of = lambda x: F.filter(F.split(F.regexp_replace(x, r"[^\p{L}\p{N}'-]+", " "), " "), lambda w: w != "")
        words = words_of(turned)
        # The family is the last word before a comma, else the last of all.
        family = F.try_element_at(words_of(F.regexp_extract(name, r"^([^,]*)", 1)), F.lit(-1))
        given = F.when(F.size(words) > 1, F.get(words, F.lit(0))).otherwise(F.lit(""))
        return F.struct(family.alias("family"), given.alias("given"), F.size(words).alias("n"))

    names = F.filter(F.transform(F.split(plain, r"\s*(?:[/&;]|\sand\s)\s*"), one), lambda s: (s["n"] > 0) & s["family"].isNotNull() & (s["family"] != ""))
    tie = lambda kind, s, g, short: F.struct(F.concat(F.lit(f"{kind}|"), s["family"], F.lit("|"), g).alias("attr"), F.lit(short).alias("short"))
    whole = F.transform(F.filter(names, lambda s: F.length(s["given"]) != 1), lambda s: tie("f", s, s["given"], False))
    long_ = F.transform(F.filter(names, lambda s: F.length(s["given"]) > 1), lambda s: tie("i", s, F.left(s["given"], F.lit(1)), False))
    short = F.transform(F.filter(names, lambda s: F.length(s["given"]) == 1), lambda s: tie("i", s, s["given"], True))
    return F.when(composer.isNull() | nobody, F.array().cast("array<struct<attr:string,short:boolean>>")).otherwise(F.concat(whole, long_, short))


def title_tie(title: Column) -> Column:
    """``t|siglum|number`` of the catalogue number in a title, else NULL.

    A siglum is five letters that aren't one of ``FORMS``; ``no.``, a dot, a hyphen, a space or nothing may stand before the number.
    """
    found = r"(?i)(?<![\p{L}\p{N}])(?!" + "|".join(FORMS) + r")([a-z]{5})(?:\s*no\.?\s*|\s*[.-]\s*|\s*)0*([0-9]+)(?![0-9\p{L}])"
    return F.when(F.rlike(title, F.lit(found)), F.lower(F.concat(F.lit("t|"), F.regexp_extract(title, found, 1), F.lit("|"), F.regexp_extract(title, found, 2))))


def key_tie(key: Column) -> Column:
    """``k|name`` of a file key without case and extension, else NULL."""
    bare = F.lower(F.regexp_replace(F.trim(key), r"(?<=.)\.[^.]*$", ""))
    return F.when(bare != "", F.concat(F.lit("k|"), bare))


def ties(scores: DataFrame) -> DataFrame:
    """``(id, attr, short)`` of every row of ``scores`` (``score_id, composer, title, key``)."""
    single = lambda c: F.when(c.isNotNull(), F.array(F.struct(c.alias("attr"), F.lit(False).alias("short")))).otherwise(F.array().cast("array<struct<attr:string,short:boolean>>"))
    every = F.concat(composer_ties(F.col("composer")), single(title_tie(F.col("title"))), single(key_tie(F.col("key"))))
    return scores.where("score_id is not null").select(F.col("score_id").cast("bigint").alias("id"), F.explode(every).alias("t")).select("id", "t.attr", "t.short")


def star_edges(tied: DataFrame) -> DataFrame:
    """``(u, v)``: each row to the smallest id that shares an attribute; as many edges as ties, not as pairs.

    The smallest id is an aggregate, combined before the shuffle. It comes back by an
    equi-join whose one side has a row an attribute, so AQE can split a hot one.
    """
    hubs = tied.groupBy("attr").agg(F.min("id").alias("v"), F.max("id").alias("most"), F.max("short").alias("anyone_short")).where("v <> most AND (anyone_short OR NOT startswith(attr, 'i|'))")
    return tied.select("id", "attr").join(hubs.select("attr", "v"), "attr").where("id <> v").select(F.col("id").alias("u"), "v").distinct()


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(labels, forest)`` of the graph with edges ``(u, v)``: ``node, root`` and the edges chosen.

    Edges are compared by (smaller end, greater end), a strict order, so the choices
    of one round form trees but for pairs that chose the same edge; the smaller of such
    a pair is a root. Trees are flattened by pointer doubling. The root of the end is
    the smallest node of its component. Everything between rounds is written to the
    shared folder. No edges: two empty tables.
    """
    edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    labels = materialize(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    live = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v")
    forest = []
    for turn in range(max_rounds + 1):
        if turn == max_rounds:
            raise RuntimeError(f"components still contract after {max_rounds} rounds")
        ends = live.select("a", "b", "u", "v").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v"))
        chosen = materialize(ends.groupBy("a").agg(F.min(F.struct("u", "v", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.u").alias("u"), F.col("m.v").alias("v")), f"chosen{turn}")
        if chosen.isEmpty():
            break
        forest.append(chosen.select("u", "v"))
        back = chosen.select(F.col("a").alias("x"), F.col("b").alias("y"))
        # a chose b: a's parent is b, unless b chose a too and a is the smaller.
        parents = chosen.join(back, F.col("b") == F.col("x"), "left").select("a", F.when((F.col("y") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("p"))
        while True:
            parents = materialize(parents, f"parents{turn}")
            up = parents.select(F.col("a").alias("x"), F.col("p").alias("y"))
            joined = parents.join(up, F.col("p") == F.col("x")).select("a", F.col("y").alias("p"), (F.col("y") != F.col("p")).alias("moved"))
            joined = materialize(joined, f"doubled{turn}")
            parents = joined.select("a", "p")
            if joined.where("moved").isEmpty():
                break
        step = parents.select(F.col("a").alias("x"), F.col("p").alias("y"))
        labels = materialize(labels.join(step, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root")), f"labels{turn}")
        for side in "ab":
            live = live.join(step, F.col(side) == F.col("x"), "left").withColumn(side, F.coalesce("y", side)).drop("x", "y")
        # Of the edges between two components only the least can ever be chosen.
        live = live.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("u", "v")).alias("m")).select("a", "b", "m.u", "m.v")
        live = materialize(live, f"live{turn}")
    smallest = labels.groupBy("root").agg(F.min("node").alias("least"))
    labels = materialize(labels.join(smallest, "root").select("node", F.col("least").alias("root")), "labels")
    chosen = reduce(DataFrame.unionByName, forest) if forest else edges
    return labels, materialize(chosen.distinct(), "forest")


def groups(scores: DataFrame) -> DataFrame:
    """``(score_id, group_id)``: every row, with the smallest ``score_id`` it is tied to, itself at last.

    NULL, blank and placeholder values tie nothing; NULL ids are left out; rows with
    one id are one row.
    """
    labels, _ = spanning_forest(star_edges(materialize(ties(scores), "ties")))
    every = scores.where("score_id is not null").select(F.col("score_id").cast("bigint").alias("score_id")).distinct()
    return every.join(labels, F.col("score_id") == F.col("node"), "left").select("score_id", F.coalesce("root", "score_id").alias("group_id"))


def deal(grouped: DataFrame, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """``(score_id, group_id, split)``: whole groups dealt to ``shares`` (name to proportion of the rows).

    Groups are stratified by size (bands of powers of two), and bands dealt from the
    largest sizes down. Within a band every 1/share-th group in a seeded order goes to a
    split; a band's shares are what the splits still lack, in rows, so small groups make
    good what larger ones missed. Every split gets groups of all sizes it has room for
    and is off in the end by about one group of the smallest size, unless few groups
    hold most rows: one larger than what any split lacks goes where most is missing.
    Ranks within a band come from range partitions: the band of single rows is as large
    as the table. The driver sees three numbers a band.
    """
    names = list(shares)
    if not names or abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares must be proportions that sum to 1")
    spark = grouped.sparkSession
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("size")).withColumn("band", F.floor(F.log2("size")).cast("int")).withColumn("order", F.xxhash64("group_id", F.lit(seed)))
    ranked = materialize(prefix_sums(sizes, ["band"], ["order", "group_id"], F.lit(1), "rank"), "ranked", "band")
    bands = ranked.groupBy("band").agg(F.sum("size").alias("rows"), F.count("*").alias("groups")).orderBy(F.desc("band")).collect()  # a row a power of two
    total, plan = sum(r.rows for r in bands), []
    lack = {x: shares[x] * total for x in names}
    for r in bands:
        # Who has room for a group of this size; if nobody has, who lacks most.
        room = {x: n for x, n in lack.items() if n >= 1 << r.band} or {max(names, key=lack.get): 1.0}
        mine = {x: room.get(x, 0.0) / sum(room.values()) for x in names}
        plan.append((r.band, [mine[x] for x in names]))
        got = _systematic(ranked.where(F.col("band") == r.band), spark.createDataFrame(plan[-1:], "b int, q array<double>"), names, seed).groupBy("split").agg(F.sum("size").alias("rows")).collect()
        for x in got:
            lack[x.split] -= x.rows
    dealt = _systematic(ranked, spark.createDataFrame(plan, "b int, q array<double>"), names, seed).select("group_id", "split")
    return grouped.join(dealt, "group_id").select("score_id", "group_id", "split")


def _systematic(ranked: DataFrame, plan: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Adds ``split``: by its rank, a group falls on one of the marks that a band's shares ``q`` set in even steps.

    The first name takes every 1/share-th group, from a place within its first interval;
    the next does so among those that are left, and so on; the last takes the rest.
    """
    ranked = ranked.join(F.broadcast(plan), F.col("band") == F.col("b"))  # a row a band
    rest, left, split, free = F.col("rank").cast("double"), F.lit(1.0), F.lit(None).cast("string"), F.lit(True)
    for i, name in enumerate(names[:-1]):
        start = F.lit(((seed + i) * 0.6180339887498949) % 1.0)
        q = F.get("q", F.lit(i))
        share = F.when(left > 1e-12, F.least(q / left, F.lit(1.0))).otherwise(0.0)
        before = F.floor(rest * share + start)
        taken = free & (F.floor((rest + 1) * share + start) > before)
        split = F.when(taken, F.lit(name)).otherwise(split)
        free, rest, left = free & ~taken, rest - before, left - q
    return ranked.withColumn("split", F.coalesce(split, F.lit(names[-1])))
