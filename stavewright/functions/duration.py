"""Written durations in exact integer divisions, as Column expressions. Always BIGINT: sums leave INT behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stavewright.functions.fixed import BASE, CANONICAL_RATIOS, MAX_DOTS, TUPLET_ACTUALS, TYPES, plain_durations

_SMALLEST = min(BASE.values())


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def divisions(kind: Column, dots: Column, actual: Column, normal: Column) -> Column:
    """Divisions of a duration in a tuplet (NULL, NULL for none); NULL if unknown or not whole."""
    base = F.get(F.array(*[_long(BASE[t]) for t in TYPES]), (F.array_position(F.array(*map(F.lit, TYPES)), kind) - 1).cast("int"))
    base = F.when(kind.isin(TYPES), base)
    legal = dots.between(0, MAX_DOTS) & (actual.isNull() == normal.isNull()) & ((F.coalesce(actual, F.lit(1)) > 0) & (F.coalesce(normal, F.lit(1)) > 0))
    twice = F.get(F.array(*[_long(2 ** (d + 1) - 1) for d in range(MAX_DOTS + 1)]), dots)
    once = F.get(F.array(*[_long(2**d) for d in range(MAX_DOTS + 1)]), dots)
    over, under = base * twice * F.coalesce(normal, F.lit(1)), once * F.coalesce(actual, F.lit(1))
    return F.when(legal & (over % under == 0), F.call_function("div", over, under))


def is_exact(kind: Column, dots: Column, actual: Column, normal: Column) -> Column:
    return divisions(kind, dots, actual, normal).isNotNull()


def from_divisions(n: Column) -> Column:
    """``struct(type, dots)`` of a plain duration, NULL if none has this length."""
    out = F.lit(None).cast("struct<type:string,dots:int>")
    table = plain_durations()
    found = F.array_position(F.array(*[_long(x) for x in table]), n).cast("int")
    values = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(d).alias("dots")) for t, d in table.values()])
    return F.when(found > 0, F.get(values, found - 1)).otherwise(out)


def recip(number: Column) -> Column:
    """A kern reciprocal as ``struct(base, actual, normal)``: its power of two, and the tuplet its odd part makes.

    ``actual`` and ``normal`` are NULL for plain values; the struct is NULL if the odd
    part is no supported tuplet. 0 is a breve and its own base.
    """
    odd = F.when(number == 0, F.lit(1)).otherwise(F.call_function("div", number, F.greatest(number.bitwiseAND(-number), F.lit(1)))).cast("int")
    # The conventional partner is the largest power of two below.
    normal = reduce(lambda acc, p: F.when(odd > p, F.lit(p)).otherwise(acc), [2, 4, 8], F.lit(1))
    plain = F.struct(number.cast("int").alias("base"), F.lit(None).cast("int").alias("actual"), F.lit(None).cast("int").alias("normal"))
    tuplet = F.struct(F.call_function("div", number * normal, F.greatest(odd, F.lit(1))).cast("int").alias("base"), odd.alias("actual"), normal.alias("normal"))
    return F.when(odd == 1, plain).when(odd.isin(TUPLET_ACTUALS), tuplet)


REST = "struct<type:string,dots:int,actual:int,normal:int>"


def _units(ratio: tuple[int, int] | None) -> Column:
    """The undotted rests of a ratio that come out whole, longest first."""
    a, n = ratio or (1, 1)
    sizes = sorted(((BASE[t] * n // a, t) for t in TYPES if BASE[t] * n % a == 0), reverse=True)
    return F.array(*[F.struct(_long(size).alias("size"), F.lit(t).alias("type")) for size, t in sizes])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def greedy(span: Column, units: Column, actual: Column, normal: Column) -> Column:
    """``struct(rests, left)``: ``span`` in ``units``, longest first, and what remains."""
    start = F.struct(F.array().cast(f"array<{REST}>").alias("rests"), span.cast("bigint").alias("left"))

    def take(acc: Column, u: Column) -> Column:
        rest = F.struct(u["type"].alias("type"), F.lit(0).alias("dots"), actual.alias("actual"), normal.alias("normal"))
        times = F.call_function("div", acc["left"], u["size"]).cast("int")
        return F.struct(F.concat(acc["rests"], F.array_repeat(rest, times)).alias("rests"), (acc["left"] % u["size"]).alias("left"))

    return F.aggregate(units, start, take)


def decompose_rests(span: Column) -> Column:
    """A span of divisions as an array of rests, NULL if no rests make it up; 0 is the empty array.

    Plain rests if they suffice. Else, for each canonical ratio in turn: rests of that
    ratio alone, or the fewest of its grains that make the remainder plain.
    """
    nothing, plain = F.lit(None).cast("int"), _units(None)
    whole = lambda g: F.when(g["left"] == 0, g["rests"])
    ratios = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n"), _long(_SMALLEST * n // a).alias("grain"), _units((a, n)).alias("units")) for a, n in CANONICAL_RATIOS])

    def mixed(r: Column, k: Column) -> Column:
        both = F.struct(greedy(span - k * r["grain"], plain, nothing, nothing).alias("x"), greedy(k * r["grain"], r["units"], r["a"], r["n"]).alias("y"))
        return _let(both, lambda g: F.when((g["x"]["left"] == 0) & (g["y"]["left"] == 0), F.concat(g["x"]["rests"], g["y"]["rests"])))

    def attempt(r: Column) -> Column:
        grains = F.filter(F.sequence(F.lit(1), r["a"] - 1), lambda k: (span >= k * r["grain"]) & ((span - k * r["grain"]) % _long(_SMALLEST) == 0))
        return F.coalesce(_let(greedy(span, r["units"], r["a"], r["n"]), whole), _let(F.get(grains, F.lit(0)), lambda k: mixed(r, k)))

    found = F.get(F.filter(F.transform(ratios, attempt), lambda x: x.isNotNull()), F.lit(0))
    return F.when(span >= 0, F.coalesce(_let(greedy(span, plain, nothing, nothing), whole), found))
