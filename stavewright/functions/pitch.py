"""Spelled pitches, intervals and keys as Column expressions. Steps are letters, intervals two columns (letters, semitones)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stavewright.functions.fixed import FIFTHS, INTERVALS, QUALITIES, SEMITONES, STEPS, TRANSPOSITIONS


def _at(values: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def floor_div(x: Column, n: int) -> Column:
    """``x / n`` rounded down, also below zero."""
    return F.floor(x / F.lit(n)).cast("int")


def step_index(step: Column) -> Column:
    """0 for C to 6 for B; NULL for anything else."""
    i = F.array_position(F.array(*map(F.lit, STEPS)), step).cast("int")
    return F.when(i > 0, i - 1)


def step_at(index: Column) -> Column:
    return _at(STEPS, F.pmod(index, F.lit(7)))


def natural(step: Column) -> Column:
    """Semitones above C."""
    return _at(SEMITONES, step_index(step))


def midi(step: Column, alter: Column, octave: Column) -> Column:
    return (F.lit(12) * (octave + 1) + natural(step) + alter).cast("int")


def fifths(step: Column, alter: Column) -> Column:
    """Place on the line of fifths."""
    return (_at(FIFTHS, step_index(step)) + F.lit(7) * alter).cast("int")


def from_fifths(position: Column) -> tuple[Column, Column]:
    """``(step, alter)`` of a place on the line of fifths."""
    step = step_at(position * 4)
    return step, floor_div(position - _at(FIFTHS, step_index(step)), 7)


def transpose(step: Column, alter: Column, octave: Column, letters: Column, semitones: Column) -> tuple[Column, Column, Column]:
    """The pitch an interval away, spelled by its letter; the accidental makes up the semitones."""
    index = step_index(step) + letters
    to, up = step_at(index), (octave + floor_div(index, 7)).cast("int")
    return to, (midi(step, alter, octave) + semitones - midi(to, F.lit(0), up)).cast("int"), up


def between(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """The interval from pitch ``a`` to pitch ``b``."""
    return (step_index(b[0]) - step_index(a[0]) + 7 * (b[2] - a[2])).cast("int"), (midi(*b) - midi(*a)).cast("int")


def negate(letters: Column, semitones: Column) -> tuple[Column, Column]:
    """The same interval the other way."""
    return -letters, -semitones


def compose(a: tuple[Column, Column], b: tuple[Column, Column], octaves: int = 0) -> tuple[Column, Column]:
    """One interval after another, and whole octaves."""
    return a[0] + b[0] + 7 * octaves, a[1] + b[1] + 12 * octaves


def interval(name: str) -> tuple[Column, Column]:
    """``perfect_fifth`` and the like, or an instrument's transposition such as ``major_ninth_down``."""
    return tuple(map(F.lit, INTERVALS.get(name) or TRANSPOSITIONS[name]))


def is_unison(letters: Column, semitones: Column) -> Column:
    return (letters == 0) & (semitones == 0)


def fifths_delta(letters: Column, semitones: Column) -> Column:
    """What an interval adds to a key signature: where it takes C."""
    to = transpose(F.lit("C"), F.lit(0), F.lit(4), letters, semitones)
    return fifths(to[0], to[1])


def transpose_key(key: Column, letters: Column, semitones: Column) -> Column:
    """A key signature moved by an interval, respelled into -7..7; NULL stays NULL."""
    moved = key + fifths_delta(letters, semitones)
    over = F.greatest(F.ceil((F.abs(moved) - 7) / 12), F.lit(0)).cast("int")
    return (moved - F.signum(moved).cast("int") * 12 * over).cast("int")


def key_interval(start: Column, goal: Column, direction: str = "nearest") -> tuple[Column, Column]:
    """The interval between two keys' tonics ``up``, ``down`` or to the ``nearest`` (down on a tie)."""
    if direction not in ("up", "down", "nearest"):
        raise ValueError(f"no direction {direction!r}")
    a, b = from_fifths(start), from_fifths(goal)
    d, c = between((*a, F.lit(4)), (*b, F.lit(4)))
    up = F.when(c < 0, 1).otherwise(0)
    down = F.when(c > 0, -1).otherwise(0)
    octaves = {"up": up, "down": down, "nearest": F.when(F.abs(c + 12 * up) < F.abs(c + 12 * down), up).otherwise(down)}[direction]
    return (d + 7 * octaves).cast("int"), (c + 12 * octaves).cast("int")


def interval_name(letters: Column, semitones: Column) -> Column:
    """``M2 down``, ``m3 + 1 octave up``, ``2 octaves down``, ``unison``; unheard-of ones as ``3d/7c``."""
    down = (letters < 0) | (semitones < 0)
    d, c = F.when(down, -letters).otherwise(letters), F.when(down, -semitones).otherwise(semitones)
    # Whole octaves are counted toward zero.
    octaves = F.when(d >= 0, F.floor(d / 7)).otherwise(-F.floor(-d / 7)).cast("int")
    d0, c0 = d - 7 * octaves, c - 12 * octaves
    quality = F.concat(d0.cast("string"), F.lit("d/"), c0.cast("string"), F.lit("c"))
    for (x, y), name in QUALITIES.items():
        quality = F.when((d0 == x) & (c0 == y), F.lit(name)).otherwise(quality)
    count = F.concat(octaves.cast("string"), F.when(octaves == 1, F.lit(" octave")).otherwise(F.lit(" octaves")))
    label = F.when(octaves == 0, quality).when(quality == "P1", count).otherwise(F.concat(quality, F.lit(" + "), count))
    return F.when((letters == 0) & (semitones == 0), F.lit("unison")).otherwise(F.concat(label, F.when(down, F.lit(" down")).otherwise(F.lit(" up"))))


def key_name(key: Column) -> Column:
    """The major key of a signature: ``B♭ major``, written ``Bb major``."""
    step, alter = from_fifths(key)
    return F.concat(step, F.when(alter > 0, F.lit("#")).otherwise(F.lit("")), F.when(alter > 1, F.lit("#")).otherwise(F.lit("")), F.when(alter < 0, F.lit("b")).otherwise(F.lit("")), F.when(alter < -1, F.lit("b")).otherwise(F.lit("")), F.lit(" major"))


def midi_name(note: Column) -> Column:
    """``C4`` for 60, sharps for black keys."""
    names = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
    return F.concat(_at(names, F.pmod(note, F.lit(12))), (floor_div(note, 12) - 1).cast("string"))
