"""Instrument names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(name: Column) -> Column:
    """Lower case, flats as b and sharps as #, and nothing but letters, digits and #."""
    return F.regexp_replace(F.replace(F.replace(F.lower(name), F.lit("♭"), F.lit("b")), F.lit("♯"), F.lit("#")), "[^a-z0-9#]", "")


def base_name(path: Column) -> Column:
    """What follows the last slash; not unique across directories."""
    return F.element_at(F.split(path, "/"), -1)
