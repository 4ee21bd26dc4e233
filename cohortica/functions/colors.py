"""Palettes by context, for whoever draws the relations of the plots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of our own.
PALETTES = {
    "categorical": ["#1b7f79", "#e07b39", "#5b5f97", "#b8336a", "#8a9a5b", "#444444"],
    "binary": ["#1b7f79", "#e07b39"],
    "sequential_teal": ["#e3f4f2", "#9fd5cf", "#4fb0a7", "#1b7f79", "#0c4a46"],
    "sequential_orange": ["#fdeee2", "#f6c49b", "#ec995b", "#e07b39", "#8f4716"],
    "diverging": ["#0c4a46", "#4fb0a7", "#f7f7f7", "#ec995b", "#8f4716"],
}


def get_colors(context: str = "categorical") -> list[str]:
    """Unknown contexts get the categorical palette."""
    return PALETTES.get(context, PALETTES["categorical"])


def palette(context: Column) -> Column:
    """The colours of a context as an array; unknown and missing ones get the categorical palette."""
    known = F.create_map(*[x for name, colors in PALETTES.items() for x in (F.lit(name), F.array(*map(F.lit, colors)))])
    return F.coalesce(F.try_element_at(known, context), F.array(*map(F.lit, PALETTES["categorical"])))
