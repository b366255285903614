"""Order-dependent folds over the array of a row: where pieces begin, told from sizes only.

What a fold carries are the places so far and the size of the open piece, so
nothing grows but by a number for each piece; units are cut once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(units: Column, begins: Callable[[Column, Column], Column], size: Callable[[Column], Column]) -> Column:
    """Places where a unit begins a piece by ``begins(acc, unit)``; acc has at, k, size of the open piece and the unit before."""
    none = F.get(F.slice(units, F.lit(1), F.lit(0)), F.lit(0))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("size"), none.alias("before"))

    def step(acc: Column, unit: Column) -> Column:
        new = (acc["k"] == 0) | begins(acc, unit)
        return F.struct(
            F.when(new, F.concat(acc["at"], F.array(acc["k"]))).otherwise(acc["at"]).alias("at"), (acc["k"] + 1).alias("k"),
            F.when(new, size(unit)).otherwise(acc["size"] + size(unit)).alias("size"), unit.alias("before"),
        )

    return F.aggregate(units, start, step, lambda acc: acc["at"])


def packed_at(sizes: Column, most: int | Column, most_units: int | None = None) -> Column:
    """Where pieces begin if units of these sizes are packed in order to at most ``most``; a larger unit is alone."""

    def begins(acc: Column, size: Column) -> Column:
        full = acc["size"] + size > most
        return full if most_units is None else full | (acc["k"] - F.element_at(acc["at"], -1) >= most_units)

    return _fold(sizes, begins, lambda size: size)


def merged_at(facts: Column, below: int) -> Column:
    """Where groups begin if each of ``facts`` (kind, size) joins the group before it of its kind, while both are below a size; a null kind joins none."""

    def begins(acc: Column, x: Column) -> Column:
        return ~F.coalesce((acc["before"]["kind"] == x["kind"]) & (acc["size"] < below) & (x["size"] < below), F.lit(False))

    return _fold(facts, begins, lambda x: x["size"])


def cut_at(units: Column, begins: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of each run of ``units`` that begins at one of the places and ends before the next."""

    def runs(x: Column) -> Column:
        end = lambda i: F.coalesce(F.get(x["at"], i + 1), F.size(x["units"]))
        return F.transform(x["at"], lambda a, i: use(F.slice(x["units"], a + 1, end(i) - a)))

    return bind(F.struct(units.alias("units"), begins.alias("at")), runs)
