"""Polynomials as maps from exponent to coefficient, and sets of blocks as ascending arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(terms: Column) -> Column:
    """A polynomial of an array of (exponent, coefficient); the exponents must descend strictly."""
    falling = F.forall(F.sequence(F.lit(1), F.size(terms) - 1), lambda k: F.get(terms, k)["exponent"] < F.get(terms, k - 1)["exponent"])
    return F.when((F.size(terms) > 1) & ~falling, F.raise_error(F.lit("exponents must strictly decrease")).cast("map<bigint,bigint>")).otherwise(F.map_from_entries(terms))


def op(p: Column, q: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Terms of either polynomial, ``f`` of both coefficients where they share an exponent. Zeros stay."""
    return F.map_zip_with(p, q, lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b)))


def add(p: Column, q: Column) -> Column:
    return op(p, q, lambda a, b: a + b)


def ior(p: Column, q: Column) -> Column:
    return op(p, q, lambda a, b: a.bitwiseOR(b))


def union(a: Column, b: Column) -> Column:
    """The union of two sets of blocks, ascending."""
    return F.array_sort(F.array_union(a, b))


def scale(color: Column, w: Column) -> Column:
    """A weighted color, every weight times ``w``."""
    return F.transform_values(color, lambda _, x: x * w)


def combine(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    """``wa`` times one weighted color plus ``wb`` times another."""
    return op(scale(a, wa), scale(b, wb), lambda x, y: x + y)


def terms(p: Column) -> Column:
    """A polynomial's entries, largest exponent first."""
    return F.sort_array(F.map_entries(p), False)
