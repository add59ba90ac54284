"""Functions of logit vectors (array<double>), all inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(z: Column, top: Column) -> Column:
    """log of the summed exponentials, from the largest entry ``top`` so that none overflows."""
    return top + F.log(_sum(F.transform(z, lambda v: F.exp(v - top))))


def mean(z: Column) -> Column:
    return _sum(z) / F.size(z)


def blend(z: Column, alpha: float) -> Column:
    """Entries moved towards their mean by ``alpha``."""
    return F.transform(F.arrays_zip(z.alias("z"), F.array_repeat(mean(z), F.size(z)).alias("m")), lambda x: x["z"] * (1 - alpha) + x["m"] * alpha)


def argmax(z: Column, top: Column) -> Column:
    """Position of the largest entry, the lowest on ties."""
    return (F.array_position(z, top) - 1).cast("int")


def ranked(z: Column, k: int) -> Column:
    """The k largest entries as structs (less, token_id), less being the negated logit; ties to
    the lower position."""
    return F.slice(F.array_sort(F.transform(z, lambda v, i: F.struct((-v).alias("less"), i.alias("token_id")))), 1, k)


def safe_exp(v: Column) -> Column:
    """exp with fixed ends: 0 below -745, infinity above 700."""
    return F.when(v < -745, F.lit(0.0)).when(v > 700, F.lit(float("inf"))).otherwise(F.exp(v))
