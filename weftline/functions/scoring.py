"""Prices, ages and fused scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.options import DEFAULTS, Options


def _lookup(table: dict, key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def edge_price(relation: Column, weight: Column, options: Options = DEFAULTS) -> Column:
    """Price of the relation (the generic one's, if unknown) times the weight (1, if unknown)."""
    return _lookup(dict(options.prices), relation, options.prices[options.generic_relation]) * F.coalesce(weight, F.lit(1.0))


def age_days(ts: Column, now: Column) -> Column:
    """Days since ``ts``, not below 0; null where it is unknown (null or the epoch itself)."""
    seconds = F.unix_micros(ts.cast("timestamp")) / 1e6
    return F.when(seconds != 0, F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) / 1e6 - seconds) / 86400.0))


def decay(ts: Column, kind: Column, now: Column, options: Options = DEFAULTS) -> Column:
    """Halves with each half-life of the type, not below the floor; 1 for an unknown age."""
    half = _lookup(dict(options.half_life_days), kind, options.default_half_life)
    age = age_days(ts, now)
    return F.when(age.isNull(), 1.0).otherwise(F.greatest(F.lit(options.recency_floor), F.pow(F.lit(0.5), age / half)))


def fused(vector: Column, graph: Column, recency: Column, intent: str, options: Options = DEFAULTS) -> Column:
    a, b = options.weights["relational" if intent == "relational" else "semantic"]
    return (F.coalesce(vector, F.lit(0.0)) * a + F.coalesce(graph, F.lit(0.0)) * b) * recency
