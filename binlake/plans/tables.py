"""Keyed merges of frames."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: the one with the highest version.  Combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
            .select(*keys, "_row.*"))


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], defaults: dict | None = None) -> DataFrame:
    """Keyed merge: an incoming non-null value wins, a null one keeps the old value."""
    defaults = defaults or {}
    cols = current.columns
    new = incoming.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in incoming.columns if c not in keys])
    out = current.join(new, keys, "full_outer")
    fields = []
    for c in cols:
        if c in keys:
            fields.append(F.col(c))
            continue
        choices = [F.col(f"_n_{c}")] if c in incoming.columns else []
        choices.append(F.col(c))
        if c in defaults:
            choices.append(F.lit(defaults[c]))
        fields.append(F.coalesce(*choices).alias(c))
    return out.select(*fields)


def overwrite(current: DataFrame, incoming: DataFrame, keys: list[str], defaults: dict | None = None) -> DataFrame:
    """Keyed upsert: an incoming row sets every field it may have; what it lacks becomes the field's default.

    Fields that are neither incoming nor in ``defaults`` keep the stored value.  ``incoming`` has one row per key.
    """
    defaults = defaults or {}
    new = incoming.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in incoming.columns if c not in keys])
    fields = []
    for c in current.columns:
        if c in keys or not (c in incoming.columns or c in defaults):
            fields.append(F.col(c))
            continue
        value = F.col(f"_n_{c}") if c in incoming.columns else F.lit(None)
        if c in defaults:
            value = F.coalesce(value, F.lit(defaults[c]))
        fields.append(F.when(F.col("_new"), value).otherwise(F.col(c)).alias(c))
    return current.join(new, keys, "full_outer").select(*fields)
