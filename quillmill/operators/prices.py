"""Price observations as a time series: trends, and keyed upserts of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A change of the rounded percentage above this is a warning.
WARN_PERCENT = 2.0


def normalize_label(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Unit spellings and the unit each stands for.
UNITS = {"kilogramm": "kg", "kilo": "kg", "kg": "kg", "gramm": "g", "gr": "g", "g": "g", "stuck": "Stück", "stueck": "Stück", "stk": "Stück", "karton": "Karton", "kt": "Karton", "liter": "l", "l": "l"}


def normalize_unit(c: Column) -> Column:
    """The unit that a spelling stands for; an unknown spelling stays, with white space collapsed."""
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.coalesce(F.try_element_at(units, key), normalize_label(c))


def price_trends(obs: DataFrame, keys: list[str], price: str, order: list[str], unit: str | None = None, warn: float = WARN_PERCENT) -> DataFrame:
    """One row for each key: oldest and latest price, change in percent, warning, number of observations.

    ``order`` names the columns that order the observations, with the tie-breakers last.  One aggregation, with
    partial aggregates before the shuffle; no window and no sort of a key's observations.
    """
    at = F.struct(*order)
    change = F.when(F.col("oldest_price") != 0, (F.col("latest_price") - F.col("oldest_price")) / F.col("oldest_price") * 100).otherwise(F.lit(0.0))
    aggs = [F.min_by(price, at).alias("oldest_price"), F.max_by(price, at).alias("latest_price"), F.count("*").alias("data_points")]
    if unit:
        aggs.append(F.max_by(unit, at).alias("unit_name"))
    out = obs.groupBy(*keys).agg(*aggs).withColumn("change_percent", change)
    return out.withColumn("warning", F.round("change_percent", 2) > warn)


def upsert_prices(existing: DataFrame, new: DataFrame, keys: list[str], document: str = "document_id") -> DataFrame:
    """Observations of a document replace those with the same keys but keep their first recorded_at; those without a document are appended.

    Of several new ones with the same keys the last counts, by recorded_at, then by the greatest values.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    named = F.coalesce(F.col(document), F.lit("")) != ""
    group = Window.partitionBy(*keys)
    kept = both.where(named).withColumn("_rn", F.row_number().over(group.orderBy(F.desc("_new"), F.desc("recorded_at"), *[F.desc(c) for c in sorted(new.columns) if c not in (*keys, "recorded_at")]))).withColumn("recorded_at", F.min("recorded_at").over(group)).where("_rn = 1")
    return kept.drop("_rn", "_new").unionByName(both.where(~named).drop("_new"))
