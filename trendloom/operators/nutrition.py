"""Ingredient lines to grams, nutrient totals and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import labels, text
from trendloom.operators import clean

NUTRIENTS = ["protein", "fat", "carbs", "sugar", "fibers", "kcal"]
BOUNDS = {
    "carbs": (None, 100.0), "kcal": (0.0, 1000.0), "fat": (None, 100.0), "protein": (None, 100.0), "sugar": (None, 100.0),
}


def items(df: DataFrame, line: str) -> DataFrame:
    """Add the quantity text, the parsed quantity and the unit of an ingredient line."""
    read = df.withColumns({"qtext": text.quantity_text(line), "unit": text.unit(line)})
    return read.withColumn("quantity", text.parse_quantity("qtext"))


def last_entry(df: DataFrame, title: str, item: str, order: Sequence[str]) -> DataFrame:
    """One (quantity, unit) per title and item, the last in the given order."""
    latest = F.max_by(F.struct("quantity", "unit"), F.struct(*order)).alias("_e")
    return df.groupBy(title, item).agg(latest).select(title, item, "_e.quantity", "_e.unit")


def with_defaults(df: DataFrame) -> DataFrame:
    """No quantity means 1, no unit means a piece."""
    return df.withColumns({"quantity": clean.fill("quantity", 1.0), "unit": clean.fill_empty("unit", "piece")})


def to_grams(df: DataFrame) -> DataFrame:
    """Whole grams (half to even) for every unit but piece and package."""
    factor = F.create_map(*[F.lit(v) for pair in text.GRAMS.items() for v in pair])
    grams = F.bround(F.col("quantity") * F.try_element_at(factor, F.col("unit")), 0)
    counted = F.col("unit").isin("piece", "package")
    return df.withColumns(
        {
            "quantity": F.when(counted, F.col("quantity")).otherwise(grams),
            "unit": F.when(counted, F.col("unit")).otherwise("grams"),
        }
    )


def rollup(
    df: DataFrame, title: str, item: str, nutrients: DataFrame, piece_grams: float = 50.0
) -> DataFrame:
    """Nutrients per 100 grams of each title.

    Gram items add quantity x value / 100 and their grams; other items add quantity x value and weigh ``piece_grams`` each.
    Items without a nutrient row are skipped, titles without weight are left out, and the weight counts one gram more.
    ``nutrients`` has one row per item.
    """
    in_grams = F.col("unit") == "grams"
    share = F.when(in_grams, F.col("quantity") / 100).otherwise(F.col("quantity"))
    weight = F.when(in_grams, F.col("quantity")).otherwise(F.col("quantity") * piece_grams)
    matched = df.join(nutrients.select(item, *NUTRIENTS), item)
    sums = matched.groupBy(title).agg(
        F.sum(weight).alias("_weight"), *[F.sum(share * F.col(c)).alias(c) for c in NUTRIENTS]
    )
    return sums.filter(F.col("_weight") != 0).select(
        title, *[(F.col(c) / (F.col("_weight") + 1) * 100).alias(c) for c in NUTRIENTS]
    )


def plausible(df: DataFrame) -> DataFrame:
    return clean.plausible(df.na.drop(subset=NUTRIENTS), BOUNDS)


def labelled(df: DataFrame, max_density: float = 10.0) -> DataFrame:
    """Ratios, classes and the binary label; rows without a ratio or above the density limit are dropped."""
    out = df.withColumns(
        {
            "caloric_density": labels.caloric_density("kcal", "protein", "carbs", "fat"),
            "protein_kcal": labels.protein_share("protein", "kcal"),
            "kcal_class": labels.kcal_class("kcal"),
            "macro_class": labels.macro_class("protein", "fat", "carbs"),
            "diet_class": labels.diet_class("carbs", "fat", "fibers"),
        }
    )
    out = out.na.drop(subset=["caloric_density", "protein_kcal"]).filter(F.col("caloric_density") < max_density)
    return out.withColumn("nutritious", labels.nutritious("macro_class", "sugar"))
