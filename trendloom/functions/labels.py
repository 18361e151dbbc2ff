"""Classes and ratios of a nutrient row, per 100 grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kcal_class(kcal: str) -> Column:
    k = F.col(kcal)
    return F.when(k < 100, "Low Calorie").when(k <= 300, "Moderate Calorie").otherwise("High Calorie")


def macro_class(protein: str, fat: str, carbs: str) -> Column:
    """The first macronutrient over its line names the class."""
    return (
        F.when(F.col(protein) > 10, "High Protein")
        .when(F.col(fat) > 15, "High Fat")
        .when(F.col(carbs) > 20, "High Carbs")
        .otherwise("Balanced")
    )


def diet_class(carbs: str, fat: str, fibers: str) -> Column:
    few_carbs, little_fat = F.col(carbs) < 10, F.col(fat) < 5
    return (
        F.when(few_carbs & little_fat, "Low Carb, Low Fat")
        .when(F.col(fibers) > 3, "High Fiber")
        .when(few_carbs, "Low Carb")
        .when(little_fat, "Low Fat")
        .otherwise("General")
    )


def nutritious(macro: str, sugar: str) -> Column:
    return (F.col(macro) == "Balanced") & (F.col(sugar) < 5)


def caloric_density(kcal: str, protein: str, carbs: str, fat: str) -> Column:
    mass = F.col(protein) + F.col(carbs) + F.col(fat)
    return F.when(mass > 0, F.try_divide(F.col(kcal), mass))


def protein_share(protein: str, kcal: str) -> Column:
    return F.try_divide(F.col(protein), F.col(kcal))
