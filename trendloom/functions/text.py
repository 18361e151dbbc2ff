"""Text expressions: tagged texts, word counts, list literals and quantity parsing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unit words looked for in an ingredient line.
UNITS = [
    "mililiter", "ml", "liter", "l", "gram", "g", "kilogram", "kg", "teaspoon", "tsp", "tablespoon", "tbsp", "cup", "c",
    "pint", "pt", "quart", "qt", "gallon", "gal", "ounce", "oz", "pound", "lb", "cups", "teaspoons", "tablespoons", "pints",
    "pounds", "quarts", "gallons", "ounces", "liters", "grams", "kilograms", "milliliters", "can", "cans", "package",
    "bunch", "head", "spring", "pinch", "dash",
]

# Grams per unit, one lower-case entry per spelling.
GRAMS = {
    "ml": 1.0, "mililiter": 1.0, "milliliters": 1.0, "l": 1000.0, "liter": 1000.0, "liters": 1000.0,
    "g": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0,
    "tsp": 4.92892, "teaspoon": 4.92892, "teaspoons": 4.92892,
    "tbsp": 14.7868, "tablespoon": 14.7868, "tablespoons": 14.7868,
    "c": 200.0, "cup": 236.588, "cups": 236.588, "pt": 473.176, "pint": 473.176, "pints": 473.176,
    "qt": 946.353, "quart": 946.353, "quarts": 946.353, "gal": 3785.41, "gallon": 3785.41, "gallons": 3785.41,
    "oz": 28.3495, "ounce": 28.3495, "ounces": 28.3495, "lb": 453.592, "pound": 453.592, "pounds": 453.592,
    "can": 400.0, "cans": 400.0, "bunch": 50.0, "head": 5.0, "spring": 50.0, "pinch": 2.0, "dash": 2.0,
}

# A range, a fraction, or a plain number, tried in this order; number words never match.
NUMBER = r"\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?/\d+|\d+(?:\.\d+)?"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tagged(parts: Mapping[str, str]) -> Column:
    """'title: ... ingredients: ... directions: ...'; null if any part is null."""
    pieces: list[Column] = []
    for tag, col in parts.items():
        pieces += [F.lit(f"{' ' if pieces else ''}{tag}: "), F.col(col)]
    return F.concat(*pieces)


def words(text: str | Column) -> Column:
    """Whitespace-separated words; none for a blank text."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def within_words(text: str, limit: int) -> Column:
    return word_count(text) <= limit


def parse_list(literal: str | Column) -> Column:
    """'[...]' with single- or double-quoted texts to an array."""
    return F.from_json(_c(literal), "array<string>")


def zip_shortest(a: str | Column, b: str | Column) -> Column:
    """Pairs of two arrays, as many as the shorter has."""
    first, second = _c(a), _c(b)
    n = F.least(F.size(first), F.size(second))
    return F.arrays_zip(F.slice(first, F.lit(1), n).alias("first"), F.slice(second, F.lit(1), n).alias("second"))


def parenthesised(text: str | Column) -> Column:
    """Contents of every pair of round brackets."""
    return F.regexp_extract_all(_c(text), F.lit(r"\((.*?)\)"), F.lit(1))


def numbers(text: str | Column) -> Column:
    """Every number, fraction and range of a text, joined by blanks."""
    return F.array_join(F.regexp_extract_all(_c(text), F.lit(NUMBER), F.lit(0)), " ")


def quantity_text(line: str | Column) -> Column:
    """Numbers of the first bracket if it has any, else all numbers of the line."""
    first = numbers(F.coalesce(F.get(parenthesised(line), F.lit(0)), F.lit("")))
    return F.when(first != "", first).otherwise(numbers(line))


def unit(line: str | Column, units: Sequence[str] = UNITS) -> Column:
    """Last word of the line that is a unit, in lower case; empty if there is none."""
    tokens = F.regexp_extract_all(F.lower(_c(line)), F.lit("[a-z]+"), F.lit(0))
    known = F.filter(tokens, lambda w: w.isin(list(units)))
    return F.when(F.size(known) > 0, F.element_at(known, -1)).otherwise("")


#: A number, then at most one more part: a sign between two numbers, and the divisor of the second.
QUANTITY = r"^([0-9]+)([.][0-9]+)?(?:([ ]*-[ ]*|/|[ ]+)([0-9]+)([.][0-9]+)?(?:/([0-9]+))?)?"
PLAIN_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"


def parse_quantity(text: str | Column) -> Column:
    """Quantity text to a number, else null: a plain number; 'a b' and 'a b/c' with a whole a are sums, 'a/b' is a ratio, 'a-b'
    its midpoint. What follows is ignored; a zero divisor gives null."""
    t = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    whole, part, sign, second, tail, divisor = (F.regexp_extract(t, QUANTITY, k) for k in range(1, 7))
    number = lambda *c: F.concat(*c).try_cast("double")
    sign = F.trim(sign)
    found = F.regexp_extract(t, QUANTITY, 4) != ""
    addend = F.when((divisor != "") & (tail == ""), F.try_divide(number(second), number(divisor))).otherwise(number(second, tail))
    return (
        F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double"))
        .when(found & (sign == ""), F.when(part == "", number(whole) + addend))
        .when(found & (sign == "/"), F.try_divide(number(whole, part), number(second)))
        .when(found, (number(whole, part) + number(second, tail)) / 2)
    )
