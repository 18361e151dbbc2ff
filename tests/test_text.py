import pytest
from pyspark.sql import functions as F

from trendloom.functions import labels, text
from trendloom.operators import nutrition, tokens
from trendloom.sources import files


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


@pytest.mark.parametrize(
    "written,want",
    [("2", 2.0), ("2.5", 2.5), ("1 1/2", 1.5), ("1 3.5", 4.5), ("1/2", 0.5), ("2-4", 3.0), ("1.5 - 3", 2.25), ("1/0", None),
     ("1 1/0", None), ("", None), ("abc", None), (" 3 ", 3.0), (None, None)],
)
def test_parse_quantity(spark, written, want):
    assert one(spark, written, text.parse_quantity("x")) == want


@pytest.mark.parametrize(
    "line,quantity,unit",
    [("1 (14.5 oz) can tomatoes", "14.5", "can"), ("two cups flour", "", "cups"), ("1 1/2 Cup milk", "1 1/2", "cup"),
     ("3 eggs", "3", ""), ("1 lb or 2 cans beans", "1 2", "cans"), ("salt (to taste) 1 pinch", "1", "pinch")],
)
def test_line_parts(spark, line, quantity, unit):
    df = spark.createDataFrame([(line,)], "x string").select(text.quantity_text("x"), text.unit("x"))
    assert tuple(df.first()) == (quantity, unit)


def test_lists_words_and_tags(spark):
    assert one(spark, "['a b', \"it's\"]", text.parse_list("x")) == ["a b", "it's"]
    assert one(spark, "  ", text.word_count("x")) == 0
    assert one(spark, " a  b\nc ", text.word_count("x")) == 3
    df = spark.createDataFrame([("t", "i"), ("t", None)], "a string, b string")
    tagged = [r[0] for r in df.select(text.tagged({"title": "a", "ingredients": "b"})).collect()]
    assert tagged == ["title: t ingredients: i", None]
    pairs = spark.createDataFrame([([1, 2, 3], ["x", "y"])], "a array<int>, b array<string>")
    assert [tuple(p) for p in pairs.select(text.zip_shortest("a", "b")).first()[0]] == [(1, "x"), (2, "y")]


def test_every_unit_but_package_has_grams():
    assert set(text.UNITS) - set(text.GRAMS) == {"package"}


def test_rollup(spark):
    items = spark.createDataFrame(
        [("r", "flour", 200.0, "grams"), ("r", "egg", 2.0, "piece"), ("r", "ghost", 9.0, "grams"), ("none", "ghost", 1.0, "piece")],
        "title string, item string, quantity double, unit string",
    )
    values = {"flour": 10.0, "egg": 5.0}
    nutrients = spark.createDataFrame([(k, *[v] * 6) for k, v in values.items()], ["item", *nutrition.NUTRIENTS])
    out = nutrition.rollup(items, "title", "item", nutrients).collect()
    assert len(out) == 1
    assert out[0]["kcal"] == pytest.approx((200 * 10 / 100 + 2 * 5) / (200 + 100 + 1) * 100)


def test_defaults_grams_and_last_write(spark):
    rows = [("r", "a", 1.0, "cup", 1), ("r", "a", 2.0, "oz", 2), ("r", "b", None, "", 3), ("r", "c", 2.5, "g", 4)]
    df = spark.createDataFrame(rows, "title string, item string, quantity double, unit string, line int")
    out = nutrition.to_grams(nutrition.with_defaults(nutrition.last_entry(df, "title", "item", ["line"])))
    got = {r["item"]: (r["quantity"], r["unit"]) for r in out.collect()}
    assert got == {"a": (57.0, "grams"), "b": (1.0, "piece"), "c": (2.0, "grams")}  # 2.5 rounds half to even


@pytest.mark.parametrize("kcal,name", [(99.9, "Low Calorie"), (100.0, "Moderate Calorie"), (300.0, "Moderate Calorie"), (300.1, "High Calorie")])
def test_kcal_borders(spark, kcal, name):
    assert one(spark, kcal, labels.kcal_class("x"), "double") == name


def test_macro_and_diet_borders(spark):
    df = spark.createDataFrame([(10.0, 15.0, 20.0), (10.1, 99.0, 99.0), (0.0, 15.1, 99.0), (0.0, 0.0, 20.1)], "p double, f double, c double")
    assert [r[0] for r in df.select(labels.macro_class("p", "f", "c")).collect()] == ["Balanced", "High Protein", "High Fat", "High Carbs"]
    diet = spark.createDataFrame([(9.0, 4.0, 9.0), (9.0, 5.0, 3.1), (9.0, 5.0, 3.0), (10.0, 4.9, 0.0), (10.0, 5.0, 3.0)], "c double, f double, b double")
    want = ["Low Carb, Low Fat", "High Fiber", "Low Carb", "Low Fat", "General"]
    assert [r[0] for r in diet.select(labels.diet_class("c", "f", "b")).collect()] == want


def test_label_drops_dense_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 4.9, 1.0, 29.0), ("b", 1.0, 1.0, 1.0, 5.0, 1.0, 30.0), ("c", 1.0, 1.0, 1.0, 5.0, 1.0, 20.0)], ["title", *nutrition.NUTRIENTS])
    out = {r["title"]: r["nutritious"] for r in nutrition.labelled(df).collect()}
    assert out == {"a": True, "c": False}


def test_vocabulary(spark):
    df = spark.createDataFrame([(["The", "egg", "+"],)] * 10 + [(["rare"],)], "w array<string>")
    counted = tokens.counts(df, "w")
    stop = spark.createDataFrame([("the",)], "token string")
    assert [tuple(r) for r in tokens.prune_vocab(counted, stop).collect()] == [("egg", 10)]
    assert [r["token"] for r in tokens.top(counted, 2).collect()] == ["+", "egg"]


def test_dictionary_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pie": {"egg": {"quantity": 2, "unit": "piece"},\n "salt": {"quantity": null, "unit": ""}}}')
    out = {tuple(r) for r in files.read_dictionary_json(spark, str(tmp_path)).collect()}
    assert out == {("pie", "egg", 2.0, "piece"), ("pie", "salt", None, "")}


def test_csv_keeps_quotes_and_breaks(spark, tmp_path):
    rows = [(1, 'say "hi", then\nleave'), (2, None)]
    df = spark.createDataFrame(rows, "id int, body string")
    files.write_csv(df, str(tmp_path / "t"))
    back = files.read_csv(spark, str(tmp_path / "t"), df.schema).orderBy("id").collect()
    assert [tuple(r) for r in back] == rows


def test_parts_are_stacked(spark):
    a, b = spark.range(2).select("id"), spark.range(1).withColumn("x", F.lit(1))
    assert files.stack([a, b]).filter("x is null").count() == 2
