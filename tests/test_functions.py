"""Known readings, one by one."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evimatch.functions import market, text, values
from evimatch.sources import csvio


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: text.fold(F.lit("  Pokémon  X ")), "pokemon x"),
        (lambda: text.fold_de(F.lit("Straße")), "strasse"),
        (lambda: text.fold(F.lit("Straße")), "straße"),
        (lambda: text.pick_number(F.lit("Glurak 004/120 Stufe 2")), "004/120"),
        (lambda: text.pick_number(F.lit("4/1O2")), "4/102"),
        (lambda: text.pick_number(F.lit("054|197")), "054/197"),
        (lambda: text.pick_number(F.lit("4\\102")), "4/102"),
        (lambda: text.pick_number(F.lit("©2007/1")), None),
        (lambda: text.years(F.lit("© 1999 Wizards, item 2999")), [1999]),
        (lambda: text.variant_terms(F.lit("Reverse Holo Rare")), ["reverse holo"]),
        (lambda: text.language(F.lit("Entwicklungsstufe 1")), "de"),
        (lambda: text.language(F.lit("カード")), "ja"),
        (lambda: text.language(F.lit("Charizard Stage 2")), None),
        (lambda: text.hp(F.lit("HP 150")), 150),
        (lambda: text.hp(F.lit("120 HP")), 120),
        (lambda: text.hp(F.lit("HP 155")), None),
        (lambda: text.hp(F.lit("HP 450")), None),
        (lambda: text.pick_name(F.lit("735% Charizard 120 HP@")), "Charizard"),
        (lambda: text.pick_name(F.lit("Pikachu VMAX HP 310")), "Pikachu VMAX"),
        (lambda: text.pick_name(F.lit("V")), None),
        (lambda: text.compare_numbers(F.lit("4/102"), F.lit("004/102")), 1.0),
        (lambda: text.compare_numbers(F.lit("4/102"), F.lit("4/130")), 0.6),
        (lambda: text.compare_numbers(F.lit("4/102"), F.lit("5/102")), 0.0),
        (lambda: text.compare_numbers(F.lit("7"), F.lit("7")), 0.85),
        (lambda: text.similarity(F.lit("ABC"), F.lit("abc")), 1.0),
        (lambda: text.similarity(F.lit("ab"), F.lit("abcdefgh")), 0.0),
        (lambda: text.contains_fuzzy(F.lit("* Dialgawes w90"), F.lit("Dialga")), 1.0),
        (lambda: text.contains_fuzzy(F.lit("Mow HP 50"), F.lit("Mew")), 0.0),
        (lambda: text.same_name(F.lit("BRAY WYATT"), F.lit("BRAY WATT")), True),
        (lambda: text.same_name(F.lit("ELLIS"), F.lit("ELLA")), False),
        (lambda: values.band(F.lit(0.95), F.lit(0.4)), "HIGH"),
        (lambda: values.band(F.lit(0.95), F.lit(0.01)), "MEDIUM"),
        (lambda: values.band(F.lit(0.5), F.lit(1.0)), "LOW"),
        (lambda: market.price(F.lit("10,5")), "10.50"),
        (lambda: market.price(F.lit("€ 12.99")), "12.99"),
        (lambda: market.price(F.lit("1,000.00")), None),
        (lambda: market.grade_id(F.lit("PSA 10")), 275020),
        (lambda: market.grader_id(F.lit("psa")), 275010),
        (lambda: market.condition_id(F.lit("Sehr gut")), 400012),
        (lambda: market.csv_field(F.lit("4/102")), '"4/102"'),
        (lambda: market.csv_field(F.lit("=1+1")), "'=1+1"),
        (lambda: market.csv_field(F.lit(None).cast("string")), ""),
        (lambda: market.delimiter(F.lit("Titel;Preis;Menge")), ";"),
        (lambda: market.delimiter(F.lit('"Last, First";Age')), ";"),
        (lambda: market.title("{name} #{number}", {"name": F.lit("X"), "number": F.lit(None)}), "X"),
        (lambda: market.descriptor_field(F.lit("CD:Card Condition - (ID: 40001)")), "cardConditionId"),
    ],
)
def test_reading(spark, make, want):
    assert one(spark, make()) == want


def test_provenance(spark):
    x = one(spark, values.extracted(F.lit(None), "ocr", F.lit(0.9), F.lit("e")))
    assert (x.value, x.confidence) == (None, 0.0)
    assert one(spark, values.extracted(F.lit("x"), "inferred", F.lit(0.99), F.lit("rule"))).confidence == 0.7
    assert one(spark, values.extracted(F.lit("x"), "user", F.lit(0.2), F.lit(None))).confidence == 1.0
    with pytest.raises(ValueError):
        values.extracted(F.lit("x"), "guess", F.lit(0.2), F.lit(None))
    with pytest.raises(PySparkException):
        one(spark, values.extracted(F.lit("x"), "inferred", F.lit(0.9), F.lit(None).cast("string")))


def test_template(spark):
    t = csvio.parse_template(spark, "#INFO,Version\nsecond\n*Title,Price,Menge,X\na,1,2,3\n")
    assert t.headers == ["*Title", "Price", "Menge", "X"] and t.required == ["*Title"] and len(t.preamble) == 2
