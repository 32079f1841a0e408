"""Lines, letters and names from whole cards."""

import pytest
from pyspark.sql import functions as F

from evimatch.functions import text
from evimatch.operators import catalog, layout, merging


def letters(word, at, gap=2, width=10):
    out = []
    for ch in word:
        out.append((ch, float(at), float(at + width)))
        at += width + gap
    return out, at


@pytest.mark.parametrize(
    ("parts", "gap", "want"),
    [
        (["JORDAN", "ELLIS"], 14, "JORDAN ELLIS"),
        (["TANAKA", "-", "REYES"], 14, "TANAKA-REYES"),
        (["TOB", "I", "AS"], 14, "TOB IAS"),
        (["A", "B"], 14, "AB"),
        (["X"], 14, "X"),
    ],
)
def test_letters_far_apart_are_words(spark, parts, gap, want):
    rows, at = [], 0
    for part in parts:
        own, at = letters(part, at)
        rows += own
        at += gap - 2
    frame = spark.createDataFrame([(1, *r, 30.0) for r in rows] + [(1, " ", 500.0, 510.0, 30.0), (1, "Z", None, None, 30.0)], "doc_id long, text string, x0 double, x1 double, line_height double")
    got = layout.space_by_gaps(frame).first().text
    assert got == want


@pytest.mark.parametrize(("line", "want"), [("KESTREL a", "KESTREL"), ("JORDAN ELLIS TOPPS", "JORDAN ELLIS"), ("J. GREEN", "J. GREEN"), ("ROOKIE CARD", ""), (None, ""), ("12 Ann O'Neil 7", "Ann O'Neil")])
def test_tidy_name(spark, line, want):
    assert spark.range(1).select(text.tidy_name(F.lit(line).cast("string")).alias("x")).first().x == want


def test_names_are_ranked_with_those_on_two_lines(spark):
    rows = [
        (1, 0, "TOPPS CHROME", 0.95, 0.95, 60.0, 100.0, 100.0, 500.0, 160.0),
        (1, 1, "ZARA", 0.9, 0.9, 70.0, 100.0, 1000.0, 300.0, 1070.0),
        (1, 2, "HOLLIS", 0.88, 0.85, 72.0, 105.0, 1080.0, 400.0, 1152.0),
        (1, 3, "guard of the season", 0.9, 0.9, 20.0, 100.0, 1300.0, 400.0, 1320.0),
        (1, 4, "Dust", 0.2, 0.2, 70.0, 100.0, 700.0, 400.0, 770.0),
        (2, 0, "JORDAN ELLIS", 0.9, 0.9, 70.0, 100.0, 1100.0, 500.0, 1170.0),
    ]
    lines = spark.createDataFrame(rows, "card long, line_id int, text string, confidence double, weakest double, height double, x0 double, y0 double, x1 double, y1 double")
    joined = layout.stacked(lines, "card").collect()
    assert [(r.card, r.line_id, r.text, r.confidence, r.height) for r in joined] == [(1, 1, "ZARA HOLLIS", 0.88, 72.0)]
    got = [(r.card, r.text) for r in layout.rank_names(lines, "card", 1400.0).orderBy("card", "place").collect()]
    assert got[0] == (1, "ZARA HOLLIS") and got[-1] == (2, "JORDAN ELLIS") and {x for _, x in got} == {"ZARA HOLLIS", "ZARA", "HOLLIS", "JORDAN ELLIS"}


def test_numbers_with_known_totals_and_places(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    known = F.array(F.lit(197))
    assert one(text.pick_number(F.lit("©2023 2004/13\n054/197"), known)) == "054/197"
    assert one(text.pick_number(F.lit("1/102"), known)) == "1/102"
    assert one(text.pick_number(F.lit("©2007/1"), known)) is None
    spans = one(text.number_spans(F.lit("x 4/1O2 and 4/1O2, 054|197")))
    assert [(r.place, r.raw) for r in spans] == [(2, "4/1O2"), (12, "4/1O2"), (19, "054|197")]


def test_early_stop_takes_a_name_inside_the_text(spark):
    asked = spark.createDataFrame([(1, "Dixlgx", 1, None, "* Dialgawes w90"), (2, "Dixlgx", 1, None, "nothing"), (3, "Dialga", 1, 1990, "")], "cid long, name string, num int, year int, said string")
    cards = spark.createDataFrame([(9, "Dialga", 1999)], "id long, name string, year int")
    found = spark.createDataFrame([(i, 9) for i in (1, 2, 3)], "cid long, id long")
    assert [r.cid for r in catalog.satisfied(found, asked, cards, "said").collect()] == [1]


def test_the_better_reading(spark):
    rows = [(1, 0, "JORDANELLIS", 0.7), (1, 1, "JORDAN ELLIS", 0.75), (1, 2, "x7", 0.99), (2, 0, "BRAY WYATT", 0.9), (2, 1, "WYATT", 0.99)]
    got = {r.card: r.text for r in merging.better_reading(spark.createDataFrame(rows, "card long, pos int, text string, confidence double"), "card").collect()}
    assert got == {1: "JORDAN ELLIS", 2: "BRAY WYATT"}


def test_capitals_are_spaced_by_their_gaps(spark):
    said = [(1, "LUKADONCIC"), (2, "Lukadoncic"), (3, "LUKADONCIG"), (4, "ROOKIE"), (5, "  Two   words "), (6, None)]
    letters = []
    for i, text in said[:4]:
        x = 0.0
        for k, c in enumerate("LUKADONCIC" if i < 4 else text):
            letters.append((i, c, x, x + 10.0, 20.0))
            x += 40.0 if k == 3 and i < 4 else 11.0
    lines = spark.createDataFrame([(i, s, 0.8) for i, s in said], "doc_id long, text string, confidence double")
    got = layout.as_reading(lines, spark.createDataFrame(letters, "doc_id long, text string, x0 double, x1 double, line_height double"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "LUKA DONCIC", 2: "Lukadoncic", 3: "LUKADONCIG", 5: "Two words"}
