"""Whole records from strips, words of both sides and a catalogue, and the same as a stream."""

import pytest
from pyspark.sql import functions as F

from evimatch.operators import assembly, layout
from evimatch.streaming import records as live


def _line(side, at, text, y, h, sure=0.9):
    return [(side, at + i, w, sure, 100.0 + 160 * i, float(y), 240.0 + 160 * i, float(y + h)) for i, w in enumerate(text.split())]


READINGS = [
    # matched by number and name; the back gives the maker
    (1, "Basic\nDialga HP 90\n16/123\n2007", 0.9, 0.9, _line("back", 0, "©2007 Topps", 900, 20)),
    # nothing matches: both sides say the name, the back its number by its place
    (2, "", 0.0, 0.0, _line("front", 0, "JORDAN ELLIS", 800, 60, 0.7) + _line("front", 10, "PANINI PRIZM", 50, 30) + _line("back", 20, "126", 60, 50) + _line("back", 30, "JORDAN ELLIS", 500, 50, 0.8)),
    # nothing at all
    (3, "", 0.0, 0.0, []),
    # two numbers: 2007/99 is of no known set
    (4, "Dialga\n2007/99\n16/123", 0.9, 0.9, []),
    # a misread name is spelled as the catalogue has it
    (5, "Dialgo HP 90\n16/123\n2007", 0.9, 0.9, []),
]


@pytest.fixture(scope="module")
def catalogue(spark):
    cards = spark.createDataFrame([(10, "Dialga", "Great", "DP", 2007, 90, 16, 123, False, "en"), (11, "Palkia", "Great", "DP", 2007, 90, 17, 123, False, "en")], "id long, name string, set_name string, series string, year int, hp int, num int, den int, has_variants boolean, language string")
    return cards, spark.createDataFrame([("Great", 123, 2007)], "set_name string, total int, released int")


def _facts(rows):
    value = lambda x: x and x.value
    source = lambda x: x and x.value and x.source
    return {r.card_id: (value(r.name), source(r.name), value(r.number), source(r.number), value(r.manufacturer), sorted(r.flags), r.best_id, r.state, r.error) for r in rows}


WANT = {
    1: ("Dialga", "ocr", "16/123", "ocr", "Topps", [], 10, "IDENTIFIED", None),
    2: ("JORDAN ELLIS", "ocr", "126", "inferred", "Panini", ["number", "year"], None, "NEEDS_REVIEW", None),
    3: (None, None, None, None, None, ["name", "number"], None, "NEEDS_REVIEW", "We could not read any text on this card."),
    4: ("Dialga", "ocr", "16/123", "ocr", None, [], 10, None, None),
    5: ("Dialga", "db_match", "16/123", "ocr", None, [], 10, None, None),
}


def _check(got):
    assert got.keys() == WANT.keys()
    for i, want in WANT.items():
        assert got[i][:7] == want[:7] and got[i][8] == want[8] and want[7] in (None, got[i][7]), (i, got[i])


def test_records(spark, catalogue):
    readings = spark.createDataFrame(READINGS, live.READING)
    words = readings.select("card_id", F.explode("words").alias("w")).select("card_id", "w.*")
    rows = assembly.records(readings.drop("words"), words, *catalogue).collect()
    _check(_facts(rows))
    texts = {r.card_id: [x.text for x in r.texts or []] for r in rows}
    assert texts[2] == ["JORDAN ELLIS", "126", "JORDAN ELLIS", "PANINI PRIZM"] and texts[1] == ["©2007 Topps"]
    name = next(r for r in rows if r.card_id == 5).name
    assert name.evidence == "10 (read as “Dialgo”)"


def test_a_stream_appends_each_batch_once(spark, catalogue, tmp_path):
    schema = live.READING
    append = live.appender(*catalogue, f"{tmp_path}/records")
    spark.createDataFrame(READINGS[:3], schema).coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        q = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(append).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([(3, *READINGS[3][1:]), *READINGS[3:]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/records").count() == 6
    append(spark.createDataFrame(READINGS[:3], schema), 0)  # a batch told twice
    assert spark.read.parquet(f"{tmp_path}/records").count() == 6
    got = _facts(live.latest(spark, f"{tmp_path}/records").collect())
    assert got[3][:3] == got[4][:3] and got[3][8] is None
    _check(got | {3: WANT[3]})


def test_a_lone_number_on_a_back(spark):
    lines = [(1, 0, "126", 0.9, 50.0, 60.0, 110.0), (1, 1, "12", 0.9, 20.0, 60.0, 80.0), (2, 0, "126", 0.9, 50.0, 60.0, 110.0), (2, 1, "45", 0.9, 45.0, 60.0, 105.0), (3, 0, "1998", 0.99, 50.0, 60.0, 110.0), (4, 0, "7", 0.8, 50.0, 60.0, 110.0), (5, 0, "7", 0.9, 50.0, 600.0, 650.0), (6, 0, "7", 0.9, 10.0, 60.0, 70.0)]
    frame = spark.createDataFrame(lines, "doc long, line_id int, text string, confidence double, height double, y0 double, y1 double")
    assert [(r.doc, r.value) for r in layout.lone_number(frame, "doc", 1000.0).collect()] == [(1, "126")]
