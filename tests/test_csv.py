"""CSV files in splits of a few bytes, made-up records against a plain reader, and what is written read back."""

import random

from pyspark.sql import functions as F

from evimatch.functions import market
from evimatch.sources import csvio


def plain_rows(text, mark):
    """Cut at quotes: pieces are by turns outside and inside; between two quotes nothing outside is a quote."""
    rows, cell = [[]], ""
    pieces = text.removeprefix("﻿").split('"')
    for i, piece in enumerate(pieces):
        if i % 2:
            cell += piece
        elif piece == "" and 0 < i < len(pieces) - 1:
            cell += '"'
        else:
            for c in piece.replace("\r", ""):
                if c in (mark, "\n"):
                    rows[-1].append(cell)
                    cell = ""
                    if c == "\n":
                        rows.append([])
                else:
                    cell += c
    rows[-1].append(cell)
    return rows if rows[-1] != [""] or not text.endswith("\n") else rows[:-1]


def _read(spark, path, mark=None):
    out = {}
    for r in csvio.read_rows(csvio.scan(spark, path), mark).collect():
        out.setdefault(r.file.rsplit("/", 1)[1], {})[r.row] = r.cells
    return {f: [rows[i] for i in range(len(rows))] for f, rows in out.items()}


def test_files_in_many_splits(spark, tmp_path):
    rng = random.Random(6)
    wanted = {}
    for n in range(5):
        parts = ["a", "bc", ";", ",", '"x"', '"p;q\n\nr"', '""', '"say ""hi"", ok"', '"', "\n", "\r\n", "ä", ""]
        text = "".join(rng.choice(parts) for _ in range(900))
        text += '"' * (text.count('"') % 2) + "end\n" * (n % 2)
        text = ("﻿" if n == 2 else "") + "k;l\n" + text
        (tmp_path / f"f{n}.csv").write_bytes(text.encode())
        wanted[f"f{n}.csv"] = plain_rows(text, ";")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = csvio.scan(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 20
        assert _read(spark, str(tmp_path), ";") == wanted
        assert _read(spark, str(tmp_path)) == wanted
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_what_is_written_is_read_back(spark, tmp_path):
    hazards = ["=1+1", "-5", "4/102", "007", 'say "x"', "a,b", "two\nlines", " outer ", "", None, "plain", "\tTab", "cr\rin"]
    cards = spark.createDataFrame([(i, ["sports", "ccg", "no-card-type"][i % 3], x) for i, x in enumerate(hazards * 3)], "id long, kind string, title string")
    lines = cards.select("id", "kind", csvio.csv_line([F.col("id"), F.col("title"), F.col("kind")], text=frozenset([0])).alias("line"))
    safe = lambda x: "" if x is None else ("'" + x if x[:1] in "=+-@\t\r" and x else x)
    csvio.write_csv(lines, "Id,*Title,Kind", ["id"], f"{tmp_path}/one", ("#INFO Version=1", "second"))
    whole = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "one").glob("part-*")))
    (tmp_path / "whole.csv").write_bytes(whole.encode())
    assert whole.startswith("﻿#INFO Version=1\r\nsecond\r\nId,*Title,Kind\r\n")
    got = _read(spark, f"{tmp_path}/whole.csv")["whole.csv"]
    assert got[:3] == [["#INFO Version=1"], ["second"], ["Id", "*Title", "Kind"]]
    assert got[3:] == [[str(i), safe(x), ["sports", "ccg", "no-card-type"][i % 3]] for i, x in enumerate(hazards * 3)]
    found = csvio.templates(csvio.read_rows(csvio.scan(spark, f"{tmp_path}/whole.csv"))).first()
    assert (found.header_row, found.headers, found.required, found.n_samples) == (2, ["Id", "*Title", "Kind"], ["*Title"], 39)

    csvio.write_csv(lines, "Id,*Title,Kind", ["id"], f"{tmp_path}/split", by="kind")
    for at, kind in enumerate(["sports", "ccg", "no-card-type"]):
        own = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "split" / f"kind={kind}").glob("part-*")))
        (tmp_path / f"{kind}.csv").write_bytes(own.encode())
        rows = _read(spark, f"{tmp_path}/{kind}.csv")[f"{kind}.csv"]
        assert rows[0] == ["Id", "*Title", "Kind"] and [r[0] for r in rows[1:]] == [str(i) for i in range(at, 39, 3)]


def test_headers_of_many_files(spark):
    texts = {"none": "one\ntwo\n", "tie": "a,b\nc,d\n", "wide": "note\nA,B\n1,2,3\n", "same": "x,x,x\nA,B,\n,,\n q ,\n", "late": "z\n" * 20 + "A,B\n"}
    lines = spark.createDataFrame([(f, 0, i, x) for f, text in texts.items() for i, x in enumerate(text.removesuffix("\n").split("\n"))], "file string, block long, at long, line string")
    got = {r.file: (r.header_row, r.headers, r.n_samples) for r in csvio.templates(csvio.read_rows(lines, ",")).collect()}
    assert got == {"tie": (0, ["a", "b"], 1), "wide": (2, ["1", "2", "3"], 0), "same": (1, ["A", "B"], 1)}
    assert csvio.read_rows(lines.limit(0)).count() == 0


def test_delimiters(spark):
    said = ["a;b,c", "a,b", "a\tb", 'x"a;b;c",d', "", None]
    got = spark.createDataFrame([(x,) for x in said], "x string").select(market.delimiter(F.col("x")).alias("d")).collect()
    assert [r.d for r in got] == [";", ",", "\t", ",", ",", ","]
