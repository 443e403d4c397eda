import random

import pytest
from pyspark.sql import functions as F

from pergamin.operators import boxes

BOX = "array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double>>"


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return both / max(size(a) + size(b) - both, 1e-9)


def test_suppression_equals_the_plain_definition(spark):
    rng = random.Random(8)
    cases = []
    for _ in range(40):
        found = []
        for k in range(rng.randrange(0, 9)):
            x, y = rng.uniform(0, 50), rng.uniform(0, 50)
            found.append((x, y, x + rng.uniform(5, 40), y + rng.uniform(5, 40), k / 10 + rng.random() / 100))
        cases.append(found)
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)] + [(99, None)], f"id int, b {BOX}")
    for r in df.select("id", boxes.suppressed(F.col("b")).alias("s")).collect():
        if r.id == 99:
            assert r.s is None
            continue
        kept = []
        for b in sorted(cases[r.id], key=lambda b: -b[4]):
            if all(plain_iou(k, b) < boxes.SAME_BOX for k in kept):
                kept.append(b)
        assert [tuple(x) for x in r.s] == kept


def test_signature_lines(spark):
    square = lambda x, y, w, h: [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    rows = [
        (1, 1, "paddle", 0, "clean", "Mrtsc", 0.1, 0.5, square(0, 0, 100, 20)), (2, 1, "paddle", 0, "clean", "texto comum da linha", 0.9, 0.95, square(0, 15, 100, 20)),
        (3, 1, "paddle", 0, "clean", "selo de autenticidade", 0.1, 0.5, square(300, 0, 100, 20)), (4, 1, "paddle", 0, "clean", "Xyz", 0.1, 0.5, square(320, 5, 50, 20)), (5, 1, "paddle", 0, "clean", "Xyz", 0.1, 0.5, None),
    ]
    lines = spark.createDataFrame(rows, "line_id long, doc_id long, step string, page_no int, kind string, clean_text string, coverage double, score double, poly array<struct<x:double,y:double>>")
    found = spark.createDataFrame([(1, 0, 0.0, 0.0, 110.0, 40.0, 0.9), (1, 0, 300.0, 0.0, 420.0, 40.0, 0.9), (1, 7, 0.0, 0.0, 9.0, 9.0, 0.9)], "doc_id long, page_no int, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert [r.line_id for r in boxes.signatures(lines, found).collect()] == [1]
    assert boxes.signatures(lines, found.limit(0)).collect() == []


def test_ink(spark):
    blank, photo, text = bytes([255] * 10000), bytes([128] * 10000), bytearray([255] * 10000)
    text[5000:5400] = bytes(400)
    rows = [(bytearray(blank), 100, 100), (bytearray(photo), 100, 100), (text, 100, 100), (None, 1, 1), (bytearray(b"x"), 5, 5)]
    df = spark.createDataFrame(rows, "p binary, w int, h int").coalesce(1)
    got = [tuple(r.i) for r in df.select(boxes.ink("p", "w", "h").alias("i")).collect()]
    assert got[0] == (False, 0.0, True) and got[1][0] and not got[1][2] and got[2][0] is False and got[2][1] == pytest.approx(400 / 8800) and got[2][2] is False
    assert got[3] == got[4] == (None, None, None)
