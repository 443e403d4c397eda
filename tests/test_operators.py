import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.operators import lines
from pergamin.plans import cascade
from pergamin.sources import files, packs
from pergamin.streaming import measure

PROSE = "O perito nomeado pela vara juntou aos autos do processo o laudo que foi requerido pela parte autora e a decisão será tomada após a vista das partes. "
OTHER = "La cooperativa entregó ayer unos documentos distintos sobre inventario general mientras ninguno estaba presente durante aquella visita nocturna. "


def reading(doc, ordinal, step, kind, text, confidence=95.0, sent=1, answered=1, available=True, loaded=1):
    return (doc * 10 + ordinal, doc, ordinal, step, kind, available, None, text, sent, answered, confidence, 0, datetime.datetime(2024, 1, loaded))


def run(spark, readings, docs=None, pages=()):
    r = spark.createDataFrame(readings, "reading_id long, doc_id long, ordinal int, step string, kind string, available boolean, why string, text string, pages_sent int, pages_answered int, confidence double, failed_batches int, loaded_at timestamp")
    d = spark.createDataFrame(docs or [(i, 1, True, False) for i in {x[1] for x in readings}], "doc_id long, pages int, has_image boolean, has_vector boolean")
    p = spark.createDataFrame(list(pages), "doc_id long, page_no int, text string, chars int, lines int, blocks int, words int, page_w double, page_h double, boxes array<struct<kind:int,x1:double,y1:double,x2:double,y2:double>>")
    return {x.doc_id: x for x in cascade.results(cascade.measured(d, p, r)).collect()}


def test_cascade_closes_as_it_should(spark):
    good = PROSE * 3
    out = run(
        spark,
        [
            reading(1, 0, "native", "native", good), reading(1, 1, "paddle", "ocr", OTHER * 3),
            reading(2, 0, "native", "native", ""), reading(2, 1, "paddle", "ocr", good),
            reading(3, 0, "native", "native", ""), reading(3, 1, "paddle", "ocr", PROSE, confidence=50.0), reading(3, 2, "vision", "ocr", PROSE + "fim", confidence=60.0),
            reading(4, 0, "native", "native", "um selo"), reading(4, 1, "paddle", "ocr", "selo um"),
            reading(5, 0, "paddle", "ocr", OTHER, confidence=10.0), reading(5, 1, "vision", "ocr", PROSE, confidence=10.0),
            reading(6, 0, "native", "native", None, available=False),
            reading(7, 0, "paddle", "ocr", "antes", loaded=1), reading(7, 0, "paddle", "ocr", good, loaded=9),
        ],
    )
    assert (out[1].step, out[1].closed_by) == ("native", "acceptance") and "paddle" not in out[1].provenance
    assert (out[2].step, out[2].closed_by) == ("paddle", "acceptance")
    assert out[3].closed_by == "agreement" and out[3].similarity >= 0.6
    assert (out[4].closed_by, out[4].text, out[4].score) == ("consensus", "", None)
    assert (out[5].step, out[5].closed_by) == ("vision", "contest")
    assert (out[6].step, out[6].text) == ("none", "")
    assert out[7].text == good and len(out) == 7


def test_replacement_gate_and_vetoes_of_expensive_steps(spark):
    old = PROSE + "Protocolo 882167 nesta vara. "
    bad, rich = old.replace("882167", "882187") + PROSE * 2, PROSE * 20
    readings = [
        reading(1, 0, "paddle", "ocr", old, confidence=50.0), reading(1, 1, "docling", "expensive", bad),
        reading(2, 0, "paddle", "ocr", old, confidence=50.0), reading(2, 1, "docling", "expensive", rich),
        reading(3, 0, "paddle", "ocr", old, confidence=50.0), reading(3, 1, "docling", "expensive", "[illegible] " * 400),
        reading(4, 0, "native", "native", ""), reading(4, 1, "docling", "expensive", "um\ndois tr-\nês"),
        reading(5, 0, "paddle", "ocr", old, confidence=50.0), reading(5, 1, "docling", "expensive", bad), reading(5, 2, "remote", "expensive", old + PROSE * 2),
        reading(6, 0, "paddle", "ocr", OTHER, confidence=50.0), reading(6, 1, "docling", "expensive", rich),
        reading(7, 0, "paddle", "ocr", OTHER, confidence=50.0), reading(7, 1, "docling", "expensive", rich),
    ]
    r = spark.createDataFrame(readings, "reading_id long, doc_id long, ordinal int, step string, kind string, available boolean, why string, text string, pages_sent int, pages_answered int, confidence double, failed_batches int, loaded_at timestamp")
    d = spark.createDataFrame([(i, 1, True, False) for i in range(1, 8)], "doc_id long, pages int, has_image boolean, has_vector boolean")
    p = spark.createDataFrame([], "doc_id long, page_no int, text string, chars int, lines int, blocks int, words int, page_w double, page_h double, boxes array<struct<kind:int,x1:double,y1:double,x2:double,y2:double>>")
    rows = cascade.measured(d, p, r)
    assert {x.doc_id: x.step for x in cascade.results(rows).where("doc_id = 1").collect()} == {1: "docling"}
    out = {x.doc_id: x for x in cascade.guarded(rows).collect()}
    assert out[1].step == "paddle" and "identifiers lost: 882167" in out[1].provenance and out[1].text == old.strip()
    assert out[2].step == "docling" and out[2].closed_by == "acceptance"
    assert out[3].step == "paddle" and "loop of unread marks" in out[3].provenance
    assert (out[4].step, out[4].text) == ("docling", "um dois três")
    assert (out[5].step, out[5].closed_by) == ("paddle", "agreement") and "remote" not in out[5].provenance
    assert out[6].step == "docling"
    w = spark.createDataFrame([(6, False, False, 1, "nada"), (7, False, False, 40, OTHER)], "doc_id long, is_photo boolean, is_blank boolean, reliable int, text string")
    seen = {x.doc_id: x for x in cascade.guarded(rows, w).collect()}
    assert seen[6].step == "paddle" and "veto: no_legible_word" in seen[6].provenance
    assert seen[7].step == "paddle" and "veto: reading_confirmed" in seen[7].provenance
    assert seen[2].step == "docling" and "no witness" in seen[2].provenance


def test_order_and_repetition_change_nothing(spark):
    rows = [reading(d, o, s, "ocr", PROSE * n + "x" * d, confidence=c) for d in range(1, 6) for o, (s, n, c) in enumerate([("paddle", 1, 60.0), ("vision", 2, 90.0), ("docling", 3, 95.0)])]
    first = run(spark, rows)
    random.Random(1).shuffle(rows)
    assert run(spark, rows + rows[:4]) == first


def test_text_only_pages_pass_and_uncovered_images_do_not(spark):
    page = lambda d, boxes: (d, 0, "x", 900, 9, 2, 150, 100.0, 100.0, boxes)
    good = PROSE * 3
    image, text = (1, 0.0, 0.0, 60.0, 60.0), (0, 10.0, 10.0, 20.0, 20.0)
    out = run(
        spark, [reading(d, 0, "native", "native", good if d > 1 else PROSE) for d in (1, 2, 3)], [(1, 9, False, False), (2, 1, True, False), (3, 1, True, False)],
        [page(1, None), page(2, [image]), page(3, [image, text])],
    )
    assert [out[d].closed_by for d in (1, 2, 3)] == ["acceptance", "contest", "acceptance"]


def test_empty_tables(spark):
    rows = [reading(1, 0, "native", "native", PROSE)]
    r = spark.createDataFrame(rows, "reading_id long, doc_id long, ordinal int, step string, kind string, available boolean, why string, text string, pages_sent int, pages_answered int, confidence double, failed_batches int, loaded_at timestamp").limit(0)
    d = spark.createDataFrame([], "doc_id long, pages int, has_image boolean, has_vector boolean")
    p = spark.createDataFrame([], "doc_id long, page_no int, text string, chars int, lines int, blocks int, words int, page_w double, page_h double, boxes array<struct<kind:int,x1:double,y1:double,x2:double,y2:double>>")
    assert cascade.results(cascade.measured(d, p, r)).collect() == []


LINE = "line_id long, doc_id long, step string, page_no int, line_no int, text string, score double, poly array<struct<x:double,y:double>>, page_w double, page_h double"


def box(x1, y1, x2, y2):
    return [(float(x), float(y)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]


def page(spark, entries):
    rows = [(k, 1, "paddle", 0, k, t, s, b, 1200.0, 1700.0) for k, (t, s, b) in enumerate(entries)]
    return spark.createDataFrame(rows, LINE)


def words(spark):
    return spark.createDataFrame([(w, 9) for w in "perito nomeado pela vara juntou autos processo laudo requerido parte autora decisão".split()], "word string, n long")


def test_line_kinds_and_containment(spark):
    flat, tall = box(200, 100, 900, 130), box(20, 200, 50, 900)
    entries = [
        ("perito nomeado pela vara juntou", 0.95, flat), ("~", 0.2, flat), ("texto vertical da margem", 0.9, tall), ("#$ ^& *~ <> {} ==", 0.9, flat), ("xqz wvk zzt qqp lkj hgf", 0.4, flat), ("26/11/2013", 0.3, flat),
        ("DESPACHO", 0.2, flat), ("rua das flores", 0.3, flat), ("漢字漢字漢字ab", 0.9, flat), ("abc dfg hjk processo", 0.8, flat), ("Scrbl", 0.5, flat), ("MARIA DA SILVA", 0.9, flat), ("Escrivã judicial", 0.9, flat), (None, None, None),
    ]
    rows = lines.mark_signatures(lines.classify(lines.with_coverage(page(spark, entries), words(spark))))
    kinds = {r.line_id: r.kind for r in rows.collect()}
    assert [kinds[k] for k in range(14)] == ["clean", "fragment", "vertical", "illegible", "illegible", "clean", "clean", "clean", "illegible", "suspect", "signature", "clean", "clean", "fragment"]
    report = lines.contain(rows).first()
    assert report.text.split("\n")[:4] == ["perito nomeado pela vara juntou", C.ILLEGIBLE_MARKER, "26/11/2013", "DESPACHO"] and C.SIGNATURE_MARKER in report.text
    assert (report.n_total, report.n_illegible, report.n_vertical, report.n_fragment, report.suggested_action) == (14, 3, 1, 2, "escalate")
    targets = [r.line_id for r in lines.reread_targets(rows, most=2).orderBy("rank").collect()]
    assert targets == [2, 3]


def test_routes(spark):
    table = [(t, 0.95, box(x, 50 * k, x + 80, 50 * k + 20)) for k, (t, x) in enumerate(itertools.product([f"1{i}/02/2010" for i in range(4)] + ["R$ 1.200,00", "R$ 30,00"], (100, 400, 700)))]
    assert lines.route(lines.with_coverage(page(spark, table), words(spark))).first().route == "table"
    prose = [("perito nomeado pela vara juntou autos do processo o laudo.", 0.95, None)] * 5
    assert lines.route(lines.with_coverage(page(spark, prose), words(spark))).first().route == "normal"
    noise = [("zzzz qqqq wwww kkkk", 0.4, None)] * 5
    assert lines.route(lines.with_coverage(page(spark, noise), words(spark))).first().route == "degraded"


def test_lexicon_counts_all_rows(spark):
    df = spark.createDataFrame([("Ação ação AÇÃO de x",), ("ação raro",), (None,)], "text string")
    assert [tuple(r) for r in lines.lexicon(df).collect()] == [("ação", 4)]


def test_files_and_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(rb"{\rtf1 texto}")
    (tmp_path / "x.bin").write_bytes(b"%PDF-1.7")
    scanned = files.scan(spark, str(tmp_path))
    assert sorted((r.identifier, r.file_format) for r in scanned.collect()) == [("x.bin", "pdf"), ("x.bin", "rtf")]
    assert {r.file_format: r.text for r in files.unwrapped(scanned).collect()} == {"pdf": None, "rtf": "texto"}
    assert json.loads(files.as_json(spark.createDataFrame([(1, "é")], "doc_id long, text string")).first().value) == {"doc_id": 1, "text": "é"}


def test_converted_reading_order(spark):
    place = lambda page, l, t, r, b: [{"page_no": page, "bbox": {"l": l, "t": t, "r": r, "b": b}}]  # noqa: E731, E741
    texts = [
        {"text": "sem lugar", "label": "text"}, {"text": "rodapé", "label": "page_footer", "prov": place(1, 0, 900, 500, 880)}, {"text": "segunda", "label": "text", "prov": place(1, 0, 500, 300, 480)},
        {"text": "primeira", "label": "text", "prov": place(1, 0, 700, 300, 680)}, {"text": "página 2", "label": "text", "prov": place(2, 0, 900, 300, 880)}, {"text": "lateral", "label": "text", "prov": place(1, 10, 800, 30, 200)}, {"text": " ", "label": "text"},
    ]
    df = spark.createDataFrame([(json.dumps({"texts": texts}),), ("no json",), (None,)], "j string")
    assert [r.t for r in df.select(files.converted_text(F.col("j")).alias("t")).collect()] == ["primeira\nsegunda\nrodapé\nlateral\npágina 2\nsem lugar".replace("rodapé\nlateral", "rodapé\nlateral"), "", None]


def test_packs(tmp_path):
    (tmp_path / "1.toml").write_text("[a.b]\npattern = 'x+'\n[a.w]\nwords = 'um dois'\n")
    (tmp_path / "2.toml").write_text("[a.b]\npattern = 'y+'\n")
    assert packs.load(tmp_path) == {"a.b": {"pattern": "y+"}, "a.w": {"words": ["um", "dois"]}}
    assert packs.overlaid({"k": {"text": "1"}}, {"k": {"text": "2"}}) == {"k": {"text": "2"}}
    for bad in ("[a]\npattern = '('\n", "[a]\npattern = 'x'\ntext = 'y'\n", "x = 1\n"):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError):
            packs.load(tmp_path / "bad.toml")


def test_stream_equals_table(spark, tmp_path):
    rows = [(k, "paddle" if k % 2 else "native", PROSE if k % 3 else "xx", datetime.datetime(2024, 1, 1 + k % 3)) for k in range(30)]
    df = spark.createDataFrame(rows, "reading_id long, step string, text string, loaded_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = measure.texts(spark, str(tmp_path / "in"), df.schema)
    query = measure.quality_by_window(stream).writeStream.format("memory").queryName("quality").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.step, r.texts, round(r.mean_score, 6)) for r in spark.table("quality").collect())
    table = measure.scored(df).groupBy(F.window("loaded_at", "1 day"), "step").agg(F.count("*").alias("texts"), F.avg("score").alias("m"))
    assert got == sorted((r.step, r.texts, round(r.m, 6)) for r in table.collect())
