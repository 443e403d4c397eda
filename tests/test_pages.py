"""Pages, engines and packs; and the SQL of final texts on planted rows."""

import random

import pytest
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.functions import checks, prose
from pergamin.functions import text as X
from pergamin.operators import engines, lines, pages
from pergamin.sources import packs

LONG = "texto nativo " * 20


def native(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page_no int, text string")


def test_pages_to_read(spark):
    rows = [(1, 0, LONG), (1, 1, ""), (1, 2, None), (2, 0, LONG), (2, 1, LONG), (3, 0, " "), (3, 1, None), (1, 1, "")]
    got = {(r.doc_id, r.page_no): r["rank"] for r in pages.to_read(native(spark, rows)).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 0): 1, (2, 1): 2, (3, 0): 1, (3, 1): 2}
    many = pages.to_read(native(spark, [(1, k, "") for k in range(70)]))
    assert many.count() == C.Thresholds().max_pages == 64 and many.agg(F.max("page_no")).first()[0] == 63
    kept = pages.subdocument(native(spark, rows), spark.createDataFrame([(1, 2), (1, 9)], "doc_id long, page_no int"))
    assert [(r.doc_id, r.page_no) for r in kept.collect()] == [(1, 2)]
    assert pages.to_read(native(spark, []).limit(0)).collect() == []


def engine():
    """A class of its own each time, so that workers need no module of the tests."""

    class Fake:
        def __init__(self, available=True):
            self.can = available

        def available(self):
            return self.can, "" if self.can else "no model"

        def read_page(self, page):
            if page == "broken":
                raise RuntimeError("a page that " + "cannot be read " * 50)
            return (page or "").upper(), 80.0

    return Fake


def test_an_engine_reads_pages_and_never_raises(spark):
    df = native(spark, [(1, 1, "b"), (1, 0, "a"), (2, 0, "broken"), (3, 0, ""), (3, 1, "broken"), (3, 2, "c")]).withColumnRenamed("text", "content")
    read = pages.transcriptions(engines.read_pages(df, engine(), "fake"))
    got = {r.doc_id: (r.text, r.pages_sent, r.pages_answered, r.confidence, len(r.failures)) for r in read.collect()}
    assert got == {1: ("A\n\nB", 2, 2, 80.0, 0), 2: ("", 1, 0, 0.0, 1), 3: ("C", 3, 2, 80.0, 1)}
    assert all(len(f) <= 160 for r in read.collect() for f in r.failures)


def test_batches_fail_as_a_whole(spark):
    made = pages.batches(native(spark, [(1, k, f"p{k}") for k in range(5)] + [(2, 0, "x")]))
    assert sorted((r.doc_id, r.batch_no, r.page_nos) for r in made.collect()) == [(1, 0, [0, 1]), (1, 1, [2, 3]), (1, 2, [4]), (2, 0, [0])]
    sent = made.withColumn("contents", F.transform("page_nos", lambda k: F.concat(F.lit("p"), k.cast("string"))))

    def client():
        def answer(texts):
            if "p2" in texts:
                raise TimeoutError("too late")
            return texts[:1] if "p4" not in texts and "p1" not in texts else texts

        return answer

    read = engines.read_batches(sent, client)
    assert {(r.doc_id, r.pages_sent, r.pages_answered, r.failed_batches) for r in pages.batch_coverage(read).collect()} == {(1, 5, 3, 1), (2, 1, 1, 0)}
    assert [r.error for r in read.where("error is not null").collect()] == ["too late"]
    short = engines.read_batches(sent.where("doc_id = 1"), lambda: lambda texts: texts[:1])
    assert {(r.pages_answered, r.failed_batches) for r in pages.batch_coverage(short).collect()} == {(1, 2)}


def test_registry_of_engines():
    registry, Fake = engines.Registry(), engine()
    registry.register("b", Fake, priority=20)
    registry.register("a", Fake, priority=20)
    registry.register("first", Fake, priority=1, platforms=("darwin",))
    registry.register("off", lambda: Fake(False), priority=2)
    registry.register("eye", Fake, priority=3, only_witness=True)
    assert registry.order("linux") == ["a", "b"] and registry.order("darwin") == ["first", "a", "b"]
    assert registry.order("darwin", {"a": "first"}) == ["first", "b"]
    assert registry.get("a") is registry.get("a") and registry.get("a") is not registry.get("a", available=True)
    assert ("off", 2, False, "no model") in registry.report("linux") and ("first", 1, False, "not on linux") in registry.report("linux")
    with pytest.raises(KeyError):
        registry.get("none")


def test_witness_words_and_second_readings(spark):
    rows = [(k, 1, p, n, t, s) for k, (p, n, t, s) in enumerate([(0, 0, "um dois", 0.9), (0, 1, "três", 0.3), (1, 0, None, 0.9), (3, 0, "longe demais", 0.99)])]
    df = spark.createDataFrame(rows, "line_id long, doc_id long, page_no int, line_no int, text string, score double")
    assert [(r.reliable, r.confidence, r.text) for r in pages.witnesses(df).collect()] == [(2, 70.0, "um dois\ntrês\n")]
    words = spark.createDataFrame([(1, 0, 0, 0, 0, 2, "mundo", 80.0, 5.0, 1.0, 9.0, 2.0), (1, 0, 0, 0, 0, 1, "olá", 90.0, 0.0, 0.0, 4.0, 2.0), (1, 0, 0, 0, 0, 3, " ", 99.0, 0.0, 0.0, 99.0, 9.0), (1, 0, 0, 0, 0, 4, "x", -1.0, 0.0, 0.0, 99.0, 9.0)], "doc_id long, page_no int, block int, paragraph int, line int, word_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    r = pages.words_to_lines(words).first()
    assert (r.text, r.score, tuple(r.box)) == ("olá mundo", 0.85, (0.0, 0.0, 9.0, 2.0))
    again = spark.createDataFrame([(0, 0, "UM", 0.95), (0, 1, "DOIS", 0.99), (0, 2, "OUTRO", 0.99), (1, 0, "TRÊS", 0.38)], "line_id long, ordinal int, text string, score double")
    assert {r.line_id: (r.text, r.replaced) for r in pages.reread(df, again).collect()} == {0: ("DOIS", True), 1: ("três", False), 2: (None, False), 3: ("longe demais", False)}


def test_packs_override_what_plans_read(spark, tmp_path, monkeypatch):
    (tmp_path / "own.toml").write_text('[stamp.patterns]\npatterns = ["CARIMBO [0-9]+"]\n[metrics.stopwords]\nwords = "the of"\n')
    df = spark.createDataFrame([("a CARIMBO 12 b",)], "text string")
    bare = lambda: df.select(X.strip_stamp(F.col("text")).alias("x")).first().x
    assert bare() == "a CARIMBO 12 b"
    with packs.used(packs.resolved(tmp_path / "own.toml")):
        assert bare() == "a b" and C.STOPWORDS == ["the", "of"]
    assert bare() == "a CARIMBO 12 b" and "de" in C.STOPWORDS
    monkeypatch.setenv(packs.ENVIRONMENT, str(tmp_path))
    assert packs.resolved()["metrics.stopwords"]["words"] == ["the", "of"] and packs.names() == sorted(packs.ENTRIES)
    with pytest.raises(ValueError), packs.used({"no.such": {"text": "x"}}):
        pass


def test_privacy(spark):
    base = [1, 1, 2, 2, 2, 3, 3, 3, 0, 0, 0, 1]
    for n in (12, 13):
        total = sum(d * w for d, w in zip(base, checks.COMPANY_WEIGHTS[13 - n :])) % 11
        base.append(0 if total < 2 else 11 - total)
    d = "".join(map(str, base))
    right = f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}"
    wrong = right[:-1] + str((int(right[-1]) + 1) % 10)
    text = f"{right} {wrong} a.b@real.net x@example.com http://10.0.0.1/ token = 'abcdefghijklmnopqrst'\nfica@aqui.net privacy-check: allow\n-----BEGIN RSA PRIVATE KEY-----"
    r = checks.privacy(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert tuple(r[0])[1:] == (2, 1, 1, "a.b@******et".replace("******", "*" * (len("a.b@real.net") - 6)), 1, 2)


def test_words_that_ran_together(spark):
    words = spark.createDataFrame([(w, 9) for w in ("estado", "mato", "grosso", "processo", "julgado")], "word string, n long")
    rows = [(1, "estadodematogrossodosul julgado"), (2, "processo julgado"), (3, "qwertyuiopasdfgh zxcvbnm"), (4, None), (1, "estadodematogrossodosul julgado")]
    df = spark.createDataFrame(rows, "line_id long, text string").withColumn("score", F.lit(0.9)).withColumn("poly", F.lit(None).cast("array<struct<x:double,y:double>>")).withColumn("page_w", F.lit(9.0)).withColumn("page_h", F.lit(9.0))
    words = words.unionByName(spark.createDataFrame([("sul", 9)], "word string, n long"))
    out = lines.classify(lines.recover(lines.with_coverage(df, words), words))
    assert sorted(((r.line_id, r.clean_text, r.kind) for r in out.collect()), key=str) == [(1, "estado de mato grosso do sul julgado", "recovered")] * 2 + [(2, "processo julgado", "clean"), (3, "qwertyuiopasdfgh zxcvbnm", "clean"), (4, "", "fragment")]


POOL = ["1)", "2)", "-", "- item", "#", "texto da frase", "Outra frase.", "consti-", "tuição", "12/", "345 v", "", "12", "TÍTULO DA PEÇA", "o Sr.", "S.A.", "ã.", "> cita", "mantê-", "los", "R$", "5,00", "RS 9,159.70 e RE 1,00 RE 2,00", "R$30,00", "Este documento é cópia  x", "este documento é cópia x", "a\tb  c", "§$", "ação, art.", "99 disse", "CÓDIGO DE VERIFICAÇÃO 1", "Уm"]


def test_final_text_equals_the_fold_of_its_sql(spark):
    """The array expressions against DuckDB's fold over lines, on composed texts."""
    duckdb = pytest.importorskip("duckdb")
    from pergamin.plans import oracles

    rng = random.Random(4)
    texts = [(k, "\n".join(rng.choice(POOL) for _ in range(rng.randint(0, 10)))) for k in range(300)]
    got = {r.k: (r.x, r.y) for r in spark.createDataFrame(texts, "k int, text string").select("k", prose.normalize(F.col("text")).alias("x"), prose.fix_thousands(F.col("text")).alias("y")).collect()}
    con = duckdb.connect()
    con.execute("create table d(k int, text varchar)")
    con.executemany("insert into d values (?, ?)", texts)
    for k, x, y in con.execute(f"select k, {oracles.final('text')}, {oracles.thousands('text')} from d").fetchall():
        assert got[k] == (x, y), texts[k]
