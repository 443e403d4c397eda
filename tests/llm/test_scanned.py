import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pergamin.llm import buckets as B
from pergamin.llm import scanned as S
from pergamin.llm.arrow_text import flat_utf8, tokens_of

WORDS = """o depositário fiel certificou que a parte autora homologou o contrato de locação perante a secretaria da vara e mandou expedir
o mandado de citação ao município conforme o processo no período da tarde em nome da comarca uma vez que o valor já estava quitado
a médica-assistente e o vice-diretor foram ouvidos na audiência de segunda-feira com a anuência dos herdeiros por simples petição
habilitação transportadora demonstrativo contábil responsável penhora memorial convocação""".split()  # fmt: skip
KNOWN = [" ".join(WORDS)] * 300
PAIRS = {int(k) for k in S.pair_key(*(lambda h: (h[:-1], h[1:]))(S.hash_words(WORDS)))}


def entries(words):
    """The entries of these words among the known ones, by the definition."""
    known = {w: (300, 300) for w in WORDS}
    forms = {}
    for w in known:
        for k in S.form_skeletons(w):
            forms[k] = min(forms.get(k, w), w)
    for w in {S.word_of(x) for x in words} | set(known):
        best = min((forms[k] for k in S.variant_skeletons(w) if k in forms and forms[k] != w), default=None)
        n = known.get(w, (0, 0))[0]
        if n or best:
            yield w, (n, n, best, 300 if best else None, 300 if best else None)


def features(lines):
    np.seterr(over="ignore")
    reader = S.LineReader(False)
    reader.words.update(entries(x for line in lines for x in line.split()))
    data, offsets = flat_utf8(pa.array(lines, pa.string()))
    return reader.features(data, offsets, np.ones(len(lines), np.int64))


@pytest.mark.parametrize(
    "line,repaired",
    [
        ("o depositário fiel certificou", None), ("homol0gou o contrato", "homologou o contrato"), ("na @udiência", "na audiência"), ("o muriicípio", "o município"),
        ("uma penbora", "uma penhora"), ("o proccsso no", "o processo no"), ("parte aufora", "parte autora"), ("mandou expeclir", "mandou expedir"), ("da cornarca", "da comarca"),
        ("o 5ecretaria da", "o secretaria da"), ("responsáveI", "responsável"), ("respons6vel", "responsável"), ("valor 1.2O0,5l", "valor 1.200,51"), ("valor 1.200,51", None), ("código KT-6l50 lote 5B às 6h46", None),
        ("Leolânio Dalmanhoz o processo", None), ("aufora@caixa.test o processo", None), ("Hornologou o contrato", "Homologou o contrato"), ("MUN1CÍPIO DA COMARCA", "MUNICÍPIO DA COMARCA"),
    ],
)
def test_misread_words(line, repaired):
    found, tokens = features([line]), line.split()
    for at, word, pairs in found.fixes.get(0, []):
        if not pairs or set(pairs) & PAIRS:
            tokens[at] = word
    assert " ".join(tokens) == (repaired or line)


NUMBERS = ["1", "- 36 -", "[43]", "p. 5", "pág. 1/4", "Fl. n. 2", "0001", "II", "Página 2 de 2", "fls. 79", "Page 3 of 9", "— 7 —", "‑ 79 ‑"]
OTHERS = ["Volume 2", "n. 0516 fl", "1 parte autora", "R$ 100,00", "", " ", "--", "Anexo III", "12/05/2010"]


def test_page_numbers():
    assert features(NUMBERS + OTHERS).page_no.tolist() == [True] * len(NUMBERS) + [False] * len(OTHERS)


def test_masks_do_not_depend_on_blanks_and_numbers():
    found = features(["Comarca de Vila - 1ª Vara - fl. 3", "Coma rca de Vila - 1ª Vara - fl. 44", "Comarca de Vila - 2ª Vara - fl. 3", "Cornarca de Vila - 1ª Vara - fl. 5", "x " * 5000])
    assert found.mask[0] == found.mask[1] == found.mask[3] != found.mask[2] and found.form[0] == found.form[2]
    assert found.masked.all()


def test_tokens_are_those_of_split():
    rng = random.Random(1)
    chars = ["a", "é", "漢", "𝐁", " ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", " ", " ", "　", " ", "​", "\x01", "-"]
    for _ in range(300):
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5))]
        tokens, first, _ = tokens_of(*flat_utf8(pa.array(texts, pa.string())))
        assert [[x.decode() for x in tokens[first[k] : first[k + 1]].to_pylist()] for k in range(len(texts))] == [t.split() for t in texts]


PAGES = [
    ["Comarca de Vila - 1ª Vara - fl. 3", "O depositário fiel certificou que a habili-", "tação da parte autora e a médica-", "assistente homologou o contrato de loca-", "fls. 1"],
    ["Comarca de Vila - 1ª Vara - fl. 4", "ção perante a secretaria da vara.", "O vice-", "diretor foram ouvidos o proces5o da trans¬", "%# &x zq ~~ kkj", "portadora.", "fls. 2"],
]
LINES = "line_id long, doc_id long, step string, page_no int, line_no int, text string"


def found_in(spark, lines=None, texts=None, rows=1, whole=False):
    others = spark.createDataFrame([(t,) for t in KNOWN], "text string")
    lines = S.page_lines(spark.createDataFrame([], LINES)) if lines is None else lines
    texts = S.reading_texts(spark.createDataFrame([], "reading_id long, text string")) if texts is None else texts
    return S.read_lines(lines, texts, others, rows, whole)


def test_noise_of_pages(spark):
    data = [(1000 + p * 100 + k, 1, "paddle", p, k, t) for p, page in enumerate(PAGES) for k, t in enumerate(page)]
    lines = S.page_lines(spark.createDataFrame(data + data[:3], LINES))
    for buckets in (1, B.BUCKET_ROWS * 5):
        got = sorted((r.row_id - 1000, r.noise) for r in S.noises(*found_in(spark, lines, rows=buckets)).distinct().collect())
        assert got == [(0, "header"), (1, "hyphen"), (3, "hyphen"), (4, "page_no"), (100, "header"), (103, "hyphen"), (103, "misread"), (106, "page_no")]
    text = [(r.page, r.paragraph, r.continues, r.text) for r in S.paragraphs(*found_in(spark, lines, whole=True)).orderBy("page", "paragraph").collect()]
    assert text[0] == (0, 0, False, "O depositário fiel certificou que a habilitação da parte autora e a médica-assistente homologou o contrato de loca")
    assert text[1][2:] == (True, "ção perante a secretaria da vara.")
    assert text[2][3] == "O vice-diretor foram ouvidos o processo da transportadora."


def test_readings_and_dirty_rows(spark):
    text = "\n\n".join("\n".join(p) for p in PAGES)
    data = [(1, text), (1, text), (2, None), (3, ""), (4, " \n\n "), (None, text), (5, "o contrato " * 30000)]
    df = spark.createDataFrame(data, "reading_id long, text string")
    got = S.noises(*found_in(spark, texts=S.reading_texts(df))).select("row_id", "noise").distinct().collect()
    assert {tuple(r) for r in got} == {(i, n) for i in (1, None) for n in ("header", "hyphen", "page_no", "misread")}
    assert S.noises(*found_in(spark, texts=S.reading_texts(df.limit(0)))).collect() == []
    lost = spark.createDataFrame([(k, None, None, None, None, t) for k, t in enumerate([*PAGES[0], None, " "])], LINES)
    assert {r.noise for r in S.noises(*found_in(spark, S.page_lines(lost))).collect()} == {"page_no", "header", "hyphen"}


def chunked(table, sizes):
    at = 0
    for n in itertools.cycle(sizes):
        if at >= table.num_rows:
            return
        yield from ((0, False, b) for b in table.slice(at, n).combine_chunks().to_batches())
        at += n


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1, 7), (5,)])
def test_batches_make_no_difference(sizes):
    """Pages that end within, at and behind the ends of batches."""
    rng = random.Random(3)
    pool = [t for p in PAGES for t in p] + ["%# &x zq ~~ kkj", "o con-", "tra-", "trato da vara", "fls. 9"]
    rows = [(0, page, k, rng.choice(pool)) for page in range(40) for k in range(rng.randint(1, 12))]
    columns = list(zip(*[(S.PAGE_LINES, i, u, p, k, t) for i, (u, p, k, t) in enumerate(rows)]))
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["record", "row_id", "unit", "page", "line_no", "text"])
    table = pa.concat_tables([table.slice(0, 5), table.slice(4)])  # a row given twice

    def read(parts):
        reader = S.LineReader(False)
        reader.words.update(entries(x for t in pool for x in t.split()))
        reader.restart = reader.close
        return sorted(str(r) for b in reader(parts) for r in b.to_pylist())

    assert read(chunked(table, sizes)) == read(chunked(table, (10_000,)))


def test_a_page_of_many_lines(spark):
    """Work in proportion to the lines, however long a page is."""
    text = F.when(F.col("id") % 2 == 1, "ção perante a secretaria").otherwise("o contrato de loca-")
    lines = spark.range(50_000).select(F.col("id").alias("line_id"), F.lit(1).alias("doc_id"), F.lit("paddle").alias("step"), F.lit(0).alias("page_no"), F.col("id").cast("int").alias("line_no"), text.alias("text"))
    got = S.noises(*found_in(spark, S.page_lines(lines))).groupBy("noise").count().collect()
    assert {(r.noise, r["count"]) for r in got} == {("hyphen", 25_000)}


def test_counts_cover_every_row(spark):
    df = spark.createDataFrame([(0, "a parte autora\na parte autora")] * 40 + [(None, None), (1, ""), (1, "Parte rara"), (1, "w" * 100_000)], "bucket int, text string").repartition(3)
    counts = S.corpus_counts(df).cache()
    words = {r.word: (r.n, r.small) for r in S.totals(counts).collect()}
    assert words["parte"] == (81, 80) and words["autora"] == (80, 80) and words["rara"] == (1, 1) and words["w" * 100_000] == (1, 1)
    keys = S.hash_words(["parte", "autora", "a"])
    pairs = {r.hash for r in S.known_pairs(counts).collect()}
    assert int(S.pair_key(keys[:1], keys[1:2])[0]) in pairs and int(S.pair_key(keys[1:2], keys[2:])[0]) not in pairs
    assert S.totals(S.corpus_counts(df.limit(0))).collect() == []


def test_what_is_known_does_not_depend_on_the_size(spark):
    """A word seen five times is known among ten words and among a hundred thousand."""
    rare = [(0, "habilitacor habilitação")] * 5
    for n in (1, 20_000):
        df = spark.createDataFrame(rare, "bucket int, text string").unionByName(spark.range(n).select(F.lit(1).alias("bucket"), F.lit("o processo da vara de locação").alias("text")))
        got = {r.word: r.n for r in S.word_entries(S.corpus_counts(df)).where("bucket = 0").collect()}
        assert got == {"habilitacor": 5, "habilitação": 5}
