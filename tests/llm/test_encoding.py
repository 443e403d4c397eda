import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pergamin.llm import encoding as E
from pergamin.llm.arrow_text import flat_utf8

CLEAN = """O depositário fiel certificou que a instituição não cumpriu a decisão liminar à vista dos documentos, conforme o art. 5º, § 2º.
A audiência de conciliação será às nove horas; o síndico, o cônjuge e a médica não estão no município. Até lá, é só o que há.
El año pasado la administración ratificó el depósito según la numeración antigua; también señaló el plazo. The owner accepted it.
Os herdeiros propõem a construção do prédio com mais três vizinhos, após a perícia, e já há acórdão público sobre a ação."""


@pytest.fixture(scope="module")
def model():
    counts = E.trigram_counts(flat_utf8(pa.array([CLEAN, CLEAN.upper()] * 200))[0])
    return E.log_probabilities([(int(k), int(counts[k])) for k in np.flatnonzero(counts)])


@pytest.mark.parametrize("pair", [p for p in E.PAIRS if p[0] not in ("utf-8 twice", "utf-7")])
def test_round_trip_of_every_pair(model, pair):
    text = CLEAN.replace("§", "par.").replace("º", "o")
    text = "".join(c if c.encode(pair[0], "ignore") else "-" for c in text)  # the older ones lack some letters
    wrong = "".join(E.read_as(c.encode(pair[0]), pair[1]) for c in text)
    fixed, states, spans = E.Labeller(model).repair(wrong)
    assert spans > 20
    assert sum(a == b for a, b in zip(fixed.split(), text.split())) >= 0.9 * len(text.split())  # a lone capital may stand for several letters


def test_twice_and_utf7_and_lost(model):
    text = CLEAN.split("\n")[1]
    twice = E.read_as(E.read_as(text.encode(), "cp1252").encode(), "cp1252")
    assert E.Labeller(model).repair(twice)[0] == text
    assert E.Labeller(model).repair("a concilia+AOcA4w-o e o s+AO0-ndico")[0] == "a conciliação e o síndico"
    fixed, states, spans = E.Labeller(model).repair("a concilia��o do s�ndico")
    assert states == ["any as substitute"] and fixed == "a concilia��o do s�ndico" and spans == 2


@pytest.mark.parametrize(
    "text",
    [CLEAN, CLEAN.upper(), "sín­tese da conci​liação", "a parte autora e o síndico", "Приложение без перевода", "Σύμβαση μίσθωσης", "翻訳のない", "¿Qué? ¡No! “sim” – ‘não’… 5 €",
     "■◦x‡x□v¦□ ¤7¤v◦ ◦J◦", "+_¨ <</*°%_ ;^¨", "certiﬁcou", "Habilitаção еxріrado", "ｐropôs", "hou-\nve lei¬\nloeiro", "C++ e a+b- c", "http://x.test/?a=b"],
)
def test_clean_texts_stay(model, text):
    assert E.Labeller(model).repair(text) == (text, [], 0)


ARCHIVE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus_model():
    texts = pa.chunked_array([c.cast("string") for t in ("readings", "unwrapped") for c in pq.read_table(f"{ARCHIVE}/{t}.parquet", columns=["text"])["text"].chunks])
    counts = E.trigram_counts(flat_utf8(texts.combine_chunks())[0])
    return E.log_probabilities([(int(k), int(counts[k])) for k in np.flatnonzero(counts)])


@pytest.mark.skipif(not os.path.isdir(ARCHIVE), reason="no test archive")
def test_letters_lost_to_question_marks(corpus_model):
    labeller = E.Labeller(corpus_model)
    for text in ("a decis?o", "n?o", "o cr?dito", "im?vel", "DECIS?O", "medi??o", "a institui??o", "n??o", "o s?ndico", "?xitos e convoca??es", "mant?-lo", "O im?vel j? foi solicit? at? a per?cia"):
        assert labeller.repair(text)[:2] == (text, ["any as substitute"]), text
    assert labeller.repair("O im?vel j? foi")[2] == 2
    for text in ("Por que o autor requereu o pagamento? A parte est\u00e1 presente? Sim??", "\u00bfQui\u00e9n firm\u00f3? Is this the agreement? the defendant?", "http://x.test/p?id=3 a.php?nome www.x.test/?acao", "Qual o valor?) (quem?) ??? ? ____?", "What?!"):
        assert labeller.repair(text) == (text, [], 0), text


def test_operator_on_dirty_rows(spark, model):
    long = "concilia��o " * 20000
    rows = spark.createDataFrame([(1, "o sÃ­ndico", True), (1, "o sÃ­ndico", True), (2, None, None), (3, "", None), (4, " \n", None), (None, "sim", None), (5, long, None), (6, "é" * 5000, None)], "row_id long, text string, garbled boolean")
    statistics = E.letter_statistics(rows)
    assert statistics.shape == (E.N, E.N, E.N)
    out = E.repair_encoding(rows, model)
    got = sorted((r.row_id, r.garbled) for r in out.collect() if r.row_id)
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, True), (6, False)]
    kept = {r.row_id: r.restored for r in out.collect()}
    assert kept[1] == "o síndico" and kept[2] is None and kept[3] == "" and kept[None] == "sim" and kept[5] == long
    assert E.repair_encoding(rows.limit(0), E.letter_statistics(rows.limit(0))).collect() == []


@pytest.mark.parametrize("shift", range(6))
def test_long_words_are_never_cut_within_a_sequence(model, shift):
    labeller = E.Labeller(model)
    word = "x" * (E.PIECE - 3 + shift) + "iniciaÃ§Ã£o"
    assert labeller.repair(word)[0] == word.replace("Ã§Ã£", "çã")


def test_quoted_words_are_words(model):
    labeller = E.Labeller(model)
    assert labeller.repair("«iniciaÃ§Ã£o»")[0] == "«iniciação»" and labeller.repair("¿iniciaÃ§Ã£o?")[0] == "¿iniciação?"
    assert labeller.repair("«iniciação»") == ("«iniciação»", [], 0)
