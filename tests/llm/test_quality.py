import math

import numpy as np
import pytest

from pergamin.llm import quality as Q

COMMON = {w: ("pt",) for w in "o a os as de do da em no na por com sem que se e ao para uma um".split()} | {w: ("en",) for w in "the of and with a".split()}
SENTENCES = ["O perito nomeado juntou o laudo, conforme a fl. 12, e o réu não se opôs.", "A parte autora requereu a penhora do imóvel, uma vez que o prazo venceu.", "Com efeito, o oficial certificou que a diligência foi feita na sede da filial.", "Em síntese, a credora aceitou a proposta de acordo, sem qualquer ressalva."]
ITEMS = ["a carta de fiança", "o laudo pericial n. 12", "a guia de recolhimento da filial", "o auto de penhora", "a nota fiscal", "o recibo de entrega"]
MARKS = ["- {}", "{n}) {}", "• {}", "{}", "({n}) {};"]


def samples():
    rows = []
    for k in range(12):
        rows.append(("\n".join(SENTENCES[(k + j) % 4] for j in range(1 + k % 4)), "prose"))
        rows.append(("\n".join(MARKS[k % 5].format(ITEMS[(k + j) % 6], n=j + 1) for j in range(5)), "list"))
        cut = ["\t", " | ", ";", "    "][k % 4]
        rows.append(("\n".join([cut.join(["Data", "Histórico", "Valor"]), *(cut.join([f"1{j}/0{1 + k % 9}/2010", ITEMS[(k + j) % 6].split(" ", 1)[1], f"1.{j}00,0{j}"]) for j in range(4))]), "table"))
        rows.append(("\n".join(["xq zvrt kkwj qqn", "#% &x *z ~q =;", "IIII llll,iiii |||", "g12g345g67g890g11", "¤†□ ◦¶▪ ‡§"][(k + j) % 5] for j in range(3)), "junk"))
    return rows


@pytest.fixture(scope="module")
def profiles():
    return Q.learn(samples(), COMMON)


def form(text, profiles):
    items = Q.items_of(text)
    forms, _ = Q.item_forms(items, Q.Describer(profiles))
    return Q.FORMS[int(np.bincount(forms, [len(i) for i in items]).argmax())]


def test_divergence():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    d = Q.divergence(p, p)
    assert d[0, 0] == d[1, 1] == 0 and math.isclose(d[0, 1], d[1, 0])
    assert math.isclose(Q.divergence(np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]]))[0, 0], 1.0)


def test_held_out_samples(profiles):
    rows = samples()
    learned = Q.learn(rows[::2] + rows[1:24:2], COMMON)
    held = rows[25::2]
    assert sum(form(t, learned) == f for t, f in held) >= 0.9 * len(held)


def test_wrapped_and_numbered_prose(profiles):
    assert form("O perito nomeado juntou o laudo, conforme\na fl. 12, e o réu não se opôs. A parte\nautora requereu a penhora do imóvel, uma\nvez que o prazo venceu.", profiles) == "prose"
    assert form("1. " + "\n2. ".join(SENTENCES), profiles) == "prose"
    assert form("- a carta de fiança da sede\n- o laudo", profiles) == "list"


def test_statistics_by_hand(spark, profiles):
    df = spark.createDataFrame([(1, "O réu, e a ré.\n12 # de", "x")], "row_id long, text string, form string")
    r = Q.text_quality(df, profiles).first()
    assert (r.words, r.punctuated_lines, r.language) == (6, 0.5, "pt")
    assert math.isclose(r.mean_word_length, (1 + 3 + 1 + 1 + 2 + 2) / 6)
    assert math.isclose(r.common_words, 4 / 6)
    assert math.isclose(r.symbol_ratio, 3 / 15)
    assert math.isclose(r.prose_share + r.list_share + r.table_share + r.junk_share, 1)


def test_dirty_rows(spark, profiles):
    long = (SENTENCES[0] + " ") * 3000
    data = [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (None, "xq zvrt kkwj qqn\n#% &x *z ~q"), (5, "é" * 100_000)]
    out = Q.text_quality(spark.createDataFrame(data, "row_id long, text string"), profiles).collect()
    assert len(out) == len(data)
    by = {r.row_id: r for r in out}
    assert [by[k].form for k in (1, 2, 3)] == [None] * 3 and by[1].words == 0 and by[1].prose_divergence == 1.0
    assert by[4].form == "prose" and by[4].words == 3000 * 15 and by[None].form == "junk"
    assert Q.text_quality(spark.createDataFrame([], "row_id long, text string"), profiles).collect() == []


def test_lines(spark):
    profiles = Q.learn(samples(), COMMON, lines=True)
    texts = ["PEDIDOS", "- a carta de fiança", "• o laudo pericial n. 12", "10/02/2010 | nota fiscal | 1.200,00", "xq zvrt kkwj qqn", "- 3 -", "n. 836.306 e o réu requereu", "o perito nomeado juntou o laudo", "J. Moura requereu a penhora", None, "  ", "1. O perito nomeado juntou o laudo pericial, conforme", "a fl. 12, e o réu não se opôs."]
    df = spark.createDataFrame([(k, 1, "paddle", 0, k, t, 0.0) for k, t in enumerate(texts)] * 2, "line_id long, doc_id long, step string, page_no int, i int, text string, junk double")
    got = Q.line_forms(df, profiles)
    assert {r.line_id: r.form for r in got.collect()} == dict(enumerate(["prose", "list", "list", "table", "junk", "prose", "prose", "prose", "prose", None, None, "prose", "prose"]))
    assert Q.line_forms(df.limit(0), profiles).collect() == []


def test_training_from_tables(spark):
    rows = spark.createDataFrame([*samples(), (None, "prose"), ("x", None), ("x", "other")], "text string, form string")
    words = spark.createDataFrame([(k, v[0]) for k, v in COMMON.items()] + [(None, "pt")], "word string, lang string")
    a, b = Q.train(rows, words), Q.train(rows.repartition(3), words)
    np.testing.assert_array_equal(a.centres, b.centres)
    assert set(a.languages) == {"pt", "en"}
