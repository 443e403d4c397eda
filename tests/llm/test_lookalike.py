import itertools
import unicodedata

from pyspark.sql import functions as F

from pergamin.llm import lookalike

SAME = [
    ["propôs a cláusula", "ｐropôs a cláusula", "propôs a cláusula", "prop​ôs a cláusula", "prορôs а cláusula", "propôs a cláus­ula", "propôs a cláusula  "],
    ["certificou", "certiﬁcou"],
    ["deso-", "deso­", "deso‑"],
    ["Nº 12", "Nº １２"],
    ["ação ό", "ação ó", "ação ό"],
]
DIFFERENT = ["l0te", "lote", "Lote", "lóte", "lote.", "lote,", "1ote", "Iote", "lote 3", "lote 8", "lote ٣", "l o t e", "lo te", "ﬁm-", "fim", "–", "-", "ç", "c"]


def plain_key(text):
    """The key by the plain definition, with Python's Unicode tables."""
    table = dict(zip(*lookalike.mapping()))
    text = text.replace("­\n", "-\n")
    text = text[:-1] + "-" if text.endswith("­") else text
    text = "".join(table.get(c, lookalike.LIGATURES.get(c, c)) for c in text)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = "".join(table.get(c, c) for c in unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", text).rstrip(" ")


def rows(spark, texts):
    return spark.createDataFrame([(i, 7, t, "x") for i, t in enumerate(texts)], "line_id long, doc_id long, text string, look string")


def test_classes_equal_the_plain_definition(spark):
    texts = [t for group in SAME for t in group] + DIFFERENT
    got = {tuple(r) for r in lookalike.same_look_pairs(rows(spark, texts), ["doc_id"], "line_id").collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] != texts[j] and plain_key(texts[i]) == plain_key(texts[j])}
    assert got == want and len(want) > 20
    forms = {r.line_id: r for r in lookalike.canonical_forms(rows(spark, texts), "line_id").collect()}
    assert len(forms) == len(texts)
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (forms[i].look == forms[j].look) == (plain_key(texts[i]) == plain_key(texts[j]))
    assert forms[1].canonical == SAME[0][0]


def test_canonical_does_not_depend_on_order(spark):
    texts = ["а", "ａ", "аbс", "аbc", "abс"]
    first = {r.line_id: r.canonical for r in lookalike.canonical_forms(rows(spark, texts), "line_id").collect()}
    second = {r.line_id: r.canonical for r in lookalike.canonical_forms(rows(spark, texts).orderBy(F.desc("line_id")).repartition(3), "line_id").collect()}
    assert first == second and len({*first.values()}) == 2


def test_dirty_rows(spark):
    long = "ação judicial " * 20000
    data = [(1, 1, "a b"), (1, 1, "a b"), (2, 1, "a b"), (2, 1, "a b"), (3, 2, "a b"), (4, None, "a b"), (5, None, "a b"), (None, 1, "a b"), (6, 1, None), (7, 1, ""), (8, 1, "  "), (9, 1, "  "), (10, 3, long), (11, 3, long.replace(" ", " "))]
    df = spark.createDataFrame(data, "line_id long, doc_id long, text string")
    assert sorted(map(tuple, lookalike.same_look_pairs(df, ["doc_id"], "line_id").collect())) == [(1, 2), (10, 11)]
    forms = lookalike.canonical_forms(df, "line_id").collect()
    assert len(forms) == len(data)
    assert {r.canonical for r in forms if r.line_id in (1, 2, 3, 4, 5)} == {"a b"}
    assert [r.look for r in forms if r.line_id == 6] == [None]
    assert lookalike.same_look_pairs(df.limit(0), ["doc_id"], "line_id").collect() == []
    assert lookalike.canonical_forms(df.limit(0), "line_id").collect() == []


def test_a_group_of_copies_forms_no_pairs_within_itself(spark):
    df = spark.range(4000).selectExpr("id as line_id", "1 as doc_id", "if(id = 0, 'a b', 'a b') as text")
    assert lookalike.same_look_pairs(df, ["doc_id"], "line_id").count() == 3999


def test_characters_that_are_another_by_definition(spark):
    """Whatever a character is by composition, it looks like it, and shares its letters and digits."""
    import unicodedata

    table = dict(zip(*lookalike.mapping()))
    for point in range(0x80, 0xD800):
        c = chr(point)
        composed = unicodedata.normalize("NFC", c)
        if composed != c and len(composed) == 1:
            assert table.get(c) == table.get(composed, composed), hex(point)
    df = spark.createDataFrame([(1, 1, "OK 5 sala"), (2, 1, "O\u212a 5 sala"), (3, 1, "O\u212a 5 \u212bs"), (4, 1, "OK 5 \u00c5s")], "line_id long, doc_id long, text string")
    assert sorted(map(tuple, lookalike.same_look_pairs(df, ["doc_id"], "line_id").collect())) == [(1, 2), (3, 4)]
