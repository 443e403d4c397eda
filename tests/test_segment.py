import itertools
import random

from pergamin.operators import segment

WORDS = frozenset("estado de mato grosso do sul documento conferido pela secretaria da vara ma to".split())


def every_split(run):
    """The first split by the plain definition: longest part first, going back where the rest fails."""
    for size in range(min(segment.LONGEST, len(run)), segment.SHORTEST - 1, -1):
        if run[:size] in WORDS:
            if size == len(run):
                return [run]
            rest = every_split(run[size:])
            if rest:
                return [run[:size], *rest]
    return None


def test_parts():
    assert segment.parts_of("ESTADODEMATOGROSSODOSUL", WORDS) == ["ESTADO", "DE", "MATO", "GROSSO", "DO", "SUL"]
    assert segment.parts_of("estadodematogrossox", WORDS) is None and segment.parts_of("secretaria", WORDS) is None
    rng = random.Random(3)
    for _ in range(300):
        run = "".join(rng.choices([*WORDS, "x"] if rng.random() < 0.3 else [*WORDS], k=rng.randrange(2, 7)))
        found = every_split(run)
        assert segment.parts_of(run, WORDS) == (found if found and len(found) > 1 else None)
    assert segment.parts_of("de" * 3000 + "x", WORDS) is None


def test_operator(spark):
    lexicon = spark.createDataFrame([(w, 5) for w in WORDS], "word string, n long")
    data = [(1, "o documentoconferidopela vara"), (2, "nada muda aqui"), (3, None), (4, ""), (None, "SECRETARIADAVARA"), (1, "o documentoconferidopela vara")]
    out = segment.resegment(spark.createDataFrame(data, "id int, text string"), lexicon)
    got = sorted(((r.id, r.resegmented) for r in out.collect()), key=str)
    assert got == sorted([(1, "o documento conferido pela vara")] * 2 + [(2, None), (3, None), (4, None), (None, "SECRETARIA DA VARA")], key=str)
    assert segment.resegment(spark.createDataFrame([], "id int, text string"), lexicon.limit(0)).collect() == []


def test_rare_words_of_a_large_lexicon_are_parts(spark):
    lexicon = spark.createDataFrame([("conferido", 3), ("Documento".lower(), 3), ("de", 10_000_000)], "word string, n long")
    out = segment.resegment(spark.createDataFrame([(1, "documentoconferido e DOCUMENTOCONFERIDO")], "id int, text string"), lexicon).collect()
    assert [r.resegmented for r in out] == ["documento conferido e DOCUMENTO CONFERIDO"]


def test_accents_keep_their_place():
    words = frozenset(["acao", "judicial", "publica"])
    assert segment.parts_of("AçãoJudicialPública", words) == ["Ação", "Judicial", "Pública"]
    assert list(itertools.chain(segment.parts_of("açãojudicialpública", words))) == ["ação", "judicial", "pública"]
