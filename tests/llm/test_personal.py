import random

import pytest

from pergamin.llm import personal as P

KNOWN = P.Knowledge(
    common=frozenset("o a os as de do da em no na senhora senhor mora reside ouvi ouviu telefone contato documento com por que foi processo protocolo declarou".split()),
    given=frozenset(["deonisia", "quirilo", "valderildo"]),
    family=frozenset(["monvesco", "ferqueto", "jacatibal"]),
    patterns={("name", "E:queto"): 0.9, ("name", "E:vesco"): 0.9, ("name", "L:a senhora"): 0.9, ("name", "L:segundo"): 0.9, ("phone", "L:telefone :"): 0.9, ("id_number", "L:do cpf"): 0.9, ("email", "H:test"): 0.9, ("address", "L:reside na"): 0.9, ("address", "N:, nº "): 0.9},
    instances={("email", P.PLAIN_EMAIL): 1.0},
    intro=frozenset(["compareceu"]),
)


@pytest.mark.parametrize(
    "text,found",
    [
        ("escreva a ana.souza+x@mail.test. Fim", [("email", "ana.souza+x@mail.test")]),
        ("ana @ mail.test ou bia[at]mail[dot]test", [("email", "ana @ mail.test"), ("email", "bia[at]mail[dot]test")]),
        ("ana@\nmail.test e bia arroba mail ponto test", [("email", "ana@\nmail.test"), ("email", "bia arroba mail ponto test")]),
        ("o contr@to e o fin@l. Em seguida", []),
        ("Telefone: (90) 92042-5490.", [("phone", "(90) 92042-5490")]),
        ("+55 50 3111-9734, 0xx80 96021-2568 e 40 99113 5005", [("phone", "+55 50 3111-9734"), ("phone", "0xx80 96021-2568"), ("phone", "40 99113 5005")]),
        ("Portador do CPF 356.221.706-99, RG 6.338.413 SSP/QV", [("id_number", "356.221.706-99"), ("id_number", "6.338.413 SSP/QV")]),
        ("CNPJ 77.569.225/0001-24, processo 6736404-76.2017.9.00.3913, R$ 52.021,72, em 06-01-24", []),
        ("Mora na Rua das Três Cancelas, nº 2078, apto 5 - Centro - CEP: 04250-153, Nova Vila/XY. Em", [("address", "Rua das Três Cancelas, nº 2078, apto 5 - Centro - CEP: 04250-153, Nova Vila/XY")]),
        ("na Avenida Treze de Abril, s/n\n- Centro", [("address", "Avenida Treze de Abril, s/n\n- Centro")]),
        ("caminhou pela Rua da Fonte Seca ontem", []),
        ("Reside na Servidão das Três Cancelas, nº 27 - Centro, Nova Vila/XY. Em", [("address", "Servidão das Três Cancelas, nº 27 - Centro, Nova Vila/XY")]),
        ("Visitou a Servidão das Três Cancelas, nº 27 - Centro, Nova Vila/XY. Em", []),
        ("x" * 300 + ".y@mail.test", [("email", "x" * 300 + ".y@mail.test")]),
        ("na Rua " + "Alta " * 30 + ", nº 5. Fim", [("address", "Rua " + "Alta " * 30 + ", nº 5")]),
        ("A senhora Deonísia X. Monvesco declarou", [("name", "Deonísia X. Monvesco")]),
        ("Compareceu Valderildo Ferqueto de Monvesco, que", [("name", "Valderildo Ferqueto de Monvesco")]),
        ("MONVESCO, Quirilo e VALDERILDO FERQUETO", [("name", "MONVESCO, Quirilo"), ("name", "VALDERILDO FERQUETO")]),
        ("A senhora Zuzu Krustak declarou", [("name", "Zuzu Krustak")]),
        ("com o Banco Monvesco Ferqueto e a Ferqueto & Cia", []),
        ("Deonísia Ferqueto Ltda e Nova Petúnia", []),
    ],
)
def test_find(text, found):
    assert [(k, text[a:b]) for k, a, b in P.find(text, KNOWN)] == found


def test_positions_with_odd_characters():
    text = "x A senhora De​onísia Monve𝐬co. 𝐓el (９0) 92042‑5490"
    assert [(k, text[a:b]) for k, a, b in P.find(text, KNOWN)] == [("name", "De​onísia Monve𝐬co"), ("phone", "(９0) 92042‑5490")]


def test_masking_keeps_the_rest():
    rng = random.Random(2)
    parts = ["ana@mail.test", "(90) 92042-5490", "356.221.706-99", "Quirilo Monvesco"]
    for _ in range(200):
        text = " , ".join(rng.choice([*parts, "o réu", "na vara", "12 de maio"]) for _ in range(6))
        found = P.find(text, KNOWN)
        assert all(a < b for _, a, b in found) and all(x[2] <= y[1] for x, y in zip(found, found[1:]))
        masked = P.masked_text(text, found)
        for kind, a, b in found:
            masked = masked.replace(f"[{kind.upper()}]", text[a:b], 1)
        assert masked == text


def corpus():
    rng = random.Random(4)
    given, family = ["Deonísia", "Quirilo", "Valderildo", "Ubirildo", "Tererildo"], ["Monvesco", "Ferqueto", "Jacatibal", "Oliqueto", "Uravesco"]
    place = ["Nova Petúnia", "Serra Quieta", "Campo Brumado"]
    for k in range(120):
        unknown = ["Zeferino Dantas", "Iracema Lopo", "Bento Calado"][k % 3]
        name = unknown if k % 5 == 0 else f"{rng.choice(given)} {rng.choice(family)}"
        yield f"A testemunha {name} declarou ter visto o veículo na comarca de {rng.choice(place)}. Telefone de recado {20 + k % 70} {90000 + k} {1000 + k} à tarde. Inscrito sob o cadastro {10000000000 + k * 7919}, na forma da lei."


def test_bootstrapping_finds_what_no_list_has(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(corpus())], "row_id long, text string")
    hints = spark.createDataFrame([("Deonísia", "given"), ("Quirilo", "given"), ("Monvesco", "family"), ("Ferqueto", "family"), (None, "given")], "name string, kind string")
    found = {r.row_id: [(f.kind, r.text[f.start_pos : f.end_pos]) for f in r.found] for r in P.personal_information(df, hints).join(df, "row_id").collect()}
    assert all([k for k, _ in f] == ["name", "phone", "id_number"] for f in found.values())
    assert found[0][0] == ("name", "Zeferino Dantas")


def test_scores_of_a_small_graph(spark):
    edges = spark.createDataFrame([("name", "L:a testemunha", "quirilo", 8), ("name", "L:a testemunha", "zeferino", 8), ("name", "L:comarca de", "serra", 9), ("name", "R:declarou", "zeferino", 5)], "kind string, pattern string, instance string, n long")
    seeds = spark.createDataFrame([("name", "quirilo", 1.0), ("name", "serra", 0.0)], "kind string, instance string, seed double")
    patterns, instances = P.score(edges, seeds, 6)
    by = {r.item: r.score for r in patterns.collect()} | {r.item: r.score for r in instances.collect()}
    assert by["L:a testemunha"] > 0.5 and by["L:comarca de"] == 0 and by["quirilo"] == 1 and by["zeferino"] > 0.5


def test_context_cuts_no_token():
    word = "w" * 500
    assert P.context(f"primeiro {word} x", len(word) + 10, len(word) + 11)[0] == ["primeiro", word]
    assert P.context(f"x {word} fim outro", 0, 1)[1] == [word, "fim"]


def test_many_hits_in_one_text():
    """Work in proportion to the text."""
    text = "ana@mail.test, (90) 92042-5490; " * 20_000
    assert len(P.find(text, KNOWN)) == 40_000


def test_dirty_rows(spark):
    long = "o réu foi ouvido ontem " * 20_000 + "ana@mail.test"
    data = [(1, "ana@mail.test"), (1, "ana@mail.test"), (2, None), (3, ""), (4, " \n"), (None, "(90) 92042-5490"), (5, long), (6, "9" * 50_000), (7, "A" * 50_000), (8, "Aa " * 20_000)]
    rows = spark.createDataFrame([(*d, "x") for d in data], "row_id long, text string, found string")
    hints = spark.createDataFrame([], "name string, kind string")
    out = P.personal_information(rows, hints).collect()
    assert len(out) == len(data)
    by = {r.row_id: r for r in out}
    assert by[1].masked == "[EMAIL]" and by[2].masked is None and by[2].found == [] and by[3].masked == "" and by[None].masked == "[PHONE]"
    assert [(f.kind, f.start_pos) for f in by[5].found] == [("email", len(long) - 13)]
    assert P.personal_information(rows.limit(0), hints).collect() == []
