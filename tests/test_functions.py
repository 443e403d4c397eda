import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.functions import checks, formats, prose
from pergamin.functions import text as X
from pergamin.operators import gates

TEXTS = [
    None, "", " ", "\n\t", "a", "O processo nº 0001234-55.2019.8.26.0100 foi julgado pela vara.\nOutra linha maior do que vinte caracteres.", "g40g86g87g72g1", "\x00\x07abc\x85",
    "ação é não são\r\nx y z\x0bfim", "😀 emoji 漢字 ção", " ".join(["de", "a", "o", "processo"] * 9), "CARIMBO [ILEGÍVEL] [ ILEGÍVEL] [ASSINATURA do juiz] resto", "fls. 12 - 13 e Para conferir o original, acesse o site",
    "9XXYZ32E41A099887 001.06.012345-6 12345 1234", "g1" * 30000, "1-" * 30000, "a " * 30000,
]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def expected_metrics(t):
    """The metrics by the plain definition."""
    lines = [x.strip() for x in t.splitlines()]
    lines = [x for x in lines if x]
    words = re.findall(r"\w+", t)
    latin = [w.lower() for w in re.findall("[A-Za-zÀ-ÿ]{2,}", t)]
    hits = sum(bool(re.search(rf"\b{p}\b", t.lower())) for p in C.DOMAIN)
    glyphs = sum(len(m.group()) for m in re.finditer(r"(?:g[0-9]{1,4}){4,}", t))
    control = sum(unicodedata.category(c) == "Cc" and c not in "\t\n\r" for c in t)
    return {
        "short_lines": sum(len(x) < 20 for x in lines) / len(lines) if lines else 1.0, "single_chars": sum(len(w) == 1 for w in words) / len(words) if words else 1.0,
        "glyph_index": glyphs / len(t) if t else 0.0, "control_chars": control / len(t) if t else 0.0, "stopwords": sum(w in C.STOPWORDS for w in latin) / len(latin) if latin else 0.0,
        "latin_words": len(latin), "domain": hits / len(C.DOMAIN),
    }


def test_metrics_equal_the_plain_definition(spark):
    for r in X.with_score(X.with_metrics(rows(spark))).collect():
        if r.text is None:
            assert r.score is None and r.odd_chars is None and r.latin_words is None
            continue
        for name, value in expected_metrics(r.text).items():
            assert r[name] == pytest.approx(value, abs=6e-5), (name, r.text[:40])
        assert 0 <= r.score <= 1
    blank = X.with_score(X.with_metrics(rows(spark, ["", "  \n"]))).collect()
    assert [r.score for r in blank] == [0.0, 0.0] and blank[0].odd_chars == 1.0


def one(spark, expression, text):
    return rows(spark, [text]).select(expression(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(
    "expression,text,expected",
    [
        (X.normalize, " a \t b\n\n\n\nc­d ", "a b\n\ncd"),
        (X.strip_stamp, "texto fls. 12 - 13 assinado digitalmente por FULANO\nfim", "texto fim"),
        (X.useful_words, "Uma frase com 6 palavras úteis x", 5),
        (X.real_content, "a [ILEGÍVEL]  [selo] b", "a b"),
        (X.marker_fraction, "[ILEGÍVEL][ILEGÍVEL]", 1.0),
        (X.marker_fraction, " ", 0.0),
        (X.anchors, "chassi 9XXYZ32E41A099887 e 001.06.012345-6, PROTOCOLO 54321 e 1234", ["00106012345" + "6", "012345", "099887", "54321", "9XXYZ32E41A099887"]),
        (X.card_text, "Data de expedição: ÓRGÃO  １２", "DATA DE EXPEDICAO ORGAO 12"),
        (prose.fix_thousands, "9,159.70 e 5,000,00 e 1.234,50", "9.159,70 e 5.000,00 e 1.234,50"),
        (prose.rebuild, "A consti-\ntuição foi man-\n12\ntida e mantê-\nlos é dever.\nOutra frase\ncontinua", "A constituição foi mantida e mantê-los é dever.\nOutra frase continua"),
        (prose.rebuild, "fls.\n12/\n1345 v\n- item\n- outro\nTÍTULO DA PEÇA", "fls. 12/1345 v\n- item\n- outro\nTÍTULO DA PEÇA"),
        (prose.normalize, "valor de R$\n115.104,90 e R$30,00 e RS 9.159,70\nEste documento é cópia\nfim §$ 2", "valor de R$ 115.104,90 e R$ 30,00 e R$ 9.159,70 fim §§ 2\n\n[digital conformity stamp]\nEste documento é cópia"),
        (prose.clean_response, "```\n=== INICIO DA TRANSCRICAO ===\nA\n=== FIM DA TRANSCRICAO ===\n=== INICIO DA TRANSCRICAO ===\nB\n```", "A\n\nB"),
        (prose.clean_response, "<think>x</think>\nSegue a transcrição:\nTexto", "Texto"),
    ],
)
def test_expressions(spark, expression, text, expected):
    assert one(spark, expression, text) == expected


def test_null_and_long_texts_do_not_fail(spark):
    long = rows(spark, [None, "", "linha curta\n" * 20000, "x-\n" * 5000])
    out = long.select(*(f(F.col("text")).alias(f.__name__) for f in (X.normalize, X.strip_stamp, X.real_content, prose.rebuild, prose.normalize, prose.fix_thousands, prose.clean_response))).collect()
    assert all(v is None for v in out[0]) and all(v == "" for v in out[1])
    assert out[3].rebuild == "x" * 4999 + "x-\n"


def test_lost_identifiers(spark):
    df = spark.createDataFrame([(["12345", "9988776"], ["0123456", "x"])], "a array<string>, b array<string>")
    assert df.select(X.lost_anchors(F.col("a"), F.col("b")).alias("x")).first().x == ["9988776"]


def test_check_digits(spark):
    # A number whose check digits are computed here by the plain definition.
    base = "111444777"
    d = [int(c) for c in base]
    for n in (10, 11):
        d.append(sum(x * (n - k) for k, x in enumerate(d)) * 10 % 11 % 10)
    right = "{}.{}.{}-{}".format(*("".join(map(str, d))[a:b] for a, b in ((0, 3), (3, 6), (6, 9), (9, 11))))
    case = 98 - int("0001234" + "20198260100" + "00") % 97
    text = f"{right} {right[:-1]}{(int(right[-1]) + 1) % 10} 111.111.111-11 0001234-{case:02d}.2019.8.26.0100 0001234-{(case + 1) % 97:02d}.2019.8.26.0100"
    r = checks.counts(rows(spark, [text, None]).withColumnRenamed("id", "doc_id")).orderBy("doc_id").collect()
    assert tuple(r[0])[1:] == (3, 1, 2, 1)


def zipped(name, content):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("carimbo.tsr", b"x" * 999)
        z.writestr(name, content)
    return b"BRyPDDE\0\1" + out.getvalue()


def tlv(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2)
    return bytes([tag]) + size + body


def test_envelopes(spark):
    rich = rb"{\rtf1{\fonttbl{\f0 Arial;}}Peti\'e7\'e3o \u231?\par{\b negrito} \{x\}}"
    signed = tlv(0x30, tlv(6, formats.SIGNED_DATA), tlv(0xA0, tlv(0x30, tlv(2, b"\1"), tlv(0x31), tlv(0x30, tlv(6, b"\x2a"), tlv(0xA0, tlv(4, rich + b" " * 200))))))
    files = [rich, zipped("d.rtf", rich), signed, b"%PDF-1.4 x", b"", None, b"BRyPDDE\0 nothing", b"\x30\x82\xff", rb"{\rtf1 a}}} b", b"plain"]
    df = spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate(files)], "id int, content binary")
    out = [r for r in df.select("id", formats.detect(F.col("content")).alias("seen"), formats.unwrap("content").alias("u")).orderBy("id").collect()]
    assert [r.seen for r in out] == ["rtf", "bry", "pkcs7", "pdf", "unknown", None, "bry", "pkcs7", "rtf", "unknown"]
    assert [r.u.text for r in out][:3] == ["Petição ç\nnegrito {x}"] * 3
    assert out[3].u.content == b"%PDF-1.4 x" and out[5].u.reason is None
    assert out[6].u.reason and out[7].u.reason and out[8].u.text == "a"


def test_envelopes_that_are_refused():
    import io
    import zipfile

    def envelope(members, lead=9):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k in range(members):
                z.writestr(f"{k}.rtf", rb"{\rtf1 texto}" + b" " * k)
        return b"BRyPDDE".ljust(lead, b"\0") + out.getvalue()

    assert formats.unwrapped(envelope(32))[1] == "texto" and "33 members" in formats.unwrapped(envelope(33))[3] and "500 members" in formats.unwrapped(envelope(500))[3]
    assert formats.unwrapped(envelope(1, 60))[1] == "texto" and formats.unwrapped(envelope(1, 61))[3]
    other = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010701")), tlv(0xA0, tlv(4, b"texto" + b" " * 200)))
    assert formats.unwrapped(other)[3] == "pkcs7: no signed data"
    assert formats.rtf_text(rb"{\rtf1 a} b\par c} d} e") == "a b\nc" and formats.rtf_text(rb"{\rtf1 a{\b c} d}") == "ac d"


def test_jpeg_header(spark):
    start, jfif = b"\xff\xd8", b"\xff\xe0\0\x04ab"
    frame = b"\xff\xc2\0\x11\x08" + (480).to_bytes(2) + (640).to_bytes(2) + b"\x03" * 9
    assert formats.jpeg_dimensions(start + jfif + frame) == (640, 480) and formats.jpeg_dimensions(start + b"\xff" * 5 + frame) == (640, 480)
    assert formats.jpeg_dimensions(b"x") is None and formats.jpeg_dimensions(start + jfif) is None and formats.jpeg_dimensions(b"") is None
    df = spark.createDataFrame([(bytearray(start + frame),), (None,), (bytearray(b"x"),)], "image binary")
    assert [tuple(r.s) for r in df.select(formats.jpeg_size("image").alias("s")).collect()] == [(640, 480), (None, None), (None, None)]


CASES = (
    (X.strip_stamp, "a ESTE DOCUMENTO É CÓPIA DO ORIGINAL, CÓDIGO ABC123\nb", "a b"), (X.strip_stamp, "a CÓDIGO DE VERIFICAÇÃO 99\nb", "a b"), (X.real_content, "a [ilegível] [brasÃo] [NÃO identificado] b", "a b"),
    (lambda t: t.rlike(C.ANCHOR_LINE), "ENDEREÇO DA PARTE", True), (lambda t: t.rlike(C.JOB_TITLE), "A SECRETÁRIA", True), (lambda t: t.rlike(C.STAMP_KEYWORDS), "VERIFICAÇÃO", True), (lambda t: t.rlike(C.SEAL), "CÓDIGO DE VERIFICAÇÃO", True),
    (lambda t: t.rlike(C.DATE_LINE), "12 DE MARÇO DE 2020", True), (lambda t: t.rlike(C.PAGE_NUMBER_ONLY), "PÁGINA 3", True), (lambda t: t.rlike(C.LEADING_META), "TRANSCRIÇÃO FIEL\n", True), (X.domain_hits, "A SENTENÇA E O ACÓRDÃO", 2),
    (prose.normalize, "corpo\nCÓDIGO DE VERIFICAÇÃO 12", "corpo\n\n[digital conformity stamp]\nCÓDIGO DE VERIFICAÇÃO 12"), (prose.normalize, "a\tb  c", "a\tb c"),
    (prose.rebuild, "1)\nTexto da frase\ncontinua aqui", "1) Texto da frase\ncontinua aqui"), (prose.rebuild, "1)\n2)\n3)\n4)\ntexto\nfim", "1) 2)\n3) 4)\ntexto fim"), (prose.rebuild, "x\n1)\nTexto\nfim", "x 1) Texto fim"),
    (prose.clean_response, "<think>a</THINK> um </think> dois", "um </think> dois"), (prose.clean_response, "```text\nA\n```", "A"), (prose.clean_response, "```A```", "```A```"),
    (prose.response_blocks, "=== INICIO DA TRANSCRICAO ===\nA\n=== FIM DA TRANSCRICAO ===\n=== inicio da transcricao ===\nB", ["A", "B"]), (prose.response_blocks, "só isto", ["só isto"]), (prose.response_blocks, "", []),
    (prose.without_images, "a\n\n<!-- image -->\n\n<!--IMAGE-->b", "a\n\nb"), (prose.converted_is_empty, "<!-- image --> " * 9, True),
)


def test_capitals_with_accents_and_ordered_rules(spark):
    df = spark.createDataFrame([tuple(t for _, t, _ in CASES)], ", ".join(f"c{k} string" for k in range(len(CASES))))
    got = df.select(*(f(F.col(f"c{k}")).alias(f"r{k}") for k, (f, _, _) in enumerate(CASES))).first()
    for k, (_, text, expected) in enumerate(CASES):
        assert got[k] == expected, text


def plain_rebuild(text, how):
    """The fold over lines by its definition; ``how`` says how two pieces are joined."""
    out = []
    for raw in text.split("\n"):
        line = raw.rstrip()
        if re.match(r"\s*(?:fls?\.?\s*[0-9]+|[0-9]{1,3}|p[áa]g(?:ina)?\.?\s*[0-9]+)\s*\Z", line, re.I):
            continue
        kind = how(out[-1], line) if out and out[-1] and line else "keep"
        if kind == "keep":
            out.append(line)
        else:
            out[-1] = (out[-1].rstrip()[: -1 if kind == "unhyphen" else None]) + (" " if kind == "space" else "") + line.lstrip()
    return "\n".join(out)


def test_rebuild_equals_the_fold(spark):
    """Against the fold line by line, with the rules asked one pair at a time."""
    import random

    rng = random.Random(5)
    pool = ["1)", "2)", "-", "- item", "#", "texto da frase", "Outra frase.", "consti-", "tuição", "12/", "345 v", "", "12", "TÍTULO DA PEÇA", "Dr.", "> cita", ">", "mantê-", "los"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    asked: dict[tuple[str, str], str] = {}

    def known(a, b):
        if (a, b) not in asked:
            missing.add((a, b))
            return "keep"
        return asked[a, b]

    while True:
        missing = set()
        expected = [plain_rebuild(t, known) for t in texts]
        if not missing:
            break
        pairs = sorted(missing)
        answers = spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(prose.join(F.col("a"), F.col("b")).alias("j")).collect()
        asked |= {p: r.j for p, r in zip(pairs, answers)}
    got = [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", prose.rebuild(F.col("t")).alias("x")).orderBy("k").collect()]
    for t, g, e in zip(texts, got, expected):
        assert g == e, t


def test_image_header(spark):
    png = bytearray(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4) + (480).to_bytes(4))
    df = spark.createDataFrame([(png,), (bytearray(b"x"),), (None,)], "image binary")
    assert [r.s and tuple(r.s) for r in df.select(formats.png_size(F.col("image")).alias("s")).collect()] == [(640, 480), None, None]


def test_agreement_and_gates(spark):
    words = [f"palavra{c}" for c in "abcdefghijklmnop"]
    df = spark.createDataFrame([([words, words],), ([words, words[:12] + ["x"] * 1],), ([words],), ([words, ["a"]],)], "v array<array<string>>")
    assert [round(r.x, 3) for r in df.select(gates.jaccard(F.col("v")).alias("x")).collect()] == [1.0, round(12 / 17, 3), 0.0, 0.0]
    gate = spark.createDataFrame([(20, 0.0, 900, 2, True, False, 0.9), (20, 0.0, 300, 2, True, False, 0.9), (3, 0.0, 900, 1, True, True, 0.9), (0, 1.0, 0, 1, False, False, 0.0), (20, 0.2, 900, 1, True, False, 0.9), (20, 0.0, 900, 1, True, False, 0.1)], "u int, g double, c int, p int, i boolean, v boolean, s double")
    c = F.col
    reasons = [r.x for r in gate.select(gates.acceptance(c("u"), c("g"), c("c"), c("p"), c("i"), c("v"), c("s")).alias("x")).collect()]
    assert [r in gates.ACCEPTED for r in reasons] == [True, False, False, True, False, False]


def test_replacement_order(spark):
    long = "O laudo do processo 0001234-55.2019.8.26.0100 foi juntado aos autos pela parte autora com todas as provas do feito e mais nada"
    cases = [
        ("", "x", 1, 1, 1, 0, True, None), (long, "[ILEGÍVEL] " * 9, 1, 1, 1, 0, True, "loop"), (long, long + " e mais", 3, 2, 2, 0, True, "pages"), (long, long + " e mais", 1, 1, 1, 1, True, "batches"),
        (long, long.replace("0001234", "0001243") + " e mais", 1, 1, 1, 0, True, "identifiers"), (long, long, 1, 1, 1, 0, True, "not longer"), (long, long + " e mais", 1, 1, 1, 0, True, None), (long, long[:-9].replace("0001234", "0001243"), 1, 1, 1, 0, False, None),
    ]
    df = spark.createDataFrame([c[:7] for c in cases], "previous string, new string, doc_pages int, sent int, answered int, failed_batches int, trustworthy boolean").coalesce(1)
    got = [r.rejection for r in gates.replacement(df).collect()]
    assert [g if g is None else next(w for w in ("loop", "pages", "batches", "identifiers", "not longer") if g.startswith(w)) for g in got] == [c[7] for c in cases]


def test_vetoes(spark):
    cases = [(3, True, False, None, None, 0.0, "photograph"), (3, False, True, None, None, 0.0, "no_ink"), (30, True, True, None, None, 0.0, None), (30, False, False, 2, 50, 0.9, "no_legible_word"), (30, False, False, 9, 5, 0.9, "sparse_page"), (30, False, False, 9, 50, 0.7, "reading_confirmed"), (30, False, False, 9, 50, 0.1, None)]
    df = spark.createDataFrame([c[:6] for c in cases], "u int, p boolean, b boolean, r int, w int, s double").coalesce(1)
    assert [r.v for r in df.select(gates.veto(*(F.col(c) for c in "upbrws")).alias("v")).collect()] == [c[6] for c in cases]
