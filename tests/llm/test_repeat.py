import random
import re
import unicodedata

import numpy as np
import pyarrow as pa

from pergamin.llm import boost, repeat
from pergamin.llm.arrow_text import flat_utf8


def plain_share(text):
    """The share by the plain definition, for texts of ASCII words, blanks, newlines and full stops."""
    words = list(re.finditer(r"[a-z0-9]+", text.lower()))
    if not words:
        return 0.0
    tokens = [w.group() for w in words]
    marked = [False] * len(words)

    def units(breaks, least):
        seen = set()
        bounds = [0, *breaks, len(words)]
        for a, b in zip(bounds, bounds[1:]):
            unit = tokens[a:b]
            w = words[a]
            rest = text[w.end() : w.end() + 2] + "\n\n"
            counter = (tokens[a][0].isdigit() and len(tokens[a]) <= 3 or len(tokens[a]) == 1) and (rest[0] in " \n" or rest[0] in ".)" and rest[1] in " \n")
            lead = int(counter and len(unit) > 1)
            key = tuple(unit[lead:])
            if key in seen and len(key) >= least:
                marked[a:b] = [True] * (b - a)
            seen.add(key)

    gaps = [text[words[i - 1].end() : words[i].start()] for i in range(1, len(words))]
    units([i + 1 for i, g in enumerate(gaps) if "\n" in g], 2)
    units([i + 1 for i, g in enumerate(gaps) if g.count("\n") > 1], 2)
    opens = [unicodedata.category(text[w.start()]) not in ("Ll", "Nd") for w in words]
    units([i + 1 for i, g in enumerate(gaps) if g.count("\n") > 1 or re.search(r"[.][ \n]", g) and opens[i + 1]], 3)
    runs = set()
    for i in range(len(words) - 7):
        run = tuple(tokens[i : i + 8])
        if run in runs:
            marked[i : i + 8] = [True] * 8
        runs.add(run)
    for k in range(1, 8):
        i = k
        while i < len(words):
            j = i
            while j < len(words) and tokens[j] == tokens[j - k]:
                j += 1
            if j - i >= k:
                marked[i:j] = [True] * (j - i)
            i = max(j, i + 1)
    size = [len(t) + 1 for t in tokens]
    return sum(s for s, m in zip(size, marked) if m) / sum(size)


def shares(texts):
    return repeat.measure(*flat_utf8(pa.array(texts, pa.string())))[:, 0]


def test_share_equals_the_plain_definition():
    rng = random.Random(9)
    vocabulary = [*"abcdefg", "Foo", "bar", "Baz", "12", "7", "2019"]
    texts = []
    for _ in range(600):
        words = [rng.choice(vocabulary[: rng.choice([3, 6, 13])]) + rng.choice(["", "", "", ".", ")"]) for _ in range(rng.randrange(0, 60))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n\n"]) for w in words))
    np.testing.assert_allclose(shares(texts), [plain_share(t) for t in texts])


def test_copies_differ_in_case_punctuation_spacing_and_counter():
    one = "Segundo consta, o inventariante contestou a declaração"
    assert shares([f"1. {one}.\n2) {one.upper()};\n"])[0] > 0.4
    assert shares(["Parcela 1 100,00\nParcela 2 100,50\nParcela 3 90,00"])[0] == 0
    assert shares(["ab​cd ef gh ij\nabcd ef gh ij"])[0] == 0.5


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + rng.normal(0, 0.2, 800)) > 0
    forest = boost.fit(x, y, [1, -1, 0])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    probe = rng.random((50, 3))
    for feature, sign in ((0, 1), (1, -1)):
        scores = []
        for v in np.linspace(0, 1, 21):
            probe[:, feature] = v
            scores.append(forest.margin(probe))
        assert (sign * np.diff(np.array(scores), axis=0) >= -1e-12).all()


def test_operator_on_dirty_rows(spark):
    loop = "o prazo corre sem falta " * 40
    clean = " ".join(f"palavra{i} outra{i * 7}" for i in range(60))
    samples = spark.createDataFrame([("\n".join(f"linha {w} com varias palavras seguidas numero {i} {w}{i}" for i, w in enumerate("abcdefghij")),)], "text string")
    forest = repeat.train(samples)
    rows = spark.createDataFrame([(1, loop, 0.1), (1, loop, 0.1), (2, clean, 0.2), (3, None, None), (4, "", 0.0), (5, " \n ", 0.0), (None, loop, 0.0), (6, loop * 300, 0.0)], "doc_id long, text string, score double")
    out = repeat.repeated_content(rows, forest)
    assert out.count() == 8
    assert {r.doc_id: r.repeated_share for r in out.where("doc_id in (3, 4, 5)").collect()} == {3: 0.0, 4: 0.0, 5: 0.0}
    assert sorted(repeat.found(out).collect(), key=str) == sorted([(1,), (None,), (6,)], key=str)
    assert repeat.found(repeat.repeated_content(rows.limit(0), forest)).collect() == []


def test_trees_agree_with_the_exact_share_where_they_are_sure():
    samples = [f"linha {w} com varias palavras seguidas numero {i} {w}{i} e mais {'z' * i}" for i, w in enumerate("abcdefghijklmnop")]
    fitted, _ = repeat.compose(["\n".join(samples)], 1500, 11)
    features = repeat.measure(*flat_utf8(pa.array(fitted, pa.string())))
    forest = boost.fit(features, features[:, 0] >= repeat.SHARE, repeat.CONSTRAINT)
    held_out, _ = repeat.compose(["\n".join(samples)], 500, 12)
    x = repeat.measure(*flat_utf8(pa.array(held_out, pa.string())))
    score, exact = forest.score(x), x[:, 0] >= repeat.SHARE
    sure = (score < repeat.UNSURE) | (score > 1 - repeat.UNSURE)
    assert sure.mean() > 0.5 and ((score > 0.5) == exact)[sure].mean() > 0.99
