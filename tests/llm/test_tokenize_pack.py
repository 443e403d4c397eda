import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pergamin.llm import pack, tokenize

TEXTS = [
    "", None, " ", "\n ", "a  b", "  a", "x\t\ty   z", "'", "'s", "x 's", "don't 'tsand ''s 're'll'vex WE'VE'd", "<|endoftext|> x<|endoftext|>",
    "aaaaaaaaaaa" * 5, "ação № ½ ²³ 12٣４ 𝐏𝐫 漢字テスト", "　　x y​z", "a\u0000b\u0085c d", "é" * 300, "1.234,56 R$ -- ... ?!", "é̂ ﻿x", "x" * 20000,
]


@pytest.fixture(scope="module")
def peer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_public_library(spark, peer):
    rng = random.Random(3)
    alphabet = "ab1 '\n\tstdrevelm.-çÃ漢٣ é"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids long").repartition(3)
    got = {r.doc_id: r.ids for r in tokenize.token_ids(rows).collect()}
    assert got == {i: peer(t) for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokenize.token_counts(rows).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_null_keys_repeated_rows_and_empty_table(spark, peer):
    rows = spark.createDataFrame([(None, "ab"), (None, "ab"), (1, "ab"), (1, "ab")], "doc_id long, text string")
    assert [r.ids for r in tokenize.token_ids(rows).collect()] == [peer("ab")] * 4
    assert tokenize.token_ids(rows.limit(0)).collect() == []


def test_slices_and_blocks_do_not_change_ids(monkeypatch, peer):
    import pyarrow as pa

    texts = [t for t in TEXTS * 3]
    model = type("Held", (), {"value": tokenize.read_model("byte_bpe_50k")})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    monkeypatch.setattr(tokenize, "BLOCK_WORDS", 10)
    monkeypatch.setattr(tokenize.slices, "__defaults__", (50,))
    out = [x for b in tokenize._encoder(model, True, ("k", "ids"))(iter([batch])) for x in b.column(1).to_pylist()]
    assert out == [peer(t) for t in texts]


def slow_first_fit(sizes, capacity):
    """Containers of the pieces by the plain definition."""
    bins, whole = [], 0
    rest = []
    for s in sizes:
        if s > capacity:
            whole += s // capacity
            s -= s // capacity * capacity
        if s > 0:
            rest.append(s)
    for s in sorted(rest, reverse=True):
        for k, b in enumerate(bins):
            if b + s <= capacity:
                bins[k] += s
                break
        else:
            bins.append(s)
    return sorted(bins + [capacity] * whole)


def test_first_fit_decreasing_equals_the_plain_definition():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([1, 7, 20, 64])
        sizes = [rng.randrange(0, 3 * capacity) if rng.random() < 0.2 else rng.randrange(0, capacity + 1) for _ in range(rng.randrange(0, 60))]
        item, piece, units, container = pack.first_fit_decreasing(np.array(sizes, np.int64), capacity)
        held = np.bincount(container, units).astype(int).tolist() if len(container) else []
        assert sorted(h for h in held if h) == slow_first_fit(sizes, capacity)
        assert np.bincount(item, units, minlength=len(sizes)).astype(int).tolist() == sizes
        divided = np.flatnonzero(np.bincount(item, minlength=len(sizes)) > 1)
        assert all(sizes[i] > capacity for i in divided)
        assert len({*zip(item.tolist(), piece.tolist())}) == len(item)


def test_pack_keeps_every_item_once_in_groups(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, None if i % 50 == 0 else i % 90, 0) for i in range(900)], "doc_id long, n_tokens long, group_no int")
    out = pack.pack(rows, [(1, 100), (2, 30)], group_rows=200).cache()
    for target, capacity in ((1, 100), (2, 30)):
        own = out.where(f"target_id = {target}")
        assert own.groupBy("group_no", "container_no").agg(F.sum("n_tokens").alias("s")).where(f"s > {capacity}").count() == 0
        assert own.agg(F.sum("n_tokens")).first()[0] == rows.agg(F.sum("n_tokens")).first()[0]
        assert own.where("piece = 0").count() == 900
    assert out.select("group_no").distinct().count() == 5
    report = {r.target_id: r for r in pack.fill(out, [(1, 100), (2, 30)]).collect()}
    assert report[1].filled > 0.9 and report[1].containers >= report[1].least_containers
    assert pack.pack(rows.limit(0), [(1, 5)]).collect() == []
    with pytest.raises(ValueError):
        pack.pack(rows, [(1, 0)])


def test_pack_does_not_depend_on_order_or_partitions(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 40, i % 7) for i in range(900)], "doc_id long, n_tokens long")
    once = sorted(map(str, pack.pack(rows, [(1, 50)], group_rows=200).collect()))
    assert once == sorted(map(str, pack.pack(rows.orderBy("n_tokens").repartition(7), [(1, 50)], group_rows=200).collect()))
