import random

import numpy as np
import pytest

from tidelog.llm import packing


@pytest.mark.parametrize("seed", range(6))
def test_differencing_places_everything(seed):
    rng = np.random.default_rng(seed)
    sizes, k = rng.integers(1, 1000, 200), int(rng.integers(1, 60))
    window, sums = packing.difference(sizes, k)
    assert (np.sort(np.bincount(window, weights=sizes, minlength=k)) == np.sort(sums)).all()
    if k <= 10:
        assert sums[0] - sums[-1] <= 5  # near-equal where windows hold many items


def test_windows_rise_until_none_is_too_full():
    sizes = np.array([60, 60, 60, 60, 60])
    assert len(set(packing.fill(sizes, 100))) == 5
    assert len(set(packing.fill(sizes, 120))) == 3
    assert list(packing.fill(np.zeros(0, np.int64), 10)) == []


def first_fit(sizes, capacity):
    room = []
    for x in sorted(sizes, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= x), None)
        if k is None:
            room.append(capacity)
            k = -1
        room[k] -= x
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_no_more_windows_than_first_fit_and_no_fewer_than_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 500, 300) if seed % 2 else (rng.lognormal(5.5, 0.6, 300).astype(np.int64) % 1000 + 1)
    window = packing.fill(sizes, 1000)
    held = np.bincount(window, weights=sizes)
    assert held.max() <= 1000 and len(window) == 300
    assert packing.fewest(sizes, 1000) <= len(held) <= first_fit(sizes.tolist(), 1000)


@pytest.mark.parametrize(("sizes", "least"), [([60] * 5, 5), ([51, 51, 50], 3), ([90, 90, 20, 20], 3), ([10] * 10, 1), ([100], 1), ([70, 70, 40, 40], 3)])
def test_fewest(sizes, least):
    assert packing.fewest(np.array(sizes), 100) == least == len(set(packing.fill(np.array(sizes), 100)))


def test_more_kinds_than_a_thousand(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    kinds = spark.createDataFrame([(f"k{k}", 5 + k, None) for k in range(1_001)], "kind string, capacity_tokens int, tokens_between int")
    try:
        found = packing.pack_kinds(docs, kinds.unionAll(kinds.limit(1)))
    except OSError:
        pytest.skip("no tokenizer files")
    assert found.groupBy("kind").count().filter("count = 2").count() == 1_001


def pack(spark, sizes, capacity, between=0, **more):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "doc_id long, tokens long")
    return [r.asDict() for r in packing.pack(df, capacity, between, **more).collect()]


@pytest.mark.parametrize(("capacity", "between", "group"), [(100, 0, 512), (100, 1, 512), (333, 2, 64)])
def test_containers_hold_and_nothing_is_lost(spark, capacity, between, group):
    rng = random.Random(capacity + between)
    sizes = [rng.randrange(0, 90) if rng.random() < 0.9 else rng.randrange(90, 1200) for _ in range(700)]
    found = pack(spark, sizes, capacity, between, group_items=group)
    whole, held = {}, {}
    for r in found:
        whole.setdefault(r["doc_id"], []).append(r)
        held.setdefault((r["grp"], r["container"]), []).append(r["tokens"])
    assert sorted(whole) == list(range(700))
    for doc, pieces in whole.items():
        assert sum(p["tokens"] for p in pieces) == sizes[doc]
        assert sorted(p["piece"] for p in pieces) == list(range(pieces[0]["n_pieces"]))
        assert (len(pieces) > 1) == (sizes[doc] > capacity)
    assert all(sum(t) + between * (len(t) - 1) <= capacity for t in held.values())
    assert sum(sizes) / (len(held) * capacity) > 0.8


def test_ties_repeats_and_exact_fits(spark):
    assert len({(r["grp"], r["container"]) for r in pack(spark, [50] * 8, 100, group_items=8)}) <= 8
    assert {r["n_pieces"] for r in pack(spark, [100, 100], 100)} == {1}
    assert sorted(r["tokens"] for r in pack(spark, [200], 100)) == [100, 100]
    assert [r["tokens"] for r in pack(spark, [0], 100)] == [0]
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 3), (2, None)], "doc_id long, tokens long")
    assert [(r.doc_id, r.tokens) for r in packing.pack(df, 100, 1).collect()] == [(1, 5), (1, 5)]
    assert packing.pack(df.limit(0), 100, 1).count() == 0


def test_counts_are_those_of_the_whole_text(spark):
    texts = ["", "one two  three", "größe " * 40_000, None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, tokens string")
    try:
        encoder = packing._encoder(f"{packing.TOKENIZERS}/byte_bpe_50k.tiktoken")
    except OSError:
        pytest.skip("no tokenizer files")
    assert {r.doc_id: r.tokens for r in packing.token_counts(df).collect()} == {k: len(encoder.encode_ordinary(t)) for k, t in enumerate(texts) if t is not None}


def test_kinds(spark, data):
    docs, kinds = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "pack_limits"))
    found = packing.pack_kinds(docs, kinds)
    assert {r.kind for r in found.select("kind").distinct().collect()} == {"short", "standard", "long"}
    assert found.filter("kind = 'long'").select("doc_id").distinct().count() == docs.count()
    assert packing.pack_kinds(docs, kinds.limit(0)).count() == 0
