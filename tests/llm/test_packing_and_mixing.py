import random

import numpy as np
import pytest
from medlattice.llm.common import TOKENIZER_DIR, count_tokens
from medlattice.llm.mixing import mix_sources, pivotal
from medlattice.llm.packing import bin_report, pack, pack_instructions, pack_items, pack_texts


def test_pack_keeps_limits_and_wastes_little():
    rng = np.random.default_rng(1)
    for seg in (1, 6, 40):
        sizes = np.stack([rng.integers(1, 900, 600), np.ones(600), rng.integers(0, 1, 600) + 1], axis=1).astype(float)
        cap = np.array([1000, seg, 1000])
        bins = pack(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(600))
        assert all((sizes[b].sum(axis=0) <= cap).all() for b in bins)
        if seg > 1:
            assert len(bins) <= 1.06 * (sizes.sum(axis=0) / cap).max() + 1
    assert pack(np.zeros((0, 3)), np.array([1, 1, 1])) == []


def test_pack_items(spark):
    rng = random.Random(3)
    rows = [
        (str(i), rng.choice([3, 40, 250, 1000, 1001, 2500, 0]), 0) for i in range(400)
    ] + [("same", 10, 5), ("same", 10, 5), (None, 7, 0), ("loss", 900, 900)]
    items = spark.createDataFrame(rows, "doc_id string, tokens long, loss_tokens long").repartition(3)
    got = pack_items(items, (1000, 50, 400), block=64).toPandas()
    placed = got[got["bin"].notna()]
    by = placed.assign(t=placed["token_end"] - placed["token_begin"]).groupby("bin").agg(t=("t", "sum"), n=("t", "size"), loss=("loss_tokens", "sum"))
    assert by["t"].max() <= 1000 and by["n"].max() <= 50 and by["loss"].max() <= 400
    assert int((placed["token_end"] - placed["token_begin"]).sum()) == sum(r[1] for r in rows)
    assert set(got[got["bin"].isna()]["doc_id"]) == {r[0] for r in rows if r[1] == 0}
    split = set(got[got["segments"] > 1]["doc_id"])
    assert split == {r[0] for r in rows if r[1] > 1000 or r[2] > 400}
    assert (got[got["doc_id"] == "loss"]["segments"] == 3).all()
    assert pack_items(items.limit(0), (10, 10, 10)).count() == 0
    with pytest.raises(ValueError):
        pack_items(items, (10, 0, 10))


def test_pack_items_that_fill_no_container(spark):
    items = spark.createDataFrame([(str(i), 600, 600) for i in range(256)], "doc_id string, tokens long, loss_tokens long").repartition(2)
    got = pack_items(items, (1000, 50, 1000), block=64)
    assert got.where("bin is null").count() == 0 and got.count() == 256
    assert bin_report(got, 1000).first()[:3] == (256, 256 * 600, 256)


def test_repeated_and_null_ids_have_containers_of_their_own(spark):
    items = spark.createDataFrame(
        [("x", 100, 100)] * 4 + [(None, 60, 60)] * 5 + [("y", 250, 250)] * 2, "doc_id string, tokens long, loss_tokens long"
    ).repartition(3)
    got = pack_items(items, (100, 50, 100)).toPandas()
    fill = got.assign(t=got["token_end"] - got["token_begin"]).groupby("bin")["t"].sum()
    assert len(got) == 4 + 5 + 6 and got["bin"].notna().all() and fill.max() <= 100


def test_pack_texts_and_pairs(spark):
    docs = spark.createDataFrame([(1, "a b c " * 3000, 0), (2, "short", 0), (3, None, 0), (4, "", 0)], "id long, t string, tokens int")
    got = pack_texts(docs, "id", "t", 4096).toPandas()
    assert set(got[got["segments"] > 1]["doc_id"]) == {"1"} and set(got[got["bin"].isna()]["doc_id"]) == {"3", "4"}
    assert bin_report(pack_texts(docs, "id", "t", 4096), 4096).first().tokens == sum(count_tokens(["a b c " * 3000, "short"], TOKENIZER_DIR))
    assert pack_instructions(
        docs.withColumnRenamed("t", "q").selectExpr("id", "q", "'yes it is' a"), "id", "q", "a", 4096, 8, 100
    ).where("bin is not null").count() >= 4


def test_pivotal_rounding_keeps_sum_and_expectation():
    hits = np.zeros(30)
    p = [0.1 + 0.8 * (i % 7) / 7 for i in range(30)]
    for seed in range(600):
        done, held = pivotal(list(range(30)), p, seed)
        ones = sum(done.values())
        assert set(done.values()) <= {0, 1} and abs(ones + (held[1] if held else 0) - sum(p)) < 1e-6
        for i, x in done.items():
            hits[i] += x
        if held:
            hits[held[0]] += held[1]
    assert np.abs(hits / 600 - p).max() < 0.09
    assert pivotal([], [], 1) == ({}, None) and pivotal(["a"], [1.0], 1) == ({"a": 1}, None)


TARGETS = "source_name string, target_weight double, max_repeats int, mix_fraction double"


def test_mix(spark):
    rng = random.Random(4)
    rows = [
        (i, " ".join(["word"] * rng.randint(1, 40)), rng.choice(["Big", "big.", " B I G"]), 0) for i in range(900)
    ] + [(1000 + i, "word " * 20, "small_one", 0) for i in range(30)] + [
        (2000, "x " * 50, None, 0), (2001, None, "big", 0), (None, "y", "big", 0), (2002, "", "other", 0)
    ]
    docs = spark.createDataFrame(rows, "id long, t string, source string, size int").repartition(5)
    targets = spark.createDataFrame([("big", 0.7, 1, 0.5), ("small one", 0.1, 2, 0.5), ("scarce", 0.2, 4, 0.5)], TARGETS)
    mix = mix_sources(docs, "id", "t", "source", targets)
    report = {r.source_name: r for r in mix.report.collect()}
    assert {n for n, r in report.items() if r.falls_short} == {"scarce"} and report["scarce"].reached_size == 0
    for n in ("big", "small one"):
        assert abs(report[n].reached_size - report[n].target_size) <= 0.03 * report[n].target_size + 45
    picks = mix.picks.toPandas()
    assert (picks.groupby("source_name")["copies"].max() <= 2).all() and picks["doc_id"].is_unique
    assert report["big"].total_size == sum(count_tokens([r[1] for r in rows], TOKENIZER_DIR))
    for n in (1, 7):  # the picks don't depend on how rows are spread
        again = mix_sources(docs.repartition(n), "id", "t", "source", targets).picks.toPandas()
        assert sorted(zip(again["doc_id"], again["copies"])) == sorted(zip(picks["doc_id"], picks["copies"]))


def test_mix_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(7, "one two three", "big")] * 400 + [(8, "one", "big")] * 3, "id long, t string, source string")
    mix = mix_sources(docs, "id", "t", "source", spark.createDataFrame([("big", 1.0, 1, 0.5)], TARGETS))
    assert abs(mix.picks.where("doc_id = '7'").count() - 200) <= 3 and mix.picks.where("copies > 1").count() == 0


def test_mix_of_empty_tables(spark):
    targets = spark.createDataFrame([("big", 0.7, 1, 0.5)], TARGETS)
    empty = spark.createDataFrame([], "id long, t string, source string")
    mix = mix_sources(empty, "id", "t", "source", targets)
    assert mix.picks.count() == 0 and not mix.report.first().falls_short
    assert mix_sources(spark.createDataFrame([(1, "a", "big")], "id long, t string, source string"), "id", "t", "source", targets.limit(0)).picks.count() == 0
