import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from medlattice.llm import quota_sample as Q
from medlattice.llm.splitting import piece_rows, split_oversized, split_text

TARGETS = "field_name string, category string, target_share double, sample_fraction double, min_rows int"


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 120))
@settings(max_examples=200, deadline=None)
def test_allotment_keeps_floors_and_caps(rows, total):
    shares, floors, caps = zip(*rows)
    q = Q.allot(total, list(shares), list(floors), list(caps))
    assert all(min(f, c) <= x <= c or s == 0 for x, f, c, s in zip(q, floors, caps, shares))
    lows = sum(min(f, c) for f, c in zip(floors, caps))
    live = sum(c if s > 0 else min(f, c) for s, f, c in rows)
    assert sum(q) == min(max(total, lows), live) or min(s for s in shares if s > 0) < 1e-6 if any(shares) else True


def test_largest_remainder():
    assert Q.allot(10, [0.5, 0.3, 0.2], [0, 0, 0], [99, 99, 99]) == [5, 3, 2]
    assert Q.allot(10, [0.34, 0.33, 0.33], [0, 0, 0], [99, 99, 99]) == [4, 3, 3]
    assert Q.allot(10, [0.5, 0.5], [0, 0], [2, 99]) == [2, 8]
    assert Q.allot(10, [0.99, 0.01], [0, 3], [99, 99]) == [7, 3]


def targets(spark):
    return spark.createDataFrame([("f", "Big", 0.5, 0.5, 1), ("f", "Small - one", 0.4, 0.5, 2), ("f", "None", 0.1, 0.5, 2)], TARGETS)


def test_sample(spark, monkeypatch):
    monkeypatch.setattr(Q, "BUCKET_ROWS", 7)
    rows = [(f"b{i}", ["Big", " BIG.", "b i g"][i % 3], "x") for i in range(60)] + [(f"s{i}", "small_one", "x") for i in range(6)] + [
        ("s0", "SMALL ONE", "x"), (None, "Big", "x"), ("n", None, "x"), ("o", "other", "x"), ("e", "", "x")
    ] * 3
    items = spark.createDataFrame(rows, "id string, label string, category string").repartition(3)
    got = Q.quota_sample(items, "id", "label", targets(spark))
    report = {r.category: r for r in got.report.collect()}
    assert report["Big"].usable_rows == 66 and report["Small - one"].available == 6 and report["None"].available == 0
    assert {c for c, r in report.items() if r.falls_short} == {"Small - one", "None"}
    assert all(r.sampled == r.quota for r in report.values()) and sum(r.quota for r in report.values()) == 33
    ids = sorted(r.item_id for r in got.sample.collect())
    assert len(ids) == len(set(ids)) == 33
    assert ids == sorted(r.item_id for r in Q.quota_sample(items.repartition(2), "id", "label", targets(spark)).sample.collect())


def test_report_tells_why_a_target_is_missed(spark):
    rows = [(f"b{i}", "big") for i in range(95)] + [(f"s{i}", "small") for i in range(50)]
    wanted = spark.createDataFrame([("f", "big", 0.9, 0.69, 0), ("f", "small", 0.1, 0.69, 50)], TARGETS)
    report = {r.category: r for r in Q.quota_sample(spark.createDataFrame(rows, "id string, label string"), "id", "label", wanted).report.collect()}
    assert report["big"].short_by == "floors of others" and not report["big"].falls_short and report["small"].short_by is None


def test_sample_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, label string")
    got = Q.quota_sample(empty, "id", "label", targets(spark))
    assert got.sample.count() == 0 and got.report.where("falls_short").count() == 0 and got.report.count() == 3
    some = spark.createDataFrame([("1", "Big")], "id string, label string")
    assert Q.quota_sample(some, "id", "label", targets(spark).limit(0)).sample.count() == 0


def test_pieces_of_random_texts():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(
            rng.choice(
                ["a", "bb ", ". ", "\n", "word ", "x" * rng.choice([1, 30, 70]), "\n\nHEAD: ", "é", "\r\n", "\t", " " * 20]
            ) for _ in range(rng.randint(0, 80))
        )
        size = rng.randint(1, 60)
        overlap = rng.randint(0, size - 1)
        pieces = split_text(text, size, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(e - b <= size for b, e, _ in pieces)
        assert all(a < c <= b < d and b - c <= overlap for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]))
        rebuilt = text[: pieces[0][1]] + "".join(text[b1:e] for (_, b1, _), (_, e, _) in zip(pieces, pieces[1:]))
        assert rebuilt == text
        if len(text) > size:
            assert any(c == "character" for *_, c in pieces) == any(len(run) > size for run in re.findall(r"[^ \t\r\n]+", text))


def test_snapped_overlaps_begin_with_a_word():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(400))
    pieces = split_text(text, 60, 15, True)
    assert all(text[b - 1] == " " for b, _, _ in pieces[1:]) and pieces[-1][1] == len(text)
    assert all(c <= b and b - c <= 15 and e - c <= 60 for (_, b, _), (c, e, _) in zip(pieces, pieces[1:]))


def test_cuts_prefer_larger_units():
    text = "One two. Three four.\n\nFive six. Seven."
    assert [text[b:e] for b, e, _ in split_text(text, 24, 0)] == ["One two. Three four.\n\n", "Five six. Seven."]
    assert [c for *_, c in split_text("aa bb. cc dd. ee", 8, 0)] == ["sentence", "sentence", "end"]
    assert split_text("aaaa bbbb cccc", 10, 3)[1][0] == 7


def test_split_table(spark):
    long = "word " * 50
    rows = [
        ("a", long, 1), ("a", long, 2), ("b", "short", 1), ("c", None, 1), ("d", "", 1), (None, long, 1), ("e", "y" * 101, 1),
        ("f", "z" * 100_000, 1), ("g", "é" * 100, 1)
    ]
    out = split_oversized(spark.createDataFrame(rows, "k string, t string, text int"), "k", "t", 100, 10)
    got = {r.item_key: r for r in out.collect()}
    assert sorted(got) == ["a", "e", "f"] and got["f"].n_chars == 100_000
    assert all(len(p.text) <= 100 for r in got.values() for p in r.pieces)
    assert piece_rows(out).where("item_key = 'f'").count() == len(got["f"].pieces)
    assert split_oversized(spark.createDataFrame([], "k string, t string"), "k", "t", 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], "k string, t string"), "k", "t", 10, 10)
