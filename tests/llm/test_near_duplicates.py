import random
import re

import medlattice.llm.near_duplicates as N
import numpy as np
import pytest


def shingle_set(text, words):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


def brute(rows, words, threshold):
    sets = [(i, shingle_set(t, words)) for i, t in rows if i is not None]
    out = set()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and i != j and len(a & b) >= threshold * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def corpus(n=160, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = re.findall("[a-z0-9]+", rng.choice(rows)[1].lower())
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], rng.choice(vocabulary)]])
            if rng.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
        else:
            w = rng.choices(vocabulary, k=rng.randint(4, 60))
        rows.append((f"r{i:03d}", rng.choice([" ", ", ", "\n"]).join(w)))
    return rows


def test_shingles_equal_plain_sets():
    texts = ["a b c d", "", "a b", "A1 b2é c3 d4", "x " * 50, "same same same same"]
    doc, h = N.shingles([t.lower().encode() for t in texts], 3)
    assert [int((doc == i).sum()) for i in range(len(texts))] == [len(shingle_set(t, 3)) for t in texts]
    d2, h2 = N.shingles([b"zz q a b c"], 3)
    assert h[doc == 0][0] in set(h2) or set(h[doc == 0]) & set(h2)
    assert len(N.shingles([b""], 3)[0]) == 0 and len(N.shingles([], 3)[0]) == 0


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for k in range(60):
        common, own = int(rng.integers(5, 150)), int(rng.integers(1, 100))
        e = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
        a, b = np.sort(e[: common + own]), np.sort(np.concatenate([e[:common], e[common + own :]]))
        s = N.sketch(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        errors.append((s[0] == s[1]).mean() - common / (common + 2 * own))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize("block, together", [(N.BLOCK, N.TOGETHER), (3, 2), (1, 1)])
def test_links_equal_brute_force(spark, monkeypatch, block, together):
    monkeypatch.setattr(N, "TOGETHER", together)
    monkeypatch.setattr(N, "MEETING", 500 if block == 3 else N.MEETING)
    rows = corpus()
    rows += [
        ("r000", rows[0][1]), ("copy1", rows[3][1]), ("copy2", rows[3][1].upper()), ("n", None), ("e", ""), ("p", " .,;"), ("two", "a b"),
        (None, rows[4][1])
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id string, t string, cls string").repartition(4)
    want = brute(rows, 3, 0.5)
    got = {tuple(r) for r in N.linked_pairs(N.near_duplicates(df, "id", "t", words=3, threshold=0.5, block=block)).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want) and len(want) > 40


def test_blocks_of_crowded_keys_change_nothing():
    rng = np.random.default_rng(4)
    n = 4000
    key = np.sort(rng.choice(np.arange(40), n, p=np.append(np.full(39, 0.5 / 39), 0.5)))  # one key has half of all rows
    cls = rng.integers(0, 3000, n)
    order = np.lexsort((cls, key))
    bits = {c: rng.integers(0, 2**62, 3) & (rng.integers(0, 2**62, 3) if c % 2 else -1) for c in range(3000)}
    rows = np.column_stack([key[order], cls[order], np.stack([bits[c] for c in cls[order]])]).astype(np.int64)

    def batches(x, names):
        for i in range(0, len(x), 300):
            yield N.pa.RecordBatch.from_arrays([N.pa.array(x[i : i + 300, k]) for k in range(x.shape[1])], names=names)

    def met(block):
        pairs, crowd = set(), []
        for b in N._meetings(batches(rows, N._KEYED), 110, block):
            for r in b.to_pylist():
                if r["cls_b"] is None:
                    crowd.append([r["key"], r["cls_a"], r["bits0"], r["bits1"], r["bits2"], r["no"]])
                else:
                    pairs.add((r["cls_a"], r["cls_b"]))
        most = {}
        for c in crowd:
            most[c[0]] = max(most.get(c[0], 0), c[5])
        each = sorted([*c[:5], min(c[5], j), max(c[5], j), c[5]] for c in crowd for j in range(most[c[0]] + 1))
        each.sort(key=lambda c: (c[0], c[5], c[6], c[7], c[1]))
        if each:
            for b in N._block_meetings(batches(np.array(each, dtype=np.int64), [*N._KEYED, "lo", "hi", "at"]), 110):
                pairs |= {(r["cls_a"], r["cls_b"]) for r in b.to_pylist()}
        return pairs

    want = set()
    distinct = np.unique(rows, axis=0)
    for k in np.unique(distinct[:, 0]):
        own = distinct[distinct[:, 0] == k]
        for i in range(len(own)):
            apart = np.bitwise_count((own[i + 1 :, 2:] ^ own[i, 2:]).view(np.uint64)).sum(axis=1)
            want |= {(int(own[i, 1]), int(c)) for c in own[i + 1 :][192 - apart.astype(int) >= 110, 1]}
    assert len(want) > 1000
    assert met(10_000) == met(500) == met(37) == want


def test_many_copies_and_empty_tables(spark, monkeypatch):
    rows = [(f"c{i}", "the same text again and again for all") for i in range(300)] + [("x", "another text that is not alike at all")]
    df = spark.createDataFrame(rows, "id string, t string")
    found = N.near_duplicates(df, "id", "t")
    assert found.links.count() == 0 and N.linked_pairs(found).count() == 300 * 299 // 2
    assert {r.copies for r in N.link_counts(found).collect()} == {300, 1}
    monkeypatch.setattr(N, "TOGETHER", 7)  # many lists of one class
    assert N.linked_pairs(found).count() == 300 * 299 // 2
    assert N.linked_pairs(N.near_duplicates(df.limit(0), "id", "t")).count() == 0
