import random
import re

import numpy as np
import pyarrow as pa
from medlattice.functions import containment as C
from medlattice.functions.similarity import bleu, lcs_length, rouge_l
from medlattice.operators import evaluate as E
from medlattice.operators import shaping as D
from pyspark.sql import functions as F


def test_entities_look_at_lower_case_only(spark):
    got = spark.createDataFrame([("MRI and Aspirin for cancer",), (None,)], "t string").select(E.entities(F.col("t")).alias("e")).collect()
    assert got[0].e == ["cancer", "aspirin"] and got[1].e == []


def test_scores_of_empty_and_small_sets(spark):
    df = spark.createDataFrame([("aspirin cancer", "aspirin"), ("x", "cancer"), ("cancer a@b.org", "")], "g string, r string")
    s = E.entity_scores(df, "g", "r").first()
    assert (s.precision, s.recall, s.f1) == (0.25, 0.5, round(2 / 3, 6)) and s.pii_leakage == round(1 / 30, 6)
    assert tuple(E.entity_scores(df.limit(0), "g", "r").first()) == (0.0, 0.0, 0.0, 0.0)


def test_correctness_by_type(spark):
    rows = [
        ("yesno", "Yes", "well yes"), ("yesno", "no", "yes"), ("factoid", "", "anything"), ("factoid", "gout", "It is GOUT"),
        ("list", "a1, b2, c3", "a1 and c3"), ("list", "a1, b2", "none"), ("other", "x", "x"), ("yesno", "no", None)
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, g string, a string").select(E.is_correct(F.col("t"), F.col("g"), F.col("a"))).collect()]
    assert got == [True, False, True, True, True, False, False, True]


def test_accuracy_sets(spark):
    df = spark.createDataFrame([(True, "s1", "a"), (False, "s1", "b"), (True, "s2", "a")], "ok boolean, s string, t string")
    got = {(r.level, r.value): (r.questions, r.correct) for r in E.accuracy_sets(df, "ok", "s", "t").collect()}
    assert got == {("overall", "all"): (3, 2), ("source", "s1"): (2, 1), ("source", "s2"): (1, 1), ("type", "a"): (2, 2), ("type", "b"): (1, 0)}


def test_term_patterns_with_groups_give_the_group(spark):
    df = spark.createDataFrame([("Crohn disease, Lung cancer, acute pain",), (None,)], "t string")
    assert {r.term for r in E.medical_terms(df, "t").collect()} == {"disease", "Lung cancer", "acute"}
    assert E.targeted_prompts(E.medical_terms(df, "t")).count() == 15 and E.targeted_prompts(E.medical_terms(df, "t"), 4).count() == 4
    assert E.untargeted_prompts(20, spark).where("prompt is not null").count() == 20


def test_extractions_equal_plain_loops(spark):
    rng = random.Random(5)
    w = [f"w{i}" for i in range(12)]
    docs = [(i, ". ".join(" ".join(rng.choices(w, k=rng.randint(3, 11))) for _ in range(4))) for i in range(12)]
    answers = [
        (i, rng.choice(["", "so "]) + rng.choice(rng.choice(docs)[1].split(". ")) + rng.choice(["", "x", " end"])) for i in range(40)
    ] + [(100 + i, " ".join(rng.choices(w, k=14))) for i in range(40)] + [(200, None), (201, "")]
    a, o = spark.createDataFrame(answers, "id int, a string"), spark.createDataFrame([*docs, (99, None)], "doc int, t string")
    exact, fuzzy = {}, {}
    for i, x in answers:
        if x is None:
            continue
        best = None
        for d, t in docs:
            for s in re.split(r"[.!?] ", t):
                if len(s.split()) >= 5 and s in x and i not in exact:
                    exact[i] = (d, s)
        if i in exact:
            continue
        for d, t in docs:
            for s in re.split(r"[.!?] ", t):
                if len(s.split()) >= 8:
                    sim = len(set(s.lower().split()) & set(x.lower().split())) / len(set(s.lower().split()))
                    if sim > 0.7 and (best is None or sim > best[0]):
                        best = (sim, d, s)
        if best:
            fuzzy[i] = (best[1], best[2], round(best[0], 6))
    e = E.exact_extractions(a, "id", "a", o, "doc", "t")
    f = E.fuzzy_extractions(a, "id", "a", o, "doc", "t", e)
    assert {r.answer_id: (r.doc, r.matched_text) for r in e.collect()} == exact and exact
    assert {r.answer_id: (r.doc, r.matched_text, r.similarity) for r in f.collect()} == fuzzy and fuzzy
    assert E.attack_rate(e, f, 100).first().success_rate == float(len(exact))


def test_containment_equals_plain_loops(monkeypatch):
    """Blocks of any size, single words, long answers: the best sentences of each answer, and all that tie in share and order."""
    rng = random.Random(3)
    for _ in range(150):
        w = [f"w{i}" for i in range(rng.choice([3, 6, 15, 40]))]
        some = lambda most: list(dict.fromkeys(rng.choices(w, k=rng.randint(1, most))))
        a, s = ([some(rng.choice([2, 9, 20, 80])) for _ in range(rng.randint(1, 30))] for _ in "as")
        for name, sizes in (("PAIRED_WORDS", [2, 8, 64]), ("MARK_BYTES", [10, 100, 1 << 20]), ("COMPARED", [8, 64, 1 << 20])):
            monkeypatch.setattr(C, name, rng.choice(sizes))
        order = np.array([rng.randint(0, 9) for _ in s])
        joined = [pa.chunked_array([[" ".join(x) for x in t]]) for t in (a, s)]
        got = {(int(i), int(j)): x for i, j, x in zip(*C.best_contained(*joined, order, 0.7))}
        want = {}
        for i, x in enumerate(a):
            held = [(-len(set(x) & set(y)) / len(y), order[j], j) for j, y in enumerate(s)]
            top = min((h[:2] for h in held if h[0] < -0.7), default=None)
            want |= {(i, j): -h for h, o, j in held if (h, o) == top}
        assert got == want


def test_sentence_of_one_word_again_and_again(spark):
    a = spark.createDataFrame([(1, "they said no"), (2, "yes")], "id int, a string")
    o = spark.createDataFrame([(7, "no " * 8)], "doc int, t string")
    assert [(r.answer_id, r.doc, r.similarity) for r in E.fuzzy_extractions(a, "id", "a", o, "doc", "t").collect()] == [(1, 7, 1.0)]


def test_exploded_runs_and_sentences_are_never_broadcast(spark):
    a = spark.createDataFrame([(i, f"w{i} and one two three four five six seven eight nine ten") for i in range(5)], "id int, a string")
    o = spark.createDataFrame([(i, f"w{i} but one two three four five six seven eight nine ten.") for i in range(5)], "doc int, t string")
    exact = E.exact_extractions(a, "id", "a", o, "doc", "t")
    for df in (exact, E.fuzzy_extractions(a, "id", "a", o, "doc", "t")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_text_measures():
    rng = random.Random(4)
    for _ in range(200):
        a, b = rng.choices("abc", k=rng.randint(0, 9)), rng.choices("abc", k=rng.randint(0, 9))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[-1][-1]
    assert rouge_l("a b", "a b") == 1.0 and rouge_l("", "a") == 0.0 and bleu("a b c d e", "a b c d e") == 1.0 and bleu("a b", "a b") == 0.0


def test_split_and_balance(spark):
    df = spark.range(1, 21).withColumnRenamed("id", "k").withColumn("g", F.when(F.col("k") <= 6, "a").otherwise("b"))
    s = D.split_by_share(df, "k", 0.9)
    assert {r.split_name: r.c for r in s.groupBy("split_name").agg(F.count("*").alias("c")).collect()} == {"train": 18, "test": 2}
    b = D.combine_balanced(df, "g", "k")
    assert {r.g: r.c for r in b.groupBy("g").agg(F.count("*").alias("c")).collect()} == {"a": 6, "b": 6}
    assert {r.split_name: r.c for r in b.groupBy("split_name").agg(F.count("*").alias("c")).collect()} == {"train": 8, "dev": 1, "test": 3}
    assert D.combine_balanced(df, "g", "k", cap=4).where("split_name is null").count() == 8
    assert D.combine_balanced(df.limit(0), "g", "k").count() == 0


def test_record_text_round_trip(spark):
    df = spark.createDataFrame(
        [(7, None, " Knee ", "d", "a\n \n\nb", "x, y"), (8, "s", "t", "d", "  ", None)], "n int, s string, t string, d string, c string, k string"
    )
    texts = df.select(D.record_text(*(F.col(c) for c in "nstdck")).alias("x"))
    rows = texts.collect()
    assert rows[1].x is None and "SPECIALTY: Unknown\nSAMPLE TYPE:  Knee \n" in rows[0].x
    r = D.parse_records(texts.where("x is not null"), "x").first()
    assert (r.record_id, r.content, r.keywords) == ("record_00007", "a\n\nb", ["x", "y"])


def test_cases_and_narratives_repeat(spark):
    a, b = (D.synthetic_cases(spark, 50).select("*", D.narrative().alias("n")).orderBy("patient_id").collect() for _ in range(2))
    assert a == b and all(r.n.startswith("Patient admitted to ICU. The patient is a ") for r in a)
