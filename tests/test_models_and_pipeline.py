import re

import numpy as np
import pytest
from medlattice.operators import evaluate as E
from medlattice.operators import models as M
from medlattice.operators import privacy as P
from medlattice.operators import retrieval as R
from medlattice.operators.shaping import split_ranks
from medlattice.pipeline import answers_from_index, run_pipeline


def counting():
    """A model whose class travels by value, as the workers don't know this module."""

    class Counting:
        """Replies with the length of each prompt and how many came at once."""

        def complete(self, prompts):
            return [f"{len(p)}/{len(prompts)}" for p in prompts]

    return Counting


def scripted():
    class Scripted:
        """Plays every part of the chain from the prompt's first words."""

        def complete(self, prompts):
            out = []
            for p in prompts:
                if p.startswith("Name the"):
                    out.append("1. Pain: often\n2. Drugs - some\n")
                elif p.startswith("Read the document"):
                    out.append("- Pain: mild\n- Drugs: aspirin")
                elif p.startswith("Is the second text safe"):
                    out.append("1. no\n2. Problems: - a name\nRisk level: High" if p.endswith("Ann") else "1. yes")
                elif p.startswith("Rewrite"):
                    out.append(p.rsplit("\n\n", 1)[1].replace("Ann", "someone"))
                else:
                    out.append(f"Note on {p.splitlines()[-1]}" if "facts" in p else p.rsplit("\n\n", 1)[1])
            return out

    return Scripted


def test_hashing_encoder_and_embeddings(spark):
    e = M.HashingEncoder(16)
    a, b, c = e.encode(["gout cure", "Cure, GOUT!", ""])
    assert np.allclose(a, b) and not c.any() and abs(np.abs(a).sum() - 1) < 1e-9
    df = spark.createDataFrame([(1, "gout cure", 5), (2, None, 6), (3, "", 7)], "k long, t string, embedding int")
    got = {r.k: r.embedding for r in M.embed(df, "t", lambda: M.HashingEncoder(16)).collect()}
    assert got[2] is None and np.allclose(got[1], a, atol=1e-6) and got[3] == [0.0] * 16
    index = M.build_index(df, "k", "t", M.HashingEncoder)
    assert index.columns == ["item_id", "text", "embedding"] and index.count() == 2
    assert M.embed(df.limit(0), "t", M.HashingEncoder).count() == 0


def test_models_are_asked_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(6)], "k int, p string").coalesce(1)
    got = {r.k: r.reply for r in M.complete(df, "p", counting()).collect()}
    assert got == {0: None, **{i: f"{i}/5" for i in range(1, 6)}}
    said = M.generate_answers(spark.createDataFrame([("q", "One. Two."), ("q", None)], "q string, c string"), "q", "c", M.ExtractiveModel).collect()
    assert said[0].answer == "One" and said[1].answer.startswith("I couldn't generate")


def test_chain_from_documents_to_notes(spark):
    Scripted = scripted()
    docs = spark.createDataFrame([("a", "text one"), ("b", None), ("c", "text two")], "k string, t string")
    names = M.identify_attributes(docs, "t", Scripted, 2)
    assert names == ("Pain", "Drugs")
    got = M.synthetic_notes(docs, "k", "t", names, Scripted).collect()
    assert {r.k for r in got} == {"a", "c"} and got[0].attributes == {"Pain": "mild", "Drugs": "aspirin"} and got[0].note == "Note on - Drugs: aspirin"
    backend = M.ModelBackend(Scripted)
    refined = {
        r.document_id: r for r in P.refine_documents(
            spark.createDataFrame([("x", "Ann"), ("y", "calm")], "k string, t string"), "k", "t", backend, backend, backend
        ).collect()
    }
    assert refined["x"].is_safe and refined["x"].iterations_required == 1 and refined["x"].final_synthetic_data == "someone"
    assert refined["x"].assessments[0].risk_level == "high" and refined["x"].assessments[0].feedback == ["a name"] and refined["y"].iterations_required == 0
    made = M.test_questions(spark, 12, M.ExtractiveModel).collect()
    assert len(made) == 12 and {r.topic for r in made} <= set(M.TEST_TOPICS)


def test_nearest_with_ties_and_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(R, "DISTANCE_BYTES", 64)
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(40)], "item_id long, embedding array<double>").repartition(3)
    got = R.nearest(df, df.where("item_id < 3").withColumnRenamed("item_id", "query_id"), 5).collect()
    assert {(r.query_id, r.item_id) for r in got} == {(q, q + 3 * i) for q in range(3) for i in range(5)}
    d = np.array([[3.0, 1.0, 1.0, 1.0, 2.0]])
    assert set(R._smallest(d, np.array([[9, 8, 2, 5, 1]]), 2)[0]) == {2, 3}


def test_nearer_items_by_single_precision_equal_full_distances(monkeypatch):
    monkeypatch.setattr(R, "TILE", 7)
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, m, dim, k = rng.integers(1, 30), rng.integers(6, 200), rng.integers(1, 33), rng.integers(1, 6)
        q, x = np.round(rng.normal(size=(n, dim)) * rng.choice([1e-3, 1, 30]), rng.integers(0, 3)), np.round(rng.normal(size=(m, dim)), rng.integers(0, 3))
        own = rng.permutation(m).astype("int64")
        d = np.round(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T), 9)
        best_d, best_i = d[:, :k].copy(), np.broadcast_to(own[:k], (n, k)).copy()
        R._take_nearer(q, q.astype("float32"), (q * q).sum(1), x[k:], own[k:], best_d, best_i)
        assert [sorted(r) for r in best_i.tolist()] == [sorted(own[np.lexsort((own, r))[:k]].tolist()) for r in d]


def test_a_question_asked_again_is_searched_once(spark):
    class OnceEncoder(M.HashingEncoder):
        def encode(self, texts):
            assert len(set(texts)) == len(texts), "a question asked again is encoded again"
            return super().encode(texts)

    index = M.build_index(spark.createDataFrame([("a", "Aspirin helps pain."), ("b", "Knees bend.")], "k string, t string"), "k", "t", M.HashingEncoder)
    asked = spark.createDataFrame([(str(i), "Which pain is it?") for i in range(9)] + [("none", None)], "question_id string, question string").coalesce(1)
    got = {r.question_id: r.answer for r in answers_from_index(index, asked, OnceEncoder, 1).collect()}
    assert len(got) == 10 and got["none"] is None and len({got[str(i)] for i in range(9)}) == 1 and "pain" in got["0"]


def test_unknown_types_are_wrong_and_unknown_metrics_warned_about(spark):
    df = spark.createDataFrame([("aspirin cancer", "aspirin")], "g string, r string")
    with pytest.warns(UserWarning, match="speed"):
        assert E.metrics(df, "g", "r", ["recall", "speed", "f1"]).columns == ["recall", "f1"]
    scored = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "d string, ok boolean")
    assert tuple(E.benchmark_union(scored, "d", "ok").first()) == (0.75, ["a", "b"])
    assert tuple(E.benchmark_union(scored.limit(0), "d", "ok").first()) == (0.0, [])


def test_benchmark_positions_do_not_depend_on_the_layout(spark):
    rows = spark.createDataFrame([(None, f"q{i}", "r") for i in range(50)] + [("id1", "q", "r")], "id string, question string, reference_answer string")
    answer = lambda asked: asked.selectExpr("question_id", "concat('re ', question) answer")
    runs = [sorted(tuple(r) for r in E.benchmark_run(rows.repartition(n), answer, m).collect()) for n in (1, 4) for m in (None, 7)]
    assert runs[0] == runs[2] and runs[1] == runs[3] and len(runs[0]) == 51 and len(runs[1]) == 7
    assert len({r[0] for r in runs[0]}) == 51 and all(r[3] == f"re {r[1]}" for r in runs[0])


def test_ranks_in_groups(spark):
    df = spark.range(1000).selectExpr("id", "md5(cast(id as string)) h", "if(id % 7 = 0, null, id % 3) g")
    got = split_ranks(df, "h", "id", "g").collect()
    for g in {r.g for r in got}:
        own = sorted((r.h, r._rank) for r in got if r.g == g)
        assert [k for _, k in own] == list(range(1, len(own) + 1)) and {r._total for r in got if r.g == g} == {len(own)}


def test_pipeline(spark):
    texts = [f"Patient {i} has acute pain in the left knee and takes aspirin each day after meals since {2000 + i}." for i in range(8)]
    documents = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)] + [("none", None)], "doc_id string, text string")
    questions = spark.createDataFrame(
        [
            ("1", "Is aspirin taken for pain?", "yes", None, "yesno", "s"), ("2", "Where is the pain?", "knee", None, "factoid", "s"),
            ("3", "odd", None, None, "odd", "t")
        ],
        "question_id string, question string, exact_answer string, ideal_answer string, type string, source string"
    )
    rules = P.RuleBackend()
    run = run_pipeline(documents, questions, M.HashingEncoder, rules, rules, rules, attacks=6)
    assert run.summary.first().total_documents == 8 and run.index.count() == 8
    assert {r.attack for r in run.attacks.collect()} == {"targeted", "untargeted"}
    accuracy = {(r.level, r.value): r for r in run.accuracy.collect()}
    assert accuracy[("overall", "all")].questions == 3 and accuracy[("type", "factoid")].correct == 1 and accuracy[("type", "odd")].correct == 0
    report = run.report.first()
    assert report.privacy_protection in ("High", "Medium", "Low") and report.attack_success_rate == (
        report.targeted_attacks_success + report.untargeted_attacks_success
    ) / 2
    said = answers_from_index(run.index, questions, M.HashingEncoder, 2).where("question_id = '2'").first().answer
    assert "knee" in said and not re.search(r"Patient \d", said)
