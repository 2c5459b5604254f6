import random
import re

import numpy as np
from medlattice.operators import answer as G
from medlattice.operators import retrieval as R
from pyspark.sql import functions as F


def test_nearest_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(120, 8)), 1)
    x[7] = x[9]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "item_id long, embedding array<double>").repartition(5)
    q = df.where("item_id % 10 = 9 and item_id < 200").withColumnRenamed("item_id", "query_id")
    want = {}
    for i in range(9, 120, 10):
        d = ((x - x[i]) ** 2).sum(1)
        want[i] = sorted((round(float(v), 6), j) for j, v in enumerate(d))[:4]
    for block in (3, 1000):
        got: dict = {}
        for r in R.nearest(df, q, 4, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(r.distance, 6), r.item_id))
        assert got == want
    assert R.nearest(df, q, 4, threshold=0.0).count() == 13  # itself, and the equal one
    assert R.nearest(df, q.limit(0), 4).count() == 0 and R.nearest(df.limit(0), q, 4).count() == 0


def test_fusion_order_and_limit(spark):
    local = spark.createDataFrame(
        [(1, "a", "text a", 1.5, 1), (1, "b", "", 0.1, 2)], "query_id long, doc_id string, document string, distance double, source_rank int"
    )
    ext = spark.createDataFrame([(1, "p1", "x", 1), (1, "p2", "y", 2)], "query_id long, doc_id string, document string, source_rank int")
    got = [(r.doc_id, r.rank) for r in R.fuse(local, {"pubmed": ext}, 2).orderBy("rank").collect()]
    assert got == [("a", 1), ("p1", 2)]  # equal scores: local first
    text = R.context_text(R.fuse(local, {"pubmed": ext}, 3)).first().context
    assert text.startswith("[Synthetic Medical Record 1]\ntext a\n\n[PubMed Article 2]\nx\n")


def test_upsert_delete_failover(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, R.upsert(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [tuple(r) for r in R.delete(a, b, "k").collect()] == [(1, "x")]
    assert sorted(map(tuple, R.failover(a, b, "k").collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_query_expansion_is_case_sensitive_in_the_replacement(spark):
    df = spark.createDataFrame([("Cancer and cancer",), ("DIABETES",), (None,)], "q string")
    assert [r[0] for r in df.select(R.expand_query(F.col("q"))).collect()] == ["Cancer and (neoplasm OR tumor OR malignancy OR cancer)", "DIABETES", None]


def test_sections_stop_at_any_letter_after_a_line_break(spark):
    df = spark.createDataFrame([("Objective: to see\nmore\n\nResults: fine\n\nConclusion: good",)], "a string")
    s = df.select(R.sections(F.col("a")).alias("s"), R.normalise_terms(F.lit("HTN, xHTN")).alias("n")).first()
    assert s.s == {"objective": "to see", "results": "fine", "conclusions": "good"} and s.n == "Hypertension, xHTN"


def python_relevant(question, title, abstract):
    kw = set(question.lower().split())
    if not (kw & set(title.lower().split()) or kw & set(abstract.lower().split())):
        return None
    return [s for s in (x.strip() for x in abstract.split(". ")) if s and any(k in s.lower() for k in kw)][:3]


def test_relevance_equals_a_plain_loop(spark):
    rng = random.Random(2)
    w = ["gout", "drug", "a", "The", "cure", "dose.", "dose", "é", "x. y"]
    rows = [
        (
            str(i), " ".join(rng.choices(w, k=3)), i % 4, " ".join(rng.choices(w, k=2)), ". ".join(" ".join(rng.choices(w, k=3)) for _ in range(5))
        ) for i in range(200)
    ]
    got = {
        r.question_id: r.key_sentences for r in G.relevant(
            spark.createDataFrame(rows, "question_id string, question string, rank int, title string, abstract string")
        ).collect()
    }
    assert got == {i: k for i, q, _, t, a in rows if (k := python_relevant(q, t, a)) is not None}


def test_answers(spark):
    q = spark.createDataFrame([("1", "what helps gout"), ("2", "zzz")], "question_id string, question string")
    d = spark.createDataFrame(
        [("1", 0, "On gout", "Rest helps. The patient slept. Ice helps", "2020", "Bell A"), ("2", 0, "t", "nothing", None, None)],
        "question_id string, rank int, title string, abstract string, year string, authors string"
    )
    a = {r.question_id: r.answer for r in G.answer_questions(q, d).collect()}
    assert a["2"] == G.NOT_FOUND + "zzz"
    assert "According to Bell A (2020):\n- Rest helps.\n- Ice helps.\n" in a["1"] and G.SYNTHETIC_NOTE in a["1"] and a["1"].endswith(
        "References:\n[1] Bell A (2020). On gout.\n"
    )


def test_validation(spark):
    kind = "id int, answer string, context string, sources array<struct<source_name string, document_id string>>"
    rows = [
        (1, "Rest helps [Local 1]. Ice [Pubmed 9].", "x", [("local", "d1")]), (2, "Studies show rest helps.", "studies show that rest helps", []),
        (3, "Studies show gold helps", "x", [("local", "d1")]), (4, None, None, None)
    ]
    got = {r.id: r for r in G.validate(spark.createDataFrame(rows, kind), "answer", "context", "sources").collect()}
    assert [c.document_id for c in got[1].citations_found] == ["d1"] and got[1].missing_citations == ["Pubmed 9"] and not got[1].is_valid
    assert got[2].is_valid and got[4].is_valid
    assert got[3].potential_hallucinations == ["Studies show gold helps"] and G.NO_CITATIONS in got[3].warnings


def test_prompts(spark):
    df = spark.createDataFrame([("q", "c")], "q string, c string")
    p = G.model_prompt(F.col("q"), F.col("c"))
    x = df.select(
        G.model_answer(F.concat(p, F.lit("  yes ")), p).alias("a"), G.model_answer(p, p).alias("b"), G.echo_reply(F.lit("z" * 60)).alias("e"),
        G.document_prompt(
            F.col("q"), F.array(F.struct(F.lit("T").alias("title"), F.lit(None).cast("string").alias("year"), F.lit("A").alias("abstract")))
        ).alias("d")
    ).first()
    assert x.a == "yes" and x.b == G.NO_REPLY and x.e.count("z") == 50 and re.search("Document 1:\nTitle: T\nYear: Unknown\nAbstract: A", x.d)
