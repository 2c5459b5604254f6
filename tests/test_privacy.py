import random
import re

from medlattice.operators import privacy as P
from pyspark.sql import functions as F


def python_redact(text, level):
    if text is None:
        return None
    out, n = text, 0
    for t, p in P.patterns(level):
        for m in [m.group(0) for m in re.finditer(p, text)]:
            out = out.replace(m, f"[REDACTED {t.upper()}]")
            n += 1
    return out + P.REDACTION_NOTE if n and "[REDACTED" in out else out


def test_phone_in_brackets_keeps_the_bracket(spark):
    row = spark.createDataFrame([("call (555) 123-4567 now",)], "t string").select(P.redact(F.col("t"), "minimal").alias("r")).first()
    assert row.r == "call ([REDACTED PHONE] now" + P.REDACTION_NOTE


def test_redaction_equals_a_plain_loop(spark):
    rng = random.Random(1)
    bits = [
        "a@b.org", "555-123-4567", "123-45-6789", "Patient #12", "Subject ID 7", "1/2/2020", "MRN 5", "Ann Bell", "12 Oak Street", "12345",
        "age 30 years", "café", " ", ". ", "was 4", "a@b.org.", "\n", "É"
    ]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", "x" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for level in ("minimal", "standard", "strict", "no such level"):
        got = {r.i: r.r for r in df.select("i", P.redact(F.col("t"), level).alias("r")).collect()}
        assert got == {i: python_redact(t, level) for i, t in enumerate(texts)}


def test_counts_and_rows(spark):
    df = spark.createDataFrame([(1, "a@b.org and c@d.org"), (2, None)], "k int, t string")
    assert [
        (r.pii_type, r.pos, r.instance) for r in P.detected_rows(df, "k", "t", "minimal").orderBy("pos").collect()
    ] == [("email", 0, "a@b.org"), ("email", 1, "c@d.org")]


def test_parsers(spark):
    r = spark.createDataFrame(
        [("Yes\n2. Worries: a - b\n3. none\nRisk level: HIGH", "1. Symptoms: x\n2. Plan - y", "- A: one\n- B: two\nmore\n- C:")],
        "a string, n string, v string"
    )
    x = r.select(
        P.parse_assessment(F.col("a")).alias("a"), P.parse_attribute_names(F.col("n"), 4).alias("n"),
        P.parse_attribute_values(F.col("v"), ("A", "B", "D")).alias("v"), P.attribute_lines(F.create_map(F.lit("k"), F.lit("v"))).alias("l")
    ).first()
    assert x.a.is_safe and x.a.feedback == ["a", "b"] and x.a.risk_level == "high"
    assert x.n == ["Symptoms", "Plan", "Treatment", "Medical History"]
    assert x.v == {"A": "one", "B": "two\nmore", "D": "Not mentioned"} and x.l == "- k: v"


def test_refinement_never_assesses_the_last_rewrite(spark):
    rules = P.RuleBackend()
    df = spark.createDataFrame([("safe", "nothing here"), ("four", "a@b.org 555-123-4567 123-45-6789 Patient 4"), ("one", "a@b.org")], "k string, t string")
    got = {r.document_id: r for r in P.refine_documents(df, "k", "t", rules, rules, rules).collect()}
    assert got["safe"].is_safe and got["safe"].iterations_required == 0
    assert got["one"].is_safe and got["one"].iterations_required == 1
    assert not got["four"].is_safe and got["four"].iterations_required == 3 and len(got["four"].assessments) == 3
    s = P.refinement_summary(P.refine_documents(df, "k", "t", rules, rules, rules)).first()
    assert (s.total_documents, s.safe_documents) == (3, 2)
    assert P.refinement_summary(P.refine_documents(df.limit(0), "k", "t", rules, rules, rules)).first().avg_iterations == 0.0


def test_private_documents_lose_names_and_hospitals(spark):
    df = spark.createDataFrame([("Dr. Smith saw Patient #54321 at Memorial Hospital.",), ("Cells divide.",), (None,)], "abstract string")
    rows = P.privatise(df, "abstract").collect()
    assert [r.contains_synthetic_data for r in rows] == [True, False, False]
    assert not re.search("Smith|54321|Memorial", rows[0].abstract) and rows[1].abstract == "Cells divide."


def test_protection_and_comparison(spark):
    df = spark.createDataFrame([(1, "Ann Bell, Ann Bell, MRN: 4", "Ann Bell")], "k int, o string, s string")
    got = {r.category: (r.original_count, r.direct_matches, r.protection_rate) for r in P.protection_rates(df, "k", "o", "s").collect()}
    assert got["Names"] == (2, 1, 50.0) and got["Patient IDs"] == (1, 0, 100.0) and got["Ages"] == (0, 0, 100.0)
    assert P.comparison_rows(df, "k", "o", "s").count() == 2


ODD_TEXTS = [
    "signed: Mavaick Brünnock\nLaboratory", "éAnn Bell", "Ann Bellé Ann Bell", "naïveMRN 5", "é12345é", "ü555-123-4567", "Ann\x0bBell", "Ann\u00a0Bell, Ann \t Bell",
    "Éage 30 years", "a@b.org", "éa@b.orgé", "12 Oak Streetß", "x\u0301Ann Bell", "Ann Bell\u0301", "日本Ann Bell日本", None, ""
]


def sql_rows(spark, name, texts):
    """(rows of Spark, rows of SQL) of a query of the records over these texts."""
    import tempfile

    import duckdb
    from medlattice.plans.reference import ORACLE, QUERIES

    with tempfile.TemporaryDirectory() as d:
        rows = [(f"r{i:03}", "s", t, t) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "record_id string, specialty string, content string, description string").write.parquet(f"{d}/records.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW records AS SELECT * FROM read_parquet('{d}/records.parquet/*.parquet')")
        return sorted(tuple(r) for r in QUERIES[name](spark, d).collect()), sorted(con.execute(ORACLE[name]).fetchall())


def test_counts_by_type_have_the_boundaries_of_sql(spark):
    got, told = sql_rows(spark, "pv2b_record_counts_by_type", ODD_TEXTS)
    assert got == told and sum(n for _, n, _ in got) > 10


def test_redaction_of_records_has_the_boundaries_of_sql(spark):
    for name in ("pv3_record_redact_strict", "pv3_record_redact_minimal", "pv3_redact_records"):
        got, told = sql_rows(spark, name, ODD_TEXTS)
        assert got == told and len(got) == len(ODD_TEXTS)


def test_metrics_of_records_have_the_boundaries_of_sql(spark):
    (got,), (told,) = sql_rows(spark, "e6_record_metrics", [*ODD_TEXTS, "écancer", "aspirin", "naïve insulin"])
    assert all(abs(x - float(y)) < 2e-6 for x, y in zip(got, told)) and got[3] > 0


def test_scores_by_specialty_have_the_boundaries_of_sql(spark):
    (got,), (told,) = sql_rows(spark, "e2_e5_record_scores_by_specialty", [*ODD_TEXTS, "écancer", "aspirin", "naïve insulin"])
    assert got[0] == told[0] and all(abs(x - float(y)) < 2e-6 for x, y in zip(got[1:], told[1:])) and got[4] > 0
