"""One query per operator, over whole tables. Names: the operator's id, pv for privacy, then what it does."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import sequence_ratio
from ..operators import answer as G
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import privacy as P
from ..operators import retrieval as R
from ..operators import shaping as D
from ..pipeline import run_pipeline
from ..session import materialise, spread, table
from ..sources import readers as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _in(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Clinical sentences derived from customers in the same way in Spark and SQL, so that every pattern has hits.
_VOCABULARY = (
    "acute pain", "Lung cancer", "Viral infection", "chronic asthma", "Crohn disease", "Zinc deficiency", "HTN and COPD", "T2DM with CHF", "diabetes",
    "Hepatitis virus"
)
_DRUGS = ("aspirin", "metformin", "insulin", "lisinopril")
_CLINIC = f"""(SELECT c_custkey AS k, c_mktsegment AS grp, concat(
    'Patient #', c_custkey, ' was seen on ', c_custkey % 12 + 1, '/', c_custkey % 28 + 1, '/2020 by John Smith for ', {_in(_VOCABULARY)}[CAST(c_custkey % 10 + 1 AS INT)],
    '. MRN ', c_custkey, ' lives at ', c_custkey % 900 + 1, ' Maple Street. Studies show ', {_in(_DRUGS)}[CAST(c_custkey % 4 + 1 AS INT)],
    ' therapy is effective for treating hypertension. Call 555-', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'),
    ' or user', c_custkey, '@example.com. SSN ', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '-12-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'),
    '. Age was ', c_custkey % 90 + 1, ' years.') AS text FROM customer)"""


def clinic(spark: SparkSession, d: str) -> DataFrame:
    """k, grp, text of the derived sentences."""
    k = F.col("c_custkey")
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    parts = [
        "Patient #", k, " was seen on ", k % 12 + 1, "/", k % 28 + 1, "/2020 by John Smith for ", pick(_VOCABULARY, 10), ". MRN ", k, " lives at ",
        k % 900 + 1, " Maple Street. Studies show ", pick(_DRUGS, 4), " therapy is effective for treating hypertension. Call 555-", pad(k % 1000, 3),
        "-", pad(k % 10000, 4), " or user", k, "@example.com. SSN ", pad(k % 1000, 3), "-12-", pad(k % 10000, 4), ". Age was ", k % 90 + 1, " years."
    ]
    return table(spark, d, "customer").select(
        k.alias("k"), F.col("c_mktsegment").alias("grp"),
        F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("text")
    )


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_sql_text(pattern)}, {group})"


def _redact_sql(text: str, level: str) -> str:
    out, hits = text, []
    for t, p in P.patterns(level):
        found = _all(text, p)
        out = f"list_reduce({found}, lambda a, x: replace(a, x, '[REDACTED {t.upper()}]'), {out})"
        hits.append(f"len({found})")
    return f"CASE WHEN {' + '.join(hits)} > 0 AND contains({out}, '[REDACTED') THEN {out} || {_sql_text(P.REDACTION_NOTE)} ELSE {out} END"


# --- privacy -------------------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT record_id, '{t}' AS pii_type, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS instance FROM (SELECT record_id, {_all('content', p)} AS m FROM records)" for t, p in P.patterns("standard")))
def pv2_detect_records(spark, d):
    return P.detected_rows(table(spark, d, "records"), "record_id", "content", "standard")


@query(" UNION ALL ".join(f"SELECT '{t}' AS pii_type, CAST(coalesce(sum(len({_all('text', p)})), 0) AS BIGINT) AS matches, count(*) FILTER (len({_all('text', p)}) > 0) AS texts FROM {_CLINIC}" for t, p in P.patterns("strict")))
def pv2b_counts_by_type(spark, d):
    return P.counts_by_type(clinic(spark, d), "text", as_sql=True)


def _redact_query(level: str):
    def run(spark, d):
        return spread(clinic(spark, d)).select("k", P.redact(F.col("text"), level, as_sql=True).alias("redacted"))

    run.__name__ = f"pv3_redact_{level}"
    query(f"SELECT k, {_redact_sql('text', level)} AS redacted FROM {_CLINIC}")(run)


for _level in ("minimal", "standard", "strict"):
    _redact_query(_level)


@query(f"SELECT record_id, {_redact_sql('content', 'standard')} AS redacted FROM records")
def pv3_redact_records(spark, d):
    return spread(table(spark, d, "records").select("record_id", "content")).select("record_id", P.redact(F.col("content"), "standard", as_sql=True).alias("redacted"))


@query(f"SELECT k, list_filter(['PHONE_NUMBER', 'EMAIL_ADDRESS'], lambda x: CASE WHEN x = 'PHONE_NUMBER' THEN regexp_matches(text, {_sql_text(P.PII_PATTERNS[1][1])}) ELSE regexp_matches(text, {_sql_text(P.PII_PATTERNS[0][1])}) END) AS types FROM {_CLINIC}")
def pv4_assessment_types(spark, d):
    return clinic(spark, d).select("k", P.assessment_types(F.col("text")).alias("types"))


@query()
def pv5_similarity(spark, d):
    return clinic(spark, d).select("k", F.round(sequence_ratio("text", P.redact(F.col("text"), "standard")), 6).alias("ratio"))


_REPLY = "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Yes, safe' ELSE 'No' END, chr(10), '2. Concerns: dates - place ', o_orderkey, chr(10), '3. Fix: drop it', chr(10), '4. Overall RISK LEVEL is ', ['Low','medium','HIGH','none'][CAST(o_orderkey % 4 + 1 AS INT)])"


@query(f"SELECT o_orderkey, o_orderkey % 2 = 0 AS is_safe, ['dates', 'place ' || o_orderkey, 'drop it'] AS feedback, ['low','medium','high','medium'][CAST(o_orderkey % 4 + 1 AS INT)] AS risk_level FROM orders WHERE {_REPLY} IS NOT NULL")
def pv6_parse_assessment(spark, d):
    k = F.col("o_orderkey")
    reply = F.concat(
        F.when(k % 2 == 0, "Yes, safe").otherwise("No"), F.lit("\n2. Concerns: dates - place "), k.cast("string"),
        F.lit("\n3. Fix: drop it\n4. Overall RISK LEVEL is "),
        F.element_at(F.array(*map(F.lit, ("Low", "medium", "HIGH", "none"))), (k % 4 + 1).cast("int"))
    )
    return table(spark, d, "orders").select("o_orderkey", P.parse_assessment(reply).alias("r")).select("o_orderkey", "r.*")


@query("SELECT k, CASE WHEN k % 2 = 0 THEN ['Symptoms', 'Site ' || k, 'Treatment', 'Medical History', 'Lab Results', 'Medications'] ELSE ['Symptoms', 'Diagnosis', 'Treatment', 'Medical History', 'Lab Results', 'Medications'] END AS names FROM (SELECT c_custkey AS k FROM customer)")
def pv7_attribute_names(spark, d):
    reply = F.concat(
        F.lit("1. Symptoms: x"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("\n2. Site "), F.col("k").cast("string"), F.lit(" - y"))).otherwise("")
    )
    return clinic(spark, d).select("k", P.parse_attribute_names(reply).alias("names"))


@query("SELECT c_custkey AS k, 'cough ' || c_custkey AS symptoms, 'rest' || chr(10) || 'at home' AS treatment, 'Not mentioned' AS diagnosis FROM customer")
def pv8_attribute_values(spark, d):
    reply = F.concat(F.lit("- Symptoms: cough "), F.col("k").cast("string"), F.lit("\n- Treatment: rest\nat home"))
    values = P.parse_attribute_values(reply, ("Symptoms", "Treatment", "Diagnosis"))
    return clinic(spark, d).select("k", values["Symptoms"].alias("symptoms"), values["Treatment"].alias("treatment"), values["Diagnosis"].alias("diagnosis"))


def _refined(spark, d):
    rules = P.RuleBackend()
    return P.refine_documents(spread(clinic(spark, d)), "k", "text", rules, rules, rules)


_STANDARD = P.patterns("standard")


def _step_sql(x: str) -> str:
    """One rewrite of the rule backend: the first type that is found loses its matches."""
    cases = " ".join(f"WHEN regexp_matches({x}, {_sql_text(p)}) THEN regexp_replace({x}, {_sql_text(p)}, '[{t}]', 'g')" for t, p in _STANDARD)
    return f"CASE {cases} ELSE {x} END"


def _unsafe_sql(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_sql_text(p)})" for _, p in _STANDARD) + ")"


def _refined_sql(rows: str) -> str:
    """k, text, the text after up to three rewrites (s3), whether an assessment found it safe, and the rewrites."""
    first = f"SELECT k, text, text AS s0, {_step_sql('text')} AS s1 FROM {rows} WHERE text IS NOT NULL"
    third = f"SELECT *, {_step_sql('s2')} AS s3 FROM (SELECT *, {_step_sql('s1')} AS s2 FROM ({first}))"
    open_ = [_unsafe_sql(f"s{i}") for i in range(3)]
    return f"(SELECT *, NOT ({' AND '.join(open_)}) AS safe, " + " + ".join(
        f"({' AND '.join(open_[: i + 1])})::INT" for i in range(3)
    ) + f" AS rewrites FROM ({third}))"


def _summary_sql(rows: str) -> str:
    mean = lambda x, n: f"round(coalesce(avg({x}), 0), 6)::DOUBLE AS {n}"
    return f"SELECT count(*) AS total_documents, count(*) FILTER (safe) AS safe_documents, {mean('rewrites', 'avg_iterations')}, {mean('length(text)', 'avg_original_length')}, {mean('length(s3)', 'avg_synthetic_length')} FROM {_refined_sql(rows)}"


@query(f"SELECT CAST(k AS VARCHAR) AS document_id, safe AS is_safe, rewrites AS iterations_required, s3 AS final_synthetic_data FROM {_refined_sql(_CLINIC)}")
def pv12_refine(spark, d):
    return _refined(spark, d).select("document_id", "is_safe", "iterations_required", "final_synthetic_data")


@query(_summary_sql(_CLINIC))
def pv13_summary(spark, d):
    return P.refinement_summary(_refined(spark, d))


def _pairs(spark, d):
    return clinic(spark, d).withColumn("synthetic", P.rule_synthetic(F.col("text")))


_HALF = "CASE WHEN k % 2 = 0 THEN text ELSE 'nothing' END"


@query(" UNION ALL ".join(f"SELECT k, '{n}' AS category, len(o) AS original_count, len(s) AS synthetic_count, len(list_distinct(list_intersect(o, s))) AS direct_matches, CASE WHEN len(o) = 0 THEN 100.0 ELSE (1 - len(list_distinct(list_intersect(o, s))) / len(o)) * 100 END::DOUBLE AS protection_rate FROM (SELECT k, {_all('text', p)} AS o, {_all(_HALF, p)} AS s FROM {_CLINIC})" for n, p in P.COMPARED_PATTERNS))
def pv14_protection(spark, d):
    return P.protection_rates(clinic(spark, d).withColumn("s", F.when(F.col("k") % 2 == 0, F.col("text")).otherwise("nothing")), "k", "text", "s")


def _general_sql(x: str) -> str:
    for pattern, general in P.GENERAL_RULES:
        x = f"regexp_replace({x}, {_sql_text(pattern)}, '{general}', 'g')"
    return x


def _comparison_sql(rows: str) -> str:
    return f"SELECT k, 'original' AS version, length(text) AS text_length FROM {rows} UNION ALL SELECT k, 'synthetic', length({_general_sql('text')}) FROM {rows}"


@query(_comparison_sql(_CLINIC))
def pv15_comparison(spark, d):
    return P.comparison_rows(_pairs(spark, d), "k", "text", "synthetic")


# --- filters and shaping -------------------------------------------------------------------------------------------

_SENSITIVE = "(" + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in P.SENSITIVE_WORDS) + ")"


@query(f"SELECT pubmed_id, coalesce({_SENSITIVE.format('abstract')}, false) AS sensitive FROM articles")
def d12_sensitive(spark, d):
    return table(spark, d, "articles").select("pubmed_id", P.is_sensitive(F.col("abstract")).alias("sensitive"))


@query(f"SELECT DISTINCT pubmed_id, CASE WHEN {_SENSITIVE.format('abstract')} THEN {_general_sql('abstract')} ELSE abstract END AS abstract, coalesce({_SENSITIVE.format('abstract')}, false) AS contains_synthetic_data FROM articles")
def d13_privatise(spark, d):
    return P.privatise(table(spark, d, "articles").select("pubmed_id", "abstract"), "abstract").distinct()


_RECORD_NO = "CAST(regexp_extract(record_id, '([0-9]+)', 1) AS INT)"


@query(f"""SELECT record_id, concat('ID: record_', lpad(CAST({_RECORD_NO} AS VARCHAR), CAST(greatest(5, length(CAST({_RECORD_NO} AS VARCHAR))) AS INT), '0'), chr(10), 'SPECIALTY: ', coalesce(specialty, 'Unknown'), chr(10), 'SAMPLE TYPE: ', coalesce(sample_type, 'Unknown'), chr(10), 'DESCRIPTION: ', coalesce(description, 'Unknown'), chr(10), chr(10), 'CONTENT:', chr(10), regexp_replace(content, '\\n\\s*\\n', chr(10) || chr(10), 'g'), chr(10), chr(10), 'KEYWORDS: ', coalesce(keywords, ''), chr(10)) AS text
    FROM records WHERE regexp_matches(content, '\\S')""")
def d1_record_text(spark, d):
    r = table(spark, d, "records")
    no = F.regexp_extract("record_id", "([0-9]+)", 1).cast("int")
    return r.select(
        "record_id",
        D.record_text(no, F.col("specialty"), F.col("sample_type"), F.col("description"), F.col("content"), F.col("keywords")).alias("text")
    ).where("text is not null")


@query("""SELECT question_id, CASE t WHEN 'yesno' THEN CASE WHEN exact_answer IS NULL THEN 'No' ELSE 'Yes' END WHEN 'factoid' THEN coalesce(exact_answer, '') WHEN 'list' THEN coalesce(exact_answer, '') END AS exact_answer, coalesce(ideal_answer, '') AS ideal_answer
    FROM (SELECT *, regexp_replace(lower(question_type), '[^a-z]', '', 'g') AS t FROM questions)""")
def d2_normalise_questions(spark, d):
    q = table(spark, d, "questions")
    kind = F.regexp_replace(F.lower("question_type"), "[^a-z]", "")
    raw = q.select(
        F.col("question_id").alias("id"), kind.alias("type"), F.col("question").alias("body"),
        F.when(F.col("ideal_answer").isNotNull(), F.array("ideal_answer")).otherwise(F.array().cast("array<string>")).alias("ideal_answer"),
        F.when(
            F.col("exact_answer").isNotNull(), F.array(F.split("exact_answer", ", "))
        ).otherwise(F.array().cast("array<array<string>>")).alias("exact_answer"),
        "documents", "snippets", "concepts"
    )
    return D.normalise_questions(raw).select(F.col("id").alias("question_id"), "exact_answer", "ideal_answer")


_DOCS_SPLIT = "(SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'test' END AS split_name FROM documents)"


@query(f"SELECT doc_id, split_name FROM {_DOCS_SPLIT}")
def d3_split(spark, d):
    return D.split_by_share(table(spark, d, "documents").select("doc_id"), "doc_id", 0.9)


@query(f"SELECT lang AS type, count(*) AS total, count(*) FILTER (split_name = 'train') AS train_count, count(*) FILTER (split_name = 'test') AS test_count FROM {_DOCS_SPLIT} GROUP BY lang")
def d4_split_stats(spark, d):
    return D.split_stats(D.split_by_share(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0.9), "lang")


@query("SELECT 'q' || l_orderkey || '-' || l_linenumber AS id, 'part ' || l_partkey AS question, 'order ' || l_orderkey AS context, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END AS answer, 'BioASQ' AS source FROM lineitem")
def d5_squad(spark, d):
    qas = F.struct(
        F.concat(F.lit("q"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.concat(F.lit("part "), "l_partkey").alias("question"),
        F.when(
            F.col("l_linenumber") % 2 == 0, F.array().cast("array<struct<text string>>")
        ).otherwise(F.array(F.struct(F.col("l_returnflag").alias("text")))).alias("answers")
    )
    nested = table(spark, d, "lineitem").select(
        F.array(
            F.struct(F.array(F.struct(F.concat(F.lit("order "), "l_orderkey").alias("context"), F.array(qas).alias("qas"))).alias("paragraphs"))
        ).alias("data")
    )
    return D.flatten_squad(nested)


def _pubmedqa(spark, d):
    k = F.col("c_custkey")
    items = table(spark, d, "customer").select(
        k.cast("string").alias("pmid"), F.concat(F.lit("Is "), "c_name", F.lit(" well?")).alias("QUESTION"),
        F.array(F.lit("a"), F.col("c_mktsegment")).alias("CONTEXTS"),
        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.col("c_name")).alias("LONG_ANSWER"),
        F.element_at(F.array(*map(F.lit, ("yes", "no", "maybe", "other"))), (k % 4 + 1).cast("int")).alias("final_decision"),
        F.lit("2020").alias("PUBDATE"), F.lit(None).cast("string").alias("JOURNAL")
    )
    truth = table(spark, d, "customer").where(k % 5 == 0).select(k.cast("string").alias("pmid"), F.col("c_mktsegment").alias("answer"))
    return D.pubmedqa_pairs(items, truth)


_PUBMEDQA = """(SELECT 'pubmedqa_' || c_custkey AS id, 'Is ' || c_name || ' well?' AS question, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name
    ELSE ['Yes. ', 'No. ', 'Maybe. ', ''][CAST(c_custkey % 4 + 1 AS INT)] || 'a ' || c_mktsegment END AS answer, ['yes', 'no', 'maybe', 'other'][CAST(c_custkey % 4 + 1 AS INT)] AS label FROM customer)"""


@query(f"SELECT id, question, answer, label FROM {_PUBMEDQA}")
def d6_pubmedqa(spark, d):
    return _pubmedqa(spark, d).select("id", "question", "answer", "metadata.label")


def _medqa(spark, d):
    items = table(spark, d, "part").select(
        (F.col("p_partkey") - 1).alias("n"), F.col("p_name").alias("question"), F.col("p_type").alias("answer"),
        F.create_map(F.lit("B"), F.col("p_brand"), F.lit("A"), F.col("p_type")).alias("options"), F.lit("A").alias("answer_idx"),
        F.lit(None).cast("string").alias("meta_info")
    )
    return D.medqa_pairs(items, "n")


@query("SELECT 'medqa_' || (p_partkey - 1) AS id, p_name AS question, p_type AS answer, [p_type, p_brand] AS options FROM part")
def d7_medqa(spark, d):
    return _medqa(spark, d).select("id", "question", "answer", "metadata.options")


@query("SELECT 'medqa_' || (p_partkey - 1) AS id, 'Answer the following medical question with a concise and accurate response:' AS instruction, p_name AS input, p_type AS output FROM part")
def d8_instructions(spark, d):
    return D.instruction_rows(_medqa(spark, d), "medqa")


_BALANCED = """(SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS r FROM customer)
    WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)))"""


@query(f"""SELECT c_mktsegment, c_custkey, CASE WHEN n > 10 THEN CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END END AS split_name
    FROM (SELECT *, row_number() OVER (ORDER BY md5('43|' || c_mktsegment || '|' || c_custkey)) AS r, count(*) OVER () AS n FROM {_BALANCED})""")
def d9_balance(spark, d):
    return D.combine_balanced(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey")


def _comprehensive(spark, d):
    b = table(spark, d, "questions").select(
        F.col("question_id").alias("id"), F.col("question_type").alias("type"), "question", F.col("ideal_answer").alias("answer")
    )
    return D.comprehensive(b, _pubmedqa(spark, d), _medqa(spark, d))


_COMPREHENSIVE = f"""(SELECT question_id AS id, question_type AS type, question, ideal_answer AS answer, 'bioasq' AS source FROM questions
    UNION ALL (SELECT id, 'yesno', question, answer, 'pubmedqa' FROM {_PUBMEDQA} ORDER BY md5('42|' || id), id LIMIT 100)
    UNION ALL (SELECT 'medqa_' || (p_partkey - 1) AS id, 'factoid', p_name, p_type, 'medqa' FROM part ORDER BY md5('42|' || 'medqa_' || (p_partkey - 1)), id LIMIT 100))"""


@query(f"SELECT * FROM {_COMPREHENSIVE}")
def d10_comprehensive(spark, d):
    return _comprehensive(spark, d)


@query(f"SELECT source, count(*) AS questions FROM {_COMPREHENSIVE} GROUP BY source")
def d11_benchmark_stats(spark, d):
    return D.benchmark_stats(_comprehensive(spark, d))


@query("SELECT pubmed_id, coalesce(journal, 'Unknown') AS journal, coalesce(pub_year, 'n.d.') AS pub_year FROM articles")
def d14_defaults(spark, d):
    return D.with_defaults(table(spark, d, "articles").select("pubmed_id", "journal", "pub_year"), {"journal": "Unknown", "pub_year": "n.d."})


def _unit_sql(name: str) -> str:
    return f"(('0x' || substr(md5('1|' || i || '|{name}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_CASE_VALUES = " || ', ' || ".join(
    [f"'Age=' || floor({D.AGE_RANGE[0]} + {_unit_sql('Age')} * {D.AGE_RANGE[1] - D.AGE_RANGE[0] + 1})::BIGINT", f"'Gender=' || CASE WHEN {_unit_sql('Gender')} < 0.5 THEN 'M' ELSE 'F' END"]
    + [f"'{m}=' || round({lo} + {_unit_sql(m)} * {hi - lo}, 1)::VARCHAR" for m, lo, hi in D.MEASURES])


@query(f"""SELECT 'patient_' || lpad(i::VARCHAR, 5, '0') AS patient_id, CASE WHEN {_unit_sql('outcome')} < 0.8 THEN 'survived' ELSE 'deceased' END AS outcome,
    floor(1 + {_unit_sql('stay')} * 30)::INT AS length_of_stay, {_CASE_VALUES} AS measurements FROM range(1000) t(i)""")
def d16_synthetic_cases(spark, d):
    told = F.array_join(F.transform("all_measurements", lambda x: F.concat(x["variable"], F.lit("="), x["value"])), ", ")
    return D.synthetic_cases(spark, 1000).select("patient_id", "outcome", "length_of_stay", told.alias("measurements"))


@query("""SELECT c_custkey, concat('Patient admitted to ICU. ', CASE c_custkey % 4 WHEN 0 THEN 'The patient is a ' || (c_custkey % 70 + 20) || '-year-old male. ' WHEN 1 THEN 'The patient is ' || (c_custkey % 70 + 20) || ' years old. ' WHEN 2 THEN 'The patient is female. ' ELSE '' END,
    'Vital signs: Heart Rate is ', c_custkey % 50 + 60, '. ', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Laboratory findings: Glucose is ' || (c_custkey % 3) || '. ' END, 'Patient outcome: survived. Length of stay: ', c_custkey % 9, ' days.') AS narrative FROM customer""")
def d17_narrative(spark, d):
    k = F.col("c_custkey")
    item = lambda n, v: F.struct(F.lit(n).alias("variable"), v.cast("string").alias("value"))
    demo = F.array(item("Age", F.when((k % 4).isin(0, 1), k % 70 + 20)), item("Gender", F.when(k % 4 == 0, "M").when(k % 4 == 2, "F")))
    cases = table(spark, d, "customer").select(
        "c_custkey", demo.alias("demographics"), F.array(item("Heart Rate", k % 50 + 60)).alias("vitals"),
        F.array(item("Glucose", k % 3)).alias("labs"), F.lit("survived").alias("outcome"), (k % 9).alias("length_of_stay")
    )
    return cases.select("c_custkey", D.narrative().alias("narrative"))


# --- sources -------------------------------------------------------------------------------------------------------


def _escaped(c):
    """A text as XML content. A bare carriage return would be read as a line end; other control characters have no form in XML and are left out."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


@query("SELECT DISTINCT coalesce(pubmed_id, '') AS pubmed_id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, coalesce(journal, '') AS journal, coalesce(pub_year, '') AS year, coalesce(authors[1], '') AS first_author FROM articles")
def s7_parse_articles(spark, d):
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), _escaped(F.col(c)), F.lit(f"</{t}>"))
    authors = F.array_join(
        F.transform(
            F.coalesce("authors", F.array().cast("array<string>")),
            lambda x: F.concat(F.lit("<Author><LastName>"), _escaped(x), F.lit("</LastName></Author>"))
        ),
        ""
    )
    xml = table(spark, d, "articles").select(
        F.concat(
            F.lit("<PubmedArticle>"), tag("PMID", "pubmed_id"), tag("ArticleTitle", "title"), tag("AbstractText", "abstract"),
            F.lit("<AbstractText>second</AbstractText><Journal>"), tag("Title", "journal"), F.lit("</Journal><PubDate>"), tag("Year", "pub_year"),
            F.lit("</PubDate><AuthorList>"), authors, F.lit("</AuthorList></PubmedArticle>")
        ).alias("x")
    )
    return S.parse_articles(xml, "x").select(
        "pubmed_id", "title", "abstract", "journal", "year", F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("first_author")
    ).distinct()


_CITED = "(SELECT DISTINCT regexp_extract(x, '([0-9]+)$', 1) AS pubmed_id FROM (SELECT unnest(documents) AS x FROM questions))"


@query(f"SELECT pubmed_id, title FROM articles WHERE pubmed_id IN (SELECT pubmed_id FROM {_CITED})")
def s8_fetch_articles(spark, d):
    ids = table(spark, d, "questions").select(F.explode("documents").alias("x")).select(F.regexp_extract("x", "([0-9]+)$", 1).alias("pubmed_id"))
    return S.fetch_articles(ids, table(spark, d, "articles")).select("pubmed_id", "title")


@query("SELECT nct_id, coalesce(title, '') AS title, coalesce(status, '') AS status, coalesce(len(phase), 0) AS phases, coalesce(len(interventions), 0) AS interventions, coalesce(brief_summary, '') AS brief_summary FROM trials WHERE nct_id IS NOT NULL")
def s9_parse_trials(spark, d):
    t = table(spark, d, "trials").where("nct_id is not null")
    study = F.struct(
        F.struct(F.col("status").alias("OverallStatus")).alias("StatusModule"),
        F.struct(
            F.struct(F.col("nct_id").alias("NCTId"), F.col("title").alias("BriefTitle")).alias("IdentificationModule"),
            F.struct(F.struct(F.col("phase").alias("Phase")).alias("PhaseList")).alias("DesignModule"),
            F.struct(
                F.struct(
                    F.transform(
                        "interventions",
                        lambda x: F.struct(x["intervention_type"].alias("InterventionType"), x["intervention_name"].alias("InterventionName"))
                    ).alias("Intervention")
                ).alias("InterventionList")
            ).alias("ArmsInterventionsModule"),
            F.struct(F.col("brief_summary").alias("BriefSummary")).alias("DescriptionModule")
        ).alias("ProtocolSection")
    )
    reply = F.to_json(F.struct(F.struct(F.array(F.struct(study.alias("Study"))).alias("FullStudies")).alias("FullStudiesResponse")))
    return S.parse_trials(t.select(reply.alias("reply")), "reply").select(
        "nct_id", "title", "status", F.size("phase").alias("phases"), F.size("interventions").alias("interventions"), "brief_summary"
    )


@query("SELECT nct_id, title FROM trials WHERE nct_id = (SELECT max(nct_id) FROM trials) LIMIT 1")
def s10_trial_by_id(spark, d):
    t = table(spark, d, "trials")
    return S.trial_by_id(t, t.agg(F.max("nct_id")).first()[0] or "").select("nct_id", "title")


_SEARCHED = ("diabetes treatment", "heart failure in older adults", "asthma", "a word that nothing holds qzx")
_SEARCHED_WORDS = " UNION ALL ".join(f"SELECT '{t}' AS query, '{w}' AS word" for t in _SEARCHED for w in dict.fromkeys(t.lower().split()))


@query(f"""SELECT pmid, title, abstract, query FROM (SELECT pmid, title, abstract, query, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, pmid) AS place
    FROM (SELECT pubmed_id AS pmid, a.title AS title, a.abstract AS abstract, unnest(list_distinct(regexp_extract_all(lower(a.title || ' ' || a.abstract), '[a-z0-9]+'))) AS word FROM
        (SELECT pubmed_id, min({{'title': coalesce(title, ''), 'abstract': coalesce(abstract, '')}}) AS a FROM articles WHERE pubmed_id IS NOT NULL GROUP BY pubmed_id)) JOIN ({_SEARCHED_WORDS}) USING (word)
    GROUP BY pmid, title, abstract, query) WHERE place <= 100""")
def s13_bulk_download(spark, d):
    return S.bulk_download(list(_SEARCHED), table(spark, d, "articles"))


@query("SELECT response_id, 'query_' || regexp_replace(query_text, '[^\\p{L}\\p{N}]', '_', 'g') || '_5' AS cache_key FROM responses")
def s11_cache_key(spark, d):
    return table(spark, d, "responses").select("response_id", S.cache_key(F.col("query_text"), F.lit(5)).alias("cache_key"))


def _asked(spark, d):
    return table(spark, d, "questions").select("question_id", "question").where("question is not null").distinct()


_ASKED = "(SELECT DISTINCT question_id, question FROM questions WHERE question IS NOT NULL)"
_MOCK = f"""(SELECT question_id, i AS rank, CAST(30000000 + i AS VARCHAR) AS pmid, 'Recent advances in ' || regexp_extract(question, '(\\S+)', 1) || ' research' AS title,
    'This is a simulated abstract about ' || question || '. It contains information about treatments, diagnoses, and patient outcomes. The research was conducted at Major Medical Center with 50 participants. Results show promising outcomes for patients with various conditions.' AS abstract,
    CAST(2020 + i % 5 AS VARCHAR) AS year, 'Smith J, Johnson A, Williams B' AS authors, 'Journal of Medical Research' AS journal FROM {_ASKED}, range(5) t(i))"""


@query(f"SELECT * FROM {_MOCK}")
def s14_mock_source(spark, d):
    return S.mock_articles(_asked(spark, d), 5)


@query(f"""SELECT question_id, i AS rank, 'MOCK' || (i + 1) AS pmid, 'Research on ' || upper(left(question, 1)) || lower(question[2:]) || ' - Study ' || (i + 1) AS title,
    'This is a mock abstract for testing purposes. It discusses ' || question || ' and related medical concepts. Some studies show promising results for patients with this condition. Treatment options vary depending on patient characteristics.' AS abstract,
    CAST(2020 + i % 5 AS VARCHAR) AS year, 'Mock Author A, Mock Author B' AS authors, 'Journal of Mock Medical Research' AS journal FROM {_ASKED}, range(3) t(i)""")
def s15_fallback_source(spark, d):
    return S.fallback_articles(_asked(spark, d), 3)


# --- retrieval -----------------------------------------------------------------------------------------------------

_KNN = """(SELECT query_id, item_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 9) AS distance
    FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e))"""


def _knn(spark, d, k=5):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    return R.nearest(e, e.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), k)


@query(f"SELECT query_id, item_id, round(distance, 6) AS distance, rank FROM {_KNN} WHERE rank <= 5")
def r3_knn(spark, d):
    return _knn(spark, d).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 7 = 0")
def r4_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    changes = e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(
        e.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1000000)
    )
    return R.upsert(e, changes, "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0")
def r5_delete(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return R.delete(e, e.where("vec_id % 3 = 0"), "vec_id")


@query(f"SELECT query_id, item_id, round(1 - least(distance / 10, 0.99), 6) AS score FROM {_KNN} WHERE rank <= 5")
def r6_score(spark, d):
    return _knn(spark, d).select("query_id", "item_id", F.round(R.distance_score(F.col("distance")), 6).alias("score"))


def _fused(spark, d):
    local = _knn(spark, d, 3).select(
        "query_id", F.concat(F.lit("v"), "item_id").alias("doc_id"), F.concat(F.lit("vector "), "item_id", F.lit("\nrow")).alias("document"),
        "distance", F.col("rank").alias("source_rank")
    )
    q = local.select("query_id").distinct()
    other = lambda name, k: q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("source_rank")).select(
        "query_id", F.concat(F.lit(name), "source_rank").alias("doc_id"), F.concat(F.lit(f"{name} "), "query_id", F.lit("\nrow")).alias("document"),
        "source_rank"
    )
    return R.fuse(local, {"pubmed": other("a", 2), "clinical_trials": other("t", 2)}, 5)


_FUSED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, source_rank) AS rank FROM (
    SELECT query_id, 0 AS o, 'local' AS source, 'v' || item_id AS doc_id, 'vector ' || item_id || chr(10) || 'row' AS document, 1 - least(distance / 10, 0.99) AS score, rank AS source_rank FROM {_KNN} WHERE rank <= 3
    UNION ALL SELECT vec_id, 1, 'pubmed', 'a' || i, 'a ' || vec_id || chr(10) || 'row', 0.85, i FROM embeddings, range(1, 3) t(i) WHERE vec_id % 50 = 0
    UNION ALL SELECT vec_id, 2, 'clinical_trials', 't' || i, 't ' || vec_id || chr(10) || 'row', 0.80, i FROM embeddings, range(1, 3) t(i) WHERE vec_id % 50 = 0)) WHERE rank <= 5)"""


@query(f"SELECT query_id, source, doc_id, round(score, 6) AS score, rank FROM {_FUSED}")
def r7_hybrid_fusion(spark, d):
    return _fused(spark, d).select("query_id", "source", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, string_agg('[' || CASE source WHEN 'local' THEN 'Synthetic Medical Record' WHEN 'pubmed' THEN 'PubMed Article' ELSE 'Clinical Trial' END || ' ' || rank || ']' || chr(10) || document || chr(10), chr(10) ORDER BY rank) AS context FROM {_FUSED} GROUP BY query_id")
def r10_context(spark, d):
    return R.context_text(_fused(spark, d))


@query(f"SELECT query_id, source AS source_type, split_part(document, chr(10), 1) AS title, doc_id AS id, round(score, 6) AS score FROM {_FUSED}")
def d15_source_list(spark, d):
    return D.source_list(_fused(spark, d)).withColumn("score", F.round("score", 6))


@query("SELECT pubmed_id, concat('Title: ', coalesce(title, ''), chr(10), 'Authors: ', coalesce(array_to_string(authors, ', '), ''), chr(10), 'Journal: ', coalesce(journal, ''), ' (', coalesce(pub_year, ''), ')', chr(10), 'PubMed ID: ', coalesce(pubmed_id, ''), chr(10), chr(10), 'Abstract:', chr(10), coalesce(abstract, ''), chr(10)) AS text FROM articles")
def r11_article_text(spark, d):
    return table(spark, d, "articles").select("pubmed_id", R.article_text().alias("text"))


@query("""SELECT nct_id, concat('Title: ', coalesce(title, ''), chr(10), 'NCT ID: ', coalesce(nct_id, ''), chr(10), 'Status: ', coalesce(status, ''), chr(10), 'Phase: ', coalesce(array_to_string(phase, ', '), ''), chr(10), chr(10), 'Conditions: ', coalesce(array_to_string(conditions, ', '), ''), chr(10), chr(10),
    'Interventions:', chr(10), coalesce(array_to_string(list_transform(interventions, lambda x: '- ' || coalesce(x.intervention_type, '') || ': ' || coalesce(x.intervention_name, '')), chr(10)), ''), chr(10), chr(10), 'Brief Summary:', chr(10), coalesce(brief_summary, ''), chr(10), chr(10), 'Detailed Description:', chr(10), coalesce(detailed_description, ''), chr(10), chr(10), 'Eligibility Criteria:', chr(10), coalesce(eligibility_criteria, ''), chr(10)) AS text FROM trials""")
def r12_trial_text(spark, d):
    return table(spark, d, "trials").select("nct_id", R.trial_text().alias("text"))


_EXPAND = "question"
for _t, _x in R.QUERY_TERMS:
    _EXPAND = f"CASE WHEN contains(lower(question), '{_t}') THEN replace({_EXPAND}, '{_t}', '({_x})') ELSE {_EXPAND} END"


@query(f"SELECT question_id, {_EXPAND} AS term FROM {_ASKED}")
def r13_expand_query(spark, d):
    return S.search_terms(_asked(spark, d))


_ANSWERED = "(length(question_id) % 2 = 0 OR right(question_id, 1) IN ('0', '2', '4', '6', '8'))"


@query(f"SELECT question_id, rank, title FROM {_MOCK} WHERE {_ANSWERED} UNION ALL SELECT question_id, i, 'Research on ' || upper(left(question, 1)) || lower(question[2:]) || ' - Study ' || (i + 1) FROM {_ASKED}, range(3) t(i) WHERE NOT {_ANSWERED}")
def r14_failover(spark, d):
    q = _asked(spark, d)
    answered = (F.length("question_id") % 2 == 0) | F.right("question_id", F.lit(1)).isin("0", "2", "4", "6", "8")
    return R.failover(S.mock_articles(q.where(answered), 5), S.fallback_articles(q, 3), "question_id").select("question_id", "rank", "title")


_TERMS = "text"
for _t, _x in R.ABBREVIATIONS:
    _TERMS = f"regexp_replace({_TERMS}, '{_t}', '{_x}', 'g')"


@query(f"SELECT k, {_TERMS} AS text FROM {_CLINIC}")
def r15_normalise(spark, d):
    return clinic(spark, d).select("k", R.normalise_terms(F.col("text")).alias("text"))


def _section_sql(p: str) -> str:
    p = p.replace("(?is)", "")
    return f"CASE WHEN regexp_matches(abstract, {_sql_text('(?is)' + p)}) THEN regexp_replace(regexp_extract(abstract, {_sql_text('(?is)' + p)}, 1), '^\\s+|\\s+$', '', 'g') END"


@query("SELECT pubmed_id, " + ", ".join(f"{_section_sql(p)} AS {n}" for n, p in R.SECTIONS) + " FROM articles")
def r16_sections(spark, d):
    s = table(spark, d, "articles").select("pubmed_id", R.sections(F.col("abstract")).alias("s"))
    return s.select("pubmed_id", *(F.col("s")[n].alias(n) for n, _ in R.SECTIONS))


@query(f"SELECT pubmed_id, {_TERMS.replace('regexp_replace(text', 'regexp_replace(abstract')} AS abstract, {_section_sql(R.SECTIONS[3][1])} AS conclusions FROM articles")
def r17_process_documents(spark, d):
    return R.process_documents(table(spark, d, "articles"), "abstract").select("pubmed_id", "abstract", F.col("sections")["conclusions"].alias("conclusions"))


# --- answers -------------------------------------------------------------------------------------------------------


def _cited_articles(spark, d):
    """Questions with the articles they cite: question_id, question, rank, title, abstract, year, authors."""
    q = table(spark, d, "questions").where("question is not null").groupBy("question_id").agg(
        F.min(F.struct("question", "documents")).alias("m")
    ).select(
        "question_id", F.col("m.question").alias("question"), F.posexplode("m.documents").alias("rank", "x")
    )
    a = table(spark, d, "articles").groupBy("pubmed_id").agg(
        F.min(
            F.struct(
                F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"),
                F.coalesce("pub_year", F.lit("Unknown")).alias("year"), F.coalesce(F.array_join("authors", ", "), F.lit("")).alias("authors")
            )
        ).alias("a")
    )
    return q.withColumn("pubmed_id", F.regexp_extract("x", "([0-9]+)$", 1)).join(a, "pubmed_id").select("question_id", "question", "rank", "a.*")


_CITING = """(SELECT q.question_id, q.question, q.rank, a.title, a.abstract, a.year, a.authors FROM (
    SELECT question_id, m.question AS question, generate_subscripts(m.documents, 1) - 1 AS rank, regexp_extract(unnest(m.documents), '([0-9]+)$', 1) AS pubmed_id FROM (SELECT question_id, min({'question': question, 'documents': documents}) AS m FROM questions WHERE question IS NOT NULL GROUP BY question_id)) q
    JOIN (SELECT pubmed_id, a.* FROM (SELECT pubmed_id, min({'title': coalesce(title, ''), 'abstract': coalesce(abstract, ''), 'year': coalesce(pub_year, 'Unknown'), 'authors': coalesce(array_to_string(authors, ', '), '')}) AS a FROM articles GROUP BY pubmed_id)) a USING (pubmed_id))"""
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


def _relevant_sql(cited: str) -> str:
    return f"""(SELECT *, list_filter(list_transform(string_split(abstract, '. '), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '' AND len(list_filter(kw, lambda k: contains(lower(s), k))) > 0)[1:3] AS key_sentences
    FROM (SELECT *, {_WORDS.format('question')} AS kw FROM {cited}) WHERE list_has_any(kw, {_WORDS.format('title')}) OR list_has_any(kw, {_WORDS.format('abstract')}))"""


_RELEVANT = _relevant_sql(_CITING)


@query(f"SELECT question_id, rank, title, key_sentences FROM {_RELEVANT}")
def g1_relevant_sentences(spark, d):
    return G.relevant(_cited_articles(spark, d)).select("question_id", "rank", "title", "key_sentences")


def _answer_sql(info: str, questions: str, flag: str = "false") -> str:
    return f"""SELECT q.question_id, q.question, CASE WHEN p.question_id IS NULL THEN {_sql_text(G.NOT_FOUND)} || q.question ELSE {_sql_text(G.INTRO[0])} || q.question || {_sql_text(G.INTRO[1])} || said || CASE WHEN syn THEN {_sql_text(G.SYNTHETIC_NOTE)} ELSE '' END || chr(10) || 'References:' || chr(10) || cited END AS answer
    FROM {questions} q LEFT JOIN (SELECT question_id, bool_or({flag}) AS syn,
        string_agg('According to ' || authors || ' (' || year || '):' || chr(10) || coalesce(array_to_string(list_transform(key_sentences, lambda s: '- ' || s || '.' || chr(10)), ''), '') || chr(10), '' ORDER BY n) FILTER (n <= 3) AS said,
        string_agg('[' || n || '] ' || authors || ' (' || year || '). ' || title || '.' || chr(10), '' ORDER BY n) FILTER (n <= 3) AS cited
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS n FROM {info}) GROUP BY question_id) p USING (question_id)"""


_QUESTIONS = "(SELECT question_id, min(question) AS question FROM questions WHERE question IS NOT NULL GROUP BY question_id)"


@query(_answer_sql(_RELEVANT, _QUESTIONS))
def g2_answer(spark, d):
    q = table(spark, d, "questions").where("question is not null").groupBy("question_id").agg(F.min("question").alias("question"))
    return G.structured_answers(q, G.relevant(_cited_articles(spark, d)).withColumn("contains_synthetic_data", F.lit(False)))


_GENERAL = _general_sql("abstract")
_FLAG = _SENSITIVE.format("abstract")
_PRIVATE = f"""(SELECT question_id, question, rank, title, CASE WHEN {_FLAG} THEN {_GENERAL} ELSE abstract END AS abstract, year, authors, {_FLAG} AS syn FROM ({_CITING[1:-1]} UNION ALL
    SELECT question_id, question, i, 'Research on ' || upper(left(question, 1)) || lower(question[2:]) || ' - Study ' || (i + 1), 'This is a mock abstract for testing purposes. It discusses ' || question || ' and related medical concepts. Some studies show promising results for patients with this condition. Treatment options vary depending on patient characteristics.',
    CAST(2020 + i % 5 AS VARCHAR), 'Mock Author A, Mock Author B' FROM {_QUESTIONS}, range(3) t(i) WHERE question_id NOT IN (SELECT question_id FROM {_CITING})))"""


@query(f"SELECT question_id, question, {_redact_sql('a', 'standard')} AS answer FROM (SELECT question_id, question, answer AS a FROM ({_answer_sql(_relevant_sql(_PRIVATE), _QUESTIONS, 'syn')}))")
def g11_answer_question(spark, d):
    q = table(spark, d, "questions").where("question is not null").groupBy("question_id").agg(F.min("question").alias("question"))
    docs = R.failover(
        _cited_articles(spark, d).drop("question"), S.fallback_articles(q, 3).select("question_id", "rank", "title", "abstract", "year", "authors"),
        "question_id"
    )
    return G.answer_questions(q, docs)


@query(f"SELECT question_id, question, {_redact_sql('a', 'standard')} AS answer FROM (SELECT question_id, question, answer AS a FROM ({_answer_sql(_RELEVANT, _QUESTIONS)}))")
def g3_generate_answer(spark, d):
    q = table(spark, d, "questions").where("question is not null").groupBy("question_id").agg(F.min("question").alias("question"))
    return G.answer_questions(q, _cited_articles(spark, d).drop("question"), "standard", private=False)


@query("SELECT response_id, CASE WHEN regexp_matches(answer, '^\\s*$') OR answer IS NULL THEN 'I couldn''t generate a response based on the available information.' ELSE regexp_replace(answer, '^\\s+|\\s+$', '', 'g') END AS answer FROM responses WHERE query_text IS NOT NULL")
def g4_model_answer(spark, d):
    r = table(spark, d, "responses").where("query_text is not null")
    prompt = G.model_prompt(F.col("query_text"), F.coalesce("context", F.lit("")))
    return r.select("response_id", G.model_answer(F.concat(prompt, F.lit(" "), F.coalesce("answer", F.lit(""))), prompt).alias("answer"))


@query("SELECT response_id, 'This is a placeholder response for: ' || left(query_text, 50) || '...' AS reply FROM responses")
def g6_echo(spark, d):
    return table(spark, d, "responses").select("response_id", G.echo_reply(F.col("query_text")).alias("reply"))


@query(f"""SELECT question_id, 'Question: ' || question || chr(10) || chr(10) || 'Research:' || chr(10) || chr(10) || string_agg('Document ' || n || ':' || chr(10) || 'Title: ' || title || chr(10) || 'Year: ' || year || chr(10) || 'Abstract: ' || abstract || chr(10) || chr(10), '' ORDER BY n)
    || 'Answer briefly from the research and cite it as [Doc 1], [Doc 2].' || chr(10) AS prompt
    FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, title, year, abstract) AS n FROM {_CITING} WHERE rank < 3) WHERE n <= 3 GROUP BY question_id, question""")
def g7_document_prompt(spark, d):
    docs = _cited_articles(spark, d).where("rank < 3").groupBy("question_id", "question").agg(
        F.sort_array(F.collect_list(F.struct("rank", "title", "year", "abstract"))).alias("docs")
    )
    return docs.select("question_id", G.document_prompt(F.col("question"), F.col("docs")).alias("prompt"))


_LABELS = "list_transform(coalesce(sources, []), lambda s, i: {'label': '[' || upper(left(coalesce(s.source_name, ''), 1)) || lower(coalesce(s.source_name, '')[2:]) || ' ' || i || ']', 'document_id': s.document_id})"


@query(f"""SELECT response_id, list_transform(list_filter(c, lambda x: len(list_filter(l, lambda y: contains(y.label, x))) > 0), lambda x: x || '=' || coalesce(list_filter(l, lambda y: contains(y.label, x))[1].document_id, '')) AS found, list_filter(c, lambda x: len(list_filter(l, lambda y: contains(y.label, x))) = 0) AS missing,
    CASE WHEN len(c) = 0 AND len(l) > 0 THEN ['No citations found in response.'] ELSE list_transform(list_filter(c, lambda x: len(list_filter(l, lambda y: contains(y.label, x))) = 0), lambda x: 'Citation ' || x || ' does not match any context document.') END AS warnings
    FROM (SELECT response_id, {_all("coalesce(answer, '')", r'\[([^\]]+)\]', 1)} AS c, {_LABELS} AS l FROM responses)""")
def g8_citations(spark, d):
    out = G.citation_checks(table(spark, d, "responses"), "sources", "answer")
    return out.select(
        "response_id", F.transform("citations_found", lambda x: F.concat(x["citation"], F.lit("="), F.coalesce(x["document_id"], F.lit("")))).alias("found"), F.col("missing_citations").alias("missing"),
        F.col("citation_warnings").alias("warnings")
    )


_CLAIM = "(?i)" + "|".join(f"(?:{c})" for c in G.CLAIMS)


@query(f"""SELECT k, list_filter(s, lambda x: regexp_matches(x, {_sql_text(_CLAIM)}) AND len(list_filter(c, lambda y: len(list_intersect({_WORDS.format('x')}, {_WORDS.format('y')})) >= 3)) = 0) AS claims
    FROM (SELECT k, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s, regexp_split_to_array(CASE WHEN k % 2 = 0 THEN 'A study of ' || grp ELSE text END, '[.!?]+') AS c FROM {_CLINIC})""")
def g9_hallucinations(spark, d):
    rows = clinic(spark, d).withColumn("context", F.when(F.col("k") % 2 == 0, F.concat(F.lit("A study of "), "grp")).otherwise(F.col("text")))
    return G.claim_checks(rows, "text", "context").select("k", F.col("potential_hallucinations").alias("claims"))


_CITATION_WARNINGS = re.search(r"CASE WHEN len\(c\) = 0.*? END", ORACLE["g8_citations"], re.S)[0]
_OPEN_CLAIMS = re.search(r"list_filter\(s, .*?\) = 0\)(?= AS claims)", ORACLE["g9_hallucinations"], re.S)[0].replace("c, lambda y", "known, lambda y")


@query(f"""SELECT response_id, len(w) = 0 AS is_valid, w AS warnings FROM (SELECT response_id, {_CITATION_WARNINGS} || list_transform({_OPEN_CLAIMS}, lambda x: 'Potential hallucination: ' || chr(39) || x || chr(39)) AS w
    FROM (SELECT response_id, {_all("coalesce(answer, '')", r'\[([^\]]+)\]', 1)} AS c, {_LABELS} AS l, regexp_split_to_array(coalesce(context, ''), '[.!?]+') AS known,
        list_filter(list_transform(regexp_split_to_array(coalesce(answer, ''), '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM responses))""")
def g10_validate(spark, d):
    return G.validate(table(spark, d, "responses"), "answer", "context", "sources").select("response_id", "is_valid", "warnings")


# --- evaluation ----------------------------------------------------------------------------------------------------

_ENTITIES = " || ".join(_all("lower({0})", p) for p in E.ENTITY_PATTERNS)
_REFERENCE = "CASE WHEN k % 3 = 0 THEN 'aspirin therapy for diabetes' WHEN k % 3 = 1 THEN text ELSE '' END"
_SETS = f"(SELECT k, grp, text, list_distinct({_ENTITIES.format('text')}) AS g, list_distinct({_ENTITIES.format(_REFERENCE)}) AS r FROM {_CLINIC})"
_LEAKS = " + ".join(f"len({_all('text', p)})" for t, p, _ in P.PII_PATTERNS if t in E.LEAK_TYPES)


def _scored(spark, d):
    k = F.col("k")
    return clinic(spark, d).withColumn("reference", F.when(k % 3 == 0, "aspirin therapy for diabetes").when(k % 3 == 1, F.col("text")).otherwise(""))


@query(f"SELECT k, {_ENTITIES.format('text')} AS entities FROM {_CLINIC}")
def e1_entities(spark, d):
    return clinic(spark, d).select("k", E.entities(F.col("text")).alias("entities"))


_N, _M, _K = "len(g)", "len(r)", "len(list_intersect(g, r))"
_SCORES = f"""round(coalesce(avg(CASE WHEN {_N} > 0 THEN {_K} / {_N} END), 0), 6) AS precision, round(coalesce(avg(CASE WHEN {_M} > 0 THEN {_K} / {_M} END), 0), 6) AS recall,
    round(coalesce(avg(CASE WHEN {_N} > 0 AND {_M} > 0 THEN CASE WHEN {_K} = 0 THEN 0 ELSE 2.0 * ({_K} / {_N}) * ({_K} / {_M}) / ({_K} / {_N} + {_K} / {_M}) END END), 0), 6) AS f1, round(least(coalesce(avg({_LEAKS}), 0) / 10, 1.0), 6) AS pii_leakage"""


@query(f"SELECT {_SCORES} FROM {_SETS}")
def e6_metrics(spark, d):
    return E.entity_scores(_scored(spark, d), "text", "reference")


@query(f"SELECT grp, {_SCORES} FROM {_SETS} GROUP BY grp")
def e2_e5_scores_by_group(spark, d):
    return E.entity_scores(_scored(spark, d), "text", "reference", ["grp"])


@query()
def e7_text_scores(spark, d):
    q = table(spark, d, "questions").select("ideal_answer", F.coalesce(F.get("snippets", F.lit(0))["text"], F.lit("")).alias("said"))
    return E.text_scores(q.where("ideal_answer is not null"), "said", "ideal_answer")


_GRADED = """(SELECT *, CASE t WHEN 'yesno' THEN (lower(coalesce(exact_answer, '')) = 'yes') = contains(lower(a), 'yes') WHEN 'factoid' THEN contains(lower(a), lower(coalesce(exact_answer, '')))
    WHEN 'list' THEN len(list_filter(list_transform(string_split(lower(coalesce(exact_answer, '')), ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: contains(lower(a), x))) / greatest(1, len(string_split(lower(coalesce(exact_answer, '')), ','))) >= 0.5 WHEN 'summary' THEN regexp_matches(a, '\\S') ELSE false END AS ok
    FROM (SELECT question_id, exact_answer, coalesce(split_name, 'none') AS split_name, coalesce(regexp_replace(lower(question_type), '[^a-z]', '', 'g'), '') AS t, coalesce(ideal_answer, '') AS a FROM questions))"""


def _graded(spark, d):
    """Every question, answered by its ideal answer: a summary's ROUGE-L is 1 unless it is blank, which SQL can follow."""
    kind = F.coalesce(F.regexp_replace(F.lower("question_type"), "[^a-z]", ""), F.lit("")).alias("t")
    q = table(spark, d, "questions").select(
        "question_id", "exact_answer", F.coalesce("split_name", F.lit("none")).alias("split_name"), kind,
        F.coalesce("ideal_answer", F.lit("")).alias("a")
    )
    return q.withColumn("ok", E.is_correct(F.col("t"), F.col("exact_answer"), F.col("a"), F.col("a")))


@query(f"SELECT question_id, t AS type, ok FROM {_GRADED}")
def e8_score_by_type(spark, d):
    return _graded(spark, d).select("question_id", F.col("t").alias("type"), "ok")


@query(f"""SELECT level, value, count(*) AS questions, CAST(sum(ok::INT) AS BIGINT) AS correct, round(sum(ok::INT) / count(*), 6) AS accuracy FROM (
    SELECT 'overall' AS level, 'all' AS value, ok FROM {_GRADED} UNION ALL SELECT 'source', split_name, ok FROM {_GRADED} UNION ALL SELECT 'type', t, ok FROM {_GRADED}) GROUP BY level, value""")
def e10_grouping_sets(spark, d):
    return E.accuracy_sets(_graded(spark, d), "ok", "split_name", "t")


@query(f"SELECT round(avg(a), 6) AS overall_accuracy, list(split_name ORDER BY split_name) AS datasets_evaluated FROM (SELECT split_name, sum(ok::INT) / count(*) AS a FROM {_GRADED} GROUP BY split_name)")
def e9_benchmark_union(spark, d):
    return E.benchmark_union(_graded(spark, d), "split_name", "ok")


@query(" UNION ALL ".join(f"SELECT '{i}' AS id, {_sql_text(q)} AS question, {_sql_text(a)} AS reference_answer" for i, q, a in E.FALLBACK_QUESTIONS))
def e20_fallback_questions(spark, d):
    return E.fallback_questions(spark)


_FOUND_TERMS = f"(SELECT DISTINCT unnest({' || '.join(_all('text', p, g) for p, g in E.TERM_PATTERNS)}) AS term FROM {_CLINIC})"


@query(f"SELECT term FROM {_FOUND_TERMS}")
def e13_terms(spark, d):
    return E.medical_terms(clinic(spark, d), "text")


@query(" UNION ALL ".join(f"SELECT term, {i} AS template, {_sql_text(t.split('{}')[0])} || term || {_sql_text(t.split('{}')[1])} AS prompt FROM {_FOUND_TERMS}" for i, t in enumerate(E.TARGETED)))
def e11_targeted_prompts(spark, d):
    return E.targeted_prompts(E.medical_terms(clinic(spark, d), "text"))


@query(f"SELECT i AS prompt_no, {_in(E.UNTARGETED)}[CAST(('0x' || substr(md5('3|' || i), 1, 8))::BIGINT % {len(E.UNTARGETED)} + 1 AS INT)] AS prompt FROM range(100) t(i)")
def e12_untargeted_prompts(spark, d):
    return E.untargeted_prompts(100, spark)


_SENT = "(SELECT doc, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT pubmed_id AS doc, regexp_split_to_array(abstract, '[.!?] ') AS s FROM articles WHERE abstract IS NOT NULL))"
_COUNT = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


def _answers(spark, d):
    """Snippets of questions as answers, the abstracts they come from as originals."""
    snippets = table(spark, d, "questions").select("question_id", F.posexplode("snippets").alias("n", "s"))
    return snippets.select(
        F.concat_ws("-", "question_id", "n").alias("answer_id"), F.concat(F.lit("We read: "), F.col("s.text"), F.lit(" and more.")).alias("answer")
    ).where("answer is not null").groupBy("answer_id").agg(F.min("answer").alias("answer"))


def _exact(spark, d):
    return E.exact_extractions(_answers(spark, d), "answer_id", "answer", table(spark, d, "articles"), "pubmed_id", "abstract")


_SNIPPETS = "(SELECT answer_id, min(answer) AS answer FROM (SELECT question_id || '-' || (generate_subscripts(snippets, 1) - 1) AS answer_id, 'We read: ' || unnest(snippets).text || ' and more.' AS answer FROM questions) WHERE answer IS NOT NULL GROUP BY answer_id)"


@query(f"SELECT answer_id, m.doc AS doc, m.sentence AS matched_text FROM (SELECT answer_id, min({{'doc': doc, 'pos': pos, 'sentence': sentence}}) AS m FROM {_SNIPPETS} a JOIN (SELECT * FROM {_SENT} WHERE {_COUNT.format('sentence')} >= 5) s ON contains(a.answer, s.sentence) GROUP BY answer_id)")
def e14_exact_extraction(spark, d):
    return _exact(spark, d)


_EXACT_SQL = ORACLE["e14_exact_extraction"]
_SAID = _WORDS.format("sentence")


@query(f"""SELECT answer_id, m.doc AS doc, m.sentence AS matched_text, round(-m.s, 6) AS similarity FROM (SELECT answer_id, min({{'s': -len(list_intersect(sw, aw)) / len(sw), 'doc': doc, 'pos': pos, 'sentence': sentence}}) AS m
    FROM (SELECT answer_id, {_WORDS.format('answer')} AS aw FROM {_SNIPPETS} WHERE answer_id NOT IN (SELECT answer_id FROM ({_EXACT_SQL}))) a,
    (SELECT sentence, {_SAID} AS sw, min({{'doc': doc, 'pos': pos}}).doc AS doc, min({{'doc': doc, 'pos': pos}}).pos AS pos FROM {_SENT} WHERE {_COUNT.format('sentence')} >= 8 GROUP BY sentence) s WHERE len(list_intersect(sw, aw)) / len(sw) > 0.7 GROUP BY answer_id)""")
def e15_fuzzy_extraction(spark, d):
    return E.fuzzy_extractions(_answers(spark, d), "answer_id", "answer", table(spark, d, "articles"), "pubmed_id", "abstract", _exact(spark, d))


_E = f"(SELECT count(*) FROM ({ORACLE['e14_exact_extraction']}))"


@query(f"SELECT {_E} AS exact_matches, (SELECT count(*) FROM ({ORACLE['e15_fuzzy_extraction']})) AS partial_matches, round(CASE WHEN count(*) > 0 THEN {_E} / count(*) * 100 ELSE 0 END, 6) AS success_rate FROM {_SNIPPETS}")
def e16_attack_rate(spark, d):
    answers, exact = _answers(spark, d), materialise(_exact(spark, d), "exact")  # used twice
    return E.attack_rate(
        exact, E.fuzzy_extractions(answers, "answer_id", "answer", table(spark, d, "articles"), "pubmed_id", "abstract", exact), answers.count()
    )


@query("SELECT c_custkey AS k, (c_custkey % 50 + c_custkey % 30) / 2 AS rate, CASE WHEN (c_custkey % 50 + c_custkey % 30) / 2 < 10 THEN 'High' WHEN (c_custkey % 50 + c_custkey % 30) / 2 < 30 THEN 'Medium' ELSE 'Low' END AS privacy, CASE WHEN c_custkey % 11 / 10 > 0.7 THEN 'High' WHEN c_custkey % 11 / 10 > 0.5 THEN 'Medium' ELSE 'Low' END AS utility FROM customer")
def e18_report(spark, d):
    k = F.col("c_custkey")
    rate = E.combined_rate((k % 50).cast("double"), (k % 30).cast("double"))
    return table(spark, d, "customer").select(
        k.alias("k"), rate.alias("rate"), E.privacy_grade(rate).alias("privacy"), E.utility_grade((k % 11) / 10).alias("utility")
    )


_MOCKED = f"""(SELECT question_id, question, rank, title, CASE WHEN {_FLAG} THEN {_GENERAL} ELSE abstract END AS abstract, year, authors, {_FLAG} AS syn FROM (SELECT question_id, question, i AS rank,
    'Recent advances in ' || coalesce(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')[1], '') || ' research' AS title,
    'This is a simulated abstract about ' || question || '. It contains information about treatments, diagnoses, and patient outcomes. The research was conducted at Major Medical Center with 50 participants. Results show promising outcomes for patients with various conditions.' AS abstract,
    CAST(2020 + i % 5 AS VARCHAR) AS year, 'Smith J, Johnson A, Williams B' AS authors FROM {_QUESTIONS}, range(3) t(i)))"""
_IDEAL = "(SELECT question_id, min({'question': question, 'reference': ideal_answer}) AS m FROM questions WHERE question IS NOT NULL GROUP BY question_id)"


def _benchmark(spark, d):
    q = table(spark, d, "questions").where("question is not null").groupBy("question_id").agg(
        F.min(F.struct("question", F.col("ideal_answer").alias("reference"))).alias("m")
    )
    rows = q.select(F.col("question_id").alias("id"), F.col("m.question").alias("question"), F.col("m.reference").alias("reference_answer"))
    return E.benchmark_run(rows, lambda asked: G.answer_questions(asked, S.mock_articles(asked, 3)))


@query(f"SELECT q.question_id AS id, q.m.question AS question, q.m.reference AS reference_answer, {_redact_sql('a', 'standard')} AS generated_answer FROM {_IDEAL} q JOIN (SELECT question_id, answer AS a FROM ({_answer_sql(_relevant_sql(_MOCKED), _QUESTIONS, 'syn')})) USING (question_id)")
def e19_benchmark_run(spark, d):
    return _benchmark(spark, d)


@query()
def e21_full_evaluation(spark, d):
    answers, exact = _answers(spark, d), materialise(_exact(spark, d), "exact")  # used twice
    fuzzy = E.fuzzy_extractions(answers, "answer_id", "answer", table(spark, d, "articles"), "pubmed_id", "abstract", exact)
    graded = _graded(spark, d).select(F.col("split_name").alias("source"), F.col("t").alias("type"), "ok")
    return E.full_evaluation(materialise(_benchmark(spark, d), "benchmark"), graded, exact, fuzzy, answers.count())


@query()
def e22_test_questions(spark, d):
    return M.test_questions(spark, 100, M.ExtractiveModel)


# --- models and the pipeline ---------------------------------------------------------------------------------------

_VECTORS = f"""(SELECT id, dim, sum(sign) / any_value(n) AS v FROM (SELECT id, n, ('0x' || substr(md5(w), 1, 6))::INT % 32 AS dim, CASE WHEN substr(md5(w), 7, 1) < '8' THEN 1.0 ELSE -1.0 END AS sign
    FROM (SELECT id, len(ws) AS n, unnest(ws) AS w FROM (SELECT DISTINCT {{0}} AS id, regexp_extract_all(lower({{1}}), '[a-z0-9]+') AS ws FROM {{2}} WHERE {{1}} IS NOT NULL))) GROUP BY id, dim)"""


def _long(vectors, key: str):
    return vectors.select(key, F.posexplode("embedding").alias("dim", "v")).where("v <> 0").select(key, "dim", F.round(F.col("v").cast("double"), 5).alias("v"))


@query(f"SELECT id AS pubmed_id, dim, round(v::FLOAT::DOUBLE, 5) AS v FROM {_VECTORS.format('pubmed_id', 'abstract', 'articles')} WHERE v <> 0")
def r1_embed(spark, d):
    return _long(
        M.embed(table(spark, d, "articles").where("abstract is not null").select("pubmed_id", "abstract").distinct(), "abstract", M.HashingEncoder),
        "pubmed_id"
    )


@query(f"SELECT count(*) AS items, count(DISTINCT item_id) AS ids, sum(length(text))::BIGINT AS characters, 32 AS dimension FROM (SELECT nct_id AS item_id, brief_summary AS text FROM trials WHERE brief_summary IS NOT NULL)")
def r2_index(spark, d):
    index = M.build_index(table(spark, d, "trials"), "nct_id", "brief_summary", M.HashingEncoder)
    return index.agg(
        F.count("*").alias("items"), F.countDistinct("item_id").alias("ids"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"),
        F.max(F.size("embedding")).alias("dimension")
    )


_FIRST = "trim(string_split(coalesce(context, ''), '. ')[1])"


@query(f"SELECT response_id, CASE WHEN regexp_matches({_FIRST}, '\\S') THEN regexp_replace({_FIRST}, '^\\s+|\\s+$', '', 'g') ELSE {_sql_text(G.NO_REPLY)} END AS answer FROM responses WHERE query_text IS NOT NULL")
def g5_generate(spark, d):
    r = table(spark, d, "responses").where("query_text is not null").select("response_id", "query_text", "context")
    return M.generate_answers(r, "query_text", "context", M.ExtractiveModel).select("response_id", "answer")


@query("SELECT k, list_sort(['Symptoms', 'Diagnosis', 'Treatment']) AS names, 'Write a clinical note that holds these facts and identifies nobody.' AS note FROM " + _CLINIC)
def pv9_synthetic_note(spark, d):
    docs = clinic(spark, d)
    names = M.identify_attributes(docs, "text", M.ExtractiveModel, 3)
    return M.synthetic_notes(docs, "k", "text", names, M.ExtractiveModel).select("k", F.array_sort(F.map_keys("attributes")).alias("names"), "note")


@query()
def a7_pipeline(spark, d):
    documents = notes(spark, d).where("k is not null").groupBy(F.col("k").alias("doc_id")).agg(F.min("text").alias("text"))
    kind = F.coalesce(F.regexp_replace(F.lower("question_type"), "[^a-z]", ""), F.lit("")).alias("type")
    q = table(spark, d, "questions").where("question is not null").select(
        "question_id", "question", "exact_answer", "ideal_answer", kind, F.coalesce("split_name", F.lit("none")).alias("source")
    )
    rules = P.RuleBackend()
    once = q.groupBy("question_id").agg(F.min(F.struct(*q.columns[1:])).alias("m")).select("question_id", "m.*")
    return run_pipeline(documents, once, M.HashingEncoder, rules, rules, rules).report


# --- the operators of clinical free text over real notes -----------------------------------------------------------
# clinic() only makes sure that every pattern has hits; these read the notes themselves, whole.

_NOTES = "(SELECT record_id AS k, specialty AS grp, content AS text, description AS reference FROM records)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    """k, grp, text, reference of the records; every row, also where text or reference is null."""
    return spread(
        table(spark, d, "records").select(
            F.col("record_id").alias("k"), F.col("specialty").alias("grp"), F.col("content").alias("text"), F.col("description").alias("reference")
        )
    )


@query(ORACLE["pv2b_counts_by_type"].replace(_CLINIC, _NOTES))
def pv2b_record_counts_by_type(spark, d):
    return P.counts_by_type(notes(spark, d), "text", as_sql=True)


def _redact_notes_query(level: str):
    def run(spark, d):
        return notes(spark, d).select("k", P.redact(F.col("text"), level, as_sql=True).alias("redacted"))

    run.__name__ = f"pv3_record_redact_{level}"
    query(f"SELECT k, {_redact_sql('text', level)} AS redacted FROM {_NOTES}")(run)


for _level in ("minimal", "strict"):
    _redact_notes_query(_level)


@query(ORACLE["pv4_assessment_types"].replace(_CLINIC, _NOTES))
def pv4_record_assessment_types(spark, d):
    return notes(spark, d).select("k", P.assessment_types(F.col("text")).alias("types"))


@query()
def pv5_record_similarity(spark, d):
    return notes(spark, d).select("k", F.round(sequence_ratio("text", P.redact(F.col("text"), "standard")), 6).alias("ratio"))


def _refined_notes(spark, d):
    rules = P.RuleBackend()
    return P.refine_documents(notes(spark, d), "k", "text", rules, rules, rules)


@query(f"SELECT k AS document_id, safe AS is_safe, rewrites AS iterations_required, s3 AS final_synthetic_data FROM {_refined_sql(_NOTES)}")
def pv12_record_refine(spark, d):
    return _refined_notes(spark, d).select("document_id", "is_safe", "iterations_required", "final_synthetic_data")


@query(_summary_sql(_NOTES))
def pv13_record_summary(spark, d):
    return P.refinement_summary(_refined_notes(spark, d))


def _note_pairs(spark, d):
    return notes(spark, d).withColumn("synthetic", P.rule_synthetic(F.col("text")))


@query()  # no SQL: its word boundaries are ASCII, so names with other letters differ
def pv14_record_protection(spark, d):
    return P.protection_rates(_note_pairs(spark, d), "k", "text", "synthetic")


@query(_comparison_sql(_NOTES))
def pv15_record_comparison(spark, d):
    return P.comparison_rows(_note_pairs(spark, d), "k", "text", "synthetic")


@query(f"SELECT k, {_ENTITIES.format('coalesce(text, ' + chr(39) * 2 + ')')} AS entities FROM {_NOTES}")
def e1_record_entities(spark, d):
    return notes(spark, d).select("k", E.entities(F.col("text")).alias("entities"))


_NOTE_SETS = f"(SELECT k, grp, text, list_distinct({_ENTITIES.format('text')}) AS g, list_distinct({_ENTITIES.format('reference')}) AS r FROM (SELECT k, grp, coalesce(text, '') AS text, coalesce(reference, '') AS reference FROM {_NOTES}))"


@query(f"SELECT {_SCORES} FROM {_NOTE_SETS}")
def e6_record_metrics(spark, d):
    return E.entity_scores(notes(spark, d), "text", "reference", as_sql=True)


@query(f"SELECT grp, {_SCORES} FROM {_NOTE_SETS} GROUP BY grp")
def e2_e5_record_scores_by_specialty(spark, d):
    return E.entity_scores(notes(spark, d), "text", "reference", ["grp"], as_sql=True)


@query(ORACLE["e13_terms"].replace(_CLINIC, _NOTES))
def e13_record_terms(spark, d):
    return E.medical_terms(notes(spark, d), "text")


@query(ORACLE["e11_targeted_prompts"].replace(_CLINIC, _NOTES))
def e11_record_prompts(spark, d):
    return E.targeted_prompts(E.medical_terms(notes(spark, d), "text"))
