"""Pattern-based detection and redaction, assessment parsers, and the generate - assess - rewrite loop."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_matches, any_contains, let, replace_chain, replace_each, sql_pattern, trimmed

# Types in redaction order, their patterns, and the level from which they are looked for.
PII_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "minimal"),
    ("phone", r"\b(?:\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", "minimal"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "minimal"),
    ("patient_id", r"\b(?:Patient|Subject)(?:\s+ID|\s+#)?\s*\d+\b", "standard"),
    ("date", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", "standard"),
    ("medical_record", r"\b(?:MRN|Medical Record)(?:\s+Number)?[\s:#]?\s*\d+\b", "standard"),
    ("name", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", "strict"),
    ("address", r"\b\d+\s+[A-Z][a-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd)\b", "strict"),
    ("zipcode", r"\b\d{5}(?:-\d{4})?\b", "strict"),
    ("age", r"\b(?:age(?:d)?|(?:is|was)\s+)?\s*\d{1,3}(?:\s*(?:years|yrs)(?:\s+old)?)?\b", "strict"),
)
LEAK_TYPES = ("email", "phone", "ssn", "patient_id", "medical_record", "name", "address")
REDACTION_NOTE = "\n\nNote: Some personally identifiable information has been redacted for privacy protection."
SENSITIVE_WORDS = ("patient", "subject", "participant", "hospital", "doctor", "diagnosis", "medical record", "treatment")
DEFAULT_ATTRIBUTES = ("Symptoms", "Diagnosis", "Treatment", "Medical History", "Lab Results", "Medications")
COMPARED_PATTERNS = (
    ("Names", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("Dates", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b"),
    ("Patient IDs", r"\bMRN: \d+\b"),
    ("Ages", r"\b\d{1,2}-year-old\b"),
    ("Exact Measurements", r"\b\d{2,3}/\d{2,3}\b"),
)
_RANK = {"minimal": 0, "standard": 1, "strict": 2}


def patterns(level: str) -> list[tuple[str, str]]:
    """(type, pattern) of a level, in redaction order; an unknown level counts as minimal."""
    rank = _RANK.get(level, 0)
    return [(t, p) for t, p, at in PII_PATTERNS if _RANK[at] <= rank]


def detect(text: Column, level: str) -> Column:
    """Struct of all matches per type, in the order of the text."""
    return F.struct(*(all_matches(text, p).alias(t) for t, p in patterns(level)))


def detected_rows(df: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """P2 in long form: key, pii_type, pos (0-based within the type), instance."""
    each = F.array(*(F.struct(F.lit(t).alias("pii_type"), all_matches(F.col(text), p).alias("m")) for t, p in patterns(level)))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(each).alias("e")).select(key, "e.pii_type", F.posexplode("e.m").alias("pos", "instance"))


def match_count(text: Column, types: tuple[str, ...], as_sql: bool = False) -> Column:
    return sum((F.regexp_count(text, F.lit(sql_pattern(p) if as_sql else p)) for t, p, _ in PII_PATTERNS if t in types), F.lit(0))


def counts_by_type(df: DataFrame, text: str, level: str = "strict", as_sql: bool = False) -> DataFrame:
    """pii_type, matches and texts with a match, for every type of the level; as_sql: word boundaries are ASCII."""
    kinds = [(t, sql_pattern(p) if as_sql else p) for t, p in patterns(level)]
    each = F.array(*(F.struct(F.lit(t).alias("pii_type"), F.size(all_matches(F.col(text), p)).alias("n")) for t, p in kinds))
    rows = df.select(F.explode(each).alias("e")).select("e.*")
    found = rows.groupBy("pii_type").agg(
        F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).cast("long").alias("matches"), F.count_if(F.col("n") > 0).alias("texts"))
    every = df.sparkSession.createDataFrame([(t,) for t, _ in kinds], "pii_type string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(found, "pii_type", "left").select("pii_type", zero("matches"), zero("texts"))


def redact(text: Column, level: str, as_sql: bool = False) -> Column:
    """Types are found in the original text and replaced one type after the other, every occurrence of each match.

    as_sql: word boundaries are those of ASCII letters, so that a name is found up to a letter with an accent.
    """
    kinds = [(t, sql_pattern(p) if as_sql else p) for t, p in patterns(level)]
    found = F.struct(text.alias("text"), *(all_matches(text, p).alias(t) for t, p in kinds))

    def replaced(x: Column) -> Column:
        out = x["text"]
        for t, _ in kinds:
            out = replace_each(out, x[t], f"[REDACTED {t.upper()}]")
        any_hit = sum((F.size(x[t]) for t, _ in kinds), F.lit(0)) > 0
        # the inner body must not use x: a Python function over such an expression would not be extracted
        return let(
            F.struct(out.alias("out"), any_hit.alias("hit")),
            lambda y: F.when(y["hit"] & y["out"].contains("[REDACTED"), F.concat(y["out"], F.lit(REDACTION_NOTE))).otherwise(y["out"])
        )

    return let(found, replaced)


def is_sensitive(text: Column) -> Column:
    """One of the sensitive words occurs in the text."""
    return F.coalesce(any_contains(F.lower(text), list(SENSITIVE_WORDS)), F.lit(False))


#: Identifying phrases and what the rule-based generator puts in their place.
GENERAL_RULES = (
    (r"\b(?:Dr|Mr|Mrs|Ms|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", "a clinician"), (r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)* (?:Hospital|Clinic|Medical Center)\b", "a medical facility"),
    (r"\b(?:Patient|Subject)(?:\s+ID|\s+#)?\s*#?\d+\b", "The patient"), (r"\b(?:MRN|Medical Record)(?:\s+Number)?[\s:#]*\d+\b", "a record"),
    (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", "a recent date"), (r"\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", "a telephone number"),
)


def rule_synthetic(text: Column) -> Column:
    """Deterministic stand-in for a generating model: identifying phrases become general ones."""
    return replace_chain(text, list(GENERAL_RULES), regex=True)


def privatise(df: DataFrame, abstract: str, generate=rule_synthetic) -> DataFrame:
    """A sensitive abstract is replaced by a generated one; contains_synthetic_data tells which."""
    flag = F.col(abstract).isNotNull() & is_sensitive(F.col(abstract))
    return df.withColumn("contains_synthetic_data", flag).withColumn(abstract, F.when(flag, generate(F.col(abstract))).otherwise(F.col(abstract)))


def assessment_types(text: Column, recognised: Column | None = None) -> Column:
    """Types a recogniser gave (repeats kept), then PHONE_NUMBER and EMAIL_ADDRESS by pattern where it gave none."""
    found = recognised if recognised is not None else F.array().cast("array<string>")
    for name, kind in (("PHONE_NUMBER", "phone"), ("EMAIL_ADDRESS", "email")):
        pattern = next(p for t, p, _ in PII_PATTERNS if t == kind)
        found = F.when(text.rlike(pattern) & ~F.array_contains(found, name), F.array_append(found, F.lit(name))).otherwise(found)
    return found


def parse_assessment(reply: Column) -> Column:
    """is_safe, feedback and risk_level of an assessor's reply."""
    lines = F.split(reply, "\n")
    points = F.filter(lines, lambda x: trimmed(x).startswith("2.") | trimmed(x).startswith("3."))
    items = F.flatten(F.transform(F.filter(points, lambda x: x.contains(":")), lambda x: F.split(F.regexp_replace(x, "^[^:]*:", ""), "-")))
    risk = F.lower(F.regexp_extract(reply, "(?i)risk level.*?(low|medium|high)", 1))
    return F.struct(
        F.lower(F.element_at(lines, 1)).contains("yes").alias("is_safe"), F.filter(F.transform(items, trimmed), lambda x: x != "").alias("feedback"), F.when(risk != "", risk).otherwise("medium").alias("risk_level"))


def parse_attribute_names(reply: Column, n: int = 6) -> Column:
    """Attribute names of a numbered list; too few are filled up from the defaults at the same places."""
    found = F.transform(all_matches(reply, r"\d+\.\s*([\w\s]+)[:|-]", 1), trimmed)
    defaults = F.array(*map(F.lit, DEFAULT_ATTRIBUTES[:n]))
    more = F.when(F.size(found) < len(DEFAULT_ATTRIBUTES[:n]), F.slice(defaults, F.size(found) + 1, n)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(found, more), 1, n)


def parse_attribute_values(reply: Column, names: tuple[str, ...]) -> Column:
    """Value of each "- name:" entry up to the next entry, else 'Not mentioned'."""
    one = lambda n: F.when(
        reply.contains(f"- {n}:"), trimmed(F.regexp_extract(reply, rf"(?s)- {re.escape(n)}:(.*?)(?=- \w|\z)", 1))
    ).otherwise("Not mentioned")
    return F.create_map(*(x for n in names for x in (F.lit(n), one(n))))


def attribute_lines(values: Column) -> Column:
    """P9: "- name: value" lines for a generating model's prompt."""
    return F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")


class Generator(Protocol):
    def generate(self, originals: list[str]) -> list[str]: ...


class Assessor(Protocol):
    """(is_safe, feedback, risk_level, pii_detected) of each text."""

    def assess(self, synthetics: list[str], originals: list[str]) -> list[tuple[bool, list[str], str, list[str]]]: ...


class Rewriter(Protocol):
    def refine(self, synthetics: list[str], feedback: list[list[str]]) -> list[str]: ...


#: Strings of which a text with a match of the pattern holds one; looked for first, since that is far quicker.
_HOLDS = {"email": ("@",), "ssn": ("-",), "patient_id": ("Patient", "Subject"), "date": ("/",), "medical_record": ("MRN", "Medical Record")}


class RuleBackend:
    """Deterministic generator, assessor and rewriter: the text is safe when no standard pattern is left; a rewrite removes one type."""

    def generate(self, originals: list[str]) -> list[str]:
        return list(originals)

    def assess(self, synthetics: list[str], originals: list[str]) -> list[tuple[bool, list[str], str, list[str]]]:
        out, kinds = [], [(t, re.compile(p).search, _HOLDS.get(t, ("",))) for t, p in patterns("standard")]
        for text in synthetics:
            found = [t for t, search, held in kinds if any(x in text for x in held) and search(text)]
            risk = "low" if not found else "high" if len(found) > 2 else "medium"
            out.append((not found, [f"remove {t}" for t in found], risk, found))
        return out

    def refine(self, synthetics: list[str], feedback: list[list[str]]) -> list[str]:
        kinds, by_kind = [f[0].removeprefix("remove ") if f else None for f in feedback], dict(patterns("standard"))
        return [s if k is None else re.sub(by_kind[k], f"[{k}]", s) for s, k in zip(synthetics, kinds)]


REFINED = (
    "document_id string, original_length int, synthetic_length int, is_safe boolean, iterations_required int, "
    "assessments array<struct<iteration int, is_safe boolean, feedback array<string>, risk_level string, pii_detected array<string>>>, final_synthetic_data string"
)


def refine_documents(df: DataFrame, key: str, text: str, generator: Generator, assessor: Assessor, rewriter: Rewriter, max_iterations: int = 3) -> DataFrame:
    """Per document, assess and rewrite until safe or max_iterations rewrites; the last rewrite is not assessed again.

    The loop runs within one Arrow pass, so that a model that isn't deterministic is asked once per step, and in batches.
    """

    def run(frames: Iterator):
        import pandas as pd

        for pdf in frames:
            originals = pdf["t"].tolist()
            current, n = generator.generate(originals), len(originals)
            safe, steps, rewrites = [False] * n, [[] for _ in range(n)], [0] * n
            active = list(range(n))
            for at in range(max_iterations):  # the texts that are not safe yet go on together
                told = assessor.assess([current[i] for i in active], [originals[i] for i in active]) if active else []
                for i, (ok, feedback, risk, found) in zip(active, told):
                    safe[i] = ok
                    steps[i].append({"iteration": at, "is_safe": ok, "feedback": feedback, "risk_level": risk, "pii_detected": found})
                active = [i for i in active if not safe[i]]
                again = rewriter.refine([current[i] for i in active], [steps[i][-1]["feedback"] for i in active]) if active else []
                for i, text in zip(active, again):
                    current[i], rewrites[i] = text, rewrites[i] + 1
            yield pd.DataFrame({
                "document_id": pdf["k"], "original_length": [len(t) for t in originals], "synthetic_length": [len(t) for t in current], "is_safe": safe,
                "iterations_required": rewrites, "assessments": steps, "final_synthetic_data": current,
            })

    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, REFINED)


def refinement_summary(refined: DataFrame) -> DataFrame:
    """Documents, safe ones and mean iterations and lengths; zeros for an empty set."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return refined.agg(
        F.count("*").alias("total_documents"), F.count_if("is_safe").alias("safe_documents"), mean("iterations_required").alias("avg_iterations"),
        mean("original_length").alias("avg_original_length"), mean("synthetic_length").alias("avg_synthetic_length")
    )


def protection_rates(pairs: DataFrame, key: str, original: str, synthetic: str) -> DataFrame:
    """Per record and category, matches of both texts, those in common, and the share that is protected in percent."""
    each = F.array(
        *(
            F.struct(F.lit(n).alias("category"), all_matches(F.col(original), p).alias("o"), all_matches(F.col(synthetic), p).alias("s")) for n, p in COMPARED_PATTERNS
        )
    )
    rows = pairs.where(F.col(original).isNotNull() & F.col(synthetic).isNotNull()).select(key, F.explode(each).alias("e"))
    common = F.size(F.array_intersect("e.o", "e.s"))
    n = F.size("e.o")
    return rows.select(
        key, "e.category", n.alias("original_count"), F.size("e.s").alias("synthetic_count"), common.alias("direct_matches"),
        F.when(n == 0, 100.0).otherwise((1 - common / n) * 100).alias("protection_rate")
    )


def comparison_rows(pairs: DataFrame, key: str, original: str, synthetic: str) -> DataFrame:
    """Two rows per record, the original and the synthetic text with their lengths."""
    each = F.array(
        F.struct(F.lit("original").alias("version"), F.col(original).alias("text")),
        F.struct(F.lit("synthetic").alias("version"), F.col(synthetic).alias("text"))
    )
    return pairs.select(key, F.explode(each).alias("e")).select(key, "e.version", F.length("e.text").alias("text_length"))
