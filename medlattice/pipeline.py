"""The whole job (A7): make documents private, index them, attack the index, score answers, and report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.answer import answer_questions
from .operators.evaluate import (
    accuracy_sets, attack_rate, combined_rate, exact_extractions, fuzzy_extractions, is_correct, medical_terms, privacy_grade, targeted_prompts,
    untargeted_prompts, utility_grade,
)
from .operators.models import Encoder, build_index, embed
from .operators.privacy import Assessor, Generator, Rewriter, refine_documents, refinement_summary
from .operators.retrieval import nearest
from .session import materialise

#: Attacks of each kind, and documents that an answer is drawn from.
ATTACKS, DOCUMENTS = 50, 5


@dataclass(frozen=True)
class PipelineRun:
    """summary: of the refinement. index: vectors of the private texts. attacks: one row per kind. accuracy: overall, by source and type. report: one row."""

    summary: DataFrame
    index: DataFrame
    attacks: DataFrame
    accuracy: DataFrame
    report: DataFrame


def answers_from_index(index: DataFrame, asked: DataFrame, encoder: Callable[[], Encoder], k: int = DOCUMENTS) -> DataFrame:
    """question_id, question, answer: each question (question_id, question) is answered from its k nearest texts of the index."""
    items = index.select(F.xxhash64("item_id").alias("item_id"), "text", "embedding")
    named = asked.select(F.col("question_id").alias("_asked"), F.xxhash64("question").alias("query_id"), "question")
    once = named.where("question is not null").select("query_id", "question").dropDuplicates(["query_id"])  # a question asked again has the same answer
    once = materialise(once, "pipeline-questions")
    near = nearest(items, embed(once, "question", encoder).select("query_id", "embedding"), k)
    texts = items.select("item_id", F.col("text").alias("abstract")).dropDuplicates(["item_id"])
    title = F.lit("").alias("title")
    unknown = (F.lit(None).cast("string").alias(c) for c in ("year", "authors"))
    docs = near.join(texts, "item_id").select(F.col("query_id").alias("question_id"), (F.col("rank") - 1).alias("rank"), title, "abstract", *unknown)
    told = answer_questions(once.withColumnRenamed("query_id", "question_id"), docs).select(F.col("question_id").alias("query_id"), "answer")
    return named.join(told, "query_id", "left").select(F.col("_asked").alias("question_id"), "question", "answer")


def run_pipeline(
    documents: DataFrame, questions: DataFrame, encoder: Callable[[], Encoder], generator: Generator, assessor: Assessor, rewriter: Rewriter,
    attacks: int = ATTACKS, k: int = DOCUMENTS,
) -> PipelineRun:
    """A7 over documents (doc_id, text) and questions (question_id, question, exact_answer, ideal_answer, type, source).

    Every step runs over whole tables; only the attacks are limited in number, which is what they are asked for. Texts that
    were made private and the vectors are written to the shared folder, since later steps read them several times.
    """
    spark = documents.sparkSession
    refined = materialise(refine_documents(documents, "doc_id", "text", generator, assessor, rewriter), "pipeline-refined")
    index = materialise(build_index(refined, "document_id", "final_synthetic_data", encoder), "pipeline-index")

    kinds = {
        "targeted": targeted_prompts(medical_terms(documents, "text"), attacks).select(F.sha2("prompt", 256).alias("question_id"), F.col("prompt").alias("question")),
        "untargeted": untargeted_prompts(attacks, spark).select(F.col("prompt_no").cast("string").alias("question_id"), F.col("prompt").alias("question")),
    }
    rates = None
    for kind, prompts in kinds.items():
        said = materialise(answers_from_index(index, prompts, encoder, k), f"pipeline-{kind}")
        exact = materialise(exact_extractions(said, "question_id", "answer", documents, "doc_id", "text"), f"pipeline-exact-{kind}")  # used twice
        fuzzy = fuzzy_extractions(said, "question_id", "answer", documents, "doc_id", "text", exact)
        row = attack_rate(exact, fuzzy, attacks).select(F.lit(kind).alias("attack"), "*")
        rates = row if rates is None else rates.unionByName(row)
    rates = materialise(rates, "pipeline-attacks")

    told = answers_from_index(index, questions.select("question_id", "question"), encoder, k).select("question_id", F.col("answer").alias("said"))
    graded = questions.join(told, "question_id", "left").select(
        "source", "type", is_correct(F.col("type"), F.col("exact_answer"), F.col("said"), F.col("ideal_answer")).alias("ok")
    )
    accuracy = materialise(accuracy_sets(graded, "ok", "source", "type"), "pipeline-accuracy")

    by_kind = rates.agg(*(F.max(F.when(F.col("attack") == n, F.col("success_rate"))).alias(n) for n in kinds))
    overall = accuracy.where("level = 'overall'").agg(F.coalesce(F.max("accuracy"), F.lit(0.0)).alias("accuracy"))
    both = by_kind.withColumn("_one", F.lit(1)).join(overall.withColumn("_one", F.lit(1)), "_one")  # one row each
    rate = combined_rate(F.col("targeted"), F.col("untargeted"))
    report = both.select(
        rate.alias("attack_success_rate"), F.col("targeted").alias("targeted_attacks_success"), F.col("untargeted").alias("untargeted_attacks_success"),
        F.col("accuracy").alias("overall_accuracy"), privacy_grade(rate).alias("privacy_protection"), utility_grade(F.col("accuracy")).alias("medical_utility"))
    return PipelineRun(refinement_summary(refined), index, rates, accuracy, report)
