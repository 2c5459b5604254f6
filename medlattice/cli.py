"""spark-submit entry: python -m medlattice.cli redact|refine|build|ask|qa|evaluate|pipeline ...."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .config import load_config
from .operators.answer import answer_questions
from .operators.evaluate import entity_scores
from .operators.models import HashingEncoder, build_index
from .operators.privacy import RuleBackend, redact, refine_documents, refinement_summary
from .pipeline import answers_from_index, run_pipeline
from .session import build_session
from .sources.readers import json_documents, mock_articles, text_corpus
from .sources.sinks import load_index, save_index, write_json, write_pairs


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="medlattice")
    parser.add_argument("--config")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, given in (
        ("redact", ("input", "output")), ("refine", ("input", "output")), ("build", ("input", "output")), ("ask", ("question",)),
        ("qa", ("index", "questions", "output")), ("evaluate", ("input", "output")), ("pipeline", ("input", "questions", "output"))
    ):
        p = sub.add_parser(name)
        for x in given:
            p.add_argument(x)
        if name == "ask":
            p.add_argument("--json", action="store_true")
        if name in ("redact", "ask"):
            p.add_argument("--level", choices=("minimal", "standard", "strict"))
    args = parser.parse_args(argv)
    config = load_config(args.config)
    spark = build_session()
    if args.command == "redact":
        level = args.level or config.privacy.filtering_level
        write_json(text_corpus(spark, args.input).withColumn("text", redact(F.col("text"), level)), args.output)
    elif args.command == "refine":
        rules = RuleBackend()
        refined = refine_documents(text_corpus(spark, args.input), "doc_id", "text", rules, rules, rules, config.privacy.max_iterations)
        write_pairs(refined, args.output)
        refinement_summary(refined).show(truncate=False)
    elif args.command == "build":  # texts, or vectors that are ready
        ready = args.input.endswith(".parquet")
        index = spark.read.parquet(args.input) if ready else build_index(text_corpus(spark, args.input), "doc_id", "text", HashingEncoder)
        save_index(index, args.output, "given vectors" if ready else "hashing-32")
    elif args.command == "qa":  # questions: JSON rows (question_id, question)
        index, _ = load_index(spark, args.index)
        write_json(answers_from_index(index, json_documents(spark, args.questions, "question_id string, question string"), HashingEncoder), args.output)
    elif args.command == "pipeline":  # questions: JSON rows (question_id, question, exact_answer, ideal_answer, type, source)
        rules = RuleBackend()
        fields = ", ".join(f"{c} string" for c in ("question_id", "question", "exact_answer", "ideal_answer", "type", "source"))
        run = run_pipeline(text_corpus(spark, args.input), json_documents(spark, args.questions, fields), HashingEncoder, rules, rules, rules)
        for part in ("summary", "attacks", "accuracy", "report"):
            write_json(getattr(run, part), f"{args.output}/{part}")
        save_index(run.index, f"{args.output}/index", "hashing-32")
    elif args.command == "ask":
        asked = spark.createDataFrame([("0", args.question)], "question_id string, question string")
        level = args.level or config.privacy.filtering_level
        said = answer_questions(asked, mock_articles(asked, config.retrieval.max_results), level, config.privacy.use_synthetic)
        print(said.toJSON().first() if args.json else said.first().answer)
    else:
        write_json(entity_scores(json_documents(spark, args.input), "generated_answer", "reference_answer"), args.output)


if __name__ == "__main__":
    main()
