"""Extractive answers, prompts, citation and claim checks, and the whole answering query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_matches, capitalised, trimmed, word_set
from .privacy import privatise, redact

# Sentences of answers and warnings, claim patterns.
NOT_FOUND = "I couldn't find relevant information to answer the question: "
INTRO = ("Based on the medical literature, I can provide the following information about '", "':\n\n")
SYNTHETIC_NOTE = "\nNote: Some of the information presented is based on synthetically generated data to protect privacy.\n"
NO_REPLY = "I couldn't generate a response based on the available information."
NO_CITATIONS = "No citations found in response."
CLAIMS = (
    "studies (show|demonstrate|indicate|reveal)", "research (has shown|demonstrates|indicates|reveals)", "according to", "(statistically|significantly) (higher|lower|increased|decreased)",
    "(recommended|approved) (dosage|dose|treatment)", "clinical (trials|studies) (show|demonstrate|confirm)", "(standard|common) (treatment|protocol)", "(effective|efficacy|efficiency) (of|for|in) (treating|treatment)",
    "(administered|prescribed) (to patients|for)", "(causes|caused by|results from|leads to)", "(risk|risks) (of|for|include|factor|factors)",
)
KEY_SENTENCES, ANSWER_DOCUMENTS = 3, 3


def relevant(pairs: DataFrame) -> DataFrame:
    """G1: of rows (question_id, question, rank, title, abstract, ...) those that share a word with the question, with key sentences."""
    keywords = word_set(F.col("question"))
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    hit = F.arrays_overlap(keywords, word_set(title)) | F.arrays_overlap(keywords, word_set(abstract))
    said = F.filter(F.transform(F.split(abstract, r"\. "), trimmed), lambda s: s != "")
    key = F.filter(said, lambda s: F.exists(keywords, lambda k: F.lower(s).contains(k)))
    return pairs.where(hit).withColumn("key_sentences", F.slice(key, 1, KEY_SENTENCES))


def structured_answers(questions: DataFrame, info: DataFrame) -> DataFrame:
    """question_id, answer from the key sentences of each question's first documents; info as given by relevant()."""
    year, authors, title = (F.coalesce(c, F.lit(d)) for c, d in (("year", "Unknown"), ("authors", "Unknown"), ("title", "")))
    order = Window.partitionBy("question_id").orderBy("rank")
    told = info.select(
        "question_id", "rank", F.coalesce("contains_synthetic_data", F.lit(False)).alias("synthetic"), "key_sentences", year.alias("y"),
        authors.alias("a"), title.alias("t")
    )
    some = F.max("synthetic").over(Window.partitionBy("question_id"))  # of all documents, not only of those shown
    first = told.withColumn("n", F.row_number().over(order)).withColumn("any_synthetic", some).where(F.col("n") <= ANSWER_DOCUMENTS)
    said = F.concat(
        F.lit("According to "), F.col("a"), F.lit(" ("), F.col("y"), F.lit("):\n"),
        F.array_join(F.transform("key_sentences", lambda s: F.concat(F.lit("- "), s, F.lit(".\n"))), ""), F.lit("\n")
    )
    cited = F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col("a"), F.lit(" ("), F.col("y"), F.lit("). "), F.col("t"), F.lit(".\n"))
    shown = F.sort_array(F.collect_list(F.struct("n", said.alias("s"), cited.alias("c")))).alias("p")  # ANSWER_DOCUMENTS per question
    parts = first.groupBy("question_id").agg(shown, F.max("any_synthetic").alias("any_synthetic"))
    join = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    text = F.concat(
        F.lit(INTRO[0]), F.col("question"), F.lit(INTRO[1]), join("s"), F.when(F.col("any_synthetic"), F.lit(SYNTHETIC_NOTE)).otherwise(F.lit("")),
        F.lit("\nReferences:\n"), join("c")
    )
    return questions.select("question_id", "question").join(parts, "question_id", "left").select(
        "question_id", "question", F.when(F.col("p").isNull(), F.concat(F.lit(NOT_FOUND), F.col("question"))).otherwise(text).alias("answer")
    )


def answer_questions(questions: DataFrame, documents: DataFrame, level: str | None = "standard", private: bool = True) -> DataFrame:
    """G11 (and G3 with private=False, level=None): retrieved documents are made private, answered from, and the answer redacted.

    questions: question_id, question. documents: question_id, rank, title, abstract, year, authors.
    """
    docs = privatise(documents, "abstract") if private else documents.withColumn("contains_synthetic_data", F.lit(False))
    answers = structured_answers(questions, relevant(questions.join(docs, "question_id")))
    return answers if level is None else answers.withColumn("answer", redact(F.col("answer"), level))


def model_prompt(question: Column, context: Column) -> Column:
    """Prompt of a generating model."""
    return F.concat(
        F.lit(
            "Use the context below to answer the biomedical question. Cite the sources of the context; where it holds no answer, say so.\n\nContext:\n"
        ),
        context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:")
    )


def model_answer(reply: Column, prompt: Column) -> Column:
    """The reply without the prompt, or a fixed sentence if nothing is left."""
    rest = trimmed(F.replace(reply, prompt, F.lit("")))
    return F.when(rest == "", F.lit(NO_REPLY)).otherwise(rest)


def echo_reply(prompt: Column) -> Column:
    """Reply of the placeholder model, with the prompt's first 50 characters."""
    return F.concat(F.lit("This is a placeholder response for: "), F.substring(prompt, 1, 50), F.lit("..."))


def document_prompt(question: Column, documents: Column) -> Column:
    """Prompt with the first three documents (array of structs title, year, abstract), missing fields filled in."""
    one = lambda d, i: F.concat(
        F.lit("Document "), i + 1, F.lit(":\nTitle: "), F.coalesce(d["title"], F.lit("Unknown")), F.lit("\nYear: "),
        F.coalesce(d["year"], F.lit("Unknown")), F.lit("\nAbstract: "), F.coalesce(d["abstract"], F.lit("Not available")), F.lit("\n\n")
    )
    return F.concat(
        F.lit("Question: "), question, F.lit("\n\nResearch:\n\n"), F.array_join(F.transform(F.slice(documents, 1, 3), one), ""),
        F.lit("Answer briefly from the research and cite it as [Doc 1], [Doc 2].\n")
    )


def citation_checks(responses: DataFrame, sources: str, answer: str) -> DataFrame:
    """Adds citations_found (citation, document_id, source), missing_citations and citation_warnings.

    `sources` is an array of structs (source_name, document_id); a citation belongs to the first of them whose label,
    [Source i] with i from 1, contains it.
    """
    docs = F.coalesce(F.col(sources), F.array().cast(responses.schema[sources].dataType))
    labels = F.transform(
        docs,
        lambda d, i: F.struct(
            F.concat(F.lit("["), capitalised(F.coalesce(d["source_name"], F.lit(""))), F.lit(" "), i + 1, F.lit("]")).alias("label"),
            d["document_id"].alias("document_id"), d["source_name"].alias("source")
        )
    )
    cited = all_matches(F.coalesce(F.col(answer), F.lit("")), r"\[([^]]+)\]", 1)
    with_labels = responses.withColumn("_labels", labels).withColumn("_cited", cited)
    first = lambda c: F.element_at(F.filter(F.col("_labels"), lambda x: x["label"].contains(c)), 1)
    known = lambda c: F.exists(F.col("_labels"), lambda x: x["label"].contains(c))
    found = F.transform(
        F.filter("_cited", known),
        lambda c: F.struct(c.alias("citation"), first(c)["document_id"].alias("document_id"), first(c)["source"].alias("source"))
    )
    missing = F.filter("_cited", lambda c: ~known(c))
    none = (F.size("_cited") == 0) & (F.size("_labels") > 0)
    warnings = F.when(none, F.array(F.lit(NO_CITATIONS))).otherwise(
        F.transform(missing, lambda c: F.concat(F.lit("Citation "), c, F.lit(" does not match any context document.")))
    )
    return with_labels.select(*responses.columns, found.alias("citations_found"), missing.alias("missing_citations"), warnings.alias("citation_warnings"))


def claim_checks(responses: DataFrame, answer: str, context: str) -> DataFrame:
    """Adds potential_hallucinations, the claiming sentences that share fewer than three words with every context sentence."""
    said = F.filter(F.transform(F.split(F.coalesce(F.col(answer), F.lit("")), "[.!?]+"), trimmed), lambda s: s != "")
    known = F.transform(F.split(F.coalesce(F.col(context), F.lit("")), "[.!?]+"), word_set)
    claim = F.filter(said, lambda s: s.rlike("(?i)" + "|".join(f"(?:{c})" for c in CLAIMS)))
    held = responses.withColumn("_known", known).withColumn("_claims", claim)
    open_ = F.filter("_claims", lambda s: ~F.exists("_known", lambda c: F.size(F.array_intersect(word_set(s), c)) >= 3))
    return held.select(*responses.columns, open_.alias("potential_hallucinations"))


def validate(responses: DataFrame, answer: str, context: str, sources: str, citations: bool = True, claims: bool = True) -> DataFrame:
    """Both checks, either of which may be off; valid is what gives no warning."""
    out = responses
    warnings = [F.array().cast("array<string>")]
    if citations:
        out = citation_checks(out, sources, answer)
        warnings.append(F.col("citation_warnings"))
    if claims:
        out = claim_checks(out, answer, context)
        warnings.append(F.transform("potential_hallucinations", lambda s: F.concat(F.lit("Potential hallucination: '"), s, F.lit("'"))))
    return out.withColumn("warnings", F.concat(*warnings)).withColumn("is_valid", F.size("warnings") == 0)


