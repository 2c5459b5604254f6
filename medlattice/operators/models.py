"""Encoders and text models as plug-ins that work on batches, and the operators that call them.

A model sees lists of texts, as many as an Arrow batch holds. Operators take a factory, which each task calls once, so that
no weights travel with a task's closure. The deterministic backends serve tests, and SQL can follow them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .answer import model_answer, model_prompt
from .privacy import DEFAULT_ATTRIBUTES, attribute_lines, parse_attribute_names, parse_attribute_values

#: Documents that a prompt for attribute names shows.
SAMPLE_DOCUMENTS = 3
# Topics of generated test questions.
TEST_TOPICS = (
    "diabetes management", "cardiovascular disease", "oncology treatments", "neurological disorders", "infectious diseases",
    "autoimmune conditions", "pediatric care", "geriatric medicine", "mental health", "preventive medicine",
    "genetic disorders", "respiratory conditions", "gastrointestinal disorders", "endocrine disorders", "hematological conditions",
)


class Encoder(Protocol):
    """Turns texts into vectors of one length; how much of a text it reads is its own business."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class TextModel(Protocol):
    """Replies to prompts, one reply per prompt."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class HashingEncoder:
    """Mean of signed one-hot vectors of a text's words (runs of a-z and 0-9 in lower case), placed by md5. Reads whole texts."""

    def __init__(self, dimension: int = 32):
        self.dimension = dimension
        self._known: dict[str, tuple[int, float]] = {}

    def _place(self, word: str) -> tuple[int, float]:
        at = self._known.get(word)
        if at is None:
            digest = hashlib.md5(word.encode()).hexdigest()
            at = self._known[word] = (int(digest[:6], 16) % self.dimension, 1.0 if digest[6] < "8" else -1.0)
        return at

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        known, place = self._known, self._place
        for i, text in enumerate(texts):
            words = re.findall("[a-z0-9]+", text.lower())
            row = [0.0] * self.dimension
            for word in words:
                at, sign = known.get(word) or place(word)
                row[at] += sign
            out[i] = row
            out[i] /= max(len(words), 1)
        return out


class ExtractiveModel:
    """Deterministic stand-in for a generating model: repeats the prompt, then says the first sentence of its context.

    A prompt without a context is answered by its own first line, so that every step of a chain has a reply.
    """

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            told = p.split("Context:\n", 1)[1].split("\n\nQuestion:", 1)[0] if "Context:\n" in p else p.split("\n", 1)[0]
            out.append(f"{p} {told.split('. ', 1)[0]}")
        return out


def _with_batches(df: DataFrame, text: str, out: str, kind: T.DataType, arrow: pa.DataType, call) -> DataFrame:
    """df with a column `out`, which call() (made once per task) gives for the texts of a batch; null for null."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, kind)])
    kept = [f.name for f in df.schema.fields if f.name != out]

    def run(batches):
        reply = call()
        for b in batches:
            texts = b.column(text).to_pylist()
            given = [i for i, t in enumerate(texts) if t is not None]
            found: list = [None] * len(texts)
            for i, r in zip(given, reply([texts[i] for i in given]) if given else []):
                found[i] = r
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, arrow)], names=[*kept, out])

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, text: str, encoder: Callable[[], Encoder], out: str = "embedding") -> DataFrame:
    """Df with the embedding (array of float) of a text column. One Arrow pass, no shuffle."""
    call = lambda: (lambda e: lambda texts: [v.astype("float32") for v in e.encode(texts)])(encoder())
    return _with_batches(df, text, out, T.ArrayType(T.FloatType()), pa.list_(pa.float32()), call)


def build_index(df: DataFrame, key: str, text: str, encoder: Callable[[], Encoder]) -> DataFrame:
    """R2: item_id, text, embedding of every row with a text; save_index() writes it with the encoder's name."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text"))
    return embed(rows, "text", encoder)


def complete(df: DataFrame, prompt: str, model: Callable[[], TextModel], out: str = "reply") -> DataFrame:
    """Df with the model's reply to each prompt, asked in batches; null for null."""
    return _with_batches(df, prompt, out, T.StringType(), pa.string(), lambda: model().complete)


def generate_answers(df: DataFrame, question: str, context: str, model: Callable[[], TextModel]) -> DataFrame:
    """Df with the model's answer to each question in its context, without the prompt."""
    prompt = model_prompt(F.col(question), F.coalesce(F.col(context), F.lit("")))
    asked = complete(df.withColumn("_prompt", prompt), "_prompt", model, "_reply")
    return asked.withColumn("answer", model_answer(F.col("_reply"), F.col("_prompt"))).drop("_prompt", "_reply")


# --- prompts of the synthesis chain (worded here; no result depends on the wording) ---------------------------------


def names_prompt(samples: Column, n: int) -> Column:
    """Asks for the attributes that matter in some sample documents, as a numbered list."""
    shown = F.array_join(F.transform(samples, lambda s, i: F.concat(F.lit("Document "), i + 1, F.lit(":\n"), s)), "\n\n")
    return F.concat(F.lit(f"Name the {n} kinds of facts that matter most in these documents, as a list of lines '1. name: why'.\n\n"), shown)


def values_prompt(text: Column, names: tuple[str, ...]) -> Column:
    """Asks for the value of each attribute in a document."""
    lines = "\n".join(f"- {n}:" for n in names)
    return F.concat(
        F.lit("Read the document and fill in each line; leave out names, numbers and places of people.\n\nDocument:\n"), text, F.lit(f"\n\n{lines}")
    )


def note_prompt(values: Column) -> Column:
    """Asks for a new note that holds the attributes and nothing that identifies a person."""
    return F.concat(F.lit("Write a clinical note that holds these facts and identifies nobody.\n\n"), attribute_lines(values))


def assessment_prompt(synthetic: Column, original: Column) -> Column:
    """Asks whether a synthetic text is safe, what is wrong with it, and how high the risk is."""
    return F.concat(
        F.lit("Compare the two texts. Reply on numbered lines: 1. Safe: yes or no. 2. Problems: - each. 3. Changes: - each. 4. Risk level: low, medium or high.\n\nOriginal:\n"),
        original, F.lit("\n\nSynthetic:\n"), synthetic)


def rewrite_prompt(text: Column, feedback: Column) -> Column:
    """Asks for a text that mends the points of an assessment."""
    points = F.array_join(F.transform(feedback, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("Rewrite the text so that these points are mended and the medical content stays.\n\n"), points, F.lit("\n\nText:\n"), text)


def identify_attributes(docs: DataFrame, text: str, model: Callable[[], TextModel], n: int = len(DEFAULT_ATTRIBUTES)) -> tuple[str, ...]:
    """N attribute names, asked of the model once with at most SAMPLE_DOCUMENTS documents; filled up from the defaults."""
    some = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).limit(SAMPLE_DOCUMENTS).agg(F.sort_array(F.collect_list("t")).alias("s"))
    asked = complete(some.select(names_prompt(F.col("s"), n).alias("p")), "p", model)
    return tuple(asked.select(parse_attribute_names(_without("reply", "p"), n).alias("a")).first().a)


def _without(reply: str, prompt: str) -> Column:
    return F.replace(F.col(reply), F.col(prompt), F.lit(""))


def extract_attributes(docs: DataFrame, text: str, names: tuple[str, ...], model: Callable[[], TextModel]) -> DataFrame:
    """Docs with a map `attributes` of what the model reads in each document."""
    asked = complete(docs.withColumn("_p", values_prompt(F.col(text), names)), "_p", model, "_r")
    return asked.withColumn("attributes", parse_attribute_values(_without("_r", "_p"), names)).drop("_p", "_r")


def synthetic_notes(docs: DataFrame, key: str, text: str, names: tuple[str, ...], model: Callable[[], TextModel]) -> DataFrame:
    """Key, attributes and the note that the model writes from them; documents meet the model in batches."""
    read = extract_attributes(docs.where(F.col(text).isNotNull()).select(key, text), text, names, model)
    written = complete(read.withColumn("_p", note_prompt(F.col("attributes"))), "_p", model, "_r")
    return written.select(key, "attributes", F.trim(_without("_r", "_p")).alias("note"))


class ModelBackend:
    """Generator, assessor and rewriter of the refinement loop (P6, P11, P12) that ask a text model in batches."""

    def __init__(self, model: Callable[[], TextModel]):
        self.model, self._made = model, None

    def __getstate__(self) -> dict:
        return {"model": self.model, "_made": None}

    def _ask(self, prompts: list[str]) -> list[str]:
        if self._made is None:
            self._made = self.model()
        return [r.replace(p, "", 1).strip() for p, r in zip(prompts, self._made.complete(prompts))]

    def generate(self, originals: list[str]) -> list[str]:
        return self._ask([f"Write a clinical note like this one that identifies nobody.\n\n{x}" for x in originals])

    def assess(self, synthetics: list[str], originals: list[str]) -> list[tuple[bool, list[str], str, list[str]]]:
        asked = [
            f"Is the second text safe to share? Reply: 1. yes or no. 2. Problems: - each. Risk level: low, medium, high.\n\n{o}\n\n{s}" for s, o in zip(synthetics, originals)
        ]
        out = []
        for reply in self._ask(asked):
            lines = reply.split("\n")
            points = [x.split(":", 1)[1].split("-") for x in lines if x.strip()[:2] in ("2.", "3.") and ":" in x]
            risk = re.search(r"risk level.*?(low|medium|high)", reply, re.I)
            out.append(("yes" in lines[0].lower(), [p.strip() for ps in points for p in ps if p.strip()], risk[1].lower() if risk else "medium", []))
        return out

    def refine(self, synthetics: list[str], feedback: list[list[str]]) -> list[str]:
        return self._ask(["Rewrite the text and mend these points: " + "; ".join(f) + f"\n\n{s}" for s, f in zip(synthetics, feedback)])


def test_questions(spark: SparkSession, n: int, model: Callable[[], TextModel], seed: int = 7) -> DataFrame:
    """N rows (question, reference_answer, topic); the topic is picked by a seeded hash of the row's number."""
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(len(TEST_TOPICS)))
    topics = spark.range(n).select(F.element_at(F.array(*map(F.lit, TEST_TOPICS)), (pick + 1).cast("int")).alias("topic"))
    asked = topics.withColumn("_p", F.concat(F.lit("Put one detailed biomedical question about "), "topic", F.lit(" as a clinician would.\n\nQuestion:")))
    asked = complete(asked, "_p", model, "_r").withColumn("question", F.trim(_without("_r", "_p")))
    told = asked.withColumn("_p", F.concat(F.lit("Answer this question in detail and without error.\n\nQuestion: "), "question", F.lit("\n\nAnswer:")))
    return complete(told, "_p", model, "_r").select("question", F.trim(_without("_r", "_p")).alias("reference_answer"), "topic")
