"""Exact k-nearest neighbours, source fusion, re-ranking, context and document texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import replace_chain, trimmed

#: Bytes of query vectors sent to every task at once, and of the distances that a task holds; more is searched in further passes.
QUERY_BYTES, DISTANCE_BYTES = 32 << 20, 64 << 20
EXTERNAL_SCORES = {"pubmed": 0.85, "clinical_trials": 0.80}
SOURCE_ORDER = ("local", "pubmed", "clinical_trials")
# Labels, abbreviations, query terms and section headings.
CONTEXT_LABELS = {"local": "Synthetic Medical Record", "pubmed": "PubMed Article", "clinical_trials": "Clinical Trial"}
ABBREVIATIONS = [
    (r"\bT2DM\b", "Type 2 Diabetes Mellitus"), (r"\bCVD\b", "Cardiovascular Disease"), (r"\bHTN\b", "Hypertension"), (r"\bAFib\b", "Atrial Fibrillation"),
    (r"\bCAD\b", "Coronary Artery Disease"), (r"\bMI\b", "Myocardial Infarction"), (r"\bCHF\b", "Congestive Heart Failure"), (r"\bCOPD\b", "Chronic Obstructive Pulmonary Disease"),
    (r"\bUTI\b", "Urinary Tract Infection"), (r"\bRA\b", "Rheumatoid Arthritis"), (r"\bSLE\b", "Systemic Lupus Erythematosus"),
]
QUERY_TERMS = [
    ("cancer", "neoplasm OR tumor OR malignancy OR cancer"), ("heart attack", "myocardial infarction OR heart attack OR cardiac arrest"),
    ("diabetes", "diabetes mellitus OR hyperglycemia"), ("high blood pressure", "hypertension OR high blood pressure"),
]
SECTIONS = [
    ("objective", r"(?is)(?:objective|aim|purpose)s?:?\s*(.*?)(?:\n\n|\n[A-Z])"), ("methods", r"(?is)(?:methods|materials and methods|study design):?\s*(.*?)(?:\n\n|\n[A-Z])"),
    ("results", r"(?is)(?:results|findings|outcomes):?\s*(.*?)(?:\n\n|\n[A-Z])"), ("conclusions", r"(?is)(?:conclusions?|discussion):?\s*(.*?)(?:\n\n|\n[A-Z]|\z)"),
]


def nearest(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, block: int | None = None) -> DataFrame:
    """For each query (query_id long, embedding) the k nearest of the corpus (item_id long, embedding) by squared L2.

    Neighbours beyond `threshold` are dropped after the k are taken; ties go to the smaller id. Every task keeps the k
    best of its partition per query, so that at most k rows per query and task are shuffled. Queries are sent in blocks of
    QUERY_BYTES (or of `block` queries), whatever their dimension.
    """
    held = queries.where("embedding is not null").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimension")).first()
    size = block or max(1, QUERY_BYTES // (8 * max(held.dimension or 1, k)))
    parts = max(1, -(-held.n // size))
    tagged = queries.where("embedding is not null").select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"))
    found = None
    for p in range(parts):
        rows = tagged.where(F.col("part") == p).select("query_id", "embedding").toPandas()
        one = _nearest_block(corpus, rows["query_id"].to_numpy("int64"), [np.asarray(x, dtype="float64") for x in rows["embedding"]], k)
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("query_id").orderBy("distance", "item_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top if threshold is None else top.where(F.col("distance") <= threshold)


def _smallest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of each row of d, ties by id (one row of ids per row of d): a partition, and a sort only where ties cross it."""
    if d.shape[1] <= k:
        return np.broadcast_to(np.arange(d.shape[1]), d.shape)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(d, at, 1).max(axis=1)
    for row in np.flatnonzero((d <= edge[:, None]).sum(axis=1) > k):
        at[row] = np.lexsort((ids[row], d[row]))[:k]
    return at


#: Rows of queries that meet a batch of the corpus at once in single precision.
TILE = 2048


def _take_nearer(q: np.ndarray, low: np.ndarray, square: np.ndarray, x: np.ndarray, own: np.ndarray, best_d: np.ndarray, best_i: np.ndarray) -> None:
    """Bring the k best of every query (best_d, best_i) up to date with the items x (numbers `own`).

    Single precision tells which items can't be nearer than the k-th best so far: its error is below a bound for sums of that
    many products. Only the others are measured in full.
    """
    k, sizes = best_d.shape[1], (x * x).sum(1)
    items, norm = x.T.astype("float32"), sizes.astype("float32")
    slack = 4 * (x.shape[1] + 8) * float(np.finfo("float32").eps)
    longest = float(np.sqrt(sizes.max(initial=0.0)))
    for at in range(0, len(q), TILE):
        rows = slice(at, min(at + TILE, len(q)))
        about = low[rows] @ items
        about *= -2
        about += norm
        limit = best_d[rows].max(axis=1) + 1e-8 - square[rows] + slack * (np.sqrt(square[rows]) + longest) ** 2
        hit, item = np.nonzero(about <= limit.astype("float32")[:, None])
        if not len(hit):
            continue
        hit += at
        products = np.concatenate([np.einsum("ij,ij->i", q[hit[c : c + 65536]], x[item[c : c + 65536]]) for c in range(0, len(hit), 65536)])
        d = np.round(np.maximum(0.0, square[hit] + sizes[item] - 2.0 * products), 9)
        changed = np.unique(hit)
        of = np.concatenate([hit, np.repeat(changed, k)])
        d, i = np.concatenate([d, best_d[changed].ravel()]), np.concatenate([own[item], best_i[changed].ravel()])
        order = np.lexsort((i, d, of))
        begin = np.searchsorted(of[order], changed)
        first = order[begin[:, None] + np.arange(k)]
        best_d[changed], best_i[changed] = d[first], i[first]


def _nearest_block(corpus: DataFrame, ids: np.ndarray, vectors: list[np.ndarray], k: int) -> DataFrame:
    queries = np.stack(vectors) if vectors else np.zeros((0, 1))
    sent = corpus.sparkSession.sparkContext.broadcast((ids, queries))

    def run(frames):
        import pandas as pd

        ids, q = sent.value
        if not len(ids):
            return
        best_d, best_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), dtype="int64")
        square, low = (q * q).sum(1), q.astype("float32")
        step, seen = max(1, DISTANCE_BYTES // (8 * len(ids))), 0
        for pdf in frames:
            pdf = pdf[pdf["embedding"].notna()]
            at = 0
            while at < len(pdf):
                full = best_d.shape[1] == k
                part = pdf.iloc[at : at + (max(step, seen) if full else step)]  # as many as were seen, so that few are nearer
                at, seen = at + len(part), seen + len(part)
                x, own = np.stack([np.asarray(v, dtype="float64") for v in part["embedding"]]), part["item_id"].to_numpy("int64")
                if full:
                    _take_nearer(q, low, square, x, own, best_d, best_i)
                    continue
                d = np.round(np.maximum(0.0, square[:, None] + (x * x).sum(1)[None, :] - 2.0 * q @ x.T), 9)
                near = _smallest(d, np.broadcast_to(own, d.shape), k)
                d, i = np.concatenate([best_d, np.take_along_axis(d, near, 1)], axis=1), np.concatenate([best_i, own[near]], axis=1)
                near = _smallest(d, i, k)
                best_d, best_i = np.take_along_axis(d, near, 1), np.take_along_axis(i, near, 1)
        m = best_d.shape[1]
        if m:
            yield pd.DataFrame({"query_id": np.repeat(ids, m), "item_id": best_i.ravel(), "distance": best_d.ravel()})

    return corpus.select("item_id", "embedding").mapInPandas(run, "query_id long, item_id long, distance double")


def upsert(index: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed rows replace those of the same key, new ones are added."""
    return index.join(changes.select(key), key, "left_anti").unionByName(changes.select(*index.columns))


def delete(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the given keys are removed."""
    return index.join(keys.select(key), key, "left_anti")


def distance_score(distance: Column) -> Column:
    """R6."""
    return 1 - F.least(distance / 10, F.lit(0.99))


def fuse(local: DataFrame, external: dict[str, DataFrame], max_results: int) -> DataFrame:
    """Hits (query_id, doc_id, document, source_rank; local ones with distance) of all sources, best first.

    External hits get their source's constant score; ties keep the order of the sources and the rank within them.
    """
    columns = ["query_id", "source", "doc_id", "document", "score", "source_rank"]
    hits = [local.withColumn("source", F.lit("local")).withColumn("score", distance_score(F.col("distance"))).select(columns)]
    hits += [df.withColumn("source", F.lit(s)).withColumn("score", F.lit(EXTERNAL_SCORES[s])).select(columns) for s, df in external.items()]
    union = reduce(DataFrame.unionByName, hits).where("document is not null and document <> ''")
    order = F.element_at(F.create_map(*(x for i, s in enumerate(SOURCE_ORDER) for x in (F.lit(s), F.lit(i)))), F.col("source"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), order, "source_rank")
    return union.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_results)


def context_text(hits: DataFrame) -> DataFrame:
    """Per query, the ranked documents under numbered labels."""
    labels = F.create_map(*(x for s, t in CONTEXT_LABELS.items() for x in (F.lit(s), F.lit(t))))
    part = F.concat(
        F.lit("["), F.coalesce(F.element_at(labels, F.col("source")), F.lit("Document")), F.lit(" "), F.col("rank"), F.lit("]\n"), F.col("document"),
        F.lit("\n")
    )
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))  # max_results per query
    return ranked.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("context"))


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def article_text() -> Column:
    """Text of an article row (title, authors, journal, pub_year, pubmed_id, abstract)."""
    return F.concat(
        F.lit("Title: "), _or_empty("title"), F.lit("\nAuthors: "), F.coalesce(F.array_join("authors", ", "), F.lit("")), F.lit("\nJournal: "),
        _or_empty("journal"), F.lit(" ("), _or_empty("pub_year"), F.lit(")\nPubMed ID: "), _or_empty("pubmed_id"), F.lit("\n\nAbstract:\n"),
        _or_empty("abstract"), F.lit("\n")
    )


def trial_text() -> Column:
    """Text of a trial row."""
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    lines = F.array_join(
        F.transform(
            "interventions",
            lambda x: F.concat(F.lit("- "), F.coalesce(x["intervention_type"], F.lit("")), F.lit(": "), F.coalesce(x["intervention_name"], F.lit("")))
        ),
        "\n"
    )
    parts = [
        ("Title: ", _or_empty("title")), ("\nNCT ID: ", _or_empty("nct_id")), ("\nStatus: ", _or_empty("status")), ("\nPhase: ", joined("phase")),
        ("\n\nConditions: ", joined("conditions")), ("\n\nInterventions:\n", F.coalesce(lines, F.lit(""))),
        ("\n\nBrief Summary:\n", _or_empty("brief_summary")), ("\n\nDetailed Description:\n", _or_empty("detailed_description")),
        ("\n\nEligibility Criteria:\n", _or_empty("eligibility_criteria"))
    ]
    return F.concat(*(x for t, c in parts for x in (F.lit(t), c)), F.lit("\n"))


def expand_query(query: Column) -> Column:
    """Known terms are widened; the condition looks at the query in lower case, the replacement at the text as it is."""
    out = query
    for term, wider in QUERY_TERMS:
        out = F.when(F.lower(query).contains(term), F.replace(out, F.lit(term), F.lit(f"({wider})"))).otherwise(out)
    return out


def failover(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """The fallback's rows for the keys of which the primary has none."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti").select(*primary.columns))


def normalise_terms(text: Column) -> Column:
    """Abbreviations are written out."""
    return replace_chain(text, ABBREVIATIONS, regex=True)


def sections(text: Column) -> Column:
    """Map of the sections that are found."""
    every = F.create_map(*(x for n, p in SECTIONS for x in (F.lit(n), F.when(text.rlike(p), trimmed(F.regexp_extract(text, p, 1))))))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def process_documents(df: DataFrame, abstract: str) -> DataFrame:
    """Normalised abstract, and the sections of the abstract as it was."""
    return df.withColumn("sections", sections(F.col(abstract))).withColumn(abstract, normalise_terms(F.col(abstract)))
