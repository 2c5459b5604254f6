"""Scans of text, CSV, JSON and XML inputs, and the sources that answer searches."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import capitalised, words
from ..operators.retrieval import expand_query

ARTICLE = "pubmed_id string, title string, abstract string, journal string, year string, authors array<string>"
SEARCH_DEFAULT = 5


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file name without .txt) and whole text of every .txt file of a folder; empty if the folder is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "doc_id string, text string")
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("doc_id"), F.col("value").alias("text"))


def notes_csv(
    spark: SparkSession, path: str,
    schema: str = "row_no int, description string, medical_specialty string, sample_name string, transcription string, keywords string"
) -> DataFrame:
    """CSV with a header and quoted line breaks."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S3: one object or array of objects per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_by_key(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Files of one object keyed by id, as rows (id, item)."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("id", "item"))


def json_lines(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """JSON lines of the first path that exists."""
    for p in paths:
        if _exists(spark, p):
            return (spark.read.schema(schema) if schema else spark.read).json(p)
    raise FileNotFoundError(", ".join(paths))


def parse_articles(xml: DataFrame, column: str) -> DataFrame:
    """Article fields of PubmedArticle XML texts; only the first abstract text; authors as 'Fore Last' or 'Last'."""
    x = F.col(column)
    author = lambda a: F.trim(F.concat_ws(" ", F.when(a["fore"] != "", a["fore"]), a["last"]))
    names = F.from_xml(
        F.concat(F.lit("<l>"), F.array_join(F.regexp_extract_all(x, F.lit(r"(?s)<Author\b[^>]*>.*?</Author>"), 0), ""), F.lit("</l>")),
        "Author array<struct<LastName string, ForeName string>>"
    )
    authors = F.transform(
        F.filter(F.coalesce(names["Author"], F.array().cast("array<struct<LastName string, ForeName string>>")), lambda a: a["LastName"].isNotNull()),
        lambda a: author(F.struct(F.coalesce(a["ForeName"], F.lit("")).alias("fore"), a["LastName"].alias("last")))
    )
    # one parse gives all text fields, parted by a character that XML can't hold
    places = {
        "pubmed_id": "(//PMID)[1]", "title": "(//ArticleTitle)[1]", "abstract": "(//AbstractText)[1]", "journal": "(//Journal/Title)[1]",
        "year": "(//PubDate/Year)[1]"
    }
    told = F.split(F.xpath_string(x, F.lit("concat(" + ", '\x01', ".join(places.values()) + ")")), "\x01")
    return xml.select(told.alias("told"), authors.alias("authors")).select(*(F.get("told", F.lit(i)).alias(n) for i, n in enumerate(places)), "authors")


_TRIAL = (
    "FullStudiesResponse struct<FullStudies array<struct<Study struct<StatusModule struct<OverallStatus string>, ProtocolSection struct<IdentificationModule struct<NCTId string, BriefTitle string>, "
    "DesignModule struct<PhaseList struct<Phase array<string>>>, ConditionsModule struct<ConditionList struct<Condition array<string>>>, "
    "ArmsInterventionsModule struct<InterventionList struct<Intervention array<struct<InterventionType string, InterventionName string>>>>, "
    "DescriptionModule struct<BriefSummary string, DetailedDescription string>, EligibilityModule struct<EligibilityCriteria string>>>>>>"
)


def parse_trials(replies: DataFrame, column: str) -> DataFrame:
    """Trial fields of search replies in JSON; what is missing becomes '' or an empty list."""
    study = replies.select(F.explode(F.from_json(column, _TRIAL)["FullStudiesResponse"]["FullStudies"]).alias("s")).select(F.col("s.Study").alias("s"))
    text = lambda p: F.coalesce(F.col(f"s.{p}"), F.lit(""))
    listed = lambda p: F.coalesce(F.col(f"s.ProtocolSection.{p}"), F.array().cast("array<string>"))
    kinds = "array<struct<intervention_type string, intervention_name string>>"
    return study.select(
        text("ProtocolSection.IdentificationModule.NCTId").alias("nct_id"), text("ProtocolSection.IdentificationModule.BriefTitle").alias("title"), text("StatusModule.OverallStatus").alias("status"),
        listed("DesignModule.PhaseList.Phase").alias("phase"), listed("ConditionsModule.ConditionList.Condition").alias("conditions"),
        F.coalesce(F.col("s.ProtocolSection.ArmsInterventionsModule.InterventionList.Intervention").cast(kinds), F.array().cast(kinds)).alias("interventions"),
        text("ProtocolSection.DescriptionModule.BriefSummary").alias("brief_summary"), text("ProtocolSection.DescriptionModule.DetailedDescription").alias("detailed_description"), text("ProtocolSection.EligibilityModule.EligibilityCriteria").alias("eligibility_criteria"))


def trial_by_id(trials: DataFrame, nct_id: str) -> DataFrame:
    """S10."""
    return trials.where(F.col("nct_id") == nct_id).limit(1)


def fetch_articles(ids: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Articles of the given pubmed_id rows."""
    return snapshot.join(ids.select("pubmed_id").distinct(), "pubmed_id", "left_semi")


def cache_key(query: Column, max_results: Column | None = None, by_id: bool = False) -> Column:
    """Key of a cached reply; unlike a key of the query alone it holds the number of results asked for."""
    key = F.concat(F.lit("id_" if by_id else "query_"), F.regexp_replace(query, r"[^\p{L}\p{N}]", "_"))
    return key if max_results is None else F.concat(key, F.lit("_"), max_results.cast("string"))


# The texts of the two simulated sources.


def mock_articles(questions: DataFrame, k: int) -> DataFrame:
    """K simulated articles per question (question_id, question), rank from 0."""
    q = F.coalesce(F.get(words(F.col("question")), F.lit(0)), F.lit(""))
    i = F.col("rank")
    return questions.select("question_id", "question", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rank")).select(
        "question_id", "rank", (30000000 + i).cast("string").alias("pmid"), F.concat(F.lit("Recent advances in "), q, F.lit(" research")).alias("title"),
        F.concat(F.lit("This is a simulated abstract about "), "question", F.lit(". It contains information about treatments, diagnoses, and patient outcomes. The research was conducted at Major Medical Center with 50 participants. Results show promising outcomes for patients with various conditions.")).alias("abstract"),
        (2020 + i % 5).cast("string").alias("year"), F.lit("Smith J, Johnson A, Williams B").alias("authors"), F.lit("Journal of Medical Research").alias("journal"))


def fallback_articles(questions: DataFrame, k: int) -> DataFrame:
    """K mock articles per question, for when no source answers."""
    i = F.col("rank")
    return questions.select("question_id", "question", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rank")).select(
        "question_id", "rank", F.concat(F.lit("MOCK"), i + 1).alias("pmid"), F.concat(F.lit("Research on "), capitalised(F.col("question")), F.lit(" - Study "), i + 1).alias("title"),
        F.concat(F.lit("This is a mock abstract for testing purposes. It discusses "), "question", F.lit(" and related medical concepts. Some studies show promising results for patients with this condition. Treatment options vary depending on patient characteristics.")).alias("abstract"),
        (2020 + i % 5).cast("string").alias("year"), F.lit("Mock Author A, Mock Author B").alias("authors"), F.lit("Journal of Mock Medical Research").alias("journal"))


def search_terms(questions: DataFrame) -> DataFrame:
    """The widened query that a live search would be sent."""
    return questions.select("question_id", expand_query(F.col("question")).alias("term"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str) -> tuple:
    """(file system, place) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _SnapshotReader(DataSourceReader):
    def __init__(self, path: str, query: list[str], most: int, gap: float):
        self.path, self.query, self.most, self.gap = path, query, most, gap

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, place = _files(self.path)
        if store.get_file_info(place).type == fs.FileType.File:
            return [_File(self.path)]
        found = [f.path for f in store.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")]
        head = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        return [_File(head + f) for f in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The best `most` of a file: most words of the query first, ties by id."""
        import heapq

        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        Spacer(self.gap).wait()
        store, place = _files(partition.path)
        best: list[tuple[int, str]] = []
        for batch in pq.ParquetFile(store.open_input_file(place)).iter_batches(columns=["pubmed_id", "title", "abstract"]):
            text = pc.utf8_lower(pc.binary_join_element_wise(*(pc.fill_null(batch.column(c), "") for c in ("title", "abstract")), " "))
            hits = [pc.match_substring(text, w).to_numpy(zero_copy_only=False) for w in self.query]
            told = sum((h.astype(int) for h in hits), 0 * hits[0].astype(int)) if hits else []
            best = heapq.nsmallest(self.most, best + [(-int(n), i) for n, i in zip(told, batch.column("pubmed_id").to_pylist()) if n and i is not None])
        yield from ((i, -n) for n, i in best)


class ArticleSearch(DataSource):
    """A search over an offline snapshot of articles; columns pubmed_id, hits (words of the query that an article holds).

    Options: path (Parquet file or folder, of any file system that Arrow knows), query, most (rows of each file at most), gap
    (seconds between requests, S12). search_articles() registers it and keeps the best of all files.
    """

    @classmethod
    def name(cls) -> str:
        return "article_search"

    def schema(self) -> str:
        return "pubmed_id string, hits int"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _SnapshotReader(o["path"], o.get("query", "").lower().split(), int(o.get("most", SEARCH_DEFAULT)), float(o.get("gap", 0)))


def search_articles(spark: SparkSession, path: str, query: str, most: int = SEARCH_DEFAULT, gap: float = 0.0) -> DataFrame:
    """pubmed_id and hits of the `most` articles of a snapshot that hold most words of the query, ties by id."""
    spark.dataSource.register(ArticleSearch)
    options = {"path": path, "query": query, "most": str(most), "gap": str(gap)}
    return spark.read.format("article_search").options(**options).load().orderBy(F.desc("hits"), "pubmed_id").limit(most)


def bulk_download(terms: list[str], snapshot: DataFrame, most: int = 100) -> DataFrame:
    """Pmid, title, abstract and query of the articles that hold most words of each term, `most` per term, ties by id.

    Terms are a control list. Articles meet them by the words of the terms only, in one pass over the snapshot.
    """
    spark = snapshot.sparkSession
    asked = [(t, w) for t in dict.fromkeys(terms) for w in dict.fromkeys(t.lower().split())]
    wanted = F.broadcast(spark.createDataFrame(asked, "query string, word string"))  # the words of the terms
    once = snapshot.where("pubmed_id is not null").groupBy("pubmed_id").agg(
        F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"))).alias("a")
    )
    text = F.lower(F.concat_ws(" ", "a.title", "a.abstract"))
    held = once.select("pubmed_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), 0))).alias("word")).join(wanted, "word")
    hits = held.groupBy("query", "pubmed_id").agg(F.count("*").alias("hits"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hits"), "pubmed_id"))
    top = hits.withColumn("at", best).where(F.col("at") <= most)
    return top.join(once, "pubmed_id").select(F.col("pubmed_id").alias("pmid"), "a.title", "a.abstract", "query")


class Spacer:
    """Waits so that the requests of one Python process are at least `gap` seconds apart."""

    _last = 0.0

    def __init__(self, gap: float):
        self.gap = gap

    def wait(self) -> None:
        rest = Spacer._last + self.gap - time.monotonic()
        if Spacer._last and rest > 0:
            time.sleep(rest)
        Spacer._last = time.monotonic()
