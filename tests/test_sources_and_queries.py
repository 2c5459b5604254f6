import json
import math
import time
import uuid
from decimal import Decimal
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from medlattice import cli
from medlattice.config import load_config
from medlattice.functions.registry import register
from medlattice.plans import ORACLE, QUERIES, reference
from medlattice.session import drop_materialised, materialise, shared_dir, spread
from medlattice.sources import readers as S
from medlattice.sources import sinks as K
from medlattice.streaming.streams import leakage_by_window, redact_stream

SMALL = "/root/testdata/sf0.001"


def test_text_folder(spark, tmp_path):
    (tmp_path / "a.b.txt").write_text("one\ntwo")
    (tmp_path / "c.md").write_text("no")
    assert [tuple(r) for r in S.text_corpus(spark, str(tmp_path)).collect()] == [("a.b", "one\ntwo")]
    assert S.text_corpus(spark, str(tmp_path / "none")).count() == 0


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "n.csv").write_text('row_no,description,medical_specialty,sample_name,transcription,keywords\n0,d,s,n,"a ""b""\nc",k\n')
    assert S.notes_csv(spark, str(tmp_path / "n.csv")).first().transcription == 'a "b"\nc'
    (tmp_path / "k.json").write_text(json.dumps({"1": {"q": "x"}, "2": {"q": "y"}}))
    assert sorted((r.id, r.item.q) for r in S.json_by_key(spark, str(tmp_path / "k.json"), "struct<q string>").collect()) == [("1", "x"), ("2", "y")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert S.json_lines(spark, [str(tmp_path / "dev.jsonl"), str(tmp_path / "l.jsonl")]).count() == 2
    with pytest.raises(FileNotFoundError):
        S.json_lines(spark, [str(tmp_path / "dev.jsonl")])
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert S.json_documents(spark, str(tmp_path / "d.json"), "a int").count() == 2


def test_article_xml(spark):
    x = "<PubmedArticle><PMID>5</PMID><ArticleTitle>T</ArticleTitle><AbstractText>one</AbstractText><AbstractText>two</AbstractText><AuthorList><Author><LastName>Bell</LastName><ForeName>Ann</ForeName></Author><Author><LastName>Solo</LastName></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></PubmedArticle>"
    r = S.parse_articles(spark.createDataFrame([(x,)], "x string"), "x").first()
    assert (r.pubmed_id, r.abstract, r.year, r.authors) == ("5", "one", "", ["Ann Bell", "Solo"])


def test_search_source(spark, tmp_path):
    pq.write_table(pa.table({"pubmed_id": ["1", "2"], "title": ["gout", None], "abstract": [None, "rest and gout cure"]}), tmp_path / "a.parquet")
    spark.dataSource.register(S.ArticleSearch)
    got = spark.read.format("article_search").option("path", str(tmp_path)).option("query", "gout cure").load()
    assert {r.pubmed_id: r.hits for r in got.collect()} == {"1": 1, "2": 2}
    pq.write_table(pa.table({"pubmed_id": [f"9{i}" for i in range(20)], "title": ["gout"] * 20, "abstract": ["cure"] * 20}), tmp_path / "b.parquet")
    assert [r.pubmed_id for r in S.search_articles(spark, f"file://{tmp_path}", "gout cure", 3).collect()] == ["2", "90", "91"]
    assert S.search_articles(spark, str(tmp_path / "a.parquet"), "gout", 5).count() == 2 and S.search_articles(spark, str(tmp_path), "", 5).count() == 0


def test_spacing_of_requests():
    began = time.monotonic()
    for _ in range(3):
        S.Spacer(0.05).wait()
    assert time.monotonic() - began >= 0.1


def test_bulk_download(spark):
    rows = [
        ("1", "Gout in adults", "cure of gout"), ("2", None, "gout"), ("3", "cure", None), (None, "gout cure", "x"),
        ("1", "Gout in adults", "cure of gout")
    ]
    got = S.bulk_download(["gout cure", "none at all"], spark.createDataFrame(rows, "pubmed_id string, title string, abstract string"), 2)
    assert sorted((r.pmid, r.query) for r in got.collect()) == [("1", "gout cure"), ("2", "gout cure")]


def test_trial_status_comes_from_the_status_module(spark):
    reply = {
        "FullStudiesResponse": {
            "FullStudies": [
                {"Study": {"StatusModule": {"OverallStatus": "Recruiting"}, "ProtocolSection": {"IdentificationModule": {"NCTId": "NCT1"}}}},
                {"Study": {}}
            ]
        }
    }
    got = S.parse_trials(spark.createDataFrame([(json.dumps(reply),), ("no json",), (None,)], "reply string"), "reply").collect()
    assert sorted((r.nct_id, r.status, r.phase) for r in got) == [("", "", []), ("NCT1", "Recruiting", [])]
    assert S.trial_by_id(spark.createDataFrame([("a", 1), ("b", 2)], "nct_id string, x int"), "b").first().x == 2


def test_tables_of_an_application_lie_in_its_own_folder(spark):
    kept = materialise(spark.range(3), "kept")
    assert spark.sparkContext.applicationId in kept.inputFiles()[0] and kept.count() == 3
    other = Path(shared_dir(spark).removeprefix("file://")) / f"medlattice/another-{uuid.uuid4().hex}"
    other.mkdir(parents=True)
    try:
        drop_materialised(spark)
        assert other.exists() and not Path(kept.inputFiles()[0].removeprefix("file://")).exists()
    finally:
        other.rmdir()


def test_small_inputs_are_dealt_out_without_a_job(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert "RoundRobin" in spread(small)._jdf.queryExecution().toString()
    rows = spark.createDataFrame([(1,)], "a int")
    assert "RoundRobin" not in spread(rows)._jdf.queryExecution().toString()  # of unknown size: left alone


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 'x "y"\nz'), ("test", "b", None)], "split string, type string, t string")
    K.write_json(df, str(tmp_path / "j"), ["split", "type"])
    assert (tmp_path / "j/split=train/type=a").is_dir() and spark.read.json(str(tmp_path / "j")).count() == 2
    K.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').where("split = 'train'").first().t == 'x "y"\nz'
    K.write_texts(df, "t", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 1
    index = spark.createDataFrame([(1, "t", [0.5])], "item_id long, text string, embedding array<double>")
    K.save_index(index, str(tmp_path / "i"), "m")
    got, model = K.load_index(spark, str(tmp_path / "i"))
    assert model == "m" and got.collect() == index.collect()
    with pytest.raises(FileNotFoundError):
        K.load_index(spark, str(tmp_path / "none"))


def test_streams(spark, tmp_path):
    spark.createDataFrame(
        [("a@b.org", "2020-01-01 00:01:00"), ("x", "2020-01-01 00:02:00")], "t string, at string"
    ).selectExpr("t", "timestamp(at) at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string, at timestamp").parquet(str(tmp_path / "in"))
    q = redact_stream(stream, "t").writeStream.format("memory").queryName("redacted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) c from redacted where redacted like '[REDACTED EMAIL]%'").first().c == 1
    q = leakage_by_window(stream, "t", "at").writeStream.outputMode("complete").format("memory").queryName("leaks").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.texts, r.matches) for r in spark.sql("select * from leaks").collect()] == [(2, 1)]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select * from pii_matches('a@b.org and 555-123-4567', 'minimal')").count() == 2
    assert spark.sql("select sequence_ratio('abcd', 'bcde') r").first().r == 0.75


def test_config_and_cli(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text('{"privacy": {"filtering_level": "strict", "odd": 1}, "other": {}}')
    assert load_config(str(tmp_path / "c.json")).privacy.filtering_level == "strict" and load_config().retrieval.max_results == 5
    cli.main(["ask", "What treatments help gout?"])
    assert "Based on the medical literature" in capsys.readouterr().out
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("mail a@b.org")
    cli.main(["redact", str(tmp_path / "in"), str(tmp_path / "out")])
    assert "REDACTED EMAIL" in spark.read.json(str(tmp_path / "out")).first().text
    cli.main(["refine", str(tmp_path / "in"), str(tmp_path / "out2")])
    assert spark.read.json(str(tmp_path / "out2/metadata")).first().is_safe and spark.read.text(str(tmp_path / "out2/texts")).first().value == "mail [email]"
    cli.main(["build", str(tmp_path / "in"), str(tmp_path / "index")])
    (tmp_path / "q.json").write_text(
        '[{"question_id": "1", "question": "Which mail is it?", "exact_answer": "yes", "ideal_answer": "a mail", "type": "yesno", "source": "s"}]'
    )
    cli.main(["qa", str(tmp_path / "index"), str(tmp_path / "q.json"), str(tmp_path / "qa")])
    assert "According to" in spark.read.json(str(tmp_path / "qa")).first().answer
    cli.main(["pipeline", str(tmp_path / "in"), str(tmp_path / "q.json"), str(tmp_path / "run")])
    assert spark.read.json(str(tmp_path / "run/report")).first().privacy_protection in ("High", "Medium", "Low")
    assert spark.read.json(str(tmp_path / "run/accuracy")).where("level = 'overall'").first().questions == 1


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) if not math.isnan(v) else "nan"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    rel = con.execute(ORACLE[name])
    columns = [c[0] for c in rel.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(x) for x in r]) for r in rel.fetchall())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_clinical_operators_read_whole_records(spark):
    records = spark.read.parquet(f"{SMALL}/records.parquet")
    for name in ("pv3_record_redact_minimal", "pv3_record_redact_strict", "pv4_record_assessment_types", "pv5_record_similarity", "e1_record_entities"):
        assert QUERIES[name](spark, SMALL).count() == records.count()
    assert QUERIES["pv12_record_refine"](spark, SMALL).count() == records.where("content is not null").count() == QUERIES["pv13_record_summary"](spark, SMALL).first().total_documents
    assert QUERIES["pv14_record_protection"](spark, SMALL).where("original_count > 0").count() > 0 and QUERIES["pv15_record_comparison"](spark, SMALL).count() == 2 * records.count()


def test_every_article_survives_xml(spark, tmp_path):
    rows = [
        ("1", "a < b & c > d", "one\r\ntwo\rthree &amp; <b>", "J & K", "2020", ["O'Neil & <Son>"]), ("2", "plain", None, None, None, None),
        ("3", None, "x\ty", "J", "2021", [])
    ]
    spark.createDataFrame(
        rows, "pubmed_id string, title string, abstract string, journal string, pub_year string, authors array<string>"
    ).write.parquet(str(tmp_path / "articles.parquet"))
    got = sorted(tuple(r) for r in QUERIES["s7_parse_articles"](spark, str(tmp_path)).collect())
    assert got == [(i, t or "", a or "", j or "", y or "", n[0] if n else "") for i, t, a, j, y, n in rows]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_attack_rate_is_of_the_answers_attacked(spark):
    row = QUERIES["e16_attack_rate"](spark, SMALL).first()
    answers = reference._answers(spark, SMALL).count()
    assert 0 < row.exact_matches <= answers and row.success_rate == round(row.exact_matches / answers * 100, 6)
