import datetime as dt
import json

from pyspark.sql import functions as F

from siltstone.sources import files


def one(spark, body):
    return spark.createDataFrame([(json.dumps(body),), (None,), ("not json",)], "b string")


def test_works(spark):
    work = {
        "title": "T", "doi": "https://doi.example/10.1/ABC", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"b": [1], "a": [0]},
        "primary_location": {"landing_page_url": "http://x.example/arxiv.2101.00001", "pdf_url": "http://p", "source": {"display_name": "Repo", "type": "repository"}},
        "topics": [{"field": {"display_name": n}} for n in ("A", "B", "A", "C", "D")], "authorships": [{"author": {"display_name": "N"}}],
    }
    got = files.parse_works(one(spark, {"results": [work, {"title": None}]}), "b").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.doi, r.arxiv_id, r.pdf_url, r.venue, r.fields_of_study, r.abstract, r.authors) == ("10.1/abc", "2101.00001", "http://p", None, ["A", "B", "C"], "a b", ["N"])


def test_articles_and_entries(spark):
    a = files.parse_articles(one(spark, {"articles": [{"title": "T", "publication_year": "2019", "citing_paper_count": "n/a", "authors": {"authors": [{"full_name": "N"}]}}]}), "b").first()
    assert (a.year, a.citation_count, a.authors) == (2019, None, ["N"])
    e = files.parse_entries(one(spark, {"search-results": {"entry": [{"dc:title": "T", "dc:description": "Abstract: Text here. © 2020 Press", "prism:coverDate": "2020-05-01", "citedby-count": "7"}]}}), "b").first()
    assert (e.abstract, e.year, e.citation_count) == ("Text here.", 2020, 7)


def test_figures_and_addresses(spark):
    f = files.parse_figures(spark.createDataFrame([('[{"name": "2", "caption": "c", "image_path": "p"}, {"figLabel": "Fig. 9", "renderURL": "u", "image_path": "p"}]',)], "b string"), "b").orderBy("no").collect()
    assert [(x.label, x.image_path) for x in f] == [("Figure 2", "p"), ("Fig. 9", "u")]
    u = spark.createDataFrame([("2101.1v2", None, "10.1/x")], "a string, p string, d string").select(files.candidate_urls(F.col("a"), F.col("p"), F.col("d"), "http://a/", "http://d/")).first()[0]
    assert u == ["http://a/2101.1", "http://d/10.1/x"]


def test_recent_failures(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    schema = "k string, last_seen timestamp, fetcher_version int"
    stored = spark.createDataFrame([("a", day(9), 2), ("b", day(1), 2), ("c", day(9), 1), ("d", day(9), 2)], schema)
    memory = spark.createDataFrame([("d", day(2), 2), ("e", day(10), 3)], schema)
    got = sorted(r.k for r in files.recent_failures(stored, memory, "k", "2025-01-10", 3, 2).collect())
    assert got == ["a", "e"]
