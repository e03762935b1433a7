"""Rows with known results, independent of the engine's own tables of constants."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import parse as P
from eventloom.functions import text as T
from eventloom.functions import urls as U
from eventloom.operators import dedup, upkeep


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("Gen-AI Meetup!!!", "gen ai meetup"), ("  GenAI   MEETUP ", "genai meetup")])
def test_titles(spark, raw, want):
    assert one(spark, raw, T.normalize_title) == want


@pytest.mark.parametrize(("raw", "want"), [("https://www.lu.ma/abc/", "lu.ma/abc"), ("https://lu.ma/abc?utm=x#f", "lu.ma/abc"), ("https://LU.MA/ABC", "lu.ma/abc")])
def test_urls(spark, raw, want):
    assert one(spark, raw, U.dedup_url) == want


def test_similarity():
    assert dedup.title_ratio("genai meetup", "gen ai meetup") >= 0.85
    assert dedup.title_ratio("devops meetup", "machine learning bootcamp") < 0.6


@pytest.mark.parametrize(("raw", "want"), [("Bengaluru", "Bangalore"), ("bombay", "Mumbai"), ("New Delhi", "Delhi"), (" Kochi ", "Kochi"), ("Mysuru", "Mysuru")])
def test_cities(spark, raw, want):
    assert one(spark, raw, T.normalize_city) == want


@pytest.mark.parametrize(
    ("text", "keywords", "city", "categories", "free"),
    [
        ("free AI meetup in Pune", [], "Pune", ["meetup", "ai"], True),
        ("AI workshops in Bangalore", [], "Bangalore", ["workshop", "ai"], False),
        ("rust and C++ hackathon near New Delhi", ["rust", "c++"], "Delhi", ["hackathon"], False),
        ("machine learning conference", ["machine", "learning"], None, ["conference", "ai"], False),
        ("   ", [], None, [], False),
    ],
)
def test_parsed_queries(spark, text, keywords, city, categories, free):
    q = one(spark, text, P.parse_query)
    assert (q.keywords, q.city, q.categories, q.free_only) == (keywords, city, categories, free)


@pytest.mark.parametrize(
    ("answers", "city"),
    [(["this is not json", '{"keywords":[],"city":"Goa","categories":["workshop"],"free_only":false}'], "Goa"), (["garbage", "still garbage"], "Pune"), (['{"categories":["concert"]}'], "Pune"), (None, "Pune")],
)
def test_model_answers_and_their_fallback(spark, answers, city):
    df = spark.createDataFrame([("free AI meetup in Pune", answers)], "t string, a array<string>")
    assert df.select(P.parse_with_model(F.col("t"), F.col("a")).alias("q")).first().q.city == city


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("An a.i. night", ["Artificial Intelligence"]), ("said aloud", []), ("MLOps with K8S", ["Machine Learning", "Kubernetes"]), ("front-end & React", ["Frontend"]), ("start ups pitch", ["Startup"]),
        ("CI/CD", ["DevOps"]), ("decentralised NFTs", ["Web3"]), ("pentesting", ["Cybersecurity"]), ("carpentest", []), ("gen ai", ["Artificial Intelligence", "Generative AI"]), ("nextvr", []), ("ar / vr", ["AR/VR"]),
    ],
)
def test_topics(spark, text, want):
    assert one(spark, text, lambda c: T.labels(c, T.TOPICS)) == want


def test_scan_over_partitions(spark):
    rows = [(f"k{i:05d}",) for i in range(2300)]
    got = upkeep.scan(spark.createDataFrame(rows, "key string").repartition(7), 500)
    assert {r.key: r.batch for r in got.collect()} == {k: i // 500 for i, (k,) in enumerate(sorted(rows))}
