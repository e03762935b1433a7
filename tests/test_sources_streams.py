import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.operators import analytics
from eventloom.sources import calendar_source, connectors
from eventloom.streaming import incremental

T0 = dt.datetime(2026, 7, 15, 12)


def test_calendar_source(spark, tmp_path):
    (tmp_path / "a.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Rust\r\n  day\\, one\r\nURL:https://x.example.com\r\nDTSTART;VALUE=DATE:20260901\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    (tmp_path / "b.txt").write_text("no calendar")
    calendar_source.register(spark)
    got = spark.read.format("icalendar").load(str(tmp_path)).collect()
    assert [(r.file, r.summary, r.dtstart, r.dtend) for r in got] == [("a.ics", "Rust day, one", "20260901", None)]


def test_provider_stream_matches_batch(spark, tmp_path):
    rows = [("p", i, T0 + dt.timedelta(minutes=i), ok, float(i)) for i, ok in enumerate([True, False, True, False, False, False])] + [("q", 9, T0, True, 4.0)]
    runs = spark.createDataFrame(rows, "provider string, run_id int, at timestamp, ok boolean, found double")
    for part in (runs.filter("run_id < 3 or run_id = 9"), runs.filter("run_id between 3 and 5")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen: dict = {}
    s = incremental.provider_stream(incremental.stream(spark, str(tmp_path / "log"), runs.schema))
    incremental.run_available(s, str(tmp_path / "cp"), lambda b, n: seen.update({r.provider: (r.runs, r.successes, r.streak, r.circuit) for r in b.collect()}))
    batch = {r.provider: (r.runs, r.successes, r.streak, r.circuit) for r in analytics.provider_state(runs).collect()}
    assert seen == batch == {"p": (6, 2, 3, "open"), "q": (1, 1, 0, "closed")}


def test_fold_backs_off():
    s = incremental.fold_runs(None, [(T0, False, 0.0)])
    assert s[5] == T0 + dt.timedelta(seconds=60)
    s = incremental.fold_runs(s, [(T0, False, 0.0)])
    assert s[5] == T0 + dt.timedelta(seconds=120)


def test_crawl_once(spark, tmp_path):
    pages = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(hours=1)), ("b", T0)], "url string, at timestamp")
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    seen: list = []
    s = incremental.crawl_once(incremental.stream(spark, str(tmp_path / "p"), pages.schema))
    incremental.run_available(s, str(tmp_path / "cp"), lambda b, n: seen.extend(r.url for r in b.collect()), mode="append")
    assert sorted(seen) == ["a", "b"]


def _catalog(spark, path, rows, n):
    from eventloom.streaming.ledger import Catalog
    from tests.test_operators import frame

    return Catalog(spark, path, 4).apply(frame(spark, *rows), n, F.col("last_seen_at"))


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_batches_take_effect_once_and_keep_other_buckets(spark, tmp_path):
    from eventloom.streaming.ledger import Catalog
    from tests.test_operators import row

    path = str(tmp_path / "cat")
    assert _catalog(spark, path, [row(k) for k in "abcdefgh"], 0)
    before = _files(tmp_path)
    assert _catalog(spark, path, [row("a", content_hash="2"), row("z")], 1)
    assert not _catalog(spark, path, [row("a", content_hash="3")], 1)  # a replay
    cat = Catalog(spark, path, 4)
    assert {r.key: r.version for r in cat.read().collect()} == {k: 2 if k == "a" else 1 for k in "abcdefghz"}
    after = _files(tmp_path)
    assert before.items() <= after.items()  # nothing was rewritten in place
    hit = {r.bucket for r in cat.ledger().filter("batch = 1").collect()}
    assert len(hit) <= 2 and {n for b, n in cat.current().items() if b not in hit} == {0}
    assert cat.vacuum() == len([1 for b in hit if b in {r.bucket for r in cat.ledger().filter("batch = 0").collect()}])
    assert {r.key: r.version for r in Catalog(spark, path, 4).read().collect()} == {k: 2 if k == "a" else 1 for k in "abcdefghz"}


def test_stream_killed_between_write_and_commit_resumes(spark, tmp_path, monkeypatch):
    from eventloom.streaming.ledger import Catalog
    from tests.test_operators import frame, row

    log, cat = tmp_path / "log", Catalog(spark, str(tmp_path / "cat"), 4)
    batches = [[row("a"), row("b")], [row("a", content_hash="2"), row("c")], [row("b", content_hash="2"), row("a", content_hash="3")]]
    for i, rows in enumerate(batches):
        frame(spark, *rows).coalesce(1).write.mode("append").parquet(str(log))
        src = incremental.stream(spark, str(log), frame(spark, *rows).schema)
        if i == 1:
            with monkeypatch.context() as m:
                m.setattr(Catalog, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
                with pytest.raises(Exception, match="killed"):
                    incremental.run_available(src, str(tmp_path / "cp"), cat.sink("last_seen_at"))
            assert {r.key: r.version for r in cat.read().collect()} == {"a": 1, "b": 1}
        incremental.run_available(src, str(tmp_path / "cp"), cat.sink("last_seen_at"))
    assert {r.key: r.version for r in cat.read().collect()} == {"a": 3, "b": 2, "c": 1}


def test_changes_of_each_batch(spark, tmp_path):
    from eventloom.streaming.ledger import Catalog
    from tests.test_operators import frame, row

    cat, seen = Catalog(spark, str(tmp_path / "cat"), 4), {}
    note = lambda df, n: seen.update({n: sorted((r.key, r.change) for r in df.collect())})
    cat.apply(frame(spark, row("a"), row("b")), 0, F.col("last_seen_at"), note)
    cat.apply(frame(spark, row("a", content_hash="2", location="Hall")), 1, F.col("last_seen_at"), note)
    assert seen == {0: [("a", "NEW"), ("b", "NEW")], 1: [("a", "UPDATED"), ("a", "VENUE_CHANGED")]}


def test_admission_stream_matches_batch(spark, tmp_path):
    from eventloom.operators import admission

    rows = [(k, i, T0 + dt.timedelta(seconds=s)) for k in "ab" for i, s in enumerate([0, 1, 2, 3, 4, 5, 5, 9, 10, 30])]
    df = spark.createDataFrame(rows, "k string, id int, at timestamp")
    for part in ("id < 4", "id between 4 and 6", "id > 6"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen: dict = {}
    s = incremental.admission_stream(incremental.stream(spark, str(tmp_path / "log"), df.schema), "k", "at", 2, "id")
    incremental.run_available(s, str(tmp_path / "cp"), lambda b, n: seen.update({(r.k, r.id): r.admitted for r in b.collect()}), mode="append")
    batch = {(r.k, r.id): r.admitted for r in admission.admitted(df, ["k"], F.col("at"), 2, "id").collect()}
    assert seen == batch and [batch["a", i] for i in range(6)] == [True, False, True, False, True, False]


def test_hackathon_period(spark):
    start, end = connectors.period(F.col("p"))
    df = spark.createDataFrame([("Sep 10 - 12, 2026",), ("Sep 28 - Oct 2, 2026",), ("Sep 10, 2026",)], "p string").select(start.alias("s"), end.alias("e"))
    assert [(r.s.day, r.e.month, r.e.day) for r in df.collect()] == [(10, 9, 12), (28, 10, 2), (10, 9, 10)]


def test_search_result_page(spark):
    html = '<a rel="x" class="result__a" href="//d.example.com/l/?uddg=https%3A%2F%2Fa.example.com%2Fx&r=1">One <b>two</b></a>'
    got = connectors.search_results(spark.createDataFrame([("q", html)], "query string, html string")).first()
    assert (got.rank, got.url, got.title) == (1, "https://a.example.com/x", "One two")
