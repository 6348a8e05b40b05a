import pytest
from pyspark.sql import functions as F

from pressmill.functions import urls
from pressmill.operators import match
from pressmill.sources import capturelog, files
from pressmill.streaming import jobs

LOG = "20200101 http://a/ 200 text/html\n\n  20200102000000\thttp://b/é 404\nbad http://c/\n20200103 http://d/\r\n" + "20200104 http://e/" + "x" * 300 + "\n20200105 http://f/ 200 a b c\n20200106"


@pytest.mark.parametrize("tail", ["", "\n"])
def test_ranges_cut_a_log_between_lines(tmp_path, tail):
    raw = (LOG + tail).encode()
    (tmp_path / "x.log").write_bytes(raw)
    want = [line for line in raw.split(b"\n")[: -1 if tail else None]]
    for split in (1, 2, 7, 50, 1000):
        for chunk in (1, 5, 64, 4096):
            got = [(n, line) for part in capturelog.ranges(str(tmp_path / "x.log"), 0, len(raw), split) for lines, places in capturelog.lines_of(str(tmp_path), part, chunk) for line, n in zip(lines, places)]
            assert [line for _, line in got] == want, (split, chunk)
            assert all(raw[n : n + len(line)] == line for n, line in got)


def test_capture_log_fields_and_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text(LOG)
    (tmp_path / "a" / "_hidden").write_text(LOG)
    (tmp_path / "a" / "empty.log").write_text("")
    at = f"file://{tmp_path}/a"
    capturelog.register(spark)
    lines = spark.read.format("capture_log").option("splitBytes", 40).load(at)
    assert lines.rdd.getNumPartitions() > 5
    want = [
        ("20200101000000", "http://a/", "200", "text/html"), ("20200102000000", "http://b/é", "404", "text/html"), ("20200103000000", "http://d/", "200", "text/html"),
        ("20200104000000", "http://e/" + "x" * 300, "200", "text/html"), ("20200105000000", "http://f/", "200", "a"),
    ]
    assert sorted(map(tuple, match.parse_capture_lines(lines).collect())) == want == sorted(map(tuple, files.read_capture_log(spark, f"{at}/x.log").collect()))
    assert match.capture_line_counts(lines).first()[:] == (5, 2, 1)
    short = match.parse_capture_lines(spark.createDataFrame([("20200101 u",), (None,), ("",)], "value string"), status="-", mimetype="unk")
    assert [tuple(r) for r in short.collect()] == [("20200101000000", "u", "-", "unk")]
    (tmp_path / "b").mkdir()
    assert spark.read.format("capture_log").load(f"file://{tmp_path}/b").count() == 0


def test_a_stream_follows_a_growing_log(spark, tmp_path):
    log, at = tmp_path / "log", f"file://{tmp_path}"
    log.mkdir()
    steps = [("a", "20200101 http://x.com/1\n20200102 http://x.com/2\n202001"), ("a", "03 http://x.com/1\n"), ("b", "20200104 http://x.com/2\nnot a capture\n20200105 http://x.com/3"), ("b", "\n")]
    seen = []
    for name, text in steps:
        with open(log / name, "a") as f:
            f.write(text)
        jobs.latest_stream(spark, files.follow_capture_log(spark, f"{at}/log"), None, f"{at}/out", f"{at}/state", ordinal="at", fan=2).awaitTermination()
        seen.append({r["key"]: r["ts"][:8] for r in jobs.read_latest(spark, f"{at}/out", fan=2).collect()})
    one, two, three = (f"https://x.com/{n}" for n in (1, 2, 3))
    assert seen == [{one: "20200101", two: "20200102"}, {one: "20200103", two: "20200102"}, {one: "20200103", two: "20200104"}, {one: "20200103", two: "20200104", three: "20200105"}]


def _captures(n, batch):
    return [(batch * 100 + i, f"20{10 + (i * 7 + batch * 3) % 15}0101", f"http://h{(i * batch) % 9}.com/{'p' if i % 4 else ''}") for i in range(n)]


def test_the_latest_index_is_written_by_batch_and_merged_by_level(spark, tmp_path):
    at, schema, fan = f"file://{tmp_path}", "event_id long, ts string, url string", 3
    everything = []
    for n in range(10):
        rows = _captures(40, n)
        everything += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/{n}")
        jobs.latest_stream(spark, f"{at}/in/*", schema, f"{at}/out", f"{at}/state", fan=fan).awaitTermination()
        levels = [level for level, _ in jobs._live(jobs._folders(spark, f"{at}/out"), fan)]
        assert all(levels.count(level) < fan for level in levels)
        first = spark.read.parquet(f"{at}/out/level=0/first={n}")
        assert first.count() == first.select("key").distinct().count() <= 18  # the batch's own keys, not the index
    assert sorted(levels) == [0, 2]
    df = spark.createDataFrame(everything, schema)
    want = {(r["key"], r["ts"], r["url"]) for r in match.latest_capture(df, urls.canonical_key(F.col("url"))).collect()}
    assert {(r["key"], r["ts"], r["url"]) for r in jobs.read_latest(spark, f"{at}/out", fan=fan).collect()} == want
    assert jobs.read_latest(spark, f"{at}/none").count() == 0


def test_half_written_folders_of_the_index_do_not_count(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    row = lambda ts: spark.createDataFrame([("k", ts, 1, "u")], jobs.LATEST)
    for n, ts in enumerate(["2001", "2003", "2002"]):
        row(ts).write.parquet(f"{at}/level=0/first={n}")
    row("2009").write.parquet(f"{at}/level=1/first=0")
    (tmp_path / "out" / "level=1" / "first=0" / "_SUCCESS").unlink()  # the merge was killed
    assert jobs._live(jobs._folders(spark, at), 2) == [(0, 0), (0, 1), (0, 2)]
    assert jobs.read_latest(spark, at, fan=2).first()["ts"] == "2003"
    (tmp_path / "out" / "level=1" / "first=0" / "_SUCCESS").touch()
    assert jobs._live(jobs._folders(spark, at), 2) == [(1, 0), (0, 2)]
    assert jobs.read_latest(spark, at, fan=2).first()["ts"] == "2009"


PAGE = "<title>t</title><p>x</p>"


def test_a_killed_enrichment_goes_on(spark, tmp_path, monkeypatch):
    at, schema = f"file://{tmp_path}", "page_id long, html string"
    write = lambda n, ids: spark.createDataFrame([(i, PAGE) for i in ids], schema).coalesce(1).write.parquet(f"{at}/in/{n}")
    run = lambda: jobs.enrich_stream(spark, f"{at}/in/*", schema, f"{at}/out", f"{at}/state", progress=f"{at}/progress").awaitTermination()
    write(1, [1, 2, 2, None, None])
    run()
    write(2, [2, 3, None, 4])
    whole = jobs._observed

    def killed(*args, **kw):
        whole(*args, **kw)
        raise RuntimeError("killed after the write")

    monkeypatch.setattr(jobs, "_observed", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(jobs, "_observed", whole)
    run()  # the batch comes again and replaces its folder
    write(3, [4, 5])
    run()
    assert sorted((r["page_id"] for r in spark.read.parquet(f"{at}/out").collect()), key=str) == [1, 2, 3, 4, 5, None]
    assert sorted(tuple(r) for r in jobs.read_progress(spark, f"{at}/progress").collect()) == [(0, 3, 3, 0), (1, 2, 2, 0), (2, 1, 1, 0)]
    assert jobs.read_progress(spark, f"{at}/none").count() == 0


def test_the_state_of_done_pages_is_bounded_by_a_watermark(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "page_id long, at timestamp, html string"
    rows = [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-03-01"), (3, "2024-06-01"), (3, "2024-06-02")]
    for n, (i, day) in enumerate(rows):
        spark.createDataFrame([(i, day, PAGE)], "page_id long, at string, html string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{at}/in/{n}")
        jobs.enrich_stream(spark, f"{at}/in/*", schema, f"{at}/out", f"{at}/state", at="at", late="10 days").awaitTermination()
    assert sorted(r["page_id"] for r in spark.read.parquet(f"{at}/out").collect()) == [1, 2, 3]


def test_a_late_day_rewrites_its_own_folder(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "ts string, status string, mimetype string, url string"
    days = lambda n, rows: spark.createDataFrame([(ts, s, "text/html", u) for ts, s, u in rows], schema).coalesce(1).write.parquet(f"{at}/in/{n}")
    run = lambda: jobs.per_day_stream(spark, f"{at}/in/*", schema, f"{at}/out", f"{at}/state").awaitTermination()
    stored = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    one = [("20240101000000", "200", "http://a.com/x"), ("20240101010000", "503", "http://a.com/y"), ("20240102000000", "200", "http://a.com/x"), ("20240101000000", "200", "http://b.com:8/z"), ("20240101000000", "200", None)]
    days(1, one)
    run()
    before = stored()
    late = [("20240101020000", "200", "http://www.a.com/late"), ("20240105000000", "404", "http://c.com/")]
    days(2, late)
    run()
    after = stored()
    kept = {p for p in before if p in after and before[p] == after[p]}
    assert {p.split("/part-")[0] for p in before if p not in kept} == {"out/host=a.com/day=20240101"} and len(kept) == 3
    df = spark.createDataFrame([(ts, s, "text/html", u) for ts, s, u in one + late], schema)
    rows = lambda d: sorted((str(r["host"]), r["day"], r["read"], r["kept"]) for r in d.collect())
    assert rows(jobs.read_days(spark, f"{at}/out")) == rows(jobs.captures_per_day(df))
    plan = jobs.day_slices(spark, f"{at}/out").filter("day = '20240101' AND host = 'a.com'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [isnotnull(host" in plan
    assert jobs.read_days(spark, f"{at}/none").count() == 0


def test_a_listener_keeps_what_a_stream_observes(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "page_id long, html string"
    spark.createDataFrame([(i, PAGE if i % 3 else None) for i in range(9)], schema).coalesce(1).write.parquet(f"{at}/in")
    listener = jobs.ProgressTable(spark, f"{at}/table")
    spark.streams.addListener(listener)
    try:
        seen = spark.readStream.schema(schema).parquet(f"{at}/in").observe("pages", F.count("*").alias("read"), F.count_if(F.col("html").isNull()).alias("empty"))
        seen.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(60):
            if (tmp_path / "table" / "_SUCCESS").exists():
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    row = spark.read.schema(jobs.ProgressTable.SCHEMA).json(f"{at}/table").orderBy("batch").first()
    assert row["rows"] == 9 and row["observed"] == {"pages": {"read": "9", "empty": "3"}}
