"""State that is bounded and restored, sessions, late rows, the log of rules, sketches, counters, pictures of places."""

import pytest
from pyspark.sql import functions as F
from siftline.operators import recognizers as rec
from siftline.operators import tagger
from siftline.plans.scan import Options, findings, scan
from siftline.sinks import report
from siftline.streaming import triage

MAIL = Options(recognizers=rec.by_entity("EMAIL_ADDRESS", "URL"))
SEEN = "file string, entity_type string, text string, ts timestamp"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, triage.ROCKSDB)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def put(spark, folder, *rows):
    data = [(f, "EMAIL_ADDRESS", x, f"2024-01-01 {t}") for f, x, t in rows]
    spark.createDataFrame(data, SEEN.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_first_in_a_while_restarts_and_forgets(spark, tmp_path, rocksdb):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"

    def run():
        df = triage.first_in_a_while(triage.table_stream(spark, src, SEEN, 1), "ts", 3600, "10 minutes")
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    put(spark, src, ("f", "a@b.org", "00:10:00"), ("f", "a@b.org", "00:40:00"), ("g", "a@b.org", "00:20:00"), ("f", "a@b.org", "01:30:00"))
    run()
    put(spark, src, ("f", "a@b.org", "02:20:00"))  # within an hour of the last one, which only the checkpoint knows
    put(spark, src, ("h", "x@b.org", "09:00:00"))
    put(spark, src, ("f", "a@b.org", "10:00:00"), ("h", "late@b.org", "01:00:00"))
    q = run()
    got = sorted((r.file, r.text, str(r.ts)[11:19]) for r in spark.read.parquet(out).collect())
    assert got == [("f", "a@b.org", "00:10:00"), ("f", "a@b.org", "10:00:00"), ("g", "a@b.org", "00:20:00"), ("h", "x@b.org", "09:00:00")]
    states = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert states[-1] <= 4 and sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) >= 1


def test_sessions_of_tables_and_streams(spark, tmp_path):
    rows = [("f", "a", "00:00:00"), ("f", "b", "00:09:00"), ("f", "c", "00:30:00"), ("g", "a", "00:05:00")]
    put(spark, f"{tmp_path}/in", *rows)
    key = lambda df: sorted((r.file, str(r.started)[11:16], str(r.ended)[11:16], r.n) for r in df.collect())
    want = [("f", "00:00", "00:19", 2), ("f", "00:30", "00:40", 1), ("g", "00:05", "00:15", 1)]
    assert key(triage.sessions(spark.read.parquet(f"{tmp_path}/in"), "ts", "10 minutes")) == want
    put(spark, f"{tmp_path}/in", ("z", "end", "05:00:00"))  # moves the watermark on
    put(spark, f"{tmp_path}/in", ("f", "late", "00:01:00"))
    totals = triage.StreamTotals()
    spark.streams.addListener(totals)
    try:
        df = triage.sessions(triage.table_stream(spark, f"{tmp_path}/in", SEEN, 1), "ts", "10 minutes", delay="1 minute")
        q = df.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        late = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
        assert key(spark.table("sessions")) == want and late == 1
    finally:
        spark.streams.removeListener(totals)


def test_the_log_of_rules(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    log = triage.RuleLog(spark, f"file://{tmp_path}/log")
    assert log.rules().count() == 0
    got: list = []
    keep = lambda left, n: got.extend(sorted(r.text for r in left.collect()))
    run = lambda: triage.triage_to_log(triage.file_stream(spark, f"file://{src}"), f"file://{tmp_path}/state", log, keep, True, options=MAIL).awaitTermination()
    (src / "a[1].txt").write_text("a@b.org and A@b.org")
    run()
    assert got == ["A@b.org", "a@b.org"]
    (src / "b.txt").write_text("a@b.org")
    run()
    assert got[2:] == ["a@b.org"] and log.rules().count() == 3
    again = log.rules().collect()
    left = spark.createDataFrame([("b.txt", 1, 0, 7, "EMAIL_ADDRESS", "a@b.org", 1.0)], "file string, line_num int, col_start int, col_end int, entity_type string, text string, score float")
    log.put(report.accepted_rules(left), 1)
    assert log.rules().count() == len(again)  # a batch that runs again adds nothing
    assert triage.RuleTable(log.rules(1)).suppressed(left).first().suppressed is False
    many = spark.range(100_000).selectExpr("concat('f', id) file", "1 line_num", "0 col_start", "5 col_end", "'URL' entity_type", "concat('t', id) text", "cast(1 as float) score")
    log.put(report.accepted_rules(many), 7)
    assert triage.RuleTable(log.rules()).suppressed(many).filter("suppressed").count() == 100_000


def test_sketches_merge(spark):
    rows = spark.range(60_000).selectExpr("id % 3 as day", "'URL' as entity_type", "concat(repeat('x', cast(id % 100 as int)), id % 20000) as text")
    stored = report.sketched(rows, "day")
    got = report.merged_sketches(stored, "entity_type").first()
    assert got.n == 60_000 and abs(got.n_texts - 20_000) < 1000 and abs(got.median_length - 55) <= 4 and abs(got.p99_length - 104) <= 3


def test_totals_without_a_second_scan(spark, tmp_path):
    docs = spark.createDataFrame([("f", "a@b.org x@y.org"), ("g", None), ("h", "none")], "file string, text string")
    outcomes, seen = report.observed(scan(docs, options=MAIL))
    findings(outcomes).write.format("noop").mode("overwrite").save()
    assert seen.get == {"files_scanned": 2, "files_skipped": 1, "findings": 2, "ignored": 0}
    docs.write.parquet(f"{tmp_path}/in")
    totals = triage.StreamTotals()
    spark.streams.addListener(totals)
    try:
        stream, _ = report.observed(scan(triage.table_stream(spark, f"{tmp_path}/in", docs.schema), options=MAIL), "totals")
        q = findings(stream).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert q.recentProgress[0]["observedMetrics"]["totals"] is not None
    finally:
        spark.streams.removeListener(totals)


def test_pictures_of_places(spark):
    docs = spark.createDataFrame([("d/f.txt", "one\n  two\n\tmail a@b.org now\nfour\nfive\nsix\nseven")], "file string, text string")
    found = findings(scan(docs, options=Options(recognizers=MAIL.recognizers, context=3)), 3)
    assert report.diagnostics(found).first().value.split("\n") == ["  ┌─ d/f.txt:3:7", "1 │ one", "2 │ two", "3 │ mail a@b.org now", "  ·         ▲", "  ·         └── EMAIL_ADDRESS (σ 1.0)", "4 │ four", "5 │ five", "6 │ six"]


def test_custom_rules():
    assert report.custom_rule("URL", "*.x.org").text == "*.x.org" and report.custom_rule("URL", "^h", True).match == "^h"
    with pytest.raises(ValueError):
        report.custom_rule("URL", "")


def test_a_line_that_a_model_fails_on_is_alone_and_counted(spark):
    def load():
        def predict(lines):
            if any("bad" in x for x in lines):
                raise ValueError("no")
            return [[(0, 2, "PERSON", x[:2], 0.9)] for x in lines]

        return predict

    text = "\n".join(["bad one" if k == 7 else f"Name{k} and {'x' * k}" for k in range(40)])
    out = scan(spark.createDataFrame([("f", text), ("g", "fine line")], "file string, text string"), options=Options(recognizers=()), tagger=tagger.model_tagger(load), confirm=False)
    got = {r.file: (len(r.findings), r.failed_lines) for r in out.collect()}
    assert got == {"f": (39, 1), "g": (1, 0)}
