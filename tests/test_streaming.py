import random

import pandas as pd
from pyspark.sql import functions as F

from gaugeworks.streaming import meter as M


def brute(rows, budget):
    spent, out = {}, []
    for trial, seq, tokens in sorted(rows):
        ok = spent.get(trial, 0) < budget
        spent[trial] = spent.get(trial, 0) + (tokens if ok else 0)
        out.append((trial, seq, ok, float(spent[trial])))
    return out


ROWS = [(t, s, float((t * 7 + s * 13) % 40)) for t in range(4) for s in range(30)]
SCHEMA = "trial long, seq long, tokens double"


def test_batch_admission(spark):
    got = sorted(tuple(r) for r in M.admission_batch(spark.createDataFrame(ROWS, SCHEMA), 200.0).collect())
    assert got == brute(ROWS, 200.0)


def test_stream_admission_keeps_state_over_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([r for r in ROWS if r[1] // 10 == k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = M.admission_stream(stream, 200.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(ROWS) and {r.trial for r in got} == {0, 1, 2, 3}
    after = {(t, s): spent for t, s, _, spent in brute(ROWS, 200.0)}
    want = [(t, s, ok, after.get((t, s - 1), 0.0)) for t, s, ok, _ in brute(ROWS, 200.0)]
    assert sorted(tuple(r) for r in got) == want


def test_publication_keeps_the_last_row_of_each_key(spark, tmp_path):
    batches = [[("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], [("b", 2, 3), ("b", 3, 2)], [("c", 9, 4), ("a", 0, 1)], [("a", 5, 9)]]
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "case string, v int, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("case string, v int, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        M.publish(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "case", "n", buckets=4).awaitTermination()
        seen.append({r["case"]: r.v for r in M.published(spark, str(tmp_path / "out")).collect()})
    assert seen == [{"a": 2, "b": 1}, {"a": 2, "b": 2}, {"a": 2, "b": 2, "c": 9}, {"a": 5, "b": 2, "c": 9}]
    # only the latest index and what it or the one before names is kept
    assert M.published(spark, str(tmp_path / "none")) is None
    assert not (tmp_path / "out/data/epoch=0").exists() or len(list((tmp_path / "out/data/epoch=0").glob("bucket=*"))) < 2


def plain_meter(events, budget):
    """What the meter tells, from lists."""
    out, accounts = [], {}
    for e in sorted(events, key=lambda e: (e[0], e[1])):
        trial, seq, request, kind, reserve, generates, tokens, read, ok, at = e
        a = accounts.setdefault(trial, {"spent": 0.0, "held": {}, "refused": 0, "most": 0, "unread": 0, "hit": None})
        admitted = None
        if kind == "start":
            admitted = a["spent"] + sum(r for r, _ in a["held"].values()) < budget
            if admitted:
                a["held"][request] = (reserve, generates)
            a["refused"] += not admitted
            a["most"] = max(a["most"], len(a["held"]))
        elif request in a["held"]:
            _, g = a["held"].pop(request)
            a["spent"] += tokens
            a["unread"] += g and ok and not read
            a["hit"] = at if a["hit"] is None and a["spent"] >= budget else a["hit"]
        out.append((trial, seq, admitted, a["spent"], sum(r for r, _ in a["held"].values()), a["refused"], a["most"], a["unread"], a["hit"]))
    return out


def meter_events():
    rng = random.Random(5)
    events = []
    for trial in range(5):
        seq, open_, n = 0, [], 0
        for _ in range(60):
            seq += 1
            if open_ and rng.random() < 0.5:
                request = open_.pop(rng.randrange(len(open_)))
                events.append((trial, seq, request, "finish", None, None, float(rng.randrange(80)), rng.random() < 0.8, rng.random() < 0.9, float(seq)))
            else:
                n += 1
                open_.append(f"r{n}")
                events.append((trial, seq, f"r{n}", "start", float(rng.randrange(100)), rng.random() < 0.7, None, None, None, None))
    return events


TOLD = ["trial", "seq", "admitted", "spent", "reserved", "refused", "max_in_flight", "usage_unread", "hit_at"]


def test_reservations_are_held_and_settled(spark):
    events = meter_events()
    rows = M.metered(spark.createDataFrame(events, M.METER_EVENT), 400.0)
    want = plain_meter(events, 400.0)
    assert sorted(tuple(r) for r in rows.select(*TOLD).collect()) == want
    assert any(r[2] is False for r in want) and any(r[4] > 0 for r in want)
    totals = {r.trial: (r.spent, r.refused, r.over_budget) for r in M.meter_totals(rows).collect()}
    assert totals == {t: next((w[3], w[5], max(0.0, w[3] - 400.0)) for w in reversed(want) if w[0] == t) for t in range(5)}


def test_reservations_in_a_stream(spark, tmp_path):
    events = meter_events()
    order = sorted(events, key=lambda e: e[1])
    for k in range(3):
        spark.createDataFrame(order[k * 100 : k * 100 + 100], M.METER_EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(M.METER_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        M.meter_stream(stream, 400.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*TOLD).collect()) == plain_meter(events, 400.0)


def test_what_requests_reserve_and_responses_use(spark):
    bodies = [("/v1/messages", '{"max_tokens": 100}', 100), ("/v1/messages", '{"max_tokens": 10000000}', 500_000), ("/v1/responses", "{}", 64_000), ("/v1/messages", "no json", 64_000), ("/m:generateContent", '{"generationConfig": {"maxOutputTokens": 7}}', 7), ("/v1/files", '{"max_tokens": 5}', 0), ("/v1/messages", '{"max_tokens": true, "max_output_tokens": 9}', 9)]
    df = spark.createDataFrame(bodies, "path string, body string, want long")
    assert all(r.got == r.want for r in df.withColumn("got", M.reservation(F.col("path"), F.col("body"), 500_000)).collect())
    events = [
        ("a", 1, "anthropic", '{"type": "message_start", "message": {"model": "m", "usage": {"output_tokens": 1}}}'), ("a", 2, "anthropic", '{"type": "message_delta", "usage": {"output_tokens": 50}}'),
        ("b", 1, "anthropic", '{"type": "message_start", "message": {"model": "m", "usage": {"output_tokens": 3}}}'), ("b", 2, "anthropic", "broken"),
        ("c", 1, "openai", '{"type": "response.completed", "response": {"model": "o", "usage": {"output_tokens": 8}}}'), ("d", 1, "openai", '{"usage": {"completion_tokens": 6}}'),
        ("e", 1, "gemini", '{"usageMetadata": {"candidatesTokenCount": 2}}'), ("e", 2, "gemini", '{"usageMetadata": {"candidatesTokenCount": 4, "thoughtsTokenCount": 5}, "modelVersion": "g"}'), ("f", 1, "other", "{}"),
    ]
    got = {r.request: (r.tokens, r.read, r.model) for r in M.folded_responses(spark.createDataFrame(events, "request string, n int, provider string, event string"), ["request"], "n").collect()}
    assert got == {"a": (50, True, "m"), "b": (3, False, "m"), "c": (8, True, "o"), "d": (6, True, None), "e": (9, True, "g"), "f": (0, False, None)}
    calls = spark.createDataFrame([(1, 1, 100, 10_000), (1, 2, 2500, 10_000), (1, 3, 10, 10_000), (2, 1, 9000, 10_000), (2, 2, 1, None)], "k int, n int, input_tokens long, context_tokens long")
    assert sorted((r.k, r.n) for r in M.needs_summary(calls, ["k"], "n").where("needed").collect()) == [(1, 3)]


def test_windows_in_batch_and_stream_agree(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = M.tumbling(stream, "ts", "1 day", "event_type", late="1 hour").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted((r.start, r.event_type, r.n) for r in M.tumbling(events, "ts", "1 day", "event_type").collect())
    assert sorted((r.start, r.event_type, r.n) for r in spark.sql("select * from daily").collect()) == want


def test_in_flight_usage_and_images(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 5, 9), (2, 0, 1)], "k int, a int, b int")
    assert {r.k: r.max_in_flight for r in M.max_in_flight(spans, "k", "a", "b").collect()} == {1: 2, 2: 1}
    events = spark.createDataFrame([(1, 1, 10, True), (1, 2, 99, False), (1, 3, 12, True), (2, 1, 5, False)], "k int, seq int, v int, final boolean")
    assert {r.k: (r.used, r.found) for r in M.folded_usage(events, "k", ["seq"], "v", F.col("final")).collect()} == {1: (12, True), 2: (None, False)}
    held = M.bounded_images(pd.DataFrame({"round": [1, 2, 3, 4], "images": [3, 3, 3, 1]}), 6, 2)
    assert held["held"].tolist() == [3, 6, 2, 3] and held["dropped"].tolist() == [0, 0, 7, 0]
