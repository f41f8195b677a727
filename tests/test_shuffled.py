"""Work that grows with the input is shuffled over tasks, not sent through the driver or left to one task."""

from faultline.operators import rules as U
from faultline.plans import catalog, inputs


def test_joins_with_rules_never_broadcast(spark):
    table = spark.createDataFrame(
        [(1, ["disk full"], "a", "warn", "", ["x"]), (2, ["k"], "b", "", "", []), (None, ["connection number 12345678"], "c", "", "", [])],
        "priority int, phrases array<string>, root_cause string, severity string, component string, commands array<string>",
    )
    messages = ["the DISK FULL now", "disk ful", "ok", "K", None, "connection number 12345678", "connection number 12345679", "the DISK FULL now"]
    rows = spark.createDataFrame([(m,) for m in messages], "message string")
    found, rule = U.with_first_rule(rows, table)
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    got = sorted(((r.message or "", r[rule] and r[rule].root_cause) for r in found.collect()), key=repr)
    wanted = ["a", "b", "b", "b", None, "c", None, "a"]
    assert got == sorted(((m or "", c) for m, c in zip(messages, wanted, strict=True)), key=repr)


def test_events_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    spark.range(500).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "id % 7 AS user_id", "'error' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props"
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for raw in (inputs.json_raw, inputs.syslog_raw):
        sizes = [len(part) for part in raw(spark, str(tmp_path)).rdd.glom().collect()]
        assert sum(sizes) == 500 and sum(n > 0 for n in sizes) >= 8 and max(sizes) < 100
    assert tuple(catalog.stream_stats(spark, str(tmp_path)).first())[1:2] == (500,)


def test_trace_files_stay_small(spark, tmp_path, monkeypatch):
    texts = [(i, f"boom {i}\n\tat x.y({i})\n\nnext\nmore") for i in range(30)] + [(30, None), (31, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    paths = []

    def held(spark, name):
        paths.append(f"{tmp_path}/{name}")
        return paths[-1]

    monkeypatch.setattr(catalog, "new_folder", held)
    monkeypatch.setattr(catalog, "TRACES_PER_FILE", 7)
    small = catalog.stream_traces(spark, str(tmp_path)).collect()
    files = list((tmp_path / "trace-files").glob("part-*"))
    assert len(files) == 5 and all(f.read_text().count("boom") <= 7 for f in files)
    assert sum(r.events for r in small) == sum(r.events for r in catalog.stacktrace_events(spark, str(tmp_path)).groupBy("severity").count().withColumnRenamed("count", "events").collect())
