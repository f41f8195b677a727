"""Answers that arrive in time, too late, twice or never, over several batches."""

from datetime import datetime, timedelta

from faultline import schemas as S
from faultline.operators import diagnose as P
from faultline.streaming import answers, ingest

AT = datetime(2024, 1, 1)
ASKED = "event_id string, signature string, sent_at timestamp"
TOLD = "event_id string, status int, body string, answered_at timestamp"


def at(seconds):
    return AT + timedelta(seconds=seconds)


def test_every_request_has_one_row(spark, tmp_path):
    asked = [[(k, f"s-{k}", at(i)) for i, k in enumerate("abcdefg")], [(None, "s", at(8)), ("late", "s", at(9))], [("end", "", at(9000))]]
    told = [
        [("a", 200, '{"root_cause": "x"}', at(5)), ("b", 503, "busy", at(6)), ("b", 200, '{"root_cause": "y"}', at(40))],
        [("c", 200, '{"root_cause": "in time"}', at(62)), ("d", 200, '{"root_cause": "too late"}', at(64)), ("e", 200, "{", at(10)), (None, 200, "{}", at(11)), ("f", 200, '{"root_cause": "before"}', at(4))],
        [("end", 500, "", at(9001)), ("a", 200, '{"root_cause": "w"}', at(30))],
    ]

    def stream(name, batches, schema):
        for number, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{number}")
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return reader.parquet(f"{tmp_path}/{name}")

    sent, said = stream("asked", asked, ASKED), stream("told", told, TOLD)
    out = str(tmp_path / "out")
    found = answers.match_answers(sent, said, limit_seconds=60, lateness_seconds=3600)
    stored = ingest.run_to_table(found, out)
    got = {r.event_id: (r.root_cause, r.failure) for r in stored.collect()}
    assert stored.count() == len(got)
    assert got == {
        "a": ("x", ""), "b": ("y", ""), "c": ("in time", ""), "d": (None, S.PROVIDER_FAILED), "e": ("", S.INVALID_RESPONSE),
        "f": (None, S.PROVIDER_FAILED), "g": (None, S.PROVIDER_FAILED), "late": (None, S.PROVIDER_FAILED),
    }
    # The batch form says the same of the answers that came in time.
    requests = spark.createDataFrame([r[:2] for rows in asked for r in rows if r[0] and r[0] != "end"], "event_id string, signature string")
    times = {r[0]: r[2] for rows in asked for r in rows}
    kept = [r[:3] for rows in told for r in rows if r[0] in times and times[r[0]] <= r[3] <= times[r[0]] + timedelta(seconds=60)]
    batch = P.responses(requests, spark.createDataFrame(kept, "event_id string, status int, body string"))
    names = [name for name in stored.columns if name != "sent_at"]
    assert batch.columns == names
    assert sorted(map(str, batch.collect())) == sorted(map(str, stored.select(names).collect()))
    # A run on the same progress folder gives nothing twice.
    assert ingest.run_to_table(found, out).count() == len(got)
