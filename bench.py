"""Benchmark: rows per job at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Inputs are derived from the tables once and stored before the clock starts, so that each query
times its own work on stored logs. Every query is run once to warm up and then timed.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultline.operators import dedup as U
from faultline.operators import diagnose as P
from faultline.operators import framing as R
from faultline.operators import normalize as N
from faultline.functions import signature as G
from faultline.plans import catalog as C
from faultline.plans import inputs as I
from faultline.session import new_folder, prepare

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)

    def stored(df):
        path = new_folder(spark, "input")
        df.repartition(int(CPUS)).write.parquet(path)
        return spark.read.parquet(path)

    json_raw = stored(I.json_raw(spark, FOLDER))
    syslog_raw = stored(I.syslog_raw(spark, FOLDER))
    texts = stored(I.trace_texts(spark, FOLDER))
    lines = stored(I.trace_lines(spark, FOLDER))
    messages = stored(I.messages(spark, FOLDER))
    by_user = stored(I.signature_events(spark, FOLDER, C.BY_USER))
    by_type = stored(I.signature_events(spark, FOLDER, C.BY_TYPE))
    errors = stored(N.error_events(N.normalize(json_raw)))
    incidents = stored(U.incidents(U.dedup(errors, C.HOUR)))
    template = G.template(F.col("service"), F.col("message"), F.array().cast("array<string>"))

    jobs = {
        "json_normalize": (json_raw, lambda: N.accepted(N.normalize(json_raw))),
        "syslog_normalize": (syslog_raw, lambda: N.accepted(N.normalize(syslog_raw))),
        "stacktrace_normalize": (texts, lambda: N.accepted(N.normalize(R.frame_text(texts)))),
        "frame_blocks_of_text": (lines, lambda: R.frame_text(texts)),
        "frame_blocks_of_rows": (lines, lambda: R.frame_blocks(lines)),
        "message_signatures": (messages, lambda: messages.select(G.signature(template))),
        "dedup_many_signatures": (by_user, lambda: U.dedup(by_user, 6 * C.HOUR)),
        "dedup_few_signatures": (by_type, lambda: U.dedup(by_type, C.HOUR)),
        "dedup_spread_signatures": (by_type, lambda: U.dedup(by_type, C.HOUR, hot_rows=5_000)),
        "incidents": (errors, lambda: U.incidents(U.dedup(errors, C.HOUR))),
        "prompts": (incidents, lambda: incidents.select(P.prompt(C.HOUR))),
        "rule_diagnosis": (incidents, lambda: P.diagnose(incidents)),
    }
    seconds, rates = {}, {}
    for name, (source, job) in jobs.items():
        rows = source.count()
        for _ in range(2):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(rows / seconds[name])
    for name in ("error_incidents", "routed_events", "template_catalogue"):
        for _ in range(2):
            start = time.perf_counter()
            C.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rates,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
