"""Diagnosis rules from a table of any size.

A message meets a rule if it holds one of the rule's phrases, without case. Phrases are found by an equi-join instead of a
search for each: every phrase is filed under one of its runs of ``ANCHOR`` characters (shorter phrases under themselves), the one that
fewest phrases have, and meets only the messages that have this run. The whole phrase is then looked for in
those, and of all rules a message meets the first one is kept by an aggregate. Equal messages and equal phrases are looked at once.
Both sides of every join may be large, so all joins are shuffled and sorted: nothing is sent through the driver.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.columns import fresh_name
from faultline.session import materialize

ANCHOR = 8
#: What is kept of a rule, in the order in which rules go: null priorities last, equal ones by cause, phrases and the rest.
_ORDER = ["late", "priority", "root_cause", "phrases", "severity", "component", "commands"]


def _texts(column: str) -> Column:
    """The entries of an array of text without nulls."""
    held = F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>"))
    return F.filter(held, lambda text: text.isNotNull())


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text; of size 0 the one empty run."""
    if size == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that never broadcasts a side: sizes of stored rows tell little about what they take in memory."""
    return left.join(right.hint("merge"), on, how)


def phrases_of(rules: DataFrame) -> DataFrame:
    """One row per distinct phrase: ``phrase``, its ``run`` and ``size``, and the first ``rule`` that has it."""
    ruled = rules.select(
        F.col("priority").isNull().alias("late"),
        "priority",
        _text("root_cause").alias("root_cause"),
        F.transform(_texts("phrases"), lambda phrase: F.lower(phrase)).alias("phrases"),
        _text("severity").alias("severity"),
        _text("component").alias("component"),
        _texts("commands").alias("commands"),
    ).select(F.struct(*_ORDER).alias("rule"))
    first = ruled.select(F.explode(F.array_distinct("rule.phrases")).alias("phrase"), "rule").groupBy("phrase")
    first = materialize(first.agg(F.min("rule").alias("rule")))
    size = F.least(F.length("phrase"), F.lit(ANCHOR))
    runs = F.lit(None).cast("array<string>")
    for n in range(ANCHOR + 1):
        runs = F.when(size == n, _runs(F.col("phrase"), n)).otherwise(runs)
    held = first.select("phrase", size.alias("size"), F.explode(runs).alias("run"))
    many = materialize(held.groupBy("run").agg(F.count("*").alias("many")))
    rarest = _joined(held, many, "run").groupBy("phrase").agg(F.min(F.struct("many", "run")).alias("best"), F.first("size").alias("size"))
    return materialize(_joined(rarest.select("phrase", F.col("best.run").alias("run"), "size"), first, "phrase"))


def first_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule`` (struct) for each distinct ``text`` of ``messages`` (lower case) that meets one."""
    phrases = phrases_of(rules)
    sizes = [row.size for row in phrases.select("size").distinct().collect()]
    # Stored, so that the numbers given to the texts stay.
    texts = materialize(messages.select("text").dropna().distinct().withColumn("id", F.monotonically_increasing_id()))
    runs = [_runs(F.col("text"), size) for size in sorted(sizes)] or [F.array().cast("array<string>")]
    shown = texts.select("id", F.explode(F.concat(*runs)).alias("run"))
    met = _joined(_joined(shown, phrases.select("run", "phrase"), "run").select("id", "phrase"), texts, "id")
    met = met.filter(F.contains("text", "phrase")).select("text", "phrase")
    found = _joined(met, phrases.select("phrase", "rule"), "phrase").groupBy("text").agg(F.min("rule").alias("rule"))
    return materialize(found)


def filled(text: Column) -> Column:
    """Text with ``{service}`` and ``{message}`` replaced by the columns of the event."""
    marks = F.regexp_extract_all(text, F.lit(r"(\{service\}|\{message\})"), F.lit(1))
    values = F.transform(marks, lambda mark: F.when(mark == "{service}", F.col("service")).otherwise(F.col("message")))
    parts = F.split(text, r"\{service\}|\{message\}", -1)
    return F.array_join(F.zip_with(parts, values, lambda part, value: F.concat(part, F.coalesce(value, F.lit("")))), "")


def with_first_rule(incidents: DataFrame, rules: DataFrame) -> tuple[DataFrame, str]:
    """``incidents`` with the struct of the first rule they meet, or null, in a column of the returned name."""
    text, rule = fresh_name("text"), fresh_name("rule")
    asked = incidents.withColumn(text, F.lower("message"))
    found = first_rules(asked.select(F.col(text).alias("text")), rules)
    return _joined(asked, found.toDF(text, rule), text, "left").drop(text), rule
