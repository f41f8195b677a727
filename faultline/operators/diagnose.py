"""Incidents to prompts, request bodies and diagnoses."""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions.json_log import STRICT
from faultline.functions.severity import severity_name
from faultline.functions.text import or_empty
from faultline.operators.dedup import window_micros
from faultline.operators.rules import filled, with_first_rule

# Model and sampling temperature.
DEFAULT_MODEL = "gemini-1.5-flash"
TEMPERATURE = 0.1


class Rule(NamedTuple):
    """Diagnosis for messages holding one of ``phrases`` (lower case).

    Empty ``severity`` or ``component`` mean that of the event, ``{service}`` in a command and
    ``{message}`` in the cause are filled in from the event.
    """

    phrases: tuple[str, ...]
    root_cause: str
    severity: str
    component: str
    commands: tuple[str, ...]


# The built-in rules, first match counts.
RULES = (
    Rule(
        ("nil pointer", "dereference"),
        "Nil pointer dereference when accessing uninitialized object instance in application"
        " code.",
        "fatal",
        "",
        ("kubectl rollout undo deployment/{service}", "git log -n 1 --stat"),
    ),
    Rule(
        ("connection refused", "timeout", "dial tcp"),
        "Upstream network failure or database connection pool exhaustion.",
        "error",
        "database-pool",
        (
            "kubectl scale deployment/{service} --replicas=5",
            "pg_isready -h db-cluster.internal -p 5432",
        ),
    ),
    Rule(
        ("out of memory", "oom", "cannot allocate"),
        "Container memory limit exceeded causing Linux kernel OOM killer trigger.",
        "fatal",
        "k8s-pod-memory",
        (
            "kubectl top pod -l app={service}",
            "kubectl edit deployment/{service} # increase memory limit to 2Gi",
        ),
    ),
)
OTHERWISE = Rule(
    (),
    "Unhandled application error: {message}",
    "",
    "",
    ("kubectl logs -l app={service} --tail=100",),
)


def duration_text(micros: int) -> str:
    """A window length as text: ``5m0s``, ``1h0m0s``, ``1.5s``, ``250ms``."""
    if micros < 1_000_000:
        for unit, size in (("ms", 1000), ("µs", 1)):
            if micros >= size:
                return f"{micros / size:.3f}".rstrip("0").rstrip(".") + unit
        return "0s"
    minutes, rest = divmod(micros, 60_000_000)
    hours, minutes = divmod(minutes, 60)
    text = f"{rest / 1_000_000:.6f}".rstrip("0").rstrip(".") + "s"
    if hours or minutes:
        text = f"{minutes}m{text}"
    return f"{hours}h{text}" if hours else text


def prompt(window_seconds: float) -> Column:
    """Prompt for one incident row (normalized event plus ``dedup_count``).

    Optional parts are left out when empty; extra fields are ordered by name.
    """

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + ": "), value, F.lit("\n"))

    def optional(present: Column, text: Column) -> Column:
        return F.when(present, text).otherwise("")

    frames = F.array_join(
        F.transform(
            "stack_frames",
            lambda frame, i: F.concat(
                F.lit("["), (i + 1).cast("string"), F.lit("] "), frame, F.lit("\n")
            ),
        ),
        "",
    )
    fields = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("fields")),
            lambda e: F.concat(F.lit("- "), e.key, F.lit(": "), e.value, F.lit("\n")),
        ),
        "",
    )
    length = duration_text(window_micros(window_seconds))
    frequency = F.concat(
        F.col("dedup_count").cast("string"), F.lit(f" times in the last {length}\n")
    )
    return F.concat(
        F.lit(
            "You diagnose production incidents for the team that runs the service.\n"
            "Find the most likely cause of the error below and say how to fix it.\n\n"
            "=== INCIDENT CONTEXT ===\n"
        ),
        line("Service", F.col("service")),
        optional(F.col("host") != "", line("Host", F.col("host"))),
        line("Severity", severity_name(F.col("severity"))),
        line("Timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX")),
        line("Event ID", F.col("event_id")),
        optional(F.col("signature") != "", line("Signature Hash", F.col("signature"))),
        line("Occurrence Frequency", frequency),
        F.lit("=== ERROR MESSAGE ===\n"),
        F.col("message"),
        F.lit("\n\n"),
        optional(
            F.size("stack_frames") > 0,
            F.concat(F.lit("=== STACK TRACE FRAMES ===\n"), frames, F.lit("\n")),
        ),
        optional(
            F.coalesce(F.size("fields"), F.lit(0)) > 0,
            F.concat(F.lit("=== METADATA & FIELDS ===\n"), fields, F.lit("\n")),
        ),
        F.lit(
            "=== REQUIRED OUTPUT FORMAT ===\n"
            "Answer with one JSON object and nothing else. Its keys:\n"
            "root_cause: text, why the error happened\n"
            "severity: fatal, error or warn\n"
            "affected_component: text, the failing service, database or network part\n"
            "fix_commands: list of shell commands\n"
            "confidence_score: number from 0 to 1\n"
        ),
    )


def requests(
    incidents: DataFrame, window_seconds: float, model: str = DEFAULT_MODEL
) -> DataFrame:
    """Incidents to request rows (``event_id``, ``signature``, JSON ``body``)."""
    message = F.struct(F.lit("user").alias("role"), prompt(window_seconds).alias("content"))
    body = F.struct(
        F.lit(model or DEFAULT_MODEL).alias("model"),
        F.array(message).alias("messages"),
        F.lit(TEMPERATURE).alias("temperature"),
    )
    return incidents.filter(F.col("event_id").isNotNull()).select(
        "event_id", "signature", F.to_json(body).alias("body")
    )


def _filled(text: str) -> Column:
    """Text with ``{service}`` and ``{message}`` replaced by the columns of the event."""
    parts = re.split(r"\{(service|message)\}", text)
    return F.concat(*[F.col(part) if i % 2 else F.lit(part) for i, part in enumerate(parts)])


def _outcome(rule: Rule) -> Column:
    return F.struct(
        _filled(rule.root_cause).alias("root_cause"),
        (F.lit(rule.severity) if rule.severity else severity_name(F.col("severity"))).alias(
            "severity"
        ),
        (F.lit(rule.component) if rule.component else F.col("service")).alias(
            "affected_component"
        ),
        F.array(*[_filled(command) for command in rule.commands])
        .cast("array<string>")
        .alias("fix_commands"),
    )


def _table_outcome(rule: Column) -> Column:
    """The outcome of a rule from a table, see ``rules.first_rules``."""
    severity, component = rule["severity"], rule["component"]
    return F.struct(
        filled(rule["root_cause"]).alias("root_cause"),
        F.when(severity != "", severity).otherwise(severity_name(F.col("severity"))).alias("severity"),
        F.when(component != "", component).otherwise(F.col("service")).alias("affected_component"),
        F.transform(rule["commands"], filled).alias("fix_commands"),
    )


def diagnose(incidents: DataFrame, rules=RULES, otherwise: Rule = OTHERWISE) -> DataFrame:
    """Rule diagnosis (``DIAGNOSIS`` without raw response) and ``failure`` per incident.

    ``rules`` are a few rules, the first that matches counts, or a table of any number of them: ``priority``, ``phrases`` and
    ``commands`` (arrays of text), ``root_cause``, ``severity``, ``component``. In a table the lowest priority comes first, null
    ones last and equal ones by cause and phrases; absent texts are '', absent arrays and their null entries are left out, phrases
    match without case and a rule without phrases never matches. Nothing measures how sure a rule is, so confidence and tokens
    are null. A row without event id has no event to diagnose and gets a failure instead. With a table ``incidents`` is read
    more than once: store it first when it is costly to compute.
    """
    found = _outcome(otherwise)
    if isinstance(rules, DataFrame):
        incidents, rule = with_first_rule(incidents, rules)
        found = F.when(F.col(rule).isNotNull(), _table_outcome(F.col(rule))).otherwise(found)
    else:
        message = F.lower("message")
        for rule in reversed(rules):
            hit = F.lit(False)
            for phrase in rule.phrases:
                hit = hit | F.contains(message, F.lit(phrase))
            found = F.when(hit, _outcome(rule)).otherwise(found)
    has_event = F.col("event_id").isNotNull()
    return incidents.select(
        "event_id",
        "signature",
        F.when(has_event, found).alias("_d"),
        F.when(has_event, "").otherwise(S.NIL_REQUEST).alias("failure"),
    ).select(
        "event_id",
        "signature",
        "_d.*",
        F.lit(None).cast("double").alias("confidence_score"),
        F.lit(None).cast("int").alias("tokens_used"),
        "failure",
    )


def diagnosis_texts(diagnoses: DataFrame) -> DataFrame:
    """Cause and fixes of every diagnosis as one text, as a report shows them."""
    text = F.concat(
        F.col("root_cause"), F.lit("\nFixes: "), F.array_join("fix_commands", "; ")
    )
    return diagnoses.filter(F.col("failure") == "").select("event_id", text.alias("text"))


# Response keys with the JSON types they may have; a null leaves the default.
_RESPONSE_TYPES = {
    "event_id": "^(STRING|VOID)$",
    "signature": "^(STRING|VOID)$",
    "root_cause": "^(STRING|VOID)$",
    "severity": "^(STRING|VOID)$",
    "affected_component": "^(STRING|VOID)$",
    "fix_commands": "^(ARRAY<(STRING|VOID)>|VOID)$",
    "confidence_score": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$",
    "raw_response": "^(STRING|VOID)$",
    "tokens_used": "^(BIGINT|VOID)$",
}


def _best_answers(answers: DataFrame) -> DataFrame:
    """One answer per event id: a usable one if there is any."""
    rest = [name for name in answers.columns if name != "event_id"]
    ranked = F.struct((F.col("failure") == "").alias("_usable"), *rest)
    best = answers.dropna(subset=["event_id"]).groupBy("event_id").agg(F.max(ranked).alias("_best"))
    return best.select("event_id", *[F.col("_best")[name].alias(name) for name in rest])


def decoded_answers(answers: DataFrame, *kept: str) -> DataFrame:
    """Answers (``event_id``, HTTP ``status``, ``body``) with the parts of their diagnosis and ``failure``.

    ``failure`` is '' for a usable answer; another status than 200 is a provider failure, and a body that is no
    object with values of the right types is an invalid response. Keys are matched without case, the last of equal ones counts.
    """
    decoded = answers.withColumn(
        "_values",
        F.when(F.trim("body") == "null", F.from_json(F.lit("{}"), "map<string,variant>"))
        .otherwise(F.from_json("body", "map<string,variant>", STRICT)),
    )
    fits = F.col("_values").isNotNull()

    def held(name: str) -> Column:
        entries = F.map_entries("_values")
        return F.try_element_at(
            F.filter(entries, lambda entry: F.lower(entry["key"]) == name), F.lit(-1)
        )["value"]

    for name, types in _RESPONSE_TYPES.items():
        value = held(name)
        fits = fits & (value.isNull() | F.rlike(F.schema_of_variant(value), F.lit(types)))
    decoded = decoded.withColumn("_fits", F.coalesce(fits, F.lit(False)))

    def value(name: str, type_name: str) -> Column:
        return F.when(F.col("_fits"), held(name).try_cast(type_name))

    return decoded.select(
        "event_id",
        *kept,
        F.when(F.col("status") != 200, F.format_string(
            S.PROVIDER_FAILED + ": http status %d: %s", "status", or_empty(F.col("body"))
        ))
        .when(~F.col("_fits"), S.INVALID_RESPONSE)
        .otherwise("")
        .alias("failure"),
        or_empty(value("root_cause", "string")).alias("root_cause"),
        or_empty(value("severity", "string")).alias("severity"),
        or_empty(value("affected_component", "string")).alias("affected_component"),
        F.coalesce(
            value("fix_commands", "array<string>"), F.array().cast("array<string>")
        ).alias("fix_commands"),
        F.coalesce(value("confidence_score", "double"), F.lit(0.0)).alias("confidence_score"),
        or_empty(value("raw_response", "string")).alias("raw_response"),
        F.coalesce(value("tokens_used", "int"), F.lit(0)).alias("tokens_used"),
    )


def responses(requested: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (``event_id``, HTTP ``status``, ``body``) to diagnoses, one per request.

    Event id and signature come from the request, whatever the answer says. For ``failure`` see
    ``decoded_answers``; a missing answer is a provider failure. Of several answers to a request a
    usable one is taken, and among equally usable ones the largest by value.
    """
    joined = requested.join(_best_answers(decoded_answers(answers)), "event_id", "left")
    return joined.select(
        "event_id",
        "signature",
        *[name for name in S.DIAGNOSIS.names if name not in ("event_id", "signature")],
        F.coalesce("failure", F.lit(S.PROVIDER_FAILED)).alias("failure"),
    )
