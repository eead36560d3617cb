"""Risk arithmetic: requests, levels, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that mark a secret in a request.
SECRET = r"(?i)token|authorization|bearer|api[_-]?key|secret"
WRITE_METHODS = ["POST", "PUT", "PATCH"]
LEVELS = ["avoid", "risky", "attention", "caution", "safe"]
# How each level's summary begins.
SUMMARIES = {"avoid": "Severe risks detected", "risky": "Elevated risk", "attention": "Moderate risk", "caution": "Low-risk signals"}
NO_RISKS = "No significant risk signals detected."


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def has_secret(text: Column) -> Column:
    return F.rlike(text, F.lit(SECRET))


def request_url(metadata: Column, args: Column) -> Column:
    """The captured address, or the first argument that could be one."""
    return F.coalesce(F.try_element_at(metadata, F.lit("url")), F.get(F.filter(args, lambda a: F.rlike(a, F.lit(r"\.|localhost|/"))), 0))


def request_method(metadata: Column, args: Column) -> Column:
    named = F.get(F.filter(args, lambda a: F.rlike(a, F.lit("(?i)^(get|post|put|patch|delete)$"))), 0)
    return F.upper(F.coalesce(F.try_element_at(metadata, F.lit("method")), named, F.lit("GET")))


def secret_in_request(metadata: Column, url: Column) -> Column:
    header = F.coalesce(F.try_element_at(metadata, F.lit("header")), F.try_element_at(metadata, F.lit("headers")), F.lit(""))
    return has_secret(F.concat_ws(" ", header, url, F.to_json(metadata)))


def risk_level(score: Column, thresholds: dict[str, float]) -> Column:
    out = F.lit("safe")
    for level in reversed(LEVELS[:-1]):
        out = F.when(score >= thresholds[level], level).otherwise(out)
    return out


def summary(level: Column, top_types: Column) -> Column:
    """top_types: the distinct types of the worst severity, in order; three at most are named."""
    names = F.array_join(F.slice(top_types, 1, 3), ", ")
    out = F.lit(NO_RISKS)
    for name, text in SUMMARIES.items():
        out = F.when((level == name) & (F.coalesce(F.size(top_types), F.lit(0)) > 0), F.concat(F.lit(f"{text}: "), names, F.lit("."))).otherwise(out)
    return out


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "critical", "error").when(severity == "warning", "warning").otherwise("note")


def reference_text(file: Column, line: Column, line_end: Column, kind: Column) -> Column:
    lines = F.when(line_end.isNotNull() & (line_end != line), F.concat_ws("-", line.cast("string"), line_end.cast("string"))).otherwise(line.cast("string"))
    return F.concat(file, F.lit(":"), lines, F.lit(" ("), kind, F.lit(")"))
