"""Reports of each package: JSON, text and SARIF, a row each, or a row for each line of them.

A report that is one row holds its whole package. `json_lines` and `sarif_lines` give the same documents line by line, an entry each, so that `write_lines` makes a file for each package out of a sorted stream: no row or
task holds more than an entry and its sort buffer, and the commit of the write leaves no file of a task that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsift import __version__
from capsift.functions import ids, risk
from capsift.operators import score

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def _listed(df: DataFrame, name: str, order: str, body: Column) -> DataFrame:
    """skill_key and an array of structs in order."""
    by_order = lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)  # noqa: E731  maps have no order of their own
    got = df.groupBy("skill_key").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), body.alias("v"))), by_order).alias(name))
    return got.select("skill_key", F.transform(name, lambda x: x["v"]).alias(name))


def _with(base: DataFrame, *parts: DataFrame) -> DataFrame:
    for p in parts:
        base = base.join(p, "skill_key", "left")
    return base


def _entries(df: DataFrame, part: int, body: Column, seq: Column | None = None, name: Column | None = None) -> DataFrame:
    """A line for each row of df, in the order of seq and name; all but a package's first begin with a comma."""
    each = df.select("skill_key", F.lit(part).alias("part"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"), (F.lit("") if name is None else name).alias("name"), F.to_json(body).alias("line"))
    first = each.groupBy("skill_key").agg(F.min(F.struct("seq", "name")).alias("first"))
    own = F.struct("seq", "name") == F.col("first")
    return each.join(first, "skill_key").select("skill_key", "part", "seq", "name", F.concat(F.when(own, "").otherwise(","), "line").alias("line"))


def _fixed(reports: DataFrame, part: int, line: Column) -> DataFrame:
    return reports.select("skill_key", F.lit(part).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("name"), line.alias("line"))


def _lines(reports: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """skill_key, part, seq, name, line of the packages that have a report."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(reports.select("skill_key").distinct(), "skill_key", "left_semi").select("skill_key", "part", "seq", "name", "line")


def _opened(body: Column) -> Column:
    """An object's fields, the object left open."""
    return F.regexp_replace(F.to_json(body), r"\}\z", "")


def _permission_body() -> Column:
    return F.struct("id", "tool", "scope", "permission", "args", F.col("file_role").alias("fileRole"), "metadata", F.col("refs").alias("references"), "source", "comment", "risks")


def _risk_body() -> Column:
    ref = F.struct("file", "line", F.col("line_end").alias("lineEnd"), F.col("ref_type").alias("type")).alias("reference")
    return F.struct("id", "type", F.col("group_key").alias("groupKey"), "severity", "message", ref, "permissions", "metadata")


def json_lines(reports: DataFrame, permissions: DataFrame, risks: DataFrame, warnings: DataFrame) -> DataFrame:
    """skill_key, part, seq, name, line: in the order of part, seq and name, the lines of a package are its JSON report, as json_reports() gives it but for the order of fields. Packages without an entry have the fixed lines alone."""
    said = warnings.select("skill_key", "message").distinct()
    after = F.concat(F.lit("],"), F.regexp_replace(_opened(F.struct("score", F.col("risk_level").alias("riskLevel"), "summary")), r"\A\{", ""), F.lit(',"warnings":['))
    parts = [
        _fixed(reports, 0, F.concat(_opened(F.struct(F.col("skill_id").alias("skillId"), F.col("version").alias("skillVersionId"))), F.lit(',"permissions":['))),
        _entries(permissions, 1, _permission_body(), F.col("perm_seq")),
        _fixed(reports, 2, F.lit('],"risks":[')),
        _entries(risks, 3, _risk_body(), F.col("risk_seq")),
        _fixed(reports, 4, after),
        # a message alone is no object: it is taken out of one
        _entries(said, 5, F.struct("message"), None, F.col("message")).withColumn("line", F.regexp_replace("line", r'\A(,?)\{"message":(.*)\}\z', "$1$2")),
        _fixed(reports, 6, F.lit("]}")),
    ]
    return _lines(reports, parts)


def write_lines(lines: DataFrame, path: str, key: str = "skill_key") -> None:
    """Write lines as one text file for each package, below `path`/skill_key=<package>/. Packages are dealt over tasks by name; a task sorts its lines (on disk if need be) and writes one file after the other."""
    # a key that can be null would make the write sort once more, by the key alone
    dealt = lines.withColumn(key, F.coalesce(key, F.lit(""))).repartition(key).sortWithinPartitions(key, "part", "seq", "name")
    dealt.select(key, "line").write.partitionBy(key).text(path)


def json_reports(reports: DataFrame, permissions: DataFrame, risks: DataFrame, warnings: DataFrame) -> DataFrame:
    """skill_key, json."""
    perms = _listed(permissions, "permissions", "perm_seq", _permission_body())
    found = _listed(risks, "risks", "risk_seq", _risk_body())
    warned = warnings.groupBy("skill_key").agg(F.array_sort(F.collect_set("message")).alias("warnings"))
    every = _with(reports, perms, found, warned)
    filled = lambda name: F.coalesce(F.col(name), F.array().cast(every.schema[name].dataType)).alias(name)
    body = F.struct(F.col("skill_id").alias("skillId"), F.col("version").alias("skillVersionId"), filled("permissions"), filled("risks"), "score", F.col("risk_level").alias("riskLevel"), "summary", filled("warnings"))
    return every.select("skill_key", F.to_json(body).alias("json"))


def text_reports(reports: DataFrame, risks: DataFrame, warnings: DataFrame) -> DataFrame:
    """skill_key, text: risks in groups, the worst first."""
    at = risk.reference_text(F.col("file"), F.col("line"), F.col("line_end"), F.col("ref_type"))
    key = F.coalesce("group_key", F.concat_ws(":", "type", "file", F.col("line").cast("string")))
    each = risks.select("skill_key", key.alias("shown_key"), "risk_seq", "severity", "type", "message", at.alias("at"), "permissions")
    lines = each.groupBy("skill_key", "shown_key").agg(F.array_sort(F.collect_list(F.struct("risk_seq", "severity", "type", "message", "at", "permissions"))).alias("all"))
    lines = lines.join(score.groups(risks), ["skill_key", "shown_key"])
    one = F.get("all", 0)
    named = F.when(F.size(one["permissions"]) > 0, F.concat(F.lit("\n      permissions: "), F.array_join(one["permissions"], ", "))).otherwise("")
    single = F.concat(F.lit("    - "), one["severity"], F.lit(" "), one["type"], F.lit("\n      message: "), one["message"], F.lit("\n      ref: "), one["at"], named)
    many = F.concat(F.lit("    ["), "shown_key", F.lit("] ("), "severity", F.lit(")\n"), F.array_join(F.transform("all", lambda r: F.concat(F.lit("      - "), r["message"], F.lit("\n        ref: "), r["at"])), "\n"))
    shown = lines.select("skill_key", "n", F.struct("rank", "first_seq", F.when(F.col("n") == 1, single).otherwise(many).alias("s")).alias("g"))
    shown = shown.groupBy("skill_key").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["s"]), "\n").alias("body"))
    warned = warnings.groupBy("skill_key").agg(F.count("*").alias("w"), F.array_join(F.transform(F.array_sort(F.collect_list("message")), lambda m: F.concat(F.lit("    - "), m)), "\n").alias("warned"))
    every = _with(reports, shown, warned)
    bar = F.lit("=" * 60)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).cast("string")
    body = F.concat_ws(
        "\n", bar, F.lit("Analysis Results"), bar, F.concat(F.lit("  Skill: "), "skill_id", F.lit("@"), "version"), F.lit(""), F.concat(F.lit("  Risks ("), count(F.col("n")), F.lit(")")), F.coalesce("body", F.lit("    - none")), F.lit(""),
        F.concat(F.lit("  Warnings ("), count(F.col("w")), F.lit(")")), F.coalesce("warned", F.lit("    - none")), F.lit(""), F.concat(F.lit("  Risk Level: "), "risk_level"), F.concat(F.lit("  Score: "), F.regexp_replace(F.col("score").cast("string"), r"\.0$", "")), F.concat(F.lit("  Summary: "), "summary"),
    )
    return every.select("skill_key", body.alias("text"))


def _location(file: Column, line: Column, end: Column) -> Column:
    region = F.struct(line.alias("startLine"), F.when(end != line, end).alias("endLine"))
    return F.array(F.struct(F.struct(F.struct(file.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))


def _rule(name: Column, short: Column, text: Column, tag: str) -> list:
    return [name.alias("id"), F.struct(short.alias("text")).alias("shortDescription"), F.struct(text.alias("text")).alias("help"), F.struct(F.array(F.lit(tag)).alias("tags")).alias("properties")]


def sarif_rules(risks: DataFrame, permissions: DataFrame) -> DataFrame:
    """skill_key, ord, and of each risk type once, then of each permission: id, shortDescription, help, properties."""
    first = risks.groupBy("skill_key", "type").agg(F.min("risk_seq").alias("n"), F.min_by("message", "risk_seq").alias("message"))
    by_risk = first.select("skill_key", F.struct(F.lit(0).alias("part"), "n").alias("ord"), *_rule(F.col("type"), F.col("type"), F.col("message"), "security"))
    text = F.coalesce("comment", F.concat(F.lit("Permission detected: "), "tool", F.lit(" "), "permission", F.lit(" ("), "scope", F.lit(")")))
    by_permission = permissions.select("skill_key", F.struct(F.lit(2).alias("part"), F.col("perm_seq").alias("n")).alias("ord"), *_rule(F.col("id"), F.concat("tool", F.lit("."), "permission", F.lit(" ["), "scope", F.lit("]")), text, "permissions"))
    return by_risk.unionByName(by_permission)


def sarif_results(risks: DataFrame) -> DataFrame:
    """skill_key, risk_seq, ruleId, level, message, locations, fingerprints."""
    print_ = F.struct(ids.fingerprint(F.col("type"), F.col("file"), F.col("line")).alias("capsift/v1"))
    return risks.select("skill_key", "risk_seq", F.col("type").alias("ruleId"), risk.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), _location(F.col("file"), F.col("line"), F.col("line_end")).alias("locations"), print_.alias("fingerprints"))


_RULE_FIELDS = ["id", "shortDescription", "help", "properties"]
_RESULT_FIELDS = ["ruleId", "level", "message", "locations", "fingerprints"]


def sarif_lines(reports: DataFrame, permissions: DataFrame, risks: DataFrame, warnings: DataFrame, scanned: DataFrame) -> DataFrame:
    """skill_key, part, seq, name, line: in that order the lines of a package are its SARIF report, the document that sarif_reports() gives."""
    said = warnings.select("skill_key", "message").distinct()
    about = said.select("skill_key").distinct().select("skill_key", F.struct(F.lit(1).alias("part"), F.lit(0).alias("n")).alias("ord"), *_about_warnings())
    # rules of risks, of warnings and of permissions follow each other: one list, so one comma rule
    rules = sarif_rules(risks, permissions).unionByName(about).withColumn("place", F.col("ord.part").cast("long") * (1 << 40) + F.col("ord.n"))
    results = sarif_results(risks).select("skill_key", F.col("risk_seq").cast("long").alias("place"), F.lit("").alias("name"), F.struct(*_RESULT_FIELDS).alias("body"))
    none = F.lit(None).cast(results.schema["body"].dataType["fingerprints"].dataType)
    note = F.struct(F.lit("capsift/warning").alias("ruleId"), F.lit("note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), _location(F.lit("SKILL.md"), F.lit(1), F.lit(1)).alias("locations"), none.alias("fingerprints"))
    results = results.unionByName(said.select("skill_key", F.lit(1 << 60).alias("place"), F.col("message").alias("name"), note.alias("body")))
    file = F.struct(F.struct(F.col("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("location"))
    head = F.concat(F.lit('{"$schema":"' + SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":'), _opened(F.struct(F.lit("capsift").alias("name"), F.lit(__version__).alias("version"))), F.lit(',"rules":['))
    parts = [
        _fixed(reports, 0, head),
        _entries(rules, 1, F.struct(*_RULE_FIELDS), F.col("place")),
        _fixed(reports, 2, F.lit(']}},"results":[')),
        _entries(results, 3, F.col("body"), F.col("place"), F.col("name")),
        _fixed(reports, 4, F.lit('],"artifacts":[')),
        _entries(scanned.select("skill_key", "path").distinct(), 5, file, None, F.col("path")),
        _fixed(reports, 6, F.lit("]}]}")),
    ]
    return _lines(reports, parts)


def _about_warnings() -> list:
    return _rule(F.lit("capsift/warning"), F.lit("Analysis warning"), F.lit("Warnings produced during analysis."), "maintainability")


def sarif_reports(reports: DataFrame, permissions: DataFrame, risks: DataFrame, warnings: DataFrame, scanned: DataFrame) -> DataFrame:
    """skill_key, sarif (2.1.0). scanned: skill_key, path."""
    warned = warnings.select("skill_key", "message").distinct()
    about = _about_warnings()
    every_rule = sarif_rules(risks, permissions).unionByName(warned.select("skill_key").distinct().select("skill_key", F.struct(F.lit(1).alias("part"), F.lit(0).alias("n")).alias("ord"), *about))
    rules = _listed(every_rule, "rules", "ord", F.struct(*_RULE_FIELDS))
    results = _listed(sarif_results(risks), "results", "risk_seq", F.struct(*_RESULT_FIELDS))
    notes = warned.groupBy("skill_key").agg(F.array_sort(F.collect_list(F.struct(F.lit("capsift/warning").alias("ruleId"), F.lit("note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), _location(F.lit("SKILL.md"), F.lit(1), F.lit(1)).alias("locations")))).alias("notes"))
    files = scanned.distinct().groupBy("skill_key").agg(F.transform(F.array_sort(F.collect_list("path")), lambda p: F.struct(F.struct(p.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("location"))).alias("artifacts"))
    every = _with(reports.select("skill_key"), rules, results, notes, files)
    none = F.lit(None).cast(every.schema["results"].dataType.elementType["fingerprints"].dataType)
    noted = F.transform("notes", lambda n: F.struct(n["ruleId"].alias("ruleId"), n["level"].alias("level"), n["message"].alias("message"), n["locations"].alias("locations"), none.alias("fingerprints")))
    filled = lambda c, name: F.coalesce(c, F.array().cast(every.schema[name].dataType))
    driver = F.struct(F.lit("capsift").alias("name"), F.lit(__version__).alias("version"), filled(F.col("rules"), "rules").alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.concat(filled(F.col("results"), "results"), filled(noted, "results")).alias("results"), filled(F.col("artifacts"), "artifacts").alias("artifacts"))
    return every.select("skill_key", F.to_json(F.struct(F.lit(SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))
