"""The analysis of a corpus of packages in one job: files in, findings, permissions, risks and reports out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift import config as cfg
from capsift.operators import closure, permissions, risks, score, sinks
from capsift.plans import tables
from capsift.plans.tables import materialize
from capsift.sources import files
from capsift.sources.frontmatter import frontmatter


@dataclass
class Analysis:
    """Every relation has skill_key."""

    frontmatter: DataFrame
    queue: DataFrame
    skipped: DataFrame
    findings: DataFrame
    permissions: DataFrame
    risks: DataFrame
    warnings: DataFrame
    rules_used: DataFrame
    reports: DataFrame
    paths: list[str] = field(default_factory=list)

    def close(self) -> None:
        """Delete the tables that the relations read; they can't be read afterwards."""
        tables.remove(self.reports.sparkSession, self.paths)
        self.paths.clear()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def json(self) -> DataFrame:
        return sinks.json_reports(self.reports, self.permissions, self.risks, self.warnings)

    def text(self) -> DataFrame:
        return sinks.text_reports(self.reports, self.risks, self.warnings)

    def sarif(self) -> DataFrame:
        return sinks.sarif_reports(self.reports, self.permissions, self.risks, self.warnings, self._scanned())

    def _scanned(self) -> DataFrame:
        return self.queue.where("source_type = 'local'").select("skill_key", "path")

    def json_lines(self) -> DataFrame:
        """The JSON reports line by line, for sinks.write_lines()."""
        return sinks.json_lines(self.reports, self.permissions, self.risks, self.warnings)

    def sarif_lines(self) -> DataFrame:
        """The SARIF reports line by line, for sinks.write_lines()."""
        return sinks.sarif_lines(self.reports, self.permissions, self.risks, self.warnings, self._scanned())


def analyze(rows: DataFrame, config: dict | None = None) -> Analysis:
    """rows: skill_key, path, size, content_type, content, list_seq. Packages without an entry file have no report but a row in `frontmatter`'s complement."""
    config = cfg.resolve(config)
    scan = config["scan"]
    kept, passing = [], []
    with tables.noted(passing):
        # a dozen steps read the files: their source is read once, and they are dealt out evenly, whatever tasks it gives
        rows = materialize(tables.dealt(rows, "skill_key", "path"), "files")
    with tables.noted(kept):
        head = materialize(frontmatter(rows), "frontmatter")
    with tables.noted(passing):
        found = materialize(closure.closure(rows, int(scan["maxScanDepth"])), "discovered")
        queued, left = closure.scan_queue(found, rows, scan["maxFileSize"], int(scan["maxFileCount"]))
    with tables.noted(kept):
        queue = materialize(queued, "queue")
        skipped = materialize(left.select("skill_key", "path", "reason", "queue_seq").unionByName(permissions.skipped(queue)), "skipped")
    with tables.noted(passing):
        targets = materialize(permissions.scan_targets(queue, rows), "targets")
    with tables.noted(kept):
        # numbered by package, in few tasks; read finding by finding
        findings = materialize(tables.dealt(permissions.findings(targets), "skill_key", "finding_seq"), "findings")
    with tables.noted(passing):
        rows = permissions.from_allowed_tools(head).unionByName(permissions.from_findings(findings)).unionByName(permissions.from_externals(queue))
        merged = materialize(permissions.merge(rows), "permissions")
    with tables.noted(kept):
        sized = findings.select("skill_key").unionByName(merged.select("skill_key"))
        numbered = materialize(risks.number(risks.dependency_risks(merged, config), risks.rule_risks(findings, merged, config), sized), "risks")
        sets, back = materialize(risks.permission_sets(merged), "sets"), materialize(risks.risk_sets(numbered), "back")
        # stored with single links; what a set holds is put in where these are read
        own = materialize(risks.with_own_risks(merged, numbered), "merged")
        best = materialize(risks.dedupe(numbered), "kept")
    tables.remove(rows.sparkSession, passing)
    unknown = permissions.unknown_fields(head).select("skill_key", F.concat(F.lit("Unknown frontmatter field '"), "field", F.lit("' - analysis not supported yet")).alias("message"))
    warnings = unknown.unionByName(permissions.unsupported(queue).select("skill_key", "message")).unionByName(risks.remote_warnings(numbered))
    scored = score.score(head, best, config["riskReport"])
    reports = head.select("skill_key", F.coalesce("name", "skill_key").alias("skill_id"), "version").join(scored, "skill_key")
    used = findings.groupBy("skill_key", "rule_id").agg(F.min("finding_seq").alias("first_seq"))
    return Analysis(head, queue, skipped, findings, risks.with_risks(own, back), risks.with_permissions(best, sets), warnings, used, reports, kept)


def analyze_source(spark: SparkSession, source: str, config: dict | None = None, ref: str | None = None, sub: str = "", many: bool = False) -> Analysis:
    """The analysis of a folder, or of a folder at a git reference. Of files that are larger than the scan's limit the sizes alone are read."""
    limit = cfg.resolve(config)["scan"]["maxFileSize"]
    return analyze(files.load(spark, source, ref, sub, many, max_size=int(limit)), config)
