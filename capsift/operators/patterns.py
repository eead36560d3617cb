"""Many expressions on the lines of texts in one pass: an automaton of the rules' literals picks lines, and only these meet expressions.

Every rule names literals of which each of its matches holds one at least. One Aho-Corasick automaton of all of them reads a text once, whatever the number of rules; a line is then compared with the expressions of those rules
alone whose literals it holds, by Spark's own expressions. Time grows with the text and with the lines that hold a literal, not with the rules.

Defined cases: null contents have no lines; case is ignored for A-Z in the search for literals, so a rule may or may not ignore it; a rule without literals is an error, since each line would be its candidate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (rule id, Java expression, literals)
Rule = tuple[str, str, list[str]]


def _lower(text: str) -> str:
    """A-Z alone: lengths stay as they are."""
    return text.encode().lower().decode()


def _lines_with(text: str, found) -> Iterator[tuple[int, str, list[int]]]:
    """Line (from 1), its text and its rules, of the lines that hold a literal. found: the automaton."""
    rules: set[int] = set()
    line, start, end = 1, 0, text.find("\n")
    for at, of in found.iter(_lower(text)):
        while 0 <= end < at:  # the line of the literal's last character
            if rules:
                yield line, text[start:end], sorted(rules)
                rules = set()
            line, start, end = line + 1, end + 1, text.find("\n", end + 1)
        rules.update(of)
    if rules:
        yield line, text[start : end if end >= 0 else len(text)], sorted(rules)


def candidates(texts: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """texts: keys, content. Returns keys, line, text, rules: the lines that hold a literal, and the places (from 0) of the rules that it belongs to."""
    of: dict[str, set[int]] = {}
    for i, (name, _, literals) in enumerate(rules):
        if not literals or any(not x or "\n" in x for x in literals):
            raise ValueError(f"rule {name} needs literals, none of them empty or of several lines")
        for x in literals:
            of.setdefault(_lower(x), set()).add(i)
    listed = {x: tuple(sorted(s)) for x, s in of.items()}

    def search(batches: Iterable) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        found = ahocorasick.Automaton()
        for x, v in listed.items():
            found.add_word(x, v)
        found.make_automaton()
        for batch in batches:
            rows, at, text, hits = [], [], [], []
            for i, content in enumerate(batch.column("content")):
                for line, said, own in _lines_with(content.as_py(), found):
                    rows.append(i), at.append(line), text.append(said), hits.append(own)
            own = batch.select(keys).take(pa.array(rows, pa.int64()))
            columns = [*own.columns, pa.array(at, pa.int32()), pa.array(text, pa.string()), pa.array(hits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "line", "text", "rules"])

    kept = texts.where("content is not null").select(*keys, "content")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keys).schema)
    if not rules:
        return kept.limit(0).select(*keys, F.lit(0).alias("line"), F.col("content").alias("text"), F.array(F.lit(0)).alias("rules"))
    return kept.mapInArrow(search, f"{schema}, line int, text string, rules array<int>")


def line_matches(texts: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """texts: keys, content. Returns keys, line, rule (its place, from 0), rule_id: each line and rule whose expression matches in it."""
    table = F.broadcast(texts.sparkSession.createDataFrame([(i, name, regex) for i, (name, regex, _) in enumerate(rules)], "rule int, rule_id string, regex string"))
    each = candidates(texts, keys, rules).select(*keys, "line", "text", F.explode("rules").alias("rule")).join(table, "rule")
    return each.where(F.rlike("text", F.col("regex"))).select(*keys, "line", "rule", "rule_id")
