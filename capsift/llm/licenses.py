"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates the expressions behind tags.

The automaton runs over the words of a text (A-Z lower-cased; runs of digits, letters and what lies outside ASCII), so a phrase is found whatever stands between its words, and phrases may
overlap. Behind a tag (`SPDX-License-Identifier:`, `license-expression:`, `license =`) stands an expression of identifiers, AND, OR, WITH and parentheses; it is read from the original text up to
the first token that can't follow, never past the line. WITH binds closest, then AND, then OR. Its value is an obligation: 1 permissive, 2 copyleft of files or libraries, 3 copyleft of works, 4 of
services; OR takes the least of its sides, AND the greatest, WITH (an exception) takes one off from 3 on. Cost is linear in the text, however many tags, brackets or places it has.

The score is the chance that some evidence holds: 1 - product of (1 - weight) over a document's distinct phrases and expressions.

Defined cases: a null text is an empty one; a text without a word has no place; a document's places are not merged, so `general public license` is one beside `lesser general public license`; a
dangling operator or an open bracket is left out; an expression without a known identifier is none; repeated rows come back alike; an empty table gives no rows; other columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import common, textbuf

# The phrases that every scan reports.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases: words, label, weight.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("licensed under the apache license version 2 0", "apache", 0.9),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 0.9),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 0.9),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.9),
    ("lesser general public license", "lgpl", 0.7),
    ("library general public license", "lgpl", 0.7),
    ("affero general public license", "agpl", 0.7),
    ("mozilla public license", "mpl", 0.7),
    ("eclipse public license", "epl", 0.7),
    ("boost software license", "bsl", 0.7),
    ("creative commons attribution", "cc-by", 0.7),
    ("creative commons zero", "cc0", 0.7),
    ("bsd license", "bsd", 0.6),
    ("bsd 2 clause", "bsd", 0.6),
    ("bsd 3 clause", "bsd", 0.6),
    ("isc license", "isc", 0.6),
    ("zlib license", "zlib", 0.6),
    ("gnu gpl", "gpl", 0.6),
    ("gnu lgpl", "lgpl", 0.6),
    ("gnu agpl", "agpl", 0.6),
]
BASE_WEIGHT, EXPRESSION_WEIGHT = 0.6, 0.9
TAGS = ["spdx license identifier", "license expression", "license"]
# Identifiers by what they begin with (a version may follow): label, obligation.
IDENTIFIERS = {"mit": ("mit", 1), "apache": ("apache", 1), "bsd": ("bsd", 1), "isc": ("isc", 1), "zlib": ("zlib", 1), "unlicense": ("unlicense", 1), "cc0": ("cc0", 1), "cc-by": ("cc-by", 1), "bsl": ("bsl", 1), "mpl": ("mpl", 2), "epl": ("epl", 2), "lgpl": ("lgpl", 2), "gpl": ("gpl", 3), "agpl": ("agpl", 4)}

_OWN = "__capsift_licenses"
_BINDS = {"or": 1, "and": 2, "with": 3}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_SAYS = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_PLACE = pa.struct([("word", pa.int64()), ("n", pa.int32()), ("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_())])
_EXPRESSION = pa.struct([("word", pa.int64()), ("postfix", pa.string()), ("labels", pa.list_(pa.string())), ("obligation", pa.int32())])
_FOUND = pa.struct([("n_words", pa.int64()), ("places", pa.list_(_PLACE)), ("expressions", pa.list_(_EXPRESSION)), ("labels", pa.list_(pa.string())), ("score", pa.float64())])
_SQL = "struct<n_words: bigint, places: array<struct<word: bigint, n: int, phrase: string, label: string, base: boolean>>, expressions: array<struct<word: bigint, postfix: string, labels: array<string>, obligation: int>>, labels: array<string>, score: double>"


@lru_cache(1)
def automaton():
    """Over the words of a text with a space before, between and behind them: kind, words, label of each phrase that ends at a place."""
    import ahocorasick

    found = ahocorasick.Automaton()
    held: dict[str, list[tuple]] = {}
    for phrase, label in BASE.items():
        held.setdefault(phrase, []).append(("base", phrase, label))
    for phrase, label, _ in NOTICES:
        held.setdefault(phrase, []).append(("notice", phrase, label))
    for tag in TAGS:
        held.setdefault(tag, []).append(("tag", tag, None))
    for phrase, what in held.items():
        found.add_word(f" {phrase} ", (len(phrase.split()), what))
    found.make_automaton()
    return found


def identifier(token: str) -> tuple[str, int] | None:
    """Label and obligation of a licence identifier; the name must end where the prefix does, or go on with a version."""
    low = token.lower().rstrip("+")
    for part in (low, low.rsplit("-", 1)[0], low.split("-", 1)[0], "-".join(low.split("-", 2)[:2])):
        if part in IDENTIFIERS:
            return IDENTIFIERS[part]
    return None


def postfix(raw: bytes, at: int) -> list[str]:
    """The expression at a place of a text in postfix form, by the shunting-yard method; empty if there is none."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what may come next
    while m := _TOKEN.match(raw, at):
        token = m[1].decode()
        low = token.lower()
        if operand:
            if token == "(":
                held.append(token)
            elif held and held[-1] == "with":
                if "exception" not in low:
                    break
                out.append(token)
                operand = False
            elif token != ")" and low not in _BINDS and (identifier(token) or low.startswith("licenseref-")):
                out.append(token)
                operand = False
            else:
                break
        elif token == ")":
            if "(" not in held:
                break
            while (top := held.pop()) != "(":
                out.append(top)
        elif low in _BINDS:
            while held and _BINDS.get(held[-1], 0) >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        else:
            break
        at = m.end()
    while operand and held:  # what waits for an operand that doesn't come
        operand = held.pop() == "("
    return [] if operand else out + [x for x in reversed(held) if x != "("]


def evaluate(rpn: list[str]) -> tuple[set[str], int]:
    """Labels and obligation of an expression in postfix form; an unknown identifier obliges like the strictest."""
    labels: set[str] = set()
    stack: list[int] = []
    for token in rpn:
        if token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if token == "or" else max(a, b) if token == "and" else a - (a >= 3))
        elif known := identifier(token):
            labels.add(known[0])
            stack.append(known[1])
        else:
            stack.append(0 if "exception" in token.lower() else 4)
    return labels, stack[-1]


def scan(raw: bytes) -> dict:
    """Places, expressions, labels and score of one text."""
    flat = raw.translate(_FOLD)
    words = flat.split()
    line = b" " + b" ".join(words) + b" "
    places, tags, spaces, upto = [], {}, 0, 0
    for end, (n, what) in automaton().iter(line.decode("latin-1")):
        spaces += line.count(b" ", upto, end + 1)
        upto = end + 1
        first = spaces - n - 1
        for kind, phrase, label in what:
            if kind == "tag":
                tags.setdefault(first + n - 1, first)
            else:
                places.append({"word": first, "n": n, "phrase": phrase, "label": label, "base": kind == "base"})
    expressions = []
    if tags:
        ends = {i: m.end() for i, m in enumerate(_WORD.finditer(flat)) if i in tags}
        for last, first in sorted(tags.items()):
            if (m := _SAYS.match(raw, ends[last])) and (rpn := postfix(raw, m.end())):
                labels, obligation = evaluate(rpn)
                if labels:
                    expressions.append({"word": first, "postfix": " ".join(rpn), "labels": sorted(labels), "obligation": obligation})
    weight = {p: w for p, _, w in NOTICES}
    left = 1.0
    for w in sorted([weight.get(p, BASE_WEIGHT) for p in {x["phrase"] for x in places}] + [EXPRESSION_WEIGHT] * len({x["postfix"] for x in expressions})):
        left *= 1 - w
    return {"n_words": len(words), "places": places, "expressions": expressions, "labels": sorted({x["label"] for x in places} | {y for x in expressions for y in x["labels"]}), "score": 1 - left}


def _scan(text: str, keep: list[str], batches):
    for b in batches:
        at = b.schema.get_field_index(text)
        for part in textbuf.slices([b], at):
            found = [scan(t.as_py() or b"") for t in part.column(at).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, _FOUND)], names=[*keep, _OWN])


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all), and a struct column `__capsift_licenses`: n_words; places (first word, words, phrase, label, whether it is a base phrase); expressions (the tag's word, postfix
    form, labels, obligation); all labels; score."""
    keep = docs.columns if keep is None else keep
    schema = docs.select(*keep).withColumn(_OWN, F.lit(None).cast(_SQL)).schema
    sent = docs.select(*dict.fromkeys([*keep, text_col]))
    return sent.mapInArrow(partial(_scan, text_col, keep), schema)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", f"{_OWN}.*")
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("expressions").cast("long").alias("n_expressions"),
    )
