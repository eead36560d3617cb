"""Licence scans, the Merkle manifest and the filter audit against plain versions."""

import random
import re
import zlib
from hashlib import sha256
from itertools import permutations

import pytest

import brute
from capsift.llm import filter_audit, licenses, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# -- licences ----------------------------------------------------------------------------------------------------------


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(text, phrases):
    w = fold(text)
    return sorted((i, p) for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


LICENSED = [
    None, "", "  \n", "MIT License", "mit-license MIT LICENSE, the Apache License", "GNU Lesser General Public License", "general public licenses", "xmit license", "mit\n\nlicense mitlicense",
    "general public license general public license", "été MIT license naïve", "Kit license", "mit license" * 3, "x SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause */", "license: nothing known",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nSPDX-License-Identifier: MIT", 'a "license": "MIT OR Apache-2.0", ', "license = MIT AND", "license: ((MIT", "license: MIT) OR GPL", "Permission is hereby granted, free of charge, to any person obtaining a copy",
]


def test_scan_equals_plain(spark):
    rng = random.Random(3)
    parts = ["mit", "license", "apache", "general", "public", "x", "é", "lesser", "gnu"]
    texts = LICENSED + ["".join(rng.choice(parts) + rng.choice([" ", "-", "\n", ": "]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as places", "2 as labels", "3 as score")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    phrases = list(licenses.BASE) + [p for p, _, _ in licenses.NOTICES]
    for i, text in enumerate(texts):
        own = got[i]["__capsift_licenses"]
        assert got[i]["text"] == text and got[i]["places"] == "x"
        assert own["n_words"] == len(fold(text))
        assert sorted((p["word"], p["phrase"]) for p in own["places"]) == places(text, phrases)
        assert sorted(p["word"] for p in own["places"] if p["base"]) == [i for i, _ in places(text, licenses.BASE)]
        assert {p["label"] for p in own["places"]} <= set(own["labels"]) and 0 <= own["score"] <= 1 and (own["score"] > 0) == bool(own["labels"])


def descend(tokens):
    """Value of an expression by recursive descent: labels, obligation."""

    def choice(i):
        value, i = both(i)
        while i < len(tokens) and tokens[i].lower() == "or":
            other, i = both(i + 1)
            value = (value[0] | other[0], min(value[1], other[1]))
        return value, i

    def both(i):
        value, i = one(i)
        while i < len(tokens) and tokens[i].lower() == "and":
            other, i = one(i + 1)
            value = (value[0] | other[0], max(value[1], other[1]))
        return value, i

    def one(i):
        if tokens[i] == "(":
            value, i = choice(i + 1)
            i += 1
        else:
            known = licenses.identifier(tokens[i])
            value, i = (({known[0]}, known[1]) if known else (set(), 4)), i + 1
        if i < len(tokens) and tokens[i].lower() == "with":
            value, i = (value[0], value[1] - (value[1] >= 3)), i + 2
        return value, i

    return choice(0)[0]


def test_expressions_equal_recursive_descent():
    rng = random.Random(9)

    def say(depth):
        if not depth or rng.random() < 0.3:
            x = rng.choice(["MIT", "Apache-2.0", "GPL-3.0-or-later", "AGPL-3.0-only", "LGPL-2.1+", "LicenseRef-own"])
            return [x, rng.choice(["WITH", "with"]), "GCC-exception-3.1"] if rng.random() < 0.2 else [x]
        out = say(depth - 1)
        for _ in range(rng.randint(0, 2)):
            out += [rng.choice(["AND", "OR", "and", "or"]), *say(depth - 1)]
        return ["(", *out, ")"] if rng.random() < 0.5 else out

    for _ in range(400):
        tokens = say(4)
        rpn = licenses.postfix(" ".join(tokens).encode(), 0)
        assert licenses.evaluate(rpn) == descend(tokens), tokens
    assert licenses.postfix(b"MIT OR ", 0) == ["MIT"] and licenses.postfix(b"((MIT AND", 0) == ["MIT"] and licenses.postfix(b"OR MIT", 0) == []
    assert licenses.postfix(b"MIT OR you may", 0) == ["MIT"] and licenses.postfix(b"MIT WITH us", 0) == ["MIT"] and licenses.postfix(b"()", 0) == []
    assert len(licenses.postfix(b"(" * 200_000 + b"MIT" + b")" * 200_000, 0)) == 1


def test_labels_of_expressions():
    own = licenses.scan(b"# SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND MPL-2.0\n")
    assert own["expressions"] == [{"word": 0, "postfix": "MIT GPL-3.0-only or MPL-2.0 and", "labels": ["gpl", "mit", "mpl"], "obligation": 2}]
    assert own["labels"] == ["gpl", "mit", "mpl"] and own["score"] == 0.9
    assert licenses.identifier("mitigation") is None and licenses.identifier("CC-BY-4.0") == ("cc-by", 1) and licenses.identifier("bsd-3-clause-clear") == ("bsd", 1)


def test_scan_is_linear():
    import time

    for text in (b"license: " * 100_000, b"license: (" * 100_000, b"mit license " * 100_000, b"license" + b" " * 1_000_000 + b": x", b"license: MIT AND " * 60_000):
        began = time.time()
        licenses.scan(text)
        assert time.time() - began < 5


def test_op11_on_the_tables(spark):
    from capsift.llm.queries import queries

    rows = queries()["op11_license_scan"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        base = places(docs[r["doc_id"]], licenses.BASE)
        starts = [i for i, _ in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(fold(docs[r["doc_id"]])), len(base), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({licenses.BASE[p] for _, p in base})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


# -- Merkle manifest ---------------------------------------------------------------------------------------------------


def hexed(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return hexed("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """All levels of a list of hashes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hexed("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, i, h):
    """Siblings and the folded hash from place i up."""
    sib = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        sib += run[: i % 3] + run[i % 3 + 1 :]
        h = hexed("".join(run[: i % 3] + [h] + run[i % 3 + 1 :]))
        i //= 3
    return sib, h


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append(tree([leaf(r, r[1]) for r in groups[s]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            seen = leaf(r, r[1].replace("\n", "") if hit and r[1] is not None else r[1])
            a, h = climb(trees[k], i, seen)
            b, h = climb(top, k, h)
            out.append((r[0], leaf(r, r[1]), trees[k][-1][0], top[-1][0], hexed("".join(a + b)), h, h == top[-1][0]))
    return out


def proved(df):
    hit = "crc32(cast(doc_id as string)) % 2 = 0"
    from pyspark.sql import functions as F

    found = merkle.manifest(df, merkle.DOCUMENT, {"text": F.when(F.expr(hit), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    return sorted((tuple(r)[:7] for r in found.collect()), key=repr)


def test_manifest_equals_plain(spark, texts):
    rows = [(i, t, [None, "en", "fr"][(i or 0) % 3], [None, "", "a", "b", "é"][(i or 0) % 5], len(t or "")) for i, t in texts] + [(7, "alone\nhere", None, "single", None), (8, "x", "en", "a", 1), (8, "x", "en", "a", 1), (8, "y\n", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as hash", "2 as grp", "3 as pos", "4 as leaf", "5 as tie")
    assert proved(df) == sorted(manifest(rows), key=repr)


@pytest.mark.parametrize("n", [1, 730, 2188])
def test_manifest_of_sizes(spark, n):
    rows = [(i, f"t{i}\nu", "en", "hot" if i % 4 else None, i) for i in range(n)]
    assert proved(spark.createDataFrame(rows, SCHEMA)) == sorted(manifest(rows), key=repr)


def test_manifest_of_many_sources_and_of_none(spark):
    rows = [(i, f"t{i}\n", "en", f"s{i % 1500}", i) for i in range(1700)]
    assert proved(spark.createDataFrame(rows, SCHEMA)) == sorted(manifest(rows), key=repr)
    assert proved(spark.createDataFrame([], SCHEMA)) == []


def test_manifest_of_equal_rows(spark):
    rows = [(5, "same\ntext", "en", "s", 9)] * 40
    assert proved(spark.createDataFrame(rows, SCHEMA)) == sorted(manifest(rows), key=repr)


# -- filter audit ------------------------------------------------------------------------------------------------------


def audit(rows, labels):
    """rows: id, text, source. The contract, order by order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = brute.words(t)
        upper = sum("A" <= c <= "Z" for c in t)
        fails.append((s or "", i in good, i in toxic, {f for f, x in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]) if x}))
    out, shares = {}, {}
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[3]]
                left = [x for x in left if f not in x[3]]
                all_fails = sum(f in x[3] for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), all_fails - len(gone), sum(x[3] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return sorted((*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def run_audit(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as w", "3 as good")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audit(filter_audit.labelled(filter_audit.failures(docs.select("doc_id", "text", "source")), marks)).collect())


def test_audit_equals_plain(spark, texts):
    rng = random.Random(2)
    rows = [(i, t, ["a", "b", None, ""][(i or 0) % 4]) for i, t in texts] + [(100 + k, "".join(rng.choice(["Big ", "small ", "# ", f"w{rng.randint(0, 400)} "]) for _ in range(rng.randint(1, 500))), "c") for k in range(60)]
    rows += [(200, rows[70][1], "a"), (199, rows[70][1], "c"), (70, None, "a")]
    labels = [(i, i % 3 == 0 and 1 or None, i % 5 == 0) for i in range(150)] + [(3, 0, 1), (None, 1, 1), (4, 1, None)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    want = audit(rows, labels)
    assert run_audit(spark, rows, labels) == want
    assert run_audit(spark, [], []) == []


def test_bitsets_in_runs():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 1000
    parts, bits = rng.choice(["x", "y", "z", "once"], n, p=[0.6, 0.3, 0.099, 0.001]), rng.random((7, n)) < 0.3
    batch = pa.RecordBatch.from_arrays([pa.array(parts), *(pa.array(b) for b in bits)], names=["part", *"0123456"])
    old, filter_audit.ROWS = filter_audit.ROWS, 64
    try:
        found = pa.Table.from_batches(filter_audit._index(5, [batch.slice(i, 37) for i in range(0, n, 37)])).to_pandas()
    finally:
        filter_audit.ROWS = old
    total = found.groupby(["part", "subset", "filter"])[["kept", "removed", "good_lost", "toxic_lost"]].sum()
    for (part, subset, f), row in total.iterrows():
        left = (parts == part) & ~np.any([bits[i] for i in range(5) if subset >> i & 1] or [np.zeros(n, bool)], axis=0)
        gone = left & bits[f]
        assert list(row) == [(left & ~bits[f]).sum(), gone.sum(), (gone & bits[5]).sum(), (gone & bits[6]).sum()]
    assert len(total) == 80 * len(set(parts))
