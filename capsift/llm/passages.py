"""Substring dedup by relative Lempel-Ziv parsing: passages that occur elsewhere in the corpus are cut out.

The reference of each document is the whole corpus. Its index has an entry for each phrase: of every window of `window`
words the anchor is its least `gram`-word run by hash (the leftmost of equals), and the windows that share
an anchor form one phrase. Equal windows have equal anchors, so the entries of one anchor, a reference block, hold
every place where a window of these can occur; blocks are dealt by the anchor's hash.

A document is factored from left to right, greedily: at the current window every place that its block offers as a source (the first and the last that have it) is followed over the next phrases
for as long as that source goes on; the one that goes on longest makes the factor, which is cut where its source ends, and the next factor begins at the next window that any source has.
Where a phrase differs from all others of its block a match ends within it: there, at the factor's boundary, the windows are looked up one by one, and a factor goes on through them. A factor
covers at least `window` words and is what is removed. Of a group of equal phrases each meets the group's first and last place only, never all others.

Anchors, phrases and windows are compared by 64-bit hashes, phrases and windows together with their anchor's.

Defined cases: null or empty texts have no words and lose none; texts shorter than a window lose none; rows equal in id
and text repeat each other like any two documents; null ids are allowed; an empty table gives no rows; other columns stay as they
are in `cut_passages`, whatever their names. One text is held in memory by the task that reads it. A phrase, an anchor or a window that very many places share is dealt over many tasks
(`common.spread_join`).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import common, textbuf

WINDOW = 35
GRAM = 8
_OWN = "__capsift_passages"


#: Runs of more words are hashed part by part: sums modulo 2**64 cancel in some runs of a thousand words and more.
PART = 512


class Sums:
    """Sums of word hashes of all texts of a slice: a hash of any run of words in one step, of long ones in one for each PART words."""

    def __init__(self, column: pa.Array):
        self.words = textbuf.Words(column)
        (self.hashes,), n = self.words.hashes(), len(self.words)
        self.up, self.down = textbuf.powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * self.up[:n], out=self.sums[1:])

    def range(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of runs of words."""
        size = np.broadcast_to(size, start.shape)
        out = textbuf.mix((self.sums[start + np.minimum(size, PART)] - self.sums[start]) * self.down[start])
        long = np.flatnonzero(size > PART)
        if long.size:
            more = -(-size[long] // PART)  # parts of each
            no = textbuf.ragged(np.zeros(len(long), dtype=np.int64), more)
            lo = np.repeat(start[long], more) + PART * no
            parts = self.range(lo, np.minimum(PART, np.repeat(size[long], more) - PART * no))
            out[long] = textbuf.mix(np.add.reduceat(textbuf.mix(parts ^ textbuf.mix((no + 1).astype(np.uint64))), np.cumsum(more) - more))
        return out


class Phrases(Sums):
    """Anchors and phrases of all texts of a slice."""

    def __init__(self, column: pa.Array, window: int = WINDOW, gram: int = GRAM):
        super().__init__(column)
        self.window, n = window, len(self.words)
        ends = np.repeat(self.words.first[1:], self.words.counts)  # of the text, for each word
        starts = np.flatnonzero(np.arange(n) + window <= ends)  # of all windows
        grams = self.range(np.arange(max(n - gram + 1, 0)), gram)
        best, width, span = np.arange(len(grams)), 1, window - gram + 1
        while width < span:  # best[i]: the least of grams i .. i + width - 1
            step = min(width, span - width)
            a, b = best[: max(len(best) - step, 0)], best[step:]
            best = np.where(grams[a] <= grams[b], a, b)
            width += step
        at = best[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        self.lo, self.at = starts[first], at[first]
        self.size = np.diff(np.append(first, len(starts)))  # windows of each phrase
        self.anchor = grams[self.at]
        self.text = np.searchsorted(self.words.first, self.lo, side="right") - 1

    def whole(self) -> np.ndarray:
        """A hash of each phrase with the place of its anchor."""
        shape = (self.size.astype(np.uint64) << np.uint64(32)) + (self.at - self.lo).astype(np.uint64)
        return textbuf.mix(self.range(self.lo, self.size + self.window - 1) ^ textbuf.mix(shape + np.uint64(1)))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _anchors(window: int, gram: int, batches):
    for b in textbuf.slices(batches, 0):
        p = Phrases(b.column(0), window, gram)
        yield pa.RecordBatch.from_arrays([_long(p.anchor)], names=["a"])


def _phrases(window: int, gram: int, batches):
    for b in textbuf.slices(batches, 1):
        p = Phrases(b.column(1), window, gram)
        key = b.column(0).take(pa.array(p.text))
        yield pa.RecordBatch.from_arrays([_long(p.anchor), _long(p.whole()), key, _long(p.lo - p.words.first[p.text]), _long(p.size)], names=["a", "f", "k", "lo", "size"])


def _windows(window: int, batches):
    """Of listed phrases (a, lo, size, alone) all windows."""
    for b in textbuf.slices(batches, 1):
        p = Sums(b.column(1))
        listed = b.column(2)
        many = np.diff(listed.offsets.to_numpy())
        flat = listed.flatten()
        a, lo, size, alone = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        row = np.repeat(np.arange(len(b)), many)
        start = textbuf.ragged(lo, size)
        row, a, alone = (np.repeat(x, size) for x in (row, a, alone))
        w = p.range(start + p.words.first[row], window)
        yield pa.RecordBatch.from_arrays([pa.array(a), _long(w), b.column(0).take(pa.array(row)), _long(start), pa.array(alone)], names=["a", "w", "k", "lo", "alone"])


def factors(pieces: list, window: int = WINDOW) -> list[tuple[int, int, bytes, int]]:
    """The greedy parse of one text. pieces: (first window, windows, sources), in order; a source (row, word) has the piece's windows from that word on. Returns (first word, words, source row, source's first word)."""
    pieces = sorted(pieces, key=lambda p: p[0])
    # from each piece on, how many windows each source (by row and distance) goes on for, from right to left
    reach: list[dict] = [{} for _ in pieces]
    for i in range(len(pieces) - 1, -1, -1):
        lo, size, sources = pieces[i]
        after = reach[i + 1] if i + 1 < len(pieces) and pieces[i + 1][0] == lo + size else {}
        for row, at in sources:
            reach[i][row, at - lo] = size + after.get((row, at - lo), 0)
    out, upto = [], -1
    for i, (lo, _, _) in enumerate(pieces):
        if lo < upto:  # within the factor
            continue
        (row, distance), windows = max(reach[i].items(), key=lambda x: (x[1], x[0]))
        upto = lo + windows
        out.append((lo, windows + window - 1, row, lo + distance))
    return out


def _cut(window: int, batches):
    """Texts without the words of their factors."""
    for b in textbuf.slices(batches, 0):
        texts, counts, removed, parsed = [], [], [], []
        for text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = (text or b"").split()
            kept, found = words, factors([(s["lo"], s["size"], [(x["k"], x["lo"]) for x in s["sources"]]) for s in spans or []], window)
            if found:
                held = np.ones(len(words), dtype=bool)
                for start, size, _, _ in found:
                    held[start : start + size] = False
                kept = [words[i] for i in np.flatnonzero(held).tolist()]
            texts.append(b" ".join(kept))
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            parsed.append(len(found))
        cols = {"kept": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_factors": pa.array(parsed, pa.int64())}
        yield pa.RecordBatch.from_arrays([*b.columns[2:], *cols.values()], names=[*b.schema.names[2:], *cols])


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k (a row's key), spans: array of lo (a window's first word), size (windows in a row), and the sources (row and word) that have them, too."""
    if not 1 <= gram <= window:
        raise ValueError("a gram must fit in a window")
    text = F.col(text_col).cast("binary").alias("text")
    keyed = docs.select(common.row_key(id_col, text_col).alias("k"), text)
    # anchors with at least two places
    counts = docs.select(text).mapInArrow(partial(_anchors, window, gram), "a long").groupBy("a").agg(F.count("*").alias("n"))
    shared = common.materialize(counts.where("n > 1"), "anchors")
    place, own = F.struct("k", "lo"), ["k", "lo"]
    phrases = keyed.mapInArrow(partial(_phrases, window, gram), "a long, f long, k binary, lo long, size long")
    blocks = common.materialize(common.spread_join(phrases, shared, ["a"], "n", own, "left_semi"), "phrases")
    classes = blocks.groupBy("a", "f").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.first("size").alias("size"))
    classes = common.materialize(classes, "classes")
    # rows that are equal in id and text stand at one place: then it is its own source
    others = F.when(F.col("first") == F.col("last"), F.array("first")).otherwise(F.array_distinct(F.filter(F.array("first", "last"), lambda s: s != place))).alias("sources")
    whole = common.spread_join(blocks, classes.where("n > 1").select("a", "f", "first", "last", "n"), ["a", "f"], "n", own).select("k", "lo", "size", others)
    # boundaries: blocks of different phrases; one place of each
    mixed = common.materialize(classes.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
    apart = common.spread_join(classes.withColumnRenamed("n", "many"), mixed, ["a"], "n", ["f"], "left_semi")
    ends = apart.groupBy(F.col("first.k").alias("k")).agg(F.collect_list(F.struct("a", F.col("first.lo").alias("lo"), "size", (F.col("many") == 1).alias("alone"))).alias("at"))
    windows = keyed.join(ends, "k").mapInArrow(partial(_windows, window), "a long, w long, k binary, lo long, alone boolean")
    windows = common.materialize(windows, "windows")
    twice = windows.groupBy("a", "w").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first < last")
    part = common.spread_join(windows.where("alone"), common.materialize(twice, "twice"), ["a", "w"], "n", own).select("k", "lo", F.lit(1).cast("long").alias("size"), others)
    spans = whole.unionByName(part.dropDuplicates(["k", "lo"]))
    return spans.groupBy("k").agg(F.collect_set(F.struct("lo", "size", "sources")).alias("spans"))


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The columns of docs in one struct `doc`, and kept (the words left, with single spaces), n_words, n_removed, n_factors."""
    with common.scratch(docs.sparkSession):
        spans = common.materialize(duplicate_spans(docs, id_col, text_col, window, gram), "spans", keep=True)
    rows = docs.select(common.row_key(id_col, text_col).alias("k"), F.col(text_col).cast("binary").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("doc"))
    joined = rows.join(spans, "k", "left").select("text", "spans", "doc")
    kind = joined.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(partial(_cut, window), f"doc {kind}, kept string, n_words long, n_removed long, n_factors long")


def op8_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_passages(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_factors")
