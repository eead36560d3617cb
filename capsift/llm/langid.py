"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

Words are runs of letters, in lower case. Learnt are, for each language, the log probabilities of hashed character
n-grams with word edges (a table of `buckets` values a language) and the share of each script among its letters. A word's
candidates are the languages with at least `MIN_SHARE` of letters in the word's script (all, if none has). Its
scores are sums over its n-grams; Viterbi finds the labels with the best total, less a penalty for each change of language.
A document's language is the one with the most letters; the score is its share of all letters.

Languages are learnt from at most about `sample_docs` documents of each (chosen by a hash of the id, whole texts), a bound that
keeps the fit small; the model's size is fixed by the number of languages and of buckets. More than `MAX_LANGS` languages are an error, not a truncation. Every document is predicted,
a long one in pieces that are cut between words and carry Viterbi's state, so a task needs some (languages / 8 + 20) bytes for a word of the longest text.

Defined cases: null texts and texts without a letter give "und" with score 0; so does everything if nothing can be learnt;
null or repeated ids are predicted like any other, a null id counts as the text "" in the split; an empty table gives no rows; other columns are kept
out. Ties between languages go to the first by name.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import common, textbuf

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SAMPLE_DOCS = 20_000
#: The model holds 4 x BUCKETS bytes a language.
MAX_LANGS = 256
#: Characters of a piece of a long text, and scores (words x languages) that are held at once.
PIECE, HELD = 1 << 18, 1 << 22
SWITCH = 12.0
SMOOTH = 0.5
MIN_SHARE = 0.005
UNKNOWN = "und"
#: First code points of ranges, and the script of each; letters of the ranges "other" share one script.
RANGES = [
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = sorted({name for _, name in RANGES})
_STARTS = np.array([a for a, _ in RANGES])
_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in RANGES])
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Text:
    """Letters and words of many texts: codes (0 for what is no letter, also between texts), first and last letter of each word, and its text."""

    def __init__(self, texts: list):
        joined = "\0".join(t.lower() if t else "" for t in texts)
        codes = np.frombuffer(("\0\0\0\0" + joined + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[codes]
        self.codes = np.where(letter, codes, 0).astype(np.uint32)
        edge = np.diff(letter.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        sizes = np.array([len(t.lower()) if t else 0 for t in texts], dtype=np.int64)
        bounds = 4 + np.concatenate(([0], np.cumsum(sizes + 1)))
        self.of = np.searchsorted(bounds, self.starts, side="right") - 1
        self.n = len(texts)

    def grams(self, buckets: int):
        """For each order: the buckets of the n-grams that end at each place, and which places hold one: n-grams of letters, with one edge at most before and behind."""
        c = self.codes
        letter = c > 0
        for n in ORDERS:
            h = np.full(len(c), n * 0x1B873593 & 0xFFFFFFFF, dtype=np.uint32)
            inner = np.ones(len(c), dtype=bool)
            for j in range(n):
                back = n - 1 - j
                shifted = c if not back else np.concatenate((np.zeros(back, dtype=np.uint32), c[:-back]))
                h ^= (shifted + np.uint32(j + 1)) * _MULTIPLIERS[j]
                h = (h << np.uint32(13)) | (h >> np.uint32(19))
                if 0 < j < n - 1:
                    inner &= shifted > 0
            first = letter if n == 1 else np.concatenate((np.zeros(n - 1, dtype=bool), letter[: 1 - n]))
            held = inner & (letter | first) if n > 1 else letter
            if n == 2:
                held = letter | first
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            yield (h & np.uint32(buckets - 1)).astype(np.int64), held

    def scripts(self) -> np.ndarray:
        """Of each word, by its first letter."""
        return _OF_RANGE[np.searchsorted(_STARTS, self.codes[self.starts], side="right") - 1]


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 3 == 1


def _count(buckets: int, batches):
    """lang, key (bucket, or from `buckets` on a script), n: the sums of one task."""
    sums: dict[str, np.ndarray] = {}
    for b in textbuf.slices(batches, 1):
        by: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).extend(pieces(text))
        for lang, texts in by.items():
            t = Text(texts)
            n = sums.setdefault(lang, np.zeros(buckets + len(SCRIPTS), dtype=np.int64))
            for key, held in t.grams(buckets):
                n[:buckets] += np.bincount(key[held], minlength=buckets)
            n[buckets:] += np.bincount(t.scripts(), weights=t.ends - t.starts, minlength=len(SCRIPTS)).astype(np.int64)
    if len(sums) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "key": at, "n": n[at]})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, buckets: int = BUCKETS) -> dict:
    """From all rows with a language. The model: langs, table (buckets x languages, log probabilities), allowed (scripts x languages)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    many = rows.groupBy("lang").agg(F.count("*").alias("many")).limit(MAX_LANGS + 1).collect()  # a row for each language
    if len(many) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of {lang_col}: clean the column, or raise MAX_LANGS with the memory of a task")
    rates = docs.sparkSession.createDataFrame([(r["lang"], sample_docs / r["many"]) for r in many], "lang string, rate double")
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.join(F.broadcast(rates), "lang").where(chance < F.col("rate"))  # MAX_LANGS rows at most
    counts = chosen.select("lang", "text").mapInArrow(partial(_count, buckets), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    per_lang = counts.groupBy("lang").agg(F.collect_list("key").alias("key"), F.collect_list("n").alias("n"))  # MAX_LANGS x buckets values at most
    langs, tables, shares = [], [], []
    for r in sorted(per_lang.collect(), key=lambda r: r["lang"]):
        n = np.zeros(buckets + len(SCRIPTS))
        n[r["key"]] = r["n"]
        langs.append(r["lang"])
        tables.append(np.log((n[:buckets] + SMOOTH) / (n[:buckets].sum() + SMOOTH * buckets)))
        shares.append(n[buckets:] / max(1, n[buckets:].sum()))
    allowed = np.array(shares).T >= MIN_SHARE if langs else np.zeros((len(SCRIPTS), 0), dtype=bool)
    allowed[~allowed.any(axis=1)] = True
    return {"langs": langs, "table": np.array(tables, dtype=np.float32).T.copy() if langs else np.zeros((buckets, 0), dtype=np.float32), "allowed": allowed}


def word_scores(t: Text, model: dict) -> np.ndarray:
    """words x languages; languages that the word's script rules out get a very low score."""
    table, n = model["table"], len(t.starts)
    if not n:
        return np.zeros((0, table.shape[1]))
    padded = np.concatenate((table, np.zeros((1, table.shape[1]), dtype=table.dtype)))  # the last row is for no n-gram
    keys = [np.where(held, key, len(table)).astype(np.int32) for key, held in t.grams(len(table))]
    out, step = np.empty((n, table.shape[1]), dtype=np.float64), max(1, HELD // (8 * table.shape[1]))
    for i in range(0, n, step):
        j = min(i + step, n)
        lo, hi = int(t.starts[i]), int(t.ends[j - 1]) + 2
        total = np.zeros((hi - lo, table.shape[1]), dtype=np.float32)
        for key in keys:
            total += np.take(padded, key[lo:hi], axis=0)
        # n-grams end at a word's letters or at the place behind it
        out[i:j] = np.add.reduceat(total, np.stack((t.starts[i:j], t.ends[i:j] + 1), axis=1).ravel() - lo, axis=0)[::2]
    return np.where(model["allowed"][t.scripts()], out, out.min(axis=1, keepdims=True) - 1e4)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The label of each word. first: for each text its first word, and at the end the number of words. All texts go step by step together."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, base = sizes[order], first[:-1][order]
    labels = np.zeros(len(scores), dtype=np.int64)
    if not len(scores):
        return labels
    longest, active = int(sizes[0]), int((sizes > 0).sum())
    changed, before = [], []
    total = scores[base[:active]].copy()
    last = np.zeros(len(sizes), dtype=np.int64)
    live = [active]
    for step in range(1, longest + 1):
        n = int(np.searchsorted(-sizes, -step, side="left"))  # texts with more than `step` words
        if n < live[-1]:
            last[n : live[-1]] = total[n : live[-1]].argmax(axis=1)
        if not n:
            break
        total = total[:n]
        best = total.argmax(axis=1)
        jump = total[np.arange(n), best][:, None] - penalty
        changed.append(total < jump)
        before.append(best)
        total = np.maximum(total, jump) + scores[base[:n] + step]
        live.append(n)
    now = last.copy()
    for step in range(len(live) - 1, -1, -1):
        n = live[step]
        labels[base[:n] + step] = now[:n]
        if step:
            hop = changed[step - 1][np.arange(n), now[:n]]
            now[:n] = np.where(hop, before[step - 1], now[:n])
    return labels


class Carried:
    """Viterbi over one text that comes in pieces: the same labels as viterbi() on the whole, with a bit for each word and language."""

    def __init__(self, penalty: float = SWITCH):
        self.penalty, self.total, self.pieces = penalty, None, []

    def add(self, scores: np.ndarray) -> None:
        if not len(scores):
            return
        changed, before = np.zeros(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int16)
        for i, row in enumerate(scores):
            if self.total is None:
                self.total = row.copy()
                continue
            best = int(self.total.argmax())
            jump = self.total[best] - self.penalty
            changed[i], before[i] = self.total < jump, best
            self.total = np.maximum(self.total, jump) + row
        self.pieces.append((np.packbits(changed, axis=1), before))

    def labels(self) -> np.ndarray:
        if self.total is None:
            return np.zeros(0, dtype=np.int64)
        now, out = int(self.total.argmax()), []
        for packed, before in reversed(self.pieces):
            label = np.empty(len(before), dtype=np.int64)
            for i in range(len(before) - 1, -1, -1):
                label[i] = now
                if packed[i, now >> 3] >> (7 - (now & 7)) & 1:
                    now = int(before[i])
            out.append(label)
        return np.concatenate(out[::-1])


def pieces(text: str, size: int | None = None):
    """The text in pieces of about `size` characters, cut behind white space if there is any, else behind another character that is no letter: never within a word."""
    at, size = 0, size or PIECE
    while len(text) - at > size:
        end = at + size
        cut = max(text.rfind(c, at, end) for c in " \n\t")
        if cut < at:
            cut = next((i for i in range(end - 1, at, -1) if not text[i].isalpha()), -1)
        if cut < at:
            cut = next((i for i in range(end, len(text)) if not text[i].isalpha()), len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    if at < len(text) or not text:
        yield text[at:]


def _labelled(texts: list, m: dict, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: which text, how many letters, which label."""
    if len(texts) == 1 and texts[0] and len(texts[0]) > PIECE:
        carried, letters = Carried(penalty), [np.zeros(0, dtype=np.int64)]
        for part in pieces(texts[0]):
            t = Text([part])
            carried.add(word_scores(t, m))
            letters.append(t.ends - t.starts)
        letters = np.concatenate(letters)
        return np.zeros(len(letters), dtype=np.int64), letters, carried.labels()
    t = Text(texts)
    return t.of, t.ends - t.starts, viterbi(word_scores(t, m), np.searchsorted(t.of, np.arange(t.n + 1)), penalty)


def _predict(model, penalty: float, batches):
    m = model.value
    langs, n_langs = [*m["langs"], UNKNOWN], len(m["langs"])
    # the scores of a slice's words are held together
    for b in textbuf.slices(batches, 1, min(1 << 20, HELD // max(1, n_langs))):
        texts = b.column(1).to_pylist()
        n = len(texts)
        if n_langs:
            of, letters, labels = _labelled(texts, m, penalty)
            weight = np.bincount(of * n_langs + labels, weights=letters, minlength=n * n_langs).reshape(n, n_langs)
            total = weight.sum(axis=1)
            best = np.where(total > 0, weight.argmax(axis=1), n_langs)
            score = np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0)
            new = np.ones(len(labels), dtype=bool)
            new[1:] = (labels[1:] != labels[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            row, lang = of[at], labels[at]
            many = np.bincount(row, minlength=n)
            begin = np.searchsorted(of, np.arange(n))
            start, end = at - begin[row], np.append(at[1:], len(labels)) - begin[row]
        else:
            best, score, many = np.full(n, 0), np.zeros(n), np.zeros(n, dtype=np.int64)
            start = end = lang = np.zeros(0, dtype=np.int64)
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([langs[i] for i in lang], pa.string())], names=["first", "end", "lang"]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([langs[i] for i in best], pa.string()), pa.array(score), spans], names=["id", "lang_pred", "score", "spans"])


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """id, lang_pred, score, spans (first word, end, lang) of every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets x 4 bytes
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_predict, shared, penalty), f"id {kind}, lang_pred string, score double, spans array<struct<first:long,end:long,lang:string>>")


def op5_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
