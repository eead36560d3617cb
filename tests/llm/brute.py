"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(docs, window):
    """docs: (id, text). Returns [(id, n_words, n_removed, kept_sha256)]."""
    split = [(i, words(t)) for i, t in docs]
    seen = Counter(tuple(w[j : j + window]) for _, w in split for j in range(len(w) - window + 1))
    out = []
    for i, w in split:
        held = [True] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                held[j : j + window] = [False] * window
        kept = [x for x, h in zip(w, held) if h]
        out.append((i, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return out


def edit_within_one(a, b):
    """Whether word lists differ by one insertion, deletion or replacement at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def lines(docs, min_words=5):
    """docs: (id, text). Returns [(id, n_lines, n_removed, kept_sha256)]; rows equal in id and text are one document."""
    key = lambda d: (d[0] is not None, d[0] or 0, d[1] or "")
    seen, gone = [], {}
    for d in sorted(set(docs), key=key):
        for no, text in enumerate((d[1] or "").split("\n")):
            w = words(text)
            if not w:
                continue
            if any(w == v or (min(len(w), len(v)) >= min_words and edit_within_one(w, v)) for v in seen):
                gone.setdefault(d, set()).add(no)
            seen.append(w)
    out = []
    for d in docs:
        every = [] if d[1] is None else d[1].split("\n")
        kept = [x for i, x in enumerate(every) if i not in gone.get(d, ())]
        out.append((d[0], len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def fingerprint(text):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, threshold=4):
    """prints: (id, fingerprint). Returns {(id, fingerprint): smallest id reachable}."""
    nodes = sorted(set(f for _, f in prints))
    root = {f: f for f in nodes}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for d, f in prints:
        if d is not None:
            least[top(f)] = min(least.get(top(f), d), d)
    return {(d, f): least.get(top(f)) for d, f in prints}


def token_ids(texts, path):
    from tokenizers import Tokenizer

    return [x.ids + [1] for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    w = words(text)
    lines_ = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines_) - len(set(lines_)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_kept(docs):
    """Of each group of texts that links of 0.8 or more connect the smallest id."""
    found = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(top(i), []).append((d is None, d or 0))
    return sorted(None if a else d for a, d in map(min, groups.values())) if all(d is not None for d, _ in docs) else sorted(map(min, groups.values()))
