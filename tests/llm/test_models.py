import numpy as np
import pytest
from pyspark.sql import functions as F

from capsift.llm import langid, topk

EN = "the of and to in is that for with as on by this it was are from which"
FR = "le la les des une que dans pour avec est sur par cette qui sont du au ce"
RU = "это как что для его она был они при так все тот мне год уже под над или"


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(t.split()) for _ in range(30)), lang) for i in range(90) for lang, t in (("en", EN), ("fr", FR), ("ru", RU))]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)] + [(1000, None, "en"), (1001, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_are_found_on_held_out_rows(labelled):
    model = langid.fit(labelled.where(~langid.held_out(F.col("doc_id"))))
    assert model["langs"] == ["en", "fr", "ru"]
    found = langid.predict(labelled.where(langid.held_out(F.col("doc_id"))), model).join(labelled, F.col("id") == F.col("doc_id")).collect()
    assert found and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97


def test_spans_scripts_and_odd_texts(spark, labelled):
    model = langid.fit(labelled)
    rows = [(1, f"{EN} {FR}"), (2, f"{RU} {EN}"), (3, None), (4, ""), (5, "12 %$ 3"), (6, "Привет"), (None, EN), (1, FR), (7, "İẞ " + EN), (8, (EN + " ") * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "1 as id", "2 as score")
    found = langid.predict(df, model).collect()
    spans = lambda i: [[(s.first, s.end, s.lang) for s in r.spans] for r in found if r.id == i]
    assert [(0, 18, "en"), (18, 36, "fr")] in spans(1)
    assert spans(2) == [[(0, len(RU.split()), "ru"), (len(RU.split()), len(RU.split()) + 18, "en")]]
    assert all(r.lang_pred == "und" and r.score == 0 and not r.spans for r in found if r.id in (3, 4, 5))
    assert {(r.id, r.lang_pred) for r in found} >= {(6, "ru"), (None, "en"), (1, "fr"), (8, "en")}
    assert all(0 <= r.score <= 1 for r in found) and len(found) == len(rows)


def test_nothing_learnt_and_empty_tables(spark, labelled):
    empty = langid.fit(labelled.limit(0))
    assert {r.lang_pred for r in langid.predict(labelled.limit(3), empty).collect()} == {"und"}
    assert langid.predict(labelled.limit(0), langid.fit(labelled)).count() == 0


def test_viterbi_equals_trying_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    sizes = [0, 5, 1, 6, 0, 3]
    scores = rng.normal(0, 3, (sum(sizes), 3))
    first = np.concatenate(([0], np.cumsum(sizes)))
    labels = langid.viterbi(scores, first, 2.0)
    value = lambda s, path: s[np.arange(len(path)), list(path)].sum() - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
    for a, b in zip(first, first[1:]):
        if b > a:
            best = max(value(scores[a:b], p) for p in product(range(3), repeat=int(b - a)))
            assert value(scores[a:b], labels[a:b].tolist()) == pytest.approx(best)


def test_carried_viterbi_equals_the_whole():
    rng = np.random.default_rng(5)
    for n_langs in (1, 3, 20):
        scores = rng.normal(0, 3, (300, n_langs))
        carried = langid.Carried(2.0)
        for part in np.split(scores, [0, 1, 50, 51, 200]):
            carried.add(part)
        assert carried.labels().tolist() == langid.viterbi(scores, np.array([0, 300]), 2.0).tolist()
    assert langid.Carried().labels().tolist() == []


def _plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + "\0":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _plain_grams(word, buckets):
    """The buckets of all n-grams of one word, one by one."""
    c, mask = [0, *map(ord, word), 0], 0xFFFFFFFF
    for n in langid.ORDERS:
        for i in range(len(c) - n + 1):
            g = c[i : i + n]
            if (n == 1 and g[0]) or (n > 1 and all(g[1:-1]) and (g[0] or g[-1])):
                h = n * 0x1B873593 & mask
                for j, x in enumerate(g):
                    h ^= (x + j + 1) * int(langid._MULTIPLIERS[j]) & mask
                    h = (h << 13 | h >> 19) & mask
                h ^= h >> 15
                h = h * 0x2C1B3C6D & mask
                yield (h ^ h >> 13) & buckets - 1


def _plain_prediction(text, model):
    """(label, score) by the definition: the best path over all words, a float for each word and language."""
    langs, table = model["langs"], model["table"].astype(float)
    total, back, found = None, [], _plain_words(text)
    for w in found:
        own = table[list(_plain_grams(w, len(table)))].sum(axis=0)
        allowed = model["allowed"][langid._OF_RANGE[np.searchsorted(langid._STARTS, ord(w[0]), side="right") - 1]]
        own = np.where(allowed, own, own.min() - 1e4)
        if total is None:
            total = own
            continue
        came = [max(range(len(langs)), key=lambda a: total[a] - langid.SWITCH * (a != b)) for b in range(len(langs))]
        total = np.array([total[a] - langid.SWITCH * (a != b) for b, a in enumerate(came)]) + own
        back.append(came)
    if total is None:
        return "und", 0.0
    path = [int(total.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    letters = np.zeros(len(langs))
    for w, label in zip(found, reversed(path)):
        letters[label] += len(w)
    return langs[int(letters.argmax())], letters.max() / letters.sum()


def test_labels_and_scores_equal_plain_ones(spark, labelled):
    import random

    rng = random.Random(8)
    model = langid.fit(labelled, buckets=1 << 12)
    mixed = lambda n: " ".join(" ".join(rng.choice(t.split()) for _ in range(rng.randint(1, 9))) for t in rng.choices((EN, FR, RU), k=n))
    rows = [(i, mixed(rng.randint(1, 12)) + rng.choice(["", " 12 ...", " Ωmega ß"])) for i in range(60)] + [(60, None), (61, "?"), (62, "a"), (63, "ой a")]
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        label, score = _plain_prediction(text, model)
        assert got[i][0] == label and got[i][1] == pytest.approx(score), (i, text)


def test_long_texts_and_many_languages_stay_small(monkeypatch):
    import random
    import tracemalloc

    rng = random.Random(3)
    n_langs = 200
    table = np.random.default_rng(1).normal(-6, 1, (1 << 10, n_langs)).astype(np.float32)
    model = {"langs": [f"l{i}" for i in range(n_langs)], "table": table, "allowed": np.ones((len(langid.SCRIPTS), n_langs), dtype=bool)}
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(40_000))
    whole = langid._labelled([text[: langid.PIECE]], model, 12.0)[2]  # as one piece
    monkeypatch.setattr(langid, "PIECE", 1 << 14)
    assert langid._labelled([text[: 1 << 18]], model, 12.0)[2].tolist() == whole.tolist()
    tracemalloc.start()
    of, letters, labels = langid._labelled([text], model, 12.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == len(letters) == 40_000 and peak < 40_000 * (n_langs / 8 + 40) + 16 * langid.HELD
    assert "".join(langid.pieces(text, 1000)) == text and list(langid.pieces("x" * 50, 10)) == ["x" * 50]
    assert all(p[-1] == " " for p in list(langid.pieces(text, 1000))[:-1])


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    df = spark.createDataFrame([(i, "text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        langid.fit(df)


def _brute(rows, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault((i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)), None)
    out = []
    for i, v in whole:
        if i % 5 == 0:
            scores = {}
            for j, u in whole:
                if j != i:
                    s = sum(a * b for a, b in zip(v, u))
                    scores[j] = max(s, scores.get(j, s))
            out += [(i, n + 1, j, s) for n, (j, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(set(out))


@pytest.mark.parametrize("block", [2048, 16])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # many equal vectors
    rows += [(300, None), (305, [1.0, None]), (310, [float("nan")] * 8), (315, [float("inf")] * 8), (None, rows[0][1]), (320, [0.5]), (325, []), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as score", "'x' as v")
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 5 == 0).collect()))
    assert got == _brute(rows, 5)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 5 == 0).collect())) == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), F.col("id") % 5 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("id") % 5 == 0).count() == 0


def test_large_components_are_exact_or_refused(spark):
    big = [(0, [2.0**20, 1.0]), (1, [2.0**21 + 1, 3.0]), (2, [-(2.0**21), 5.0]), (5, [2.0**20 + 2.0**-8, -1.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    want = {(i, j): sum(int(256 * a) * int(256 * b) for a, b in zip(x, y)) for i, x in big for j, y in big}
    assert max(abs(x) for x in want.values()) > 2**53
    got = topk.top_k(df, F.col("id") % 5 == 0).collect()
    assert len(got) == 6 and all(r.score == want[r.query_id, r.vec_id] for r in got)
    huge = spark.createDataFrame([(0, [1e30]), (1, [1.0]), (2, [-1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(huge, F.col("id") % 5 == 0)


def test_pairs_of_blocks_are_ruled_out_before_vectors_travel(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "PIVOTS", 8)
    seen = []
    keep = topk._met
    monkeypatch.setattr(topk, "_met", lambda pairs, asked, blocks, k, exact: (seen.append((pairs.count(), asked.count() * blocks.count())), keep(pairs, asked, blocks, k, exact))[1])
    rng = np.random.default_rng(7)
    rows = [(20 * c + i, [float(np.float32(x)) for x in rng.normal(0, 0.02, 8) + centre]) for c, centre in enumerate(rng.normal(0, 1, (12, 8))) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 5 == 0).collect()))
    assert got == _brute(rows, 5)
    assert sum(n for n, _ in seen) < seen[0][1] * 0.8


def test_bounds_prune_and_never_lose(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (8, 16))
    v = np.rint(np.repeat(centres, 100, axis=0) + rng.normal(0, 2, (800, 16)))
    pivots = topk.choose_pivots(v, 16)
    d = topk.distances(v, pivots)
    best = topk.Best(np.arange(10), v[:10], d[:10], 5)
    for at in range(0, 800, 200):
        best.add(np.arange(at, at + 200), v[at : at + 200], d[at : at + 200])
    upper = best.bounds(v, d)
    assert (upper >= v[:10] @ v.T).all()
    assert best.evaluated < 10 * 800 / 2
