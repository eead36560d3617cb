import random

import brute
import corpus_pipeline
import pytest

from capsift.llm import shingles, simhash


def planted(say, first, changes):
    """Pairs of texts of 400 words, the second with some words replaced far from each other: each costs five shingles."""
    out = []
    for n, c in enumerate(changes):
        words = say(400).split()
        copy = list(words)
        for at in range(c):
            copy[10 + at * (380 // c)] = f"new{at}"
        out += [(first + 2 * n, " ".join(words)), (first + 2 * n + 1, " ".join(copy))]
    return out


@pytest.fixture(scope="module")
def say():
    rng = random.Random(11)
    return lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))


def test_the_stage_drops_pairs_from_the_bound_on(spark, make, say):
    changes = [c for c in (2, 4, 6, 7, 8, 9, 10, 14) for _ in range(6)]  # 0.95, 0.90, 0.86, 0.84, 0.82, 0.80, 0.78, 0.70
    docs = planted(say, 1000, changes)
    measured = [len(brute.shingles(a) & brute.shingles(b)) / len(brute.shingles(a) | brute.shingles(b)) for (_, a), (_, b) in zip(docs[::2], docs[1::2])]
    assert min(abs(m - 0.8) for m in measured) < 0.01 and {m >= 0.8 for m in measured} == {True, False}
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make(docs), "").collect()}
    assert got == {i for i, _ in docs[::2]} | {1001 + 2 * n for n, m in enumerate(measured) if m < 0.8}


def test_all_columns_odd_texts_and_repeated_rows(make, texts):
    docs = [d for d in texts if d[0] is not None]
    table = make(docs, True)
    found = simhash.drop_near_duplicates(table)
    assert found.columns == table.columns
    assert sorted(r.doc_id for r in found.collect()) == brute.near_kept(docs)
    ids = [r.doc_id for r in simhash.drop_near_duplicates(make(texts)).collect()]
    assert sorted((i is None, i or 0) for i in ids) == brute.near_kept(texts)
    assert simhash.drop_near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_large_groups_lose_no_link(make, say, block):
    rng, docs = random.Random(4), []
    for n in range(3):
        words = say(100).split()
        for k in range(40):
            copy = list(words)
            for at in rng.sample(range(100), rng.randint(0, 4)):
                copy[at] = f"new{n}x{k}x{at}"
            docs.append((100 * n + k, " ".join(copy)))
    want = brute.near_kept(docs)
    assert 3 < len(want) < 100
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(make(docs), block=block).collect()) == want


def test_sets_of_parts_of_a_batch(texts):
    import pyarrow as pa

    column = pa.array([t for _, t in texts] + ["A b C d É f"], pa.string())
    for part in (column, column.slice(7), column.slice(3, 20), column.slice(0, 0)):
        h, edges = shingles.sets(part)
        assert (edges[1:] - edges[:-1]).tolist() == [len(brute.shingles(t)) for t in part.to_pylist()] and len(h) == edges[-1]
    assert shingles.sets(pa.array(["a B c D É f"]))[0].tolist() == shingles.sets(column)[0][-2:].tolist()
