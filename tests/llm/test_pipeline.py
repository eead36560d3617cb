from collections import Counter

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from capsift.llm import mixing, queries, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_works_on_what_the_one_before_kept(spark, make, texts, tmp_path):
    import random

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice([*["the", "of", "a", "in", "to"] * 40, *(f"v{i}" for i in range(400))]) for _ in range(n))
    good = [(i, "\n".join(say(30) for _ in range(4))) for i in range(200, 400)]
    rows = texts + good + [(450 + i, good[0][1]) for i in range(5)] + [(500 + i, "!! ".join(say(100).upper().split())) for i in range(20)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, docs))
    by = dict(seen)
    assert [n for n, _ in seen] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    assert all(df.columns == COLUMNS for _, df in seen[:-1])
    kept = {r.doc_id for r in by["quality_rules"].collect()}
    assert {i for i, _ in good} <= kept and not kept & {1, *range(500, 520)}
    assert not any(brute.quality(r.text)[5] for r in by["quality_rules"].collect())
    first = sorted(set((r.doc_id, r.text) for r in by["quality_rules"].collect()), key=lambda d: (d[0] is not None, d[0] or 0))
    want = {(i, h) for i, _, _, h in brute.lines(first)}
    assert {(r.doc_id, brute.sha(r.text)) for r in by["line_dedup"].collect()} == want
    assert sorted(r.doc_id for r in by["near_dedup"].collect()) == brute.near_kept([(r.doc_id, r.text) for r in by["line_dedup"].collect()])
    near = {r.doc_id: r.text for r in by["near_dedup"].collect()}
    mixed = by["mix_sources"].collect()
    assert all(near[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in mixed)
    total = sum(len(brute.words(t)) for t in near.values())
    assert 0.95 * total <= sum(len(brute.words(r.text)) for r in mixed) <= total
    want = Counter(map(tuple, brute.token_ids([r.text for r in mixed], tokens.default_tokenizer())))
    pieces = {}
    for p in by["pack_sequences"].collect():
        pieces.setdefault((p.doc_id, p.sequence_id >> 40, p.doc_tokens), []).append(p)
    assert sum(p.length for ps in pieces.values() for p in ps) == sum(len(k) * n for k, n in want.items())
    assert sum(len(np.frombuffer(p.ids, "<u4")) for ps in pieces.values() for p in ps) == sum(p.length for ps in pieces.values() for p in ps)


def test_stages_take_empty_tables_and_other_columns(make, texts):
    import random

    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice([*["the", "of", "a", "in", "to"] * 40, *(f"v{i}" for i in range(400))]) for _ in range(n))
    rows = [(i, "\n".join(say(30) + "." for _ in range(4))) for i in range(30)] + [(None, "\n".join(say(30) + "." for _ in range(4))), (100, say(40_000))]
    full, none = make(rows, True), make([], True)
    for name, stage in corpus_pipeline.STAGES:
        some = stage(full.sparkSession, full, "")
        assert some.count() > 0, name
        if name != "pack_sequences":
            assert some.columns == full.columns, name
        assert stage(full.sparkSession, none, "").count() == 0, name


def test_results_handed_out_before_a_run_can_still_be_read(spark):
    from capsift.llm import simhash

    found = simhash.op2_simhash(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, "elsewhere").count()
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_a_stage_leaves_the_results_of_other_calls_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs.limit(40), "same")
    second = corpus_pipeline.quality_rules(spark, docs, "same")
    lines = corpus_pipeline.line_dedup(spark, docs, "same")
    assert first.count() <= 40 and second.count() > 0 and lines.count() == docs.count()


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from capsift.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_run_over_a_whole_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    sizes = [r.n for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sizes and max(sizes) <= 2048


def test_every_operator_is_registered():
    names = sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op"))
    assert names == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert mixing.SEED == 42
