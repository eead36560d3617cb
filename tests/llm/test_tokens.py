import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest

from capsift.llm import packing, token_files, tokens, wavelet


def test_wavelet_questions_equal_a_list():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 300, 1000).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(data, [5, None], np.array([400, 600])))
    assert m.tokens().tolist() == data.tolist()
    assert m.doc_ids() == [5, None] and m.counts().tolist() == [400, 600]
    for t in (0, 7, 299, 511, 10_000):
        places = np.flatnonzero(data == t).tolist()
        assert m.count(t) == len(places)
        assert m.occurrences(t) == places
        assert m.rank(t, 500) == sum(p < 500 for p in places)
    assert [m.access(i) for i in (0, 63, 64, 999)] == data[[0, 63, 64, 999]].tolist()
    empty = wavelet.WaveletMatrix(wavelet.build(np.zeros(0, dtype=np.uint32), [], np.zeros(0)))
    assert empty.tokens().tolist() == [] and empty.count(3) == 0


@pytest.mark.parametrize("shard", [50, 10_000])
def test_files_give_back_every_token(spark, make, texts, tmp_path, shard):
    path = f"file://{tmp_path}/out"
    token_files.write(make(texts, True), path, shard_tokens=shard)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    order = sorted(texts, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    want = brute.token_ids([t for _, t in order], tokens.default_tokenizer())
    assert [r.doc_id for r in got] == [i for i, _ in order]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    starts = np.cumsum([0] + [len(x) for x in want])[:-1].tolist()
    assert [(r.start, r.n_tokens) for r in got] == list(zip(starts, map(len, want)))


def test_an_empty_table_gives_no_file(spark, make, tmp_path):
    path = f"file://{tmp_path}/out"
    assert token_files.write(make([]), path).count() == 0


def _check(pieces, want, length, segments):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, ids in want.items():
        rest = sorted(by_doc[i], key=lambda p: p.start)
        assert sum((np.frombuffer(p.ids, "<u4").tolist() for p in rest), []) == ids
        assert all(p.doc_tokens == len(ids) and p.length for p in rest)
    for rows in by_sequence.values():
        rows.sort(key=lambda p: p.offset)
        assert len(rows) <= segments
        ends = np.cumsum([p.length for p in rows])
        assert [p.offset for p in rows] == [0, *ends[:-1]] and ends[-1] <= length
    return by_sequence


def test_packing_places_each_token_once_with_little_padding(make, texts):
    docs = [(i, t) for n, (i, t) in enumerate(texts) if i is not None and (i, n) != (5, len(texts) - 3)]
    want = dict(zip([i for i, _ in docs], brute.token_ids([t for _, t in docs], tokens.default_tokenizer())))
    pieces = packing.pack(make(docs, True).coalesce(1), length=128, segments=16).collect()
    by_sequence = _check(pieces, want, 128, 16)
    used = sum(p.length for p in pieces)
    assert used / (128 * len(by_sequence)) > 0.9
    assert packing.pack(make([])).count() == 0


def test_packing_holds_the_limit_of_loss(spark):
    rows = [(i, "a b c d e f " * (i % 5 + 1), i % 7) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt long").coalesce(1)
    pieces = packing.pack(docs, length=64, segments=8, loss=20, prompt_tokens="prompt").collect()
    sums = defaultdict(int)
    for p in pieces:
        sums[p.sequence_id] += p.loss_tokens
        assert p.loss_tokens == max(0, p.start + p.length - max(p.start, rows[p.doc_id][2]))
    assert max(sums.values()) <= 20
    assert sum(p.length for p in pieces) == sum(len(x) for x in brute.token_ids([t for _, t, _ in rows], tokens.default_tokenizer()))
    assert zlib.crc32(pieces[0].ids)


def test_waiting_remainders_hold_their_own_ids_only():
    packer = packing.Packer(length=64, pool=8)
    packer.keep = lambda example, at: (at, example[1][at:])
    for i in range(10):
        packer.add((0, list(range(1000 + i))), 1000 + i, 0)
    assert packer.items and all(len(example[1]) == end - at < 64 for example, at, end, _ in packer.items)
    assert sum(p[2] for p in packer.drain()) + sum(end - at for _, at, end, _ in packer.items) == sum(range(1000, 1010))


def test_conversations_are_packed_under_three_limits(spark):
    rows = packing.packed_conversations(spark, "/root/testdata/sf0.001").collect()
    sums, many, used = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in rows:
        sums[p.sequence_id] += p.loss_tokens
        used[p.sequence_id] += p.length
        many[p.sequence_id] += 1
    assert max(sums.values()) <= 512 and max(used.values()) <= 2048 and max(many.values()) <= 16
    assert 0 < sum(sums.values()) < sum(used.values())
    per = {}
    for p in rows:
        per[p.conv_id] = per.get(p.conv_id, 0) + p.length
        assert p.length <= p.doc_tokens
    assert all(per[p.conv_id] == p.doc_tokens for p in rows)
    asked = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
    assert len(per) == asked


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_words_whose_sums_cancel_keep_their_own_ids():
    """Thue and Morse's word and its complement collide in every polynomial of an odd base modulo 2**64."""
    import pyarrow as pa

    from capsift.llm import textbuf, tokens

    for n in (1024, 2048, 4096):
        words = ["".join("ab"[x] for x in thue_morse(n)), "".join("ba"[x] for x in thue_morse(n))]
        eights = ["".join(["abcdefgh", "zyxwvuts"][x ^ k] for x in thue_morse(n)) for k in (0, 1)]
        for pair in (words, eights):
            own = textbuf.Words(pa.array([" ".join(pair)]))
            assert all(h[0] != h[1] for h in own.hashes(2))
            encoder = tokens.WordEncoder(tokens.default_tokenizer())
            ids, bounds = encoder.encode(pa.array(pair))
            for k, text in enumerate(pair):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_pieces_with_equal_first_halves(monkeypatch):
    """However bad the first half of the hash is, the ids are the library's."""
    import numpy as np
    import pyarrow as pa

    from capsift.llm import textbuf, tokens

    real = textbuf.Words.hashes
    monkeypatch.setattr(textbuf.Words, "hashes", lambda self, lanes=1: [h % np.uint64(3) if i == 0 else h for i, h in enumerate(real(self, lanes))])
    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    for text in ("one two three four one five", "six one two \u00e9t\u00e9 seven", "five"):
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_hashes_take_words_alone():
    import pyarrow as pa

    from capsift.llm import textbuf

    texts = ["a bb ccc dddddddd eeeeeeeee " + "f" * 33, None, "", "x" * 3_000_000 + " a", " eeeeeeeee\tdddddddd"]
    own = textbuf.Words(pa.array(texts))
    h = own.hashes(2)
    seen = {}
    for i in range(len(own)):
        seen.setdefault(own.word(i), set()).add((int(h[0][i]), int(h[1][i])))
    assert all(len(x) == 1 for x in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)
    assert [x.tolist() for x in textbuf.Words(pa.array(["zz " + texts[0]])).hashes(2)] == [[*y] for y in ([int(v) for v in [*textbuf.Words(pa.array(["zz"])).hashes(2)[k], *h[k][:6]]] for k in (0, 1))]


def test_runs_of_words_whose_sums_cancel():
    import numpy as np
    import pyarrow as pa

    from capsift.llm import passages

    for n in (1024, 4096):
        p = passages.Sums(pa.array([" ".join("ab"[x] for x in thue_morse(n)), " ".join("ba"[x] for x in thue_morse(n)), "q " + " ".join("ab"[x] for x in thue_morse(n))]))
        h = p.range(np.array([0, n, 2 * n + 1]), n)
        assert h[0] != h[1] and h[0] == h[2]
