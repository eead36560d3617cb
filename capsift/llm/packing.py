"""Vector bin packing of examples into sequences under three limits at once: tokens, segments and loss-bearing tokens.

Each task packs its own examples, without a shuffle: pieces are dealt from a pool of at most `pool`
remainders of less than a sequence, of which only the ids themselves are kept, so besides the text at hand memory is bounded whatever the input. For the open sequence the heuristic takes
the piece that fits and has the greatest dot product of the room left with the piece's demand, each in parts
of its limit. When nothing fits whole, the longest piece is cut to the room that is left and its rest goes
back to the pool. Only a task's last sequence has padding, but for sequences that meet the limit of segments or of loss first.

Defined cases: null text counts as empty (the end id alone); rows with equal or null ids are examples of their own; an
empty table gives no piece; other columns are kept out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import common, textbuf, tokens

LENGTH = 2048
SEGMENTS = 256
POOL = 1024

_SCHEMA = "doc_id long, start long, length long, loss_tokens long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "loss_tokens", "ids", "doc_tokens", "sequence_id", "offset")])


class Packer:
    """Pieces come back as (example, start, length, loss, sequence, offset); example is what `add` got."""

    def __init__(self, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, pool: int = POOL, first: int = 0):
        if min(length, segments, loss, pool) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([length, segments, loss], dtype=np.float64)
        self.length, self.segments, self.loss, self.pool = length, segments, loss, pool
        self.sequence = first
        self.items: list = []
        self.keep = lambda example, at: example  # what of an example its remainder needs
        self.size, self.bears = np.zeros(2 * pool + 1), np.zeros(2 * pool + 1)
        self.out: list[tuple] = []

    def add(self, example, n: int, loss_from: int) -> None:
        """Tokens from `loss_from` on bear loss. Whole sequences are cut off at once; the rest waits in the pool."""
        at = 0
        while n - at >= self.length or max(0, n - max(at, loss_from)) >= self.loss:
            end = min(at + self.length, max(at, loss_from) + self.loss, n)
            self.out.append((example, at, end - at, max(0, end - max(at, loss_from)), self.sequence, 0))
            self.sequence += 1
            at = end
        if at < n:
            self._put(self.keep(example, at), at, n, loss_from)
        if len(self.items) >= 2 * self.pool:
            self._pack(self.pool)

    def _put(self, example, at: int, n: int, loss_from: int) -> None:
        i = len(self.items)
        self.items.append((example, at, n, loss_from))
        self.size[i], self.bears[i] = n - at, max(0, n - max(at, loss_from))

    def _take(self, i: int) -> tuple:
        got, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.size[i], self.bears[i] = self.size[len(self.items)], self.bears[len(self.items)]
        return got

    def _pack(self, down_to: int) -> None:
        while len(self.items) > down_to:
            room = self.limits.copy()
            offset = 0
            while self.items and room.min() >= 1:
                n = len(self.items)
                size, bears = self.size[:n], self.bears[:n]
                part = room / self.limits / self.limits
                score = np.where((size <= room[0]) & (bears <= room[2]), size * part[0] + part[1] + bears * part[2], -1)
                i = int(score.argmax())
                cut = score[i] < 0
                example, at, end, loss_from = self._take(int(size.argmax()) if cut else i)
                stop = min(at + int(room[0]), max(at, loss_from) + int(room[2])) if cut else end
                bearing = max(0, stop - max(at, loss_from))
                self.out.append((example, at, stop - at, bearing, self.sequence, offset))
                if cut:
                    self._put(example, stop, end, loss_from)
                room -= (stop - at, 1, bearing)
                offset += stop - at
            self.sequence += 1

    def flush(self) -> None:
        self._pack(0)

    def drain(self) -> list[tuple]:
        got, self.out = self.out, []
        return got


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_tokens: str | None = None, prompt_col: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, loss_tokens, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Instruction data: prompt_tokens, a column with the number of a text's leading tokens that bear no loss, or prompt_col, a column of text that comes before the
    document's own and bears none. Without either all tokens do.
    """
    tokenizer = tokenizer or tokens.default_tokenizer()
    loss = length if loss is None else loss

    def run(batches):
        packer = Packer(length, segments, loss, first=TaskContext.get().partitionId() << 40)
        # an example: its id, number of tokens, and its ids from `base` on
        packer.keep = lambda example, at: (*example[:2], at, example[3][4 * (at - example[2]) :])
        coder = tokens.encoder(tokenizer)

        def rows():
            p = packer.drain()
            if p:
                cols = list(zip(*((d, at, n, bear, ids[4 * (at - base) : 4 * (at - base + n)], many, q, o) for (d, many, base, ids), at, n, bear, q, o in p)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

        for b in textbuf.slices(batches, 1):
            ids, at = coder.encode(b.column(1))
            before, from_ = coder.encode(b.column(2), None)
            for r, (d, free) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                prompt = before[from_[r] : from_[r + 1]]
                own = prompt.tobytes() + ids[at[r] : at[r + 1]].tobytes()
                packer.add((d, len(own) // 4, 0, own), len(own) // 4, len(prompt) + max(0, free or 0))
            yield from rows()
        packer.flush()
        yield from rows()

    prompt, free = F.col(prompt_col) if prompt_col else F.lit(None), F.col(prompt_tokens) if prompt_tokens else F.lit(0)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), prompt.cast("string").alias("prompt"), free.cast("long").alias("free")).mapInArrow(run, _SCHEMA)


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three limits at work: each conversation's last assistant turn bears loss, what comes before it does not; at most 16 conversations and 512 loss-bearing tokens a sequence."""
    turn = F.struct("turn", "role", "text")
    said = common.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last = F.size("turns") - F.coalesce(F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == "assistant")), F.lit(True)), F.lit(0)).cast("int")
    split = said.withColumn("last", last)
    text = lambda turns: F.array_join(F.transform(turns, lambda t: F.coalesce(t["text"], F.lit(""))), "\n")
    answered = split.select("conv_id", text(F.slice("turns", F.lit(1), F.col("last"))).alias("prompt"), F.get(F.transform("turns", lambda t: t["text"]), F.col("last")).alias("text"))
    return pack(answered, segments=16, loss=512, id_col="conv_id", prompt_col="prompt").select(F.col("doc_id").alias("conv_id"), "start", "length", "loss_tokens", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
