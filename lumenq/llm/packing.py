"""Operator 4: order-preserving packing of documents into sequences of at most `window` tokens.

Each partition's documents stand one behind the other, in their order. Dynamic programming chooses the cuts between
sequences among document ends (free), sentence ends (a small penalty) and, so that no sequence is too long, any place
(a larger one). The cost of a sequence is its padding; a sequence whose length is a power of two isn't padded. With
positions p and best costs f, f(j) = cut(j) + min over p(j) - window <= p(i) < p(j) of f(i) + window - (p(j) - p(i)),
so the minimum of f(i) + p(i) over a sliding window is what is needed: a monotone queue gives it in amortised constant
time. The powers of two below the window are looked up by position.

A partition is packed in blocks of documents of bounded size. The last, unfinished sequence of a block is carried over
to the next, and what is open at the end of a partition is cut into sequences by the binary digits of its length when
that needs no padding.

Defined results: a null or empty text is a document of one id (the end mark); repeated rows are packed one by one; an
empty table gives no rows; no input columns are carried along.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.bpe import load
from lumenq.llm.common import returning, text_of
from lumenq.llm.tokenizing import default_path, encoded_chunks

WINDOW = 1024
SENTENCE_PENALTY = 2.0
ANYWHERE_PENALTY = 24.0
#: A stretch without a natural cut of more than this many ids may be cut at any multiple of it as well.
STRIDE = 256
#: Sequence numbers of a partition start at its number shifted by so many bits.
PARTITION_SHIFT = 40


def candidate_cuts(ends: np.ndarray, sentence: np.ndarray, total: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may lie, ascending, and the penalty of each. ends: document ends; sentence: sentence ends."""
    natural = np.unique(np.concatenate((ends, sentence)))
    natural = natural[(natural > 0) & (natural <= total)]
    gap = np.diff(natural, prepend=0)
    wide = np.nonzero(gap > stride)[0]
    grid = [np.arange(natural[k] - gap[k] + stride, natural[k], stride) for k in wide.tolist()]
    at = np.unique(np.concatenate([natural, *grid]))
    cost = np.full(len(at), ANYWHERE_PENALTY)
    cost[np.searchsorted(at, sentence[(sentence > 0) & (sentence <= total)])] = SENTENCE_PENALTY
    cost[np.searchsorted(at, ends[ends > 0])] = 0.0
    return at, cost


def choose_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts of least cost; the last candidate is always one. Neighbouring candidates lie at most `window` apart."""
    positions = [0, *at.tolist()]
    n = len(positions)
    source = [0] * n
    cost = {0: 0.0}  # by position
    place = {0: 0}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    waiting, keys, head = [0], [0.0], 0  # candidates i and f(i) + p(i), both ascending from head on
    for j, (p, cut) in enumerate(zip(positions[1:], penalty.tolist()), 1):
        low = p - window
        while positions[waiting[head]] < low:
            head += 1
        via = waiting[head]
        best = keys[head] - low
        for power in powers:
            c = cost.get(p - power)
            if c is not None and c < best:
                best, via = c, place[p - power]
        best += cut
        cost[p], place[p], source[j] = best, j, via
        k = best + p
        while len(keys) > head and keys[-1] >= k:
            keys.pop()
            waiting.pop()
        keys.append(k)
        waiting.append(j)
    out = []
    j = n - 1
    while j:
        out.append(positions[j])
        j = source[j]
    return out[::-1]


class Packer:
    """Packs a stream of documents; holds the ids of one block and of the open sequence."""

    def __init__(self, sentence_ids: np.ndarray, end_id: int, window: int, first_sequence: int, carry_ids: bool = False):
        self.sentence_ids, self.end_id, self.window, self.sequence = sentence_ids, end_id, window, first_sequence
        self.carry_ids = carry_ids
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of what is not yet cut

    def add(self, docs: list[tuple]) -> list[tuple]:
        """docs: (doc_id, start, ids with the end mark, doc_tokens). Returns finished pieces."""
        self.open += docs
        return self._flush(last=False)

    def close(self) -> list[tuple]:
        return self._flush(last=True)

    def _flush(self, last: bool) -> list[tuple]:
        if not self.open:
            return []
        length = np.array([len(d[2]) for d in self.open], np.int64)
        ids = np.concatenate([d[2] for d in self.open])
        total = len(ids)
        if total < 8 * self.window and not last:
            return []
        ends = np.cumsum(length)
        sentence = np.nonzero(self.sentence_ids[ids])[0] + 1
        at, penalty = candidate_cuts(ends, sentence, total)
        if not len(at) or at[-1] != total:
            at, penalty = np.append(at, total), np.append(penalty, 0.0)
        cuts = choose_cuts(at, penalty, self.window)
        if not last:  # the last sequences wait for what follows
            keep = [c for c in cuts if c <= total - 2 * self.window]
            cuts = keep
        else:
            cuts = self._end_without_padding(cuts)
        out = self._pieces(cuts, ends, length, ids)
        done = cuts[-1] if cuts else 0
        k = int(np.searchsorted(ends, done, side="right"))
        rest = []
        if k < len(self.open):
            doc, start, own, n = self.open[k]
            skip = done - int(ends[k] - length[k])
            rest = [(doc, start + skip, own[skip:], n), *self.open[k + 1 :]]
        self.open = rest
        return out

    def _end_without_padding(self, cuts: list[int]) -> list[int]:
        """The last sequence in parts that are powers of two, if padding would be the larger share of it."""
        begin = cuts[-2] if len(cuts) > 1 else 0
        size = cuts[-1] - begin
        if size & (size - 1) and size < self.window * 3 // 4:
            parts, at = [], begin
            for k in range(size.bit_length() - 1, -1, -1):
                if size >> k & 1:
                    at += 1 << k
                    parts.append(at)
            return [*cuts[:-1], *parts]
        return cuts

    def _pieces(self, cuts: list[int], ends: np.ndarray, length: np.ndarray, ids: np.ndarray) -> list[tuple]:
        if not cuts:
            return []
        stop = cuts[-1]
        little = memoryview(np.ascontiguousarray(ids[:stop].astype("<u4"))).cast("B")
        edges = np.unique(np.concatenate(([0], ends[ends < stop], cuts)))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, a, side="right")
        ordinal = np.searchsorted(cuts, a, side="right")
        first = np.concatenate(([0], cuts))[ordinal]
        begin = (ends - length)[doc]
        out = []
        for x, y, d, o, f, g in zip(a.tolist(), b.tolist(), doc.tolist(), ordinal.tolist(), first.tolist(), begin.tolist()):
            doc_id, start, _, n = self.open[d]
            out.append((doc_id, start + x - g, y - x, zlib.crc32(little[4 * x : 4 * y]), n, self.sequence + o, x - f, *[ids[x:y]] * self.carry_ids))
        self.sequence += len(cuts)
        return out


def pack(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = 0, carry_ids: bool = False) -> DataFrame:
    """Pieces: id_column, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if carry_ids)."""
    path = path or default_path()
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * carry_ids]

    def run(batches):
        bpe = load(path)
        ends_sentence = np.array([t.rstrip(b"\"')\xe2\x80\x9d").endswith((b".", b"!", b"?", b"\n")) for t in bpe.token_bytes])
        context = TaskContext.get()
        packer = Packer(ends_sentence, end_id, window, (context.partitionId() if context else 0) << PARTITION_SHIFT, carry_ids)

        def frame(pieces):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names=names)

        kinds = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * carry_ids]
        for batch, a, b, ids, counts in encoded_chunks(batches, 1, path):
            own = batch.column(0).slice(a, b - a).to_pylist()
            docs, at = [], 0
            mark = np.array([end_id], np.int32)
            for doc, n in zip(own, counts.tolist()):
                docs.append((doc, 0, np.concatenate((ids[at : at + n], mark)), n + 1))
                at += n
            if pieces := packer.add(docs):
                yield frame(pieces)
        if pieces := packer.close():
            yield frame(pieces)

    kind = df.schema[id_column].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField(id_column, kind), *[T.StructField(n, T.LongType()) for n in names[1:7]], *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * carry_ids])
    return df.select(F.col(id_column), text_of(df, text_column).alias("_text")).mapInArrow(returning(run), schema)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens, and padded places (a power of two isn't padded)."""
    size = F.sum("length")
    per = pieces.groupBy("sequence_id").agg(size.alias("n"))
    whole = (F.col("n").bitwiseAND(F.col("n") - 1)) == 0
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(whole, F.lit(0)).otherwise(window - F.col("n"))).alias("padded"))
