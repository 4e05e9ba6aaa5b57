"""Operator 6: removal of 50-byte strings that an earlier document holds too, by prefix-free parsing.

A rolling hash over 24 bytes triggers phrase ends: the trigger of a 50-byte string is the place of its least hash, so
every string holds the trigger it belongs to, at the same place wherever the string stands. Between two triggers lies a
phrase; a trigger with all strings that belong to it is a dictionary entry: 26 bytes to the left of it, its 24 bytes
and 26 to the right. The parse is the list of the entries' occurrences.

1. Each chunk of documents sends the hashes of its triggers to buckets, each hash once; a bucket answers which hashes
   are in several documents. Others can't take part in a repeat, so most of the text goes no further.
2. The chunk sends the dictionary entries of those triggers, equal ones once with the smallest document; occurrences
   stay with the chunk. A bucket sorts its entries into the suffix order of the dictionary from the trigger on, and
   into that of the reversed text to the left. With the common prefixes of neighbours in these two arrays, strings at
   the same distance from the trigger are equal if and only if they share a class in both, so a sort of number pairs
   gives the smallest document of every string. The answer holds that document for each entry and place.
3. The chunk lays the answers over its parse, marks the bytes to remove and cuts them out.

Documents are dealt to chunks by a hash of their id and text, and a chunk's texts are shuffled once. A string of which a
third of all documents is made reaches its bucket once from each chunk. Rows without id go past all this. Nothing is
broadcast or collected.

Defined results: a null text is empty; texts under 50 bytes are kept; of equal texts the smallest id stays; rows of one
id don't remove each other; a row without id is kept whole and removes nothing; an empty table gives no rows; no input
columns are carried along by `repeated_spans`; `without_repeats` keeps all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenq.llm.common import chunks_of, give_back, ragged_gather, text_of, utf8_rows

LENGTH = 50
TRIGGER = 24
SIDE = LENGTH - TRIGGER  # bytes on either side of a trigger that its strings can reach
PLACES = SIDE + 1
ENTRY = LENGTH + SIDE
CHUNK_INPUT = 4 << 20
LARGEST_CHUNK = 64 << 20
CHUNKS = 1 << 21
BUCKET_INPUT = 8 << 20
SLICE = 1_500_000
LOW = np.uint64((1 << 24) - 1)
WIDE = np.uint64((1 << 48) - 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        base = 0xD6E8FEB86659FD93
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def triggers(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one behind the other (bytes x, text edges): place and hash of each trigger, and first and last string.

    Strings are given by the place where they begin; all strings of one trigger follow each other.
    """
    n = len(x)
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none, none.astype(np.uint64), none, none
    if n > 1 << 23:  # longer texts: in pieces of strings, so that places fit beside the hash
        out, step = [], 1 << 22
        for a in range(0, n - LENGTH + 1, step):
            b = min(n, a + step + LENGTH - 1)
            inner = edges[(edges > a) & (edges < b)] - a
            p, h, s, e = triggers(x[a:b], np.concatenate(([0], inner, [b - a])))
            out.append((p + a, h, s + a, e + a))
        return tuple(np.concatenate(c) for c in zip(*out))
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[TRIGGER:] - sums[:-TRIGGER]) * down[: n - TRIGGER + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= PLACES:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < PLACES:
        least = np.minimum(least[: len(least) - (PLACES - size)], least[PLACES - size :])
    least &= LOW
    whole = np.ones(len(least), bool)  # strings that lie in one text
    inner = edges[(edges > 0) & (edges < n)]
    if len(inner):
        bad = np.zeros(len(least) + 1, np.int32)
        np.add.at(bad, np.maximum(inner - (LENGTH - 1), 0), 1)
        np.add.at(bad, np.minimum(inner, len(least)), -1)
        whole = np.cumsum(bad[:-1]) == 0
    at = np.nonzero(whole)[0]
    if not len(at):
        return none, none.astype(np.uint64), none, none
    place = least[at].astype(np.int64)
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.nonzero(new)[0]
    last = np.concatenate((first[1:], [len(at)])) - 1
    return place[first], h[place[first]], at[first], at[last]


def scan(raw: np.ndarray, offsets: np.ndarray):
    """triggers() of a chunk of texts, in slices; places count from the chunk's beginning."""
    out = []
    for a, b in chunks_of(offsets, SLICE):
        p, h, s, e = triggers(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out.append((p + offsets[a], h, s + offsets[a], e + offsets[a]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else triggers(raw, offsets)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.int64) % buckets


def _six(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def distinct_triggers(h: np.ndarray, text: np.ndarray):
    """Distinct hashes, ascending; whether each is in several texts; and which one each trigger has."""
    order = np.argsort(h, kind="stable")
    hs, ts = h[order], text[order]
    new = np.concatenate(([True], hs[1:] != hs[:-1])) if len(hs) else np.zeros(0, bool)
    starts = np.nonzero(new)[0]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    if not len(starts):
        return hs, np.zeros(0, bool), which
    several = np.minimum.reduceat(ts, starts) != np.maximum.reduceat(ts, starts)
    return hs[starts], several, which


def by_bucket(bucket: np.ndarray):
    """(bucket, indices) for each bucket that occurs; indices ascend."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.nonzero(b[1:] != b[:-1])[0] + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(bucket[part[0]]), part


class Chunk:
    """The texts of a chunk and their triggers; built alike in each step."""

    def __init__(self, table: pa.Table, buckets: int):
        ids = table.column(1).combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.known = known
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((self.ids, ~known))
        table = table.take(pa.array(order))
        self.ids, self.known, self.table = self.ids[order], known[order], table
        self.raw, self.offsets = utf8_rows(table.column(2))
        self.place, self.hash, self.first, self.last = scan(self.raw, self.offsets)
        self.text = np.searchsorted(self.offsets, self.place, side="right") - 1
        usable = self.known[self.text]
        self.place, self.hash, self.first, self.last, self.text = (v[usable] for v in (self.place, self.hash, self.first, self.last, self.text))
        self.distinct, self.several, self.which = distinct_triggers(self.hash, self.ids[self.text])
        self.bucket = _bucket(self.distinct, buckets)


def _pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def send_hashes(chunk: Chunk):
    """(bucket, distinct hashes and whether several texts of the chunk have them)."""
    for b, part in by_bucket(chunk.bucket):
        yield b, _six(chunk.distinct[part] & WIDE) + np.packbits(chunk.several[part]).tobytes(), len(part)


def answer_hashes(blobs: list[bytes], counts: list[int]) -> list[bytes]:
    """For each message the bits of those hashes that are in several texts."""
    hashes = [_of_six(x[: 6 * n]) for x, n in zip(blobs, counts)]
    several = [np.unpackbits(np.frombuffer(x[6 * n :], np.uint8), count=n).astype(bool) for x, n in zip(blobs, counts)]
    every, own = np.concatenate(hashes), np.concatenate(several)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flag = np.empty(len(s), bool)
    flag[order] = twice
    flag |= own
    ends = np.cumsum(counts)
    return [np.packbits(flag[e - n : e]).tobytes() for e, n in zip(ends.tolist(), counts)]


def repeated_triggers(chunk: Chunk, answers: dict[int, bytes]) -> np.ndarray:
    """The chunk's triggers (indices) whose hash is in several texts."""
    flag = np.zeros(len(chunk.distinct), bool)
    for b, part in by_bucket(chunk.bucket):
        if b in answers:
            flag[part] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(part)).astype(bool)
    return np.nonzero(flag[chunk.which])[0]


def entries(chunk: Chunk, index: np.ndarray):
    """Distinct dictionary entries of these triggers: bytes (n, 76), places from and to, and which one each has.

    Bytes that no string of the trigger reaches are zero, so that entries don't differ by them.
    """
    place = chunk.place[index]
    nearest, farthest = place - chunk.last[index], place - chunk.first[index]
    padded = np.concatenate((np.zeros(SIDE, np.uint8), chunk.raw, np.zeros(LENGTH, np.uint8)))
    rows = padded[place[:, None] + np.arange(ENTRY)]  # text from place - SIDE on
    column = np.arange(ENTRY)
    rows[(column < (SIDE - farthest)[:, None]) | (column >= (SIDE - nearest + LENGTH)[:, None])] = 0
    head = np.empty((len(index), 2), np.uint8)
    head[:, 0], head[:, 1] = nearest, farthest
    whole = np.concatenate((rows, head), axis=1)
    distinct, where, which = np.unique(np.ascontiguousarray(whole).view(f"V{ENTRY + 2}").ravel(), return_index=True, return_inverse=True)
    return whole[where], which.ravel()


def send_entries(chunk: Chunk, index: np.ndarray):
    """(bucket, entries with the smallest and the largest document of each)."""
    if not len(index):
        return
    rows, which = entries(chunk, index)
    ids = chunk.ids[chunk.text[index]]
    least, most = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).min)
    np.minimum.at(least, which, ids)
    np.maximum.at(most, which, ids)
    some = np.zeros(len(rows), np.int64)
    some[which] = np.arange(len(which))
    bucket = chunk.bucket[chunk.which[index[some]]]
    press = zstandard.ZstdCompressor(level=1)
    for b, part in by_bucket(bucket):
        yield b, press.compress(rows[part].tobytes() + _pack(least[part]) + _pack(most[part])), len(part)


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian numbers of eight bytes, the last key first, for lexsort."""
    pad = -rows.shape[1] % 8
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    return [wide[:, k] for k in range(wide.shape[1] - 1, -1, -1)]


def classes(rows: np.ndarray, depths: range) -> list[np.ndarray]:
    """For each depth the class of each row among those with the same first `depth` bytes, from the rows' sorted order."""
    order = np.lexsort(_words(rows))
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    out = []
    for depth in depths:
        own = np.empty(len(rows), np.int64)
        own[order] = np.concatenate(([0], np.cumsum(common < depth)))
        out.append(own)
    return out


def answer_entries(blobs: list[bytes], counts: list[int]) -> list[bytes]:
    """For each message: per entry and place the smallest document that has the string, where the entry's largest is larger.

    An answer is a list of (entry, place, document).
    """
    press = zstandard.ZstdDecompressor()
    rows, least, most = [], [], []
    for x, n in zip(blobs, counts):
        x = press.decompress(x)
        rows.append(np.frombuffer(x, np.uint8, n * (ENTRY + 2)).reshape(n, ENTRY + 2))
        least.append(np.frombuffer(x, np.int64, n, n * (ENTRY + 2)))
        most.append(np.frombuffer(x, np.int64, n, n * (ENTRY + 10)))
    rows, least, most = np.concatenate(rows), np.concatenate(least), np.concatenate(most)
    nearest, farthest = rows[:, ENTRY].astype(np.int64), rows[:, ENTRY + 1].astype(np.int64)
    right = classes(rows[:, SIDE:ENTRY], range(TRIGGER, LENGTH + 1))
    left = classes(rows[:, :SIDE][:, ::-1], range(SIDE + 1))
    found = []
    for place in range(PLACES):
        own = np.nonzero((nearest <= place) & (place <= farthest))[0]
        if not len(own):
            continue
        key = left[place][own] * len(rows) + right[LENGTH - place - TRIGGER][own]
        order = np.argsort(key, kind="stable")
        k = key[order]
        starts = np.nonzero(np.concatenate(([True], k[1:] != k[:-1])))[0]
        low = np.repeat(np.minimum.reduceat(least[own][order], starts), np.diff(np.append(starts, len(k))))
        hit = low < most[own][order]
        e = own[order][hit]
        found.append((e, np.full(len(e), place, np.int64), low[hit]))
    none = np.empty(0, np.int64)
    e, place, low = (np.concatenate([none, *c]) for c in zip(*found)) if found else (none, none, none)
    ends = np.cumsum(counts)
    message = np.searchsorted(ends, e, side="right")
    order = np.lexsort((place, e))
    e, place, low, message = e[order], place[order], low[order], message[order]
    edge = np.searchsorted(message, np.arange(len(counts) + 1))
    out = []
    squeeze = zstandard.ZstdCompressor(level=1)
    for m, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        own = (e[a:b] - (ends[m] - counts[m])).astype(np.uint32)
        out.append(squeeze.compress(_pack(own) + _pack(place[a:b].astype(np.uint8)) + _pack(low[a:b])))
    return out


def string_marks(chunk: Chunk, index: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """Where strings begin (places in the chunk, ascending) that a smaller document holds too."""
    if not len(index) or not answers:
        return np.empty(0, np.int64)
    rows, which = entries(chunk, index)
    some = np.zeros(len(rows), np.int64)
    some[which] = np.arange(len(which))
    bucket = chunk.bucket[chunk.which[index[some]]]
    low = np.full((len(rows), PLACES), np.iinfo(np.int64).max)
    press = zstandard.ZstdDecompressor()
    for b, part in by_bucket(bucket):
        if b in answers:
            x = press.decompress(answers[b])
            n = len(x) // 13
            e = part[np.frombuffer(x, np.uint32, n)]
            low[e, np.frombuffer(x, np.uint8, n, 4 * n)] = np.frombuffer(x, np.int64, n, 5 * n)
    hot = np.nonzero((low[which] < chunk.ids[chunk.text[index]][:, None]))
    return np.sort(chunk.place[index][hot[0]] - hot[1])


def removed_runs(begin: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [a, b) of bytes, each within a text, that the strings beginning at these places (ascending) cover."""
    if not len(begin):
        return begin, begin
    text = np.searchsorted(offsets, begin, side="right")
    gap = np.nonzero((begin[1:] > begin[:-1] + LENGTH) | (text[1:] != text[:-1]))[0]
    return begin[np.concatenate(([0], gap + 1))], begin[np.concatenate((gap, [len(begin) - 1]))] + LENGTH


# ---- Spark -------------------------------------------------------------------------------------------------------

MESSAGE = "chunk long, bucket long, payload binary, n long"


def _sizes(df: DataFrame) -> tuple[int, int]:
    """Numbers of chunks and buckets, in proportion to the size of the input that Spark knows of.

    Chunks grow from CHUNK_INPUT to LARGEST_CHUNK as there would be more than CHUNKS of them: a string that all chunks
    hold reaches its bucket once from each.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(size, 1 << 50)
    chunk = min(LARGEST_CHUNK, max(CHUNK_INPUT, size // CHUNKS))
    return max(least, size // chunk), max(least, size // BUCKET_INPUT)


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], names=["chunk", "bucket", "payload", "n"])


def _answered(messages: DataFrame, answer) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        chunk, bucket, payload, n = (table.column(k).to_pylist() for k in range(4))
        order = sorted(range(len(chunk)), key=chunk.__getitem__)
        replies = answer([payload[i] for i in order], [n[i] for i in order])
        out = _messages([(chunk[i], bucket[i], r, n[i]) for i, r in zip(order, replies)])
        give_back()
        return out

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE)


def _by_bucket(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()))


def _spans(df: DataFrame, id_column: str, text_column: str, finish, schema: T.StructType, more: tuple = ()) -> DataFrame:
    """The three steps; finish(chunk, first bytes and ends of removed runs) makes the result columns of a chunk.

    `more` are columns that go along with the texts, as columns 3 and on of the chunk's table.
    """
    chunks, buckets = _sizes(df.select(id_column, text_column))
    docs = df.where(F.col(id_column).isNotNull()).select(
        F.pmod(F.xxhash64(F.col(id_column), text_of(df, text_column)), F.lit(chunks)).alias("chunk"),
        F.col(id_column).cast("bigint").alias("_id"),
        text_of(df, text_column).alias("_text"),
        *more,
    )
    grouped = docs.groupBy("chunk")

    def first(table: pa.Table) -> pa.Table:
        chunk, number = Chunk(table, buckets), table.column(0)[0].as_py()
        out = _messages([(number, b, x, n) for b, x, n in send_hashes(chunk)])
        del chunk
        give_back()
        return out

    hashes = _answered(grouped.applyInArrow(first, MESSAGE), answer_hashes)

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([])
        chunk, number = Chunk(table, buckets), table.column(0)[0].as_py()
        index = repeated_triggers(chunk, _by_bucket(replies))
        out = _messages([(number, b, x, n) for b, x, n in send_entries(chunk, index)])
        del chunk, index
        give_back()
        return out

    found = _answered(grouped.cogroup(hashes.groupBy("chunk")).applyInArrow(second, MESSAGE), answer_entries)
    both = hashes.select("chunk", F.lit(0).alias("step"), "bucket", "payload").unionAll(found.select("chunk", F.lit(1), "bucket", "payload"))

    arrow = to_arrow_schema(schema)

    def third(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        chunk = Chunk(table, buckets)
        step = replies.column("step").to_numpy()
        index = repeated_triggers(chunk, _by_bucket(replies.filter(pa.array(step == 0))))
        marks = string_marks(chunk, index, _by_bucket(replies.filter(pa.array(step == 1))))
        columns = finish(chunk, *removed_runs(marks, chunk.offsets))
        del chunk, index, marks
        give_back()
        return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return grouped.cogroup(both.groupBy("chunk")).applyInArrow(third, schema)


def _kept(chunk: Chunk, a: np.ndarray, b: np.ndarray):
    """(id, text bytes, runs removed, bytes kept) of each text of the chunk."""
    raw = chunk.raw.tobytes()
    edge = np.searchsorted(a, chunk.offsets)
    a, b = a.tolist(), b.tolist()
    for i, (x, y) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())):
        runs = range(int(edge[i]), int(edge[i + 1]))
        parts, at = [], x
        for r in runs:
            parts.append(raw[at : a[r]])
            at = b[r]
        parts.append(raw[at:y])
        yield (int(chunk.ids[i]) if chunk.known[i] else None), y - x, [(a[r] - x, b[r] - x) for r in runs], b"".join(parts)


def repeated_spans(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    schema = T.StructType([T.StructField(id_column, T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])

    def finish(chunk: Chunk, a: np.ndarray, b: np.ndarray) -> list:
        rows = [(i, n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) for i, n, runs, kept in _kept(chunk, a, b)]
        return list(zip(*rows))

    text = text_of(df, text_column)
    none = F.lit(0).cast("long")
    unknown = df.where(F.col(id_column).isNull()).select(F.lit(None).cast("long").alias(id_column), F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))
    return _spans(df, id_column, text_column, finish, schema).unionAll(unknown)


def without_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns, the repeated strings cut out of the texts; a null text stays null.

    A cut may fall inside a character; what is left of it is dropped.
    """
    others = [c for c in df.columns if c != text_column]
    schema = T.StructType([T.StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(others)] + [T.StructField("_kept", T.StringType())])

    def finish(chunk: Chunk, a: np.ndarray, b: np.ndarray) -> list:
        null = chunk.table.column("_null").to_pylist()
        texts = [None if gone else kept.decode("utf-8", "ignore") for gone, (_, _, _, kept) in zip(null, _kept(chunk, a, b))]
        return [*[chunk.table.column(f"c{k}") for k in range(len(others))], texts]

    more = (df[text_column].isNull().alias("_null"), *[df[c].alias(f"c{k}") for k, c in enumerate(others)])
    kept = _spans(df, id_column, text_column, finish, schema, more)
    known = kept.select(*[F.col("_kept").alias(c) if c == text_column else F.col(f"c{others.index(c)}").alias(c) for c in df.columns])
    return known.unionAll(df.where(F.col(id_column).isNull()))
