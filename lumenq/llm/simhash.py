"""Operator 5: SimHash fingerprints and their self-join by a binary trie.

Fingerprints that differ in at most `radius` bits agree wholly in one of radius + 1 blocks of bits, so each distinct
fingerprint goes to one bucket for each block. A bucket's sorted fingerprints are a binary trie whose nodes are index
ranges. The join starts with the pair (root, root), walks both nodes of a pair down a bit at a time, adds one to the
pair's errors where the bits differ, and drops the pair when they exceed the radius; all pairs of a level are held in
arrays. A bucket gives the links of a spanning forest, not all pairs. A bucket of more than BUCKET_ROWS is dealt again
by the blocks of the bits that its key does not fix; after two such steps the free bits bound its size.

Defined results: a null or white text has fingerprint zero, which is linked like any other; a text of fewer words than
a shingle is one shingle; rows of one id and repeated rows form groups like any copies; a row without id gets the
component of its fingerprint as well; an empty table gives no rows; no input columns are carried along by
`near_duplicates`, all of them by `drop_near_duplicates`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenq.llm.common import cut, returning, text_of, utf8_rows
from lumenq.llm.components import connected_components, contracted, labels, local_components

BITS = 64
BUCKET_ROWS = 20_000
BATCH_ROWS = 60_000
#: Keys of crowded buckets up to this number are broadcast.
BROADCAST_KEYS = 100_000
SEED = 42


def shingle_digests(text: bytes, width: int) -> bytes:
    """The XXH64 digests (big-endian) of a text's shingles of `width` words, one behind the other, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and the six white ASCII characters
    if not words:
        return b""
    digest = xxhash.xxh64_digest
    whole = b" ".join(words)
    if len(words) <= width:
        return digest(whole, SEED)
    starts = list(accumulate(map(len, words), lambda a, b: a + b + 1, initial=0))
    return b"".join([digest(whole[a : b - 1], SEED) for a, b in zip(starts, starts[width:])])


def majority(digests: bytes) -> int:
    """The fingerprint: a bit is one if it is in over half of the hashes; as a signed 64-bit integer."""
    if not digests:
        return 0
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(rows), 4096):
        counts += np.unpackbits(rows[a : a + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """(id_column, fp long) for each row, from its whole text."""
    kind = df.schema[id_column].dataType

    def run(batches):
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(1))
            raw = raw.tobytes()
            edges = offsets.tolist()
            fps = [majority(shingle_digests(raw[a:b], width)) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_column, "fp"])

    schema = T.StructType([T.StructField(id_column, kind), T.StructField("fp", T.LongType())])
    return df.select(F.col(id_column), text_of(df, text_column).alias("_text")).mapInArrow(returning(run), schema)


# ---- the trie ----------------------------------------------------------------------------------------------------


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(fp: np.ndarray, bucket: np.ndarray, radius: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints (uint64, ascending within each bucket; buckets one behind the other) within radius."""
    n = len(fp)
    edge = np.nonzero(bucket[1:] != bucket[:-1])[0] + 1
    lo = np.concatenate(([0], edge))
    hi = np.concatenate((edge, [n]))
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    pair = (lo, hi, lo, hi, np.zeros(len(lo), np.int64))
    found_a, found_b = [], []
    for bit in range(bits - 1, -1, -1):
        if not len(pair[0]):
            break
        a0, a1, b0, b1, errors = pair
        size = (a1 - a0) * (b1 - b0)
        small = size <= 24
        if small.any():
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            count, across = size[small], (t1 - t0)
            which = np.repeat(np.arange(len(count)), count)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            i, j = s0[which] + inner // across[which], t0[which] + inner % across[which]
            near = (i < j) if len(i) else np.zeros(0, bool)
            near |= (s0 != t0)[which]
            i, j = i[near], j[near]
            near = popcount(fp[i] ^ fp[j]) <= radius
            found_a.append(i[near])
            found_b.append(j[near])
            rest = ~small
            a0, a1, b0, b1, errors = a0[rest], a1[rest], b0[rest], b1[rest], errors[rest]
        if not len(a0):
            break
        ones = np.zeros(n + 1, np.int64)
        np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        alike = a0 == b0
        other = ~alike
        parts = [
            (a0, am, b0, bm, errors),
            (am, a1, bm, b1, errors),
            (a0, am, bm, b1, errors + 1),
            (am[other], a1[other], b0[other], bm[other], errors[other] + 1),
        ]
        joined = [np.concatenate(x) for x in zip(*parts)]
        live = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= radius)
        live &= (joined[0] != joined[2]) | (joined[1] - joined[0] > 1)
        pair = tuple(x[live] for x in joined)
    else:
        if len(pair[0]):  # equal fingerprints that stand more than once
            for a0, a1, b0, b1, _ in zip(*pair):
                i, j = np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij")
                up = i < j
                found_a.append(i[up])
                found_b.append(j[up])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def blocks_of(free: list[int], parts: int) -> list[list[int]]:
    """The bit numbers `free` in `parts` runs of nearly equal length."""
    at = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [free[a:b] for a, b in zip(at, at[1:])]


def _key(fp: Column, tag: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    return F.struct(tag.alias("t"), fp.bitwiseAND(F.lit(mask)).alias("k"))


def bucket_rows(nodes: DataFrame, radius: int, most: int = BUCKET_ROWS, bits: int = BITS) -> DataFrame:
    """Each row of nodes (with a column fp) once for each block of bits, under a key (t, k).

    Buckets that are crowded are dealt again by the blocks of the bits that their key leaves free. A column `table`, if
    there is one, keeps the fingerprints of different tables apart.
    """
    every = list(range(bits - 1, -1, -1))
    own = nodes.columns
    apart = [c for c in own if c == "table"]

    def deal(rows: DataFrame, choice: Column) -> DataFrame:
        return rows.select(F.explode(choice).alias("key"), *own).select("key.t", "key.k", *own)

    fixed = dict(enumerate(blocks_of(every, radius + 1)))
    rows = deal(nodes, F.array(*[_key(F.col("fp"), F.lit(t), b) for t, b in fixed.items()]))
    keys, done = [*apart, "t", "k"], None
    for _ in range(2):
        crowded = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys)
        n = crowded.count()
        if not n:
            break
        crowded = cut(crowded)
        if n <= BROADCAST_KEYS:
            crowded = F.broadcast(crowded)  # of a size that was checked; more of them are joined by a shuffle
        calm = rows.join(crowded, keys, "left_anti").select("t", "k", *own)
        done = calm if done is None else done.unionAll(calm)
        hot = rows.join(crowded, keys, "left_semi").select("t", "k", *own)
        finer = {}
        choice = F.lit(None).cast("array<struct<t:int,k:bigint>>")
        for tag, taken in fixed.items():
            free = [b for b in every if b not in set(taken)]
            sub = {(tag + 1) * 16 + k: taken + more for k, more in enumerate(blocks_of(free, radius + 1))}
            finer.update(sub)
            choice = F.when(F.col("t") == tag, F.array(*[_key(F.col("fp"), F.lit(t), b) for t, b in sub.items()])).otherwise(choice)
        rows = deal(hot, choice)
        fixed = finer
    return rows if done is None else done.unionAll(rows)


def whole_buckets(rows: DataFrame, keys: list[str], order: list, columns: list[str], body, schema: str) -> DataFrame:
    """body(arrays of `columns`, bucket numbers) for some whole buckets at a time, rows in order; one task may have many.

    It gives one batch or several, one after the other.
    """
    dealt = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    width = len(keys)
    several = lambda out: [out] if isinstance(out, pa.RecordBatch) else out

    def work(held):
        arrays = [np.concatenate(x) for x in zip(*held)]
        change = np.zeros(len(arrays[0]), bool)
        for key in arrays[:width]:
            change[1:] |= key[1:] != key[:-1]
        return arrays, change

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n < BATCH_ROWS:
                continue
            arrays, change = work(held)
            last = int(np.nonzero(change)[0][-1]) if change.any() else 0  # its bucket may go on in the next batch
            if last:
                yield from several(body([x[:last] for x in arrays[width:]], np.cumsum(change[:last])))
            held = [[x[last:] for x in arrays]]
            n = len(arrays[0]) - last
        if n:
            arrays, change = work(held)
            yield from several(body(arrays[width:], np.cumsum(change)))

    return dealt.mapInArrow(returning(run), schema)


def trie_join(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between nodes (node long, fp long, all fps distinct) that keep every group within radius together."""

    def body(arrays, bucket):
        fp, node = arrays
        a, b = trie_links(fp.view(np.uint64), bucket, radius)
        label = local_components(len(fp), a, b)
        # the smallest node of each group, then a link from every other one to it
        low = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(low, label, node)
        least = low[label]
        far = node != least
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(least[far])], names=["u", "v"])

    rows = bucket_rows(nodes.select("fp", "node"), radius)
    return whole_buckets(rows, ["t", "k"], [(F.col("fp") < 0), "fp"], ["fp", "node"], body, "u long, v long")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(id_column, fingerprint, component_id) for each row; component_id is the smallest id that links can reach."""
    fps = cut(fingerprints(df, id_column, text_column, width))
    nodes = cut(fps.groupBy("fp").agg(F.min(id_column).alias("node")))
    groups = connected_components(trie_join(nodes.where("node is not null"), radius))
    of_fp = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of_fp, "fp").select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity -----------------------------------------------------------------------------------

#: Candidates differ in at most this share of all bits; at a Jaccard similarity of 0.8 the mean is BIT_SHARE.
CANDIDATE_SHARE = 0.23
BIT_SHARE = math.acos(2 * 0.8 / 1.8) / math.pi
#: A pair of similarity 0.8 is in one of the tables at this probability at least.
RECALL = 0.92
LEAF = 4096
#: Pairs of rows that are looked at in one go.
PAIRS = 100_000
#: Rows of a bucket of table values; they are not all compared.
TABLE_BUCKET_ROWS = 200_000
#: Bins, in words of 64, that bound the similarity of open candidates.
BIN_WORDS = 16
#: Rounds of the search for components between the steps of comparison.
PARTIAL_ROUNDS = 2
#: Open candidates of a node in a bucket that are compared before all others are.
NEAREST = 4


@dataclass(frozen=True)
class Tables:
    """Bits of a table value, number of tables, and the 64-bit SimHash words that hold the values one behind the other.

    The bits grow with the logarithm of the number of rows, so that values which agree by chance stay few for each row;
    the number of tables follows from the bits, so that RECALL holds at every size.
    """

    bits: int
    tables: int
    words: int

    @classmethod
    def of(cls, rows: int, radius: int) -> Tables:
        bits = max(24, rows.bit_length() + 4)
        within = sum(math.comb(bits, k) * BIT_SHARE**k * (1 - BIT_SHARE) ** (bits - k) for k in range(radius + 1))
        tables = math.ceil(math.log(1 - RECALL) / math.log(1 - within) - 0.05)
        return cls(bits, tables, max(4, -(-tables // (64 // bits))))

    def value(self, table: int) -> tuple[int, int]:
        """The word that holds the table's value and the value's lowest bit there."""
        word, place = divmod(table, 64 // self.bits)
        return word, place * self.bits


def wide_fingerprint(digests: bytes, words: int = 4) -> list[int]:
    """So many fingerprints of the same shingles, each from the hashes mixed in another way."""
    if not digests:
        return [0] * words
    h = np.frombuffer(digests, ">u8").astype(np.uint64)
    out = []
    for k in range(words):
        x = h * np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64))
        x ^= x >> np.uint64(32)
        out.append(majority(x.astype(">u8").tobytes()))
    return out


def sketch(digests: bytes) -> bytes:
    """All distinct shingle hashes (32 bits each), ascending."""
    return np.unique(np.frombuffer(digests, ">u4")[1::2].astype(np.uint32)).tobytes() if digests else b""


def bins(hashes: bytes) -> list[int]:
    """Which of 64 * BIN_WORDS bins a sketch's hashes fall into, as signed 64-bit integers."""
    seen = np.zeros(64 * BIN_WORDS, np.uint8)
    seen[np.frombuffer(hashes, np.uint32) % (64 * BIN_WORDS)] = 1
    return np.packbits(seen).view(np.int64).tolist()


def at_most(held: list[np.ndarray], size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A bound of the similarity of rows i and j: hashes in bins that the other set doesn't reach are in one set only."""
    only_i, only_j = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for word in held:
        a, b = word[i], word[j]
        only_i += popcount(a & ~b)
        only_j += popcount(b & ~a)
    both = np.minimum(size[i] - only_i, size[j] - only_j)
    return both / np.maximum(size[i] + size[j] - both, 1)


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of hashes (ascending)."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate((x, y)))
    twice = np.count_nonzero(both[1:] == both[:-1])
    return twice / (len(both) - twice)


def _distance(wide: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for k in range(wide.shape[1]):
        out += popcount(wide[a, k] ^ wide[b, k])
    return out


def leaf_links(wide: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """In each run [start, end) every row with its nearest earlier and nearest later row, if within `most` bits.

    That keeps groups together without all their pairs. Longer runs are walked through in blocks that overlap by half.
    """
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(a, b):
        near = _distance(wide, a, b) <= most
        found_a.append(a[near])
        found_b.append(b[near])

    two = np.nonzero(end - start == 2)[0]
    add(start[two], start[two] + 1)
    for s, e in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist()):
        for a in range(s, max(s + 1, e - LEAF // 2), LEAF // 2):
            b = min(e, a + LEAF)
            rows = np.arange(a, b)
            for c in range(a, b, 512):
                part = np.arange(c, min(b, c + 512))
                d = np.zeros((len(part), b - a), np.int32)
                for k in range(wide.shape[1]):
                    d += popcount(wide[part, k][:, None] ^ wide[a:b, k][None])
                for side in (rows[None] < part[:, None], rows[None] > part[:, None]):
                    own = np.where(side, d, 1 << 30)
                    j = own.argmin(1)
                    ok = own[np.arange(len(part)), j] <= most
                    found_a.append(part[ok])
                    found_b.append(rows[j[ok]])
    return np.concatenate(found_a), np.concatenate(found_b)


def candidate_links(value: np.ndarray, node: np.ndarray, wide: np.ndarray, bucket: np.ndarray, radius: int, most: int, bits: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes, and their distance, whose table values are within `radius` bits and wide fingerprints within `most`.

    Not all of them, but every node that is in one, and (paired with itself) every node whose pairs were not all looked at.
    """
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])))
    start = np.nonzero(new)[0]
    end = np.append(start[1:], len(value))
    a, b = leaf_links(wide, start, end, most)
    g, h = trie_links(value[start].astype(np.uint64), bucket[start], radius, bits)
    few = np.minimum(end - start, 16)  # the rest is looked at later
    count = few[g] * few[h]
    which = np.repeat(np.arange(len(g)), count)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    i, j = start[g][which] + inner // few[h][which], start[h][which] + inner % few[h][which]
    a, b = np.concatenate((a, i)), np.concatenate((b, j))
    distance = _distance(wide, a, b)
    near = distance <= most
    u, v, d = nearest_links(node[a[near]], node[b[near]], distance[near])
    size = end - start
    part = size > LEAF
    for x, y in ((g, h), (h, g)):
        part[x[(few[x] < size[x]) | (few[y] < size[y])]] = True
    unseen = node[np.repeat(part, size)]
    return np.concatenate((u, unseen)), np.concatenate((v, unseen)), np.concatenate((d, np.zeros(len(unseen), np.int64)))


def open_pairs(value: np.ndarray, wide: np.ndarray, component: np.ndarray, bucket: np.ndarray, radius: int, most: int, bits: int = 24):
    """Index pairs and their distances, some at a time: all rows of different components whose table values are within
    `radius` bits and whose wide fingerprints are within `most`.

    Rows stand in the order of bucket, value and component; rows of one component are never paired to look at them.
    """
    n = len(value)
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])))
    start = np.nonzero(new)[0]
    end = np.append(start[1:], n)
    run = np.cumsum(new) - 1
    rank = np.unique(component, return_inverse=True)[1]
    block = run * (int(rank.max(initial=0)) + 1) + rank  # ascending
    g, h = trie_links(value[start].astype(np.uint64), bucket[start], radius, bits)
    size = end - start
    own = np.arange(n)
    which = np.repeat(np.arange(len(g)), size[g])
    other = np.repeat(start[g] - np.cumsum(size[g]) + size[g], size[g]) + np.arange(len(which))
    same = h[which] * (int(rank.max(initial=0)) + 1) + rank[other]
    low, high = np.searchsorted(block, same, side="left"), np.searchsorted(block, same, side="right")
    left = np.concatenate((own, other, other))
    first = np.concatenate((np.searchsorted(block, block, side="right"), start[h][which], high))
    last = np.concatenate((end[run], low, end[h][which]))
    some = np.nonzero(last > first)[0]
    left, first, count = left[some], first[some], (last - first)[some]
    total = np.concatenate(([0], np.cumsum(count)))
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
        i = np.repeat(left[a:b], count[a:b])
        j = np.repeat(first[a:b] - total[a:b], count[a:b]) + np.arange(total[a], total[b])
        distance = _distance(wide, i, j)
        near = distance <= most
        yield i[near], j[near], distance[near]
        a = b


def nearest_links(u: np.ndarray, v: np.ndarray, distance: np.ndarray, most: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs those that join a node with its `most` nearest smaller or `most` nearest larger partners, node first.

    Most of a group of near copies stays together by them.
    """
    one, other, far = np.concatenate((u, v)), np.concatenate((v, u)), np.concatenate((distance, distance))
    larger = other > one
    order = np.lexsort((other, far, larger, one))
    one, other, far, larger = one[order], other[order], far[order], larger[order]
    first = np.ones(len(one), bool)
    first[1:] = (one[1:] != one[:-1]) | (other[1:] != other[:-1])  # each pair once
    one, other, far, larger = one[first], other[first], far[first], larger[first]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (larger[1:] != larger[:-1])
    begin = np.nonzero(new)[0]
    keep = np.arange(len(one)) - np.repeat(begin, np.diff(np.append(begin, len(one)))) < most
    return one[keep], other[keep], far[keep]


def _hashed(rows: DataFrame, keys: list[T.StructField], width: int, body, more: list[T.StructField]) -> DataFrame:
    """The key columns of rows, and the columns that body makes of the text (the last column) and its shingles' digests."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(batch.num_columns - 1))
            raw, edges = raw.tobytes(), offsets.tolist()
            made = [body(raw[a:b], shingle_digests(raw[a:b], width)) for a, b in zip(edges, edges[1:])]
            columns = list(zip(*made)) if made else [[]] * len(more)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, more)]], names=schema.names)

    schema = T.StructType([*keys, *more])
    return rows.mapInArrow(returning(run), schema)


def _keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, row, _text): rows of one id and one text are the same row, whatever else they hold."""
    text = text_of(df, text_column)
    return df.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("row"), text.alias("_text")).where("id IS NOT NULL")


def near_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """(id, row, first): for each row its id and the hash of its text, and those of the smallest of its group.

    Near copies share `least` of their distinct shingles. Candidates come from tables of SimHash bits (Tables), each
    joined by its trie within `radius` bits. Candidates are compared by all their shingles: first each node's nearest,
    then the nearest of those that are still in different groups, at last all that still are; so all candidates are in
    one group, were compared, or can't be similar by the bins of their shingles; a large group of near copies costs some
    comparisons for each of its texts.
    """
    plan = Tables.of(df.count(), radius)
    longs = lambda names: [T.StructField(n, T.LongType()) for n in names]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    words = [f"w{k}" for k in range(plan.words)]

    def first(text: bytes, digests: bytes) -> tuple:
        return signed(xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))), *wide_fingerprint(digests, len(words))

    docs = cut(_hashed(_keyed(df, id_column, text_column), longs(["id", "row"]), width, first, longs(["same", *words])))
    nodes = docs.groupBy("same", *words).agg(F.min(F.struct("id", "row")).alias("first"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    most = int(CANDIDATE_SHARE * 64 * plan.words)
    mask = F.lit((1 << plan.bits) - 1)
    at = [plan.value(t) for t in range(plan.tables)]
    values = F.array(*[F.struct(F.lit(t).alias("table"), F.shiftrightunsigned(F.col(f"w{w}"), shift).bitwiseAND(mask).alias("fp")) for t, (w, shift) in enumerate(at)])

    def dealt(rows: DataFrame, more: list[str], body, schema: str) -> DataFrame:
        own = ["node", *more, *words]
        spread = rows.select(F.explode(values).alias("x"), *own).select("x.table", "x.fp", *own)
        buckets = bucket_rows(spread, radius, TABLE_BUCKET_ROWS, plan.bits)
        return whole_buckets(buckets, ["table", "t", "k"], ["fp", *more[:1], "node"], ["fp", *own], body, schema)

    def batch(u, v, d) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d)], names=["u", "v", "d"])

    def nearest(arrays, bucket):
        value, node, *wide = arrays
        return batch(*candidate_links(value, node, np.stack(wide, axis=1).view(np.uint64), bucket, radius, most, plan.bits))

    def still_open(arrays, bucket):
        value, node, component, size, *more = arrays
        held, wide = [x.view(np.uint64) for x in more[:BIN_WORDS]], np.stack(more[BIN_WORDS:], axis=1).view(np.uint64)
        for i, j, d in open_pairs(value, wide, component, bucket, radius, most, plan.bits):
            may = at_most(held, size, i, j) >= least - 1e-9
            yield node[i[may]], node[j[may]], d[may]

    def nearest_open(arrays, bucket):
        held = (np.empty(0, np.int64),) * 3
        for found in still_open(arrays, bucket):
            held = nearest_links(*(np.concatenate(x) for x in zip(held, found)), NEAREST)
        yield batch(*held)

    def all_open(arrays, bucket):
        for found in still_open(arrays, bucket):
            yield batch(*found)

    def pairs(links: DataFrame) -> DataFrame:
        return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    links = cut(dealt(nodes, [], nearest, "u long, v long, d long").groupBy("u", (F.col("v") > F.col("u")).alias("up"), (F.col("v") == F.col("u")).alias("unseen")).agg(F.min(F.struct("d", "v")).alias("n")).select("u", "n.v"))
    some = cut(nodes.join(links.select(F.col("u").alias("node")).distinct(), "node", "left_semi"))
    texts = _keyed(df, id_column, text_column).join(some.select("first.id", "first.row", "node"), ["id", "row"]).select("node", "_text")

    def second(text: bytes, digests: bytes) -> tuple:
        hashes = sketch(digests)
        return hashes, len(hashes) // 4, *bins(hashes)

    binned = [f"b{k}" for k in range(BIN_WORDS)]
    pieces = cut(_hashed(texts, longs(["node"]), width, second, [T.StructField("sketch", T.BinaryType()), *longs(["n", *binned])]).dropDuplicates(["node"]))
    counted = some.select("node", *words).join(pieces.select("node", "n", *binned), "node")

    def compare(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                u, v, a, b = rows.slice(at, 256).columns
                keep = pa.array([similarity(x, y) >= least for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(keep)

    def verified(found: DataFrame) -> DataFrame:
        one = found.join(pieces.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u")
        two = one.join(pieces.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v")
        return two.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")

    seen = cut(pairs(links))
    held = contracted(verified(seen), PARTIAL_ROUNDS)  # while groups are in parts, more pairs are open
    for body, rounds in ((nearest_open, PARTIAL_ROUNDS), (all_open, None)):
        rows = counted.join(labels(held), "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = cut(pairs(dealt(rows, ["component", "n", *binned], body, "u long, v long, d long")).join(seen, ["u", "v"], "left_anti"))
        seen = seen.unionAll(found)
        held = contracted(held.unionAll(verified(found)), rounds)
    groups = labels(held)
    smallest = groups.join(some.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    of_node = nodes.join(groups.join(smallest, "component").select("node", "least"), "node", "left")
    return docs.join(of_node.select("same", *words, F.coalesce("least", "first").alias("first")), ["same", *words]).select("id", "row", "first")


def near_copy_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """(id, group): the smallest id of the group, for each row whose text has a copy or near copy under a smaller id."""
    return near_copies(df, id_column, text_column, width, least, radius).select("id", F.col("first.id").alias("group")).where("id <> group")


def drop_near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of copies and near copies: that of the smallest id, and of those the smallest hash of the text.

    Of repeated rows (one id and one text) the smallest as JSON stays. Rows without id are kept.
    """
    rows = cut(near_copies(df, id_column, text_column, width, least))
    gone = rows.where("id <> first.id OR row <> first.row").select("id", "row")
    again = rows.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first")).where("n > 1").select("id", "row", "first")
    names = [f"c{k}" for k in range(len(df.columns))]
    own = df.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text_of(df, text_column)).alias("row"), *[df[c].alias(n) for c, n in zip(df.columns, names)])
    kept = own.join(gone.unionAll(again.select("id", "row")), ["id", "row"], "left_anti").select(*names)
    whole = F.struct(*names)
    once = own.join(again.where("id = first.id AND row = first.row").select("id", "row"), ["id", "row"]).groupBy("id", "row").agg(F.min_by(whole, F.to_json(whole)).alias("whole")).select("whole.*")
    return kept.unionAll(once).toDF(*df.columns)
