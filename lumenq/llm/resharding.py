"""Operator 3: resharding by minimum-cost flow.

Documents lie in old shards, folders of files whose sizes differ; new shards have capacities. A block is the documents of
one old shard that share a slot of a hash of their id; old shards have blocks in proportion to their bytes, of which there
are at most BLOCKS in all, so the table of block sizes that the driver sees is bounded however many documents there are.
A file holds consecutive blocks of one old shard, some PART_BYTES of them.

A flow network leads from old shards over (old, new) edges, free where a shard stays and one a byte where bytes move, to
the new shards' capacities. Its minimum cost is the fewest bytes that must move. Each old shard then hands over runs of
consecutive blocks, as many as each edge has flow, so that few files are cut in two; a last pass evens out what is over
with single blocks. Files all of whose blocks stay are left as they lie, byte for byte; the others are written again,
into the folder of each block's new shard, and then removed.

Slots are numbered without gaps: a block's first slot follows from the block counts, and a row's place within its block is
stored with it, so that rows that stay needn't be written for their slot.

Defined results: a null text has no bytes (size 8) and the checksum of an empty one; rows of one id lie in one block,
in the order of size and checksum; a row without id hashes like any other value; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.llm.common import drop_path, scratch_path

SHARDS = 24
OLD_SHARDS = 20
BLOCKS = 20_480
PART_BYTES = 64 << 20
LEAST_PART = 1 << 20
OVERHEAD = 8


def minimum_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from supplies to demands (equal sums) of least total cost, by successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, right = list(supply), list(demand)
    pi = [0] * (n + m)
    while any(left):
        far = [float("inf")] * (n + m)
        via = [-1] * (n + m)
        done = [False] * (n + m)
        for i in range(n):
            if left[i]:
                far[i] = 0
        goal = -1
        while True:
            x = min((k for k in range(n + m) if not done[k]), key=far.__getitem__, default=-1)
            if x < 0 or far[x] == float("inf"):
                break
            done[x] = True
            if x >= n and right[x - n] and (goal < 0 or far[x] + pi[x] < far[goal] + pi[goal]):
                goal = x
            edges = ((n + j, cost[x][j] + pi[x] - pi[n + j]) for j in range(m)) if x < n else ((i, pi[x] - pi[i] - cost[i][x - n]) for i in range(n) if flow[i][x - n])
            for y, c in edges:
                if not done[y] and far[x] + c < far[y]:
                    far[y], via[y] = far[x] + c, x
        if goal < 0:
            raise ValueError("supplies and demands differ")
        reach = far[goal]
        for k in range(n + m):
            pi[k] += min(far[k], reach)
        path, x = [], goal
        while via[x] >= 0:
            path.append((via[x], x))
            x = via[x]
        amount = min([left[x], right[goal - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[x] -= amount
        right[goal - n] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


@dataclass
class Plan:
    """Where blocks go. size[old][block]; target[old][block]: new shard; first[old][block]: first slot there; part[old][block]: file."""

    size: list[np.ndarray]
    target: list[np.ndarray]
    first: list[np.ndarray]
    part: list[np.ndarray]
    sizes: list[int]
    moved: int
    least: int  # bytes that any plan must move
    affected: set[tuple[int, int]]  # (old, part) of files that don't stay as they are


def parts_of(size: np.ndarray, most: int) -> np.ndarray:
    """The number of the file of each block: consecutive blocks of about `most` bytes."""
    return (np.cumsum(size) - size) // max(1, most)


def plan_blocks(size: list[np.ndarray], rows: list[np.ndarray], shards: int = SHARDS, part_bytes: int = PART_BYTES) -> Plan:
    """size, rows: bytes and documents of each block, by old shard."""
    old = len(size)
    supply = [int(x.sum()) for x in size]
    capacity = even_capacities(sum(supply), shards)
    flow = minimum_cost_flow(supply, capacity, [[0 if i == j else 1 for j in range(shards)] for i in range(old)])
    part = [parts_of(x, part_bytes) for x in size]
    target, filled = [], [0] * shards
    for i in range(old):
        edges = sorted((j for j in range(shards) if flow[i][j]), key=lambda j: (j != i, j))  # what stays, then what moves
        ends = np.cumsum([flow[i][j] for j in edges])
        middle = np.cumsum(size[i]) - size[i] / 2
        where = np.searchsorted(ends, middle, side="right").clip(max=max(0, len(edges) - 1))
        target.append(np.array(edges, np.int64)[where] if edges else np.full(len(size[i]), min(i, shards - 1)))
        for j in edges:
            filled[j] += int(size[i][target[i] == j].sum())
    _even_out(target, size, filled, capacity)
    first, next_slot = [np.zeros(len(x), np.int64) for x in size], [0] * shards
    for i in range(old):
        for b, (j, n) in enumerate(zip(target[i].tolist(), rows[i].tolist())):
            first[i][b] = next_slot[j]
            next_slot[j] += n
    moved = int(sum(size[i][target[i] != i].sum() for i in range(old)))
    least = sum(flow[i][j] for i in range(old) for j in range(shards) if i != j)
    affected = {(i, int(p)) for i in range(old) for p in np.unique(part[i][(size[i] > 0) & (target[i] != i)])}
    return Plan(size, target, first, part, filled, moved, least, affected)


def _even_out(target: list[np.ndarray], size: list[np.ndarray], filled: list[int], capacity: list[int]) -> None:
    """Hand single blocks from the fullest to the emptiest shard while that brings the two closer together."""
    over = lambda j: filled[j] - capacity[j]
    old = np.repeat(np.arange(len(size)), [len(x) for x in size])
    number = np.concatenate([np.arange(len(x)) for x in size])
    every, to = np.concatenate(size), np.concatenate(target)
    for _ in range(8 * len(filled)):
        high = max(range(len(filled)), key=over)
        low = min(range(len(filled)), key=over)
        gap = over(high) - over(low)
        pick = np.nonzero((to == high) & (every > 0) & (every < gap))[0]
        if not len(pick):
            break
        k = pick[np.argmin(np.abs(2 * every[pick] - gap))]
        to[k] = low
        filled[high] -= int(every[k])
        filled[low] += int(every[k])
    for i in range(len(size)):
        target[i][number[old == i]] = to[old == i]


def laid_out(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", old_shards: int = OLD_SHARDS, blocks: int = BLOCKS) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray]]:
    """Rows (id, text, size, checksum, old, block), and the sizes and counts of all blocks; a row's old shard is its source's."""
    text = df[text_column].cast("string")
    known = F.coalesce(text, F.lit(""))
    old = F.pmod(F.xxhash64(df[source_column]), F.lit(old_shards)).cast("int")
    size = F.octet_length(known).cast("bigint") + OVERHEAD
    totals = dict(df.select(old.alias("old"), size.alias("size")).groupBy("old").agg(F.sum("size")).collect())  # a row for each old shard
    every = max(1, sum(totals.values()))
    count = [max(1, blocks * totals.get(i, 0) // every) for i in range(old_shards)]
    block = F.pmod(F.xxhash64(df[id_column], F.lit(3)), F.element_at(F.array(*map(F.lit, count)), old + 1)).cast("int")
    rows = df.select(df[id_column].alias("id"), text.alias("text"), size.alias("size"), F.crc32(F.encode(known, "UTF-8")).alias("crc"), old.alias("old"), block.alias("block"))
    sizes, counts = [np.zeros(n, np.int64) for n in count], [np.zeros(n, np.int64) for n in count]
    for r in rows.groupBy("old", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toLocalIterator():  # at most blocks + old_shards rows
        sizes[r["old"]][r["block"]], counts[r["old"]][r["block"]] = r["size"], r["n"]
    return rows, sizes, counts


def _lookup(spark, sizes: list[np.ndarray], **columns: list[np.ndarray]) -> DataFrame:
    """(old, block, and the given numbers), a row for each block: bounded, so it may be broadcast."""
    rows = [(i, b, *(int(c[i][b]) for c in columns.values())) for i, size in enumerate(sizes) for b in np.nonzero(size)[0].tolist()]
    return F.broadcast(spark.createDataFrame(rows, "old int, block int" + "".join(f", {c} long" for c in columns)))


def _part_bytes(df: DataFrame, sizes: list[np.ndarray]) -> int:
    share = sum(int(x.sum()) for x in sizes) // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(PART_BYTES, max(LEAST_PART, share))


def store_shards(rows: DataFrame, sizes: list[np.ndarray], path: str, part_bytes: int) -> None:
    """The old shards: path/old=i/part=p, a file of consecutive blocks each, sorted by block and place."""
    part = [parts_of(x, part_bytes) for x in sizes]
    number = sum(len(np.unique(p[x > 0])) for p, x in zip(part, sizes))
    dealt = rows.join(_lookup(rows.sparkSession, sizes, part=part), ["old", "block"]).repartition(max(1, number), "old", "part")
    own = Window.partitionBy("old", "part", "block").orderBy("id", "size", "crc")
    numbered = dealt.withColumn("place", F.row_number().over(own).cast("long") - 1)
    numbered.select("id", "text", "block", "place", "old", "part").write.partitionBy("old", "part").option("compression", "zstd").parquet(path)


def reshard(df: DataFrame, out: str | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> tuple[DataFrame, Plan, str]:
    """Store the old shards below `out`, move what the plan moves; the frame of the stored rows, the plan and the path."""
    spark = df.sparkSession
    out = out or scratch_path(spark, "shards")
    rows, sizes, counts = laid_out(df, id_column, text_column, source_column, old_shards)
    part_bytes = _part_bytes(df, sizes)
    kind = df.schema[id_column].dataType.simpleString()
    if not sum(int(x.sum()) for x in sizes):
        plan = plan_blocks(sizes, counts, shards, part_bytes)
        return spark.createDataFrame([], f"`{id_column}` {kind}, text string, shard int, slot long"), plan, out
    store_shards(rows, sizes, f"{out}/old", part_bytes)
    return *move(spark, out, sizes, counts, kind, id_column, shards, part_bytes), out


def move(spark, out: str, sizes: list[np.ndarray], counts: list[np.ndarray], kind: str, id_column: str, shards: int, part_bytes: int) -> tuple[DataFrame, Plan]:
    """Rewrite the affected files of the old shards below `out`; (id, text, shard, slot) of all rows as they then lie."""
    plan = plan_blocks(sizes, counts, shards, part_bytes)
    where = _lookup(spark, sizes, shard=plan.target, first=plan.first)
    stay = [f"{out}/old/old={i}/part={p}" for i, x in enumerate(plan.part) for p in np.unique(x[sizes[i] > 0]).tolist() if (i, p) not in plan.affected]
    gone = [f"{out}/old/old={i}/part={p}" for i, p in sorted(plan.affected)]
    stored = []
    if gone:
        read = spark.read.option("basePath", f"{out}/old").schema(f"id {kind}, text string, block int, place long, old int, part long").parquet(*gone)
        moved = read.join(where, ["old", "block"]).select("id", "text", "old", "block", "place", "shard")
        moved.write.partitionBy("shard").option("compression", "zstd").parquet(f"{out}/new")  # from file to file, without a shuffle
        for path in gone:
            drop_path(spark, path)
        stored.append(spark.read.schema(f"id {kind}, text string, old int, block int, place long, shard int").parquet(f"{out}/new").drop("shard"))
    if stay:
        read = spark.read.option("basePath", f"{out}/old").schema(f"id {kind}, text string, block int, place long, old int, part long").parquet(*stay)
        stored.append(read.select("id", "text", "old", "block", "place"))
    rows = reduce(DataFrame.unionByName, stored).join(where, ["old", "block"])
    return rows.select(F.col("id").alias(id_column), "text", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("place")).alias("slot")), plan


def read_back(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of the rows as they are stored."""
    known = F.coalesce(F.col("text"), F.lit(""))
    crc: Column = F.crc32(F.encode(known, "UTF-8"))
    return stored.select(
        id_column,
        (F.octet_length(known).cast("bigint") + OVERHEAD).alias("size"),
        crc.alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
