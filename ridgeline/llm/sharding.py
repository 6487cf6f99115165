"""Sharding by Karmarkar-Karp differencing of indivisible groups (documents with equal texts).

Groups are summed first, so a group of any number of copies is one row. Blocks of groups (dealt by a hash of the
group) are differenced in parallel: every group starts as a partial partition with one filled shard; again and again
the two partial partitions of the largest spread are combined, largest shard against smallest. What a block leaves is
itself a partial partition of ``shards`` sums, and these, one for each block, are differenced in the same way, together
with the groups that are large beside a shard: these stand alone, for no block could level them. Only the blocks' sums
and those groups (blocks x shards and ``LARGE`` x shards numbers at most) reach the driver.

Law: ``bytes``. Sums differ by little unless one group alone outweighs an even share; groups are never split.

Defined cases: a null text counts no bytes (size 1) and forms a group with null texts only (its crc is that of
nothing); ties fall by group key; repeated rows stay rows of their group; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

#: Groups in a block are about so many at most; the number of blocks grows with the groups.
BLOCK_GROUPS = 20_000
#: A group of more than a shard's even share divided by this is large; there are fewer than LARGE * shards of them.
LARGE = 64
#: Slots are numbered in so many pieces of each shard, side by side.
PIECES = 64


def difference(items: list[tuple[float, object]], shards: int) -> list[tuple[float, list]]:
    """Partitions (size, payload) pairs; returns (sum, payloads) for each of the shards, largest sum first."""
    #: an entry: sums (descending) and, beside each sum, a tree of payloads
    heap: list = [(-size, k, [(size, (payload,))]) for k, (size, payload) in enumerate(items)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        a, b = a + [(0, ())] * (shards - len(a)), b + [(0, ())] * (shards - len(b))
        merged = [(x + y, (s, t) if s and t else s or t) for (x, s), (y, t) in zip(a, reversed(b))]
        merged.sort(key=lambda e: -e[0])
        low = merged[-1][0]
        turn += 1
        while merged and not merged[-1][1]:
            merged.pop()
        heapq.heappush(heap, (-(merged[0][0] - low), turn, merged))
    out = heap[0][2] if heap else []
    return [(s, _leaves(tree)) for s, tree in out] + [(0, [])] * (shards - len(out))


def _leaves(tree: tuple) -> list:
    found, todo = [], [tree]
    while todo:
        t = todo.pop()
        if len(t) == 1:
            found.append(t[0])
        else:
            todo += [x for x in t if x]
    return found


def _block(shards: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["bytes", "digest"], ascending=[False, True], kind="stable")
        parts = difference(list(zip(block["bytes"].tolist(), block["digest"].tolist())), shards)
        number = int(block["block"].iloc[0])
        return pd.DataFrame([(number, k, d, s) for k, (s, digests) in enumerate(parts) for d in digests], columns=["block", "part", "digest", "part_bytes"])

    return run


def shard(documents: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard: every row of documents once."""
    spark = documents.sparkSession
    work = Scratch(spark, "sharding")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.concat(F.unhex(F.md5(body)), F.when(F.col(text).isNull(), F.lit(b"0")).otherwise(F.lit(b"1"))).alias("digest"),
    )
    rows = work.put("rows", rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    is_large = F.col("bytes") * LARGE * shards > total
    large = [(-1 - k, 0, bytes(r.digest), r.bytes) for k, r in enumerate(groups.where(is_large).orderBy(F.desc("bytes"), "digest").collect())]  # under LARGE x shards rows
    kind = "block int, part int, digest binary, part_bytes long"
    blocks = max(1, -(-rows.select(F.approx_count_distinct("digest")).first()[0] // BLOCK_GROUPS))
    dealt = groups.where(~is_large).withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int"))
    parts = work.put("parts", dealt.groupBy("block").applyInPandas(_block(shards), kind).unionByName(spark.createDataFrame(large, kind)))
    sums: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("block", "part").agg(F.first("part_bytes").alias("s")).orderBy("block", "part").collect():  # blocks x shards rows
        sums.setdefault(r.block, {})[r.part] = r.s
    place = _combine(sums, shards)
    where = spark.createDataFrame(place or [(0, 0, 0)], "block int, part int, shard int")
    placed = parts.join(F.broadcast(where), ["block", "part"]).select("digest", "shard")
    located = rows.join(placed, "digest").select(key, "size", "text_crc32", "shard")
    return _slots(work.put("located", located), key, shards).select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _combine(sums: dict[int, dict[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Differences the blocks' partial partitions: (block, part, shard)."""
    heap = []
    for block, parts in sums.items():
        entry = sorted(((parts.get(k, 0), [(block, k)]) for k in range(shards)), key=lambda e: -e[0])
        heap.append((-(entry[0][0] - entry[-1][0]), block, entry))
    heapq.heapify(heap)
    turn = max(sums, default=0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x + y, s + t) for (x, s), (y, t) in zip(a, reversed(b))), key=lambda e: -e[0])
        turn += 1
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), turn, merged))
    return [(block, part, k) for k, (_, inside) in enumerate(heap[0][2]) for block, part in inside] if heap else []


def _slots(located: DataFrame, key: str, shards: int) -> DataFrame:
    """Gapless numbers in each shard: pieces number their rows side by side, from what lies before each piece."""
    pieces = located.withColumn("_piece", F.pmod(F.xxhash64(key), F.lit(PIECES)).cast("int"))
    before = pieces.groupBy("shard", "_piece").agg(F.count("*").alias("n"))  # shards x pieces rows
    before = before.selectExpr("shard", "_piece", "sum(n) over (partition by shard order by _piece) - n as _from")
    inside = pieces.selectExpr("*", f"row_number() over (partition by shard, _piece order by {key}, text_crc32, size) - 1 as _at")
    return inside.join(F.broadcast(before), ["shard", "_piece"]).withColumn("slot", (F.col("_from") + F.col("_at")).cast("long"))
