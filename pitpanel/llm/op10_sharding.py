"""Sharding by balanced label propagation.

Documents with equal texts are linked and should meet in one shard; shards have equal
numbers of rows, at most one apart. Every document begins in a shard drawn by hash. In
each round, Spark joins find for each group of linked documents the shard with room that
holds most of it, and the group's members elsewhere ask to move there. Requests are
granted by gain under quotas, so that no shard's linked documents exceed its capacity.
Copies of a text are interchangeable, so the state is a count for each group and shard:
the rounds don't touch documents, and a group of any size is sixteen rows. Documents that
are linked to none fill what is left.

At last one range-partitioned sort numbers the rows of each shard; the few beyond a
shard's capacity, unlinked ones first, go to the next free places of other shards. That
needs counts by sort partition, not rows, on the driver.

Defined results: a null text has size 1 and checksum 0, and null texts are linked to each
other; ids may be null or repeated; repeated rows are linked and placed each for itself;
an empty table gives an empty one; other columns are left out. Equal gains and equal homes go
by a hash of group and shard; what doesn't fit into a shard is that which the numbering by
group and row puts last. A text of any length is hashed whole and not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import cut, meet

SHARDS = 16
#: Rounds at most; labels stand still earlier, as rows only move to shards that hold more of
#: their group. Rows that are cut from their group either way are counted by ``cut_links``.
ROUNDS = 40


def quotas(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How much of each request (from, to) is granted, so that no shard gains more than its room."""
    granted = wanted.astype(float)
    for _ in range(100):
        gain, loss = granted.sum(axis=0), granted.sum(axis=1)
        most = np.maximum(room + loss, 0)
        if (gain <= most + 0.5).all():
            break
        granted *= np.where(gain > most, most / np.maximum(gain, 1), 1.0)[None, :]
    return granted


def propagate(counts: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``g, shard, n`` after label propagation; ``counts`` has the linked groups' rows alone."""
    shards = len(capacity)
    state = cut(counts.select("g", "shard", "n"))
    for _ in range(rounds):
        load, settled = np.zeros(shards), np.zeros(shards)
        for shard, n in state.groupBy("shard").agg(F.sum("n")).collect():
            load[shard] = n
        room = np.array(capacity) - load
        tight = [s for s in range(shards) if room[s] <= 0.01 * capacity[s]]
        # A group's homes are the shards that hold most of it, as many as it needs to fit; of
        # equal shards a hash decides, so that groups don't crowd into the same ones. A small
        # group that is split between a full shard and another is at home in the other.
        here = F.struct("n", F.xxhash64("g", "shard").alias("tie"), "shard")
        groups = state.groupBy("g").agg(F.reverse(F.array_sort(F.collect_list(here))).alias("held"), F.sum("n").alias("total"))
        groups = groups.withColumn("homes", F.slice("held", 1, F.ceil(F.col("total") / max(1, max(capacity))).cast("int")))
        loose = F.filter("held", lambda x: ~x["shard"].isin(tight))
        stuck = (F.size("homes") == 1) & (F.size("held") > 1) & F.exists("homes", lambda x: x["shard"].isin(tight)) & (F.size(loose) > 0)
        groups = groups.withColumn("homes", F.when(stuck, F.slice(loose, 1, 1)).otherwise(F.col("homes")))
        is_home = lambda shard: F.exists("homes", lambda x: x["shard"] == shard)
        placed = state.join(groups, "g").withColumn("home", is_home(F.col("shard")))
        for shard, m in placed.filter("home").groupBy("shard").agg(F.sum("n")).collect():
            settled[shard] = m
        free = [s for s in range(shards) if settled[s] < 0.99 * capacity[s]]
        if not free:
            break
        open_ = lambda x: x["shard"].isin(free)
        asks = placed.filter(~F.col("home")).withColumn("to", F.filter("homes", open_))
        asks = asks.withColumn("to", F.when(F.size("to") > 0, F.col("to")).otherwise(F.slice(F.filter("held", open_), 1, 1))).filter(F.size("to") > 0)
        asks = asks.withColumn("to", F.get("to", F.pmod(F.col("shard"), F.greatest(F.size("to"), F.lit(1)))))
        better = F.struct("n", F.xxhash64("g", "shard")) < F.struct(F.col("to.n").alias("n"), F.col("to.tie"))
        asks = asks.filter(is_home(F.col("to.shard")) | better)
        asks = asks.select("g", "shard", "n", F.col("to.shard").alias("to"), F.col("to.n").alias("most"))
        gain = F.floor(F.log2(F.col("most").cast("double"))).cast("int")
        asks = cut(asks.withColumn("rank", (F.lit(62) - gain) * 16 + F.pmod(F.xxhash64("g"), F.lit(16)).cast("int")))
        sums = asks.groupBy("shard", "to", "rank").agg(F.sum("n").alias("n")).collect()
        if not sums:
            break
        wanted = np.zeros((shards, shards))
        for shard, to, _, n in sums:
            wanted[shard, to] += n
        granted = quotas(wanted, room)
        shares, used = [], np.zeros((shards, shards))
        for shard, to, rank, n in sorted(sums):
            share = min(1.0, max(0.0, (granted[shard, to] - used[shard, to]) / n))
            used[shard, to] += n * share
            if share > 0:
                shares.append((shard, to, rank, float(share)))
        if not shares:
            break
        # At most shards^2 * 62 * 16 rows, whatever the input.
        table = asks.sparkSession.createDataFrame(shares, "shard int, to int, rank int, share double")
        moves = asks.join(F.broadcast(table), ["shard", "to", "rank"])
        part = F.pmod(F.xxhash64("g", "shard", F.lit("part")), F.lit(1000)) / 1000.0  # a part of a row moves as a whole or not at all
        moves = moves.withColumn("moved", F.floor(F.col("n") * F.col("share") + part).cast("bigint")).withColumn("moved", F.least("moved", "n")).filter("moved > 0")
        changes = moves.select("g", "shard", (-F.col("moved")).alias("n")).unionByName(moves.select("g", F.col("to").alias("shard"), F.col("moved").alias("n")))
        new = cut(state.unionByName(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        moved = moves.limit(1).count()
        state = new
        if not moved:
            break
    return state


def place(rows: DataFrame, capacity: list[int]) -> DataFrame:
    """``rows`` with final shard and slot: numbered in each shard, what is too much moved on."""
    order = ["shard", "single", "g", "row"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()))
    found = dealt.groupBy("part", "shard").count().collect()  # parts + shards rows about
    first: dict[tuple[int, int], int] = {}
    load = [0] * len(capacity)
    for part, shard, n in sorted(found):
        first[part, shard] = load[shard]
        load[shard] += n
    over = np.concatenate([[0], np.cumsum([max(0, a - b) for a, b in zip(load, capacity)])])
    under = np.concatenate([[0], np.cumsum([max(0, b - a) for a, b in zip(load, capacity)])])
    columns = [c for c in rows.columns if c not in ("shard", *order[1:])]
    at = {c: k for k, c in enumerate(dealt.columns)}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in columns) + ", shard int, slot bigint"
    most, held = np.array(capacity), np.array(load)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            shard = batch.column(at["shard"]).to_numpy(zero_copy_only=False).astype(np.int64)
            part = batch.column(at["part"]).to_numpy(zero_copy_only=False)
            slot = np.zeros(len(shard), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
                key = int(part[a]), int(shard[a])
                n = seen.get(key, first[key])
                slot[a:b] = np.arange(n, n + b - a)
                seen[key] = n + b - a
            late = slot >= most[shard]
            place = over[shard[late]] + slot[late] - most[shard[late]]
            to = np.searchsorted(under, place, side="right") - 1
            slot[late] = held[to] + place - under[to]
            shard[late] = to
            arrays = [*(batch.column(at[c]) for c in columns), pa.array(shard.astype(np.int32)), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "shard", "slot"])

    return dealt.mapInArrow(run, schema)


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, g, shard, slot`` of each document; ``g`` names its group."""
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("g"),
    )
    base = cut(base.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    count = base.count()
    capacity = [count // shards + (s < count % shards) for s in range(shards)]
    counts = cut(base.groupBy("g", "shard").agg(F.count("*").alias("n")))
    linked = counts.groupBy("g").agg(F.sum("n").alias("total")).filter("total > 1")
    # Rows are drawn by hash below, so a shard is filled to some deviations under its capacity.
    state = propagate(counts.join(linked, "g"), [c - min(int(4 * c**0.5), c // 8) for c in capacity], rounds)
    parts = state.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("held"), F.sum("n").alias("total"))
    parts = cut(parts.select("g", "held", "total", F.col("total").alias("n")))
    # A row takes a shard of its group by hash, in proportion to what the shard holds of it.
    drawn = F.pmod(F.xxhash64("row", F.lit("draw")), F.col("total"))
    pick = F.aggregate(
        "held",
        F.struct(drawn.alias("left"), F.lit(-1).alias("shard")),
        lambda a, x: F.when(a["shard"] >= 0, a).otherwise(
            F.when(a["left"] < x["n"], F.struct(a["left"].alias("left"), x["shard"].alias("shard"))).otherwise(
                F.struct((a["left"] - x["n"]).alias("left"), F.lit(-1).alias("shard"))
            )
        ),
    )
    met = meet(base, parts, "g", count, "left")
    rows = met.select(
        "row", "doc_id", "size", "text_crc32", "g",
        F.when(F.col("held").isNull(), F.col("shard")).otherwise(pick["shard"]).cast("int").alias("shard"),
        F.when(F.col("held").isNull(), 1).otherwise(0).alias("single"),
    )
    return place(rows.select("doc_id", "size", "text_crc32", F.col("g").alias("group"), "g", "row", "single", "shard"), capacity)


def cut_links(assigned: DataFrame) -> DataFrame:
    """One row ``linked, cut``: rows that are linked to others, and those outside the shard
    that holds most of their group."""
    counts = assigned.groupBy("group", "shard").agg(F.count("*").alias("n")).groupBy("group").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    linked = counts.filter("n > 1")
    return linked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def digests(assigned: DataFrame) -> DataFrame:
    """The contract's columns, under the law of equal numbers of rows."""
    return assigned.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
