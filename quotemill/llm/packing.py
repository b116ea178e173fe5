"""Items of varying length in containers of fixed capacity, with little space left."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.session import Stored

#: Fill levels that the level array tells apart.
LEVELS = 64
#: Containers filled up to this share are repacked when the stream has ended.
REPACK = 0.985
#: Containers that a shard fills: enough for the last ones not to matter, few enough for one task.
SHARD_CONTAINERS = 2_000
#: Tokens that a shard holds at most, whatever the capacity.
SHARD_TOKENS = 16_000_000

#: Parts of documents that a shard holds at most.
SHARD_ITEMS = 200_000

PLACED = "limit_name string, capacity_tokens int, container_id string, doc_id bigint, part int, first_token int, n_tokens int, at_token int, online_id string"


class Packer:
    """Sum-of-squares online packing of one shard.

    levels[i] counts the partly filled containers whose fill lies in level i. An item goes where the
    sum of the squared counts grows least: into a new container, or into the fullest container of a
    level that still takes it; of equal choices into the fuller one. As counts are kept alike, a
    container of nearly any fill stays at hand to be topped up exactly.
    """

    def __init__(self, capacity: int, levels: int = LEVELS) -> None:
        self.capacity, self.n = capacity, min(levels, capacity)
        self.counts = [0] * (self.n + 1)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(self.n + 1)]  # (fill, container) in order
        self.fills: list[int] = []
        self.contents: list[list[int]] = []

    @property
    def levels(self) -> np.ndarray:
        return np.array(self.counts)

    def place(self, item: int, size: int) -> None:
        # Squares grow by 2N+1 where a count goes up, and shrink by 2N-1 where one goes down; a full container counts nowhere.
        capacity, n, counts, open_ = self.capacity, self.n, self.counts, self.open
        room = capacity - size
        best, fullest, level, place = (2 * counts[size * n // capacity] + 1 if room else 0), 0, -1, -1
        top = room * n // capacity
        for i in range(top, -1, -1):
            group = open_[i]
            if not group:
                continue
            k = len(group) - 1
            if i == top:
                k = bisect_right(group, (room, 1 << 60)) - 1
                if k < 0:
                    continue
            fill = group[k][0]
            here = 2 * counts[i] - 1
            if fill == room:
                change = -here
            else:
                to = (fill + size) * n // capacity
                change = 2 * counts[to] + 1 - here if to != i else 0
            if change < best or (change == best and fill > fullest):
                best, fullest, level, place = change, fill, i, k
        if level < 0:
            fill, container = 0, len(self.fills)
            self.fills.append(0)
            self.contents.append([])
        else:
            fill, container = open_[level].pop(place)
            counts[level] -= 1
        self.fills[container] = fill = fill + size
        self.contents[container].append(item)
        if fill < capacity:
            i = fill * n // capacity
            insort(open_[i], (fill, container))
            counts[i] += 1

    def close(self, sizes: list[int]) -> None:
        """Repacks what lies in containers that stayed clearly open when the stream ended: largest first, each into the fullest container that takes it; kept if it saves containers."""
        left = [c for g in self.open for f, c in g if f <= self.capacity * REPACK]
        items = sorted((i for c in left for i in self.contents[c]), key=lambda i: (-sizes[i], i))
        bins: list[list[int]] = []
        order: list[tuple[int, int]] = []
        for i in items:
            k = bisect_right(order, (self.capacity - sizes[i], 1 << 60)) - 1
            if k < 0:
                bins.append([i])
                insort(order, (sizes[i], len(bins) - 1))
            else:
                fill, at = order.pop(k)
                bins[at].append(i)
                insort(order, (fill + sizes[i], at))
        if len(bins) < len(left):
            for c in left:
                self.contents[c] = []
            self.contents += bins


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packs each shard; rows come in order of limit, shard and place in the stream."""
    held: list[pd.DataFrame] = []
    current = None
    for batch in batches:
        for shard, rows in batch.groupby(["limit_name", "shard"], sort=False):
            if shard != current and held:
                yield _pack_shard(pd.concat(held, ignore_index=True))
                held = []
            current = shard
            held.append(rows)
    if held:
        yield _pack_shard(pd.concat(held, ignore_index=True))


def _pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    limit, shard, capacity = rows["limit_name"].iat[0], int(rows["shard"].iat[0]), int(rows["capacity_tokens"].iat[0])
    sizes = rows["n_tokens"].to_numpy()
    packer = Packer(capacity)
    for i, size in enumerate(sizes.tolist()):
        packer.place(i, size)
    online = np.zeros(len(rows), dtype=np.int64)
    for c, items in enumerate(packer.contents):
        online[items] = c
    packer.close(sizes.tolist())
    filled = [c for c in packer.contents if c]
    order = np.array([i for c in filled for i in c], dtype=np.int64)
    number = np.repeat(np.arange(len(filled)), [len(c) for c in filled])
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = number[1:] != number[:-1]
    base = np.maximum.accumulate(np.where(new, starts, 0))
    out = rows.iloc[order][["limit_name", "capacity_tokens", "doc_id", "part", "first_token", "n_tokens"]].copy()
    out["container_id"] = [f"{limit}-{shard}-{n}" for n in number]
    out["at_token"] = starts - base
    out["online_id"] = [f"{limit}-{shard}-{n}" for n in online[order]]
    return out[["limit_name", "capacity_tokens", "container_id", "doc_id", "part", "first_token", "n_tokens", "at_token", "online_id"]]


def pack(sizes: DataFrame, limits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where each document goes, for each limit: limit_name, capacity_tokens, container_id, doc_id, part, first_token, n_tokens, at_token; and online_id, the container that it lay in before the last open ones were repacked.

    sizes: key and n_tokens; limits: limit_name, capacity_tokens. A document longer than the capacity is
    split into parts of full capacity and a last one; no other is split. Documents without tokens (null
    or empty texts) take no space and get no row, limits that are null or below 1 are left out.

    Documents are dealt to shards by a hash of their key, so any source or key may hold a third of all
    rows; the number of shards follows from the total, so each has about SHARD_CONTAINERS containers or
    SHARD_TOKENS tokens, and one task packs it online. Only numbers travel, never texts.
    """
    sizes = Stored(sizes.select(F.col(key).cast("bigint").alias("doc_id"), "n_tokens").filter("n_tokens > 0 and doc_id is not null")).df
    total, documents = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    # A handful of limits, each of which takes all documents: they stand beside each document as an array.
    chosen = []
    for r in limits.select("limit_name", "capacity_tokens").filter("capacity_tokens >= 1").collect():
        shards = max(1, -(-total // min(r["capacity_tokens"] * SHARD_CONTAINERS, SHARD_TOKENS)), -(-(documents + total // r["capacity_tokens"]) // SHARD_ITEMS))
        chosen.append(F.struct(F.lit(r["limit_name"]).alias("limit_name"), F.lit(r["capacity_tokens"]).cast("int").alias("capacity_tokens"), F.lit(shards).cast("bigint").alias("shards")))
    if not chosen:
        return sizes.sparkSession.createDataFrame([], PLACED)
    cuts = F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity_tokens")).cast("int"))
    parts = sizes.select("doc_id", "n_tokens", F.inline(F.array(*chosen))).select("limit_name", "capacity_tokens", "shards", "doc_id", F.col("n_tokens").alias("whole"), F.explode(cuts).alias("part"))
    first = F.col("part") * F.col("capacity_tokens")
    parts = parts.select("limit_name", "capacity_tokens", F.pmod(F.xxhash64("doc_id", "part"), F.col("shards")).alias("shard"), "doc_id", "part", first.cast("int").alias("first_token"), F.least(F.col("capacity_tokens"), F.col("whole") - first).cast("int").alias("n_tokens"))
    streams = parts.repartition("limit_name", "shard").sortWithinPartitions("limit_name", "shard", F.xxhash64("doc_id", F.lit(1)), "doc_id", "part")
    return streams.mapInPandas(_pack, PLACED)


def report(placed: DataFrame) -> DataFrame:
    """By limit: containers, tokens, fill (share of the space that holds tokens), documents split; and the containers and fill of the online rule alone, before the last open ones were repacked."""
    per = placed.groupBy("limit_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.count_if(F.col("part") == 1).alias("split"))
    online = placed.groupBy("limit_name", "online_id").agg(F.lit(1).alias("one")).groupBy("limit_name").agg(F.count("*").alias("online_containers"))
    whole = per.groupBy("limit_name", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.sum("split").alias("split_documents"))
    filled = lambda c: F.col("tokens") / (F.col(c) * F.col("capacity_tokens"))
    return whole.join(online, "limit_name").select("limit_name", "capacity_tokens", "containers", "tokens", filled("containers").alias("fill"), "split_documents", "online_containers", filled("online_containers").alias("online_fill"))


def faults(placed: DataFrame, sizes: DataFrame, limits: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a packing must not have, by limit: limit_name, lost_tokens (tokens of documents less those placed), overfull (containers beyond their capacity), needless_splits (documents split that fit whole), overlaps (parts that don't begin where the one before ends)."""
    total = sizes.filter("n_tokens > 0").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    per = placed.groupBy("limit_name").agg(F.sum("n_tokens").alias("placed"))
    over = placed.groupBy("limit_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.count_if(F.col("at_token") + F.col("n_tokens") > F.col("capacity_tokens")).alias("out")).groupBy("limit_name").agg(F.count_if((F.col("n") > F.col("capacity_tokens")) | (F.col("out") > 0)).alias("overfull"))
    docs = placed.groupBy("limit_name", "capacity_tokens", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end")).groupBy("limit_name").agg(F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("needless_splits"), F.count_if(F.col("n") != F.col("end")).alias("overlaps"))
    out = limits.filter("capacity_tokens >= 1").select("limit_name").join(per, "limit_name", "left").join(over, "limit_name", "left").join(docs, "limit_name", "left").withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("limit_name", (F.col("all_tokens") - F.coalesce("placed", F.lit(0))).cast("bigint").alias("lost_tokens"), zero("overfull"), zero("needless_splits"), zero("overlaps"))
