"""Similarity joins of token sets and nearest neighbours of vectors, without all pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.titles import jaccard
from quotemill.session import Stored


def set_classes(df: DataFrame, key: str, tokens: str, block: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with equal token sets (within their block) as classes: (classes: block, tokens, class_id; members: key, class_id). class_id is the smallest key. Null and empty sets have no class."""
    rows = df.select(F.col(key), *block, F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("tokens")).filter(F.size("tokens") > 0)
    classes = rows.groupBy(*block, "tokens").agg(F.min(key).alias("class_id"))
    members = rows.join(classes, [*block, "tokens"]).select(key, "class_id")
    return classes, members


def similar_classes(classes: DataFrame, least: float, block: Sequence[str] = ()) -> DataFrame:
    """Pairs of classes in the same block whose sets have a Jaccard similarity of at least `least`: a, b (a < b), jaccard.

    Tokens are put in order of rarity; of n tokens the first n - ceil(least * n) + 1 are a set's prefix,
    and two sets that are similar enough share a token of their prefixes, so the join meets rare
    tokens only. Sizes must fit before sets are compared. Nothing is capped; a token in a third of all
    sets enters a prefix only of sets that have nothing rarer.
    """
    classes = Stored(classes).df
    often = classes.select(*block, F.explode("tokens").alias("t")).groupBy(*block, "t").agg(F.count("*").alias("f"))
    ranked = classes.select("class_id", *block, "tokens", F.explode("tokens").alias("t")).join(often, [*block, "t"])
    ordered = ranked.groupBy("class_id", *block, "tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "t"))), lambda x: x["t"]).alias("o"))
    n = F.size("tokens")
    prefix = ordered.select("class_id", *block, "tokens", n.alias("n"), F.posexplode(F.slice("o", F.lit(1), n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1)).alias("i", "t"))
    a, b = (prefix.select(*block, "t", F.col("class_id").alias(s), *[F.col(c).alias(c + s) for c in ("tokens", "n", "i")]) for s in ("a", "b"))
    # Where a pair's first common token meets, what is left of either set bounds what they share.
    left, needed = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")), (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9
    met = a.join(b, [*block, "t"]).filter((F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9) & (left >= needed))
    scored = met.select("a", "b", jaccard(F.col("tokensa"), F.col("tokensb")).alias("jaccard")).filter(F.col("jaccard") >= least)
    return scored.distinct()


def membership(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each member (key, class_id) with n_members of its class and n_links, the number of other classes that similar_classes pairs it with (0 if none)."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n_members")).join(links, "class_id", "left")
    return members.join(sizes, "class_id").select(*members.columns, "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _packed(df: DataFrame, key: str, vector: str, per: int) -> DataFrame:
    """Vectors in blocks of about `per`, by a hash of their key: block, keys, vectors (flat)."""
    n = df.count()
    blocks = max(1, -(-n // per))
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<float>").alias("v")).filter("k is not null and v is not null")
    return rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("k", "v")).alias("rows"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, least: float = -1.0, per: int = 4096) -> DataFrame:
    """For each query the k rows of largest inner product, itself left out: query, neighbour, similarity, rank. Exact.

    Queries and rows are dealt into blocks of about `per` vectors; each pair of blocks is one matrix
    product in one task, which returns k rows a query, and a window over those picks the k best. Ties
    go to the smaller key. Null keys and vectors take no part; vectors of another length than the
    first of their block have no similarity.
    """
    q, r = _packed(queries, key, vector, per), _packed(rows, key, vector, per)
    grid = q.select(F.col("rows").alias("q")).join(r.select(F.col("rows").alias("r")))  # the stated query set against all rows, by blocks

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["q"], batch["r"]):
                size = len(left[0]["v"])
                left, right = ([x for x in side if len(x["v"]) == size] for side in (left, right))
                if not right:
                    continue
                lk, rk = (np.array([x["k"] for x in side], dtype=np.int64) for side in (left, right))
                sims = np.array([x["v"] for x in left], dtype=np.float64) @ np.array([x["v"] for x in right], dtype=np.float64).T
                sims[lk[:, None] == rk[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(rk, sims.shape), -np.round(sims, 12)), axis=1)[:, :k]
                found = np.take_along_axis(sims, order, axis=1)
                keep = np.isfinite(found) & (found >= least)
                i, j = np.nonzero(keep)
                yield pd.DataFrame({"query": lk[i], "neighbour": rk[order[i, j]], "similarity": found[i, j]})

    best = grid.mapInPandas(product, "query bigint, neighbour bigint, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
