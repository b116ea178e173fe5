"""Long exact spans that records share: which stretches of a text stand verbatim in other records.

Units start at line starts and are UNIT code points long (where no line starts within reach, at any
place). Every run of `least` code points owns the unit of smallest digest inside it, so two records
that share such a run choose the same unit. Digests are grouped globally; then the runs around equal
units are compared by digest, those of whole blocks first, and single runs only where blocks differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.session import Stored

#: Code points of a unit. Shorter ones stand by chance in many records, longer ones are more rows.
UNIT = 80
#: Code points that are worked on at once; longer texts are cut into overlapping pieces.
AT_ONCE = 400_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _short(x: np.ndarray) -> np.ndarray:
    """32 bits of a 64-bit value."""
    return (_mix(x) >> np.uint64(32)).astype(np.uint32).view(np.int32)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 2**64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Digests of any stretch of an array of code points, as polynomials modulo 2**64."""

    def __init__(self, codes: np.ndarray, base: int) -> None:
        size = 1 << max(12, int(len(codes) + 1).bit_length())  # few sizes, so that powers are kept
        up, self.down = _powers(base, size)
        values = _mix(codes.astype(np.uint64) + np.uint64(base))
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def smallest_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of each window of that width: of the rest of one row of a grid and the start of the next."""
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


#: A block of runs; h is its unit's digest, w and x are those of its whole stretch.
_BLOCK = "id bigint, first int, last int, h bigint, w bigint, x int"
#: A stretch to be compared run by run: it stands in records a to b, c numbers its class (0 for a block of one record only).
_EDGE = "a bigint, b bigint, first int, h bigint, c bigint, stretch string"
#: A run by its digests w and x.
_RUN = "w bigint, x int, a bigint, b bigint, start int"


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def blocks(texts: list[str], least: int, whole: bool = True) -> dict[str, np.ndarray]:
    """The blocks of runs that own the same unit, over several texts.

    Columns: text (its index), first and last (starts of the block's runs), h (the unit's digest and rank),
    and, if whole, w and x (64 and 32 bits of digests of the block's whole stretch).
    """
    arrays = [codes_of(t) for t in texts]
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    codes = np.concatenate(arrays) if len(arrays) else np.zeros(0, np.uint32)
    if not (sizes >= least).any():
        return {k: np.zeros(0, np.int64) for k in ("text", "first", "last", "h", "w", "x")}
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    a = Rolling(codes, _BASES[0])
    at = np.arange(len(codes) - UNIT + 1)
    rank = _mix(a.of(at, at + UNIT)) >> np.uint64(1)
    breaks = (codes == 10) | (codes == 13)
    # Units at line starts come before all others.
    rank |= np.uint64(1 << 63)
    lines = np.flatnonzero(breaks[:-1] & ~breaks[1:]) + 1
    rank[lines[lines < len(rank)]] &= np.uint64((1 << 63) - 1)
    width = least - UNIT
    # Run s owns a unit that starts in s+1 ... s+least-UNIT: the character before it lies inside the run.
    own = smallest_in_window(rank[1:], width)
    inside = np.ones(len(own), dtype=bool)
    for start, size in zip(starts.tolist(), sizes.tolist()):
        inside[max(start, start + size - least + 1) : start + size] = False  # runs don't reach over a text's end
    s = np.flatnonzero(inside)
    h = own[s]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1] + 1)
    i = np.flatnonzero(new)
    first, last = s[i], s[np.append(i[1:], len(s)) - 1]
    text = np.searchsorted(starts, first, side="right") - 1
    out = {"text": text, "first": first - starts[text], "last": last - starts[text], "h": h[i].view(np.int64)}
    if whole:
        shape, b = _mix((last - first).astype(np.uint64)), Rolling(codes, _BASES[1])
        out |= {"w": _mix(b.of(first, last + least) ^ shape).view(np.int64), "x": _short(a.of(first, last + least) ^ shape)}
    return out


def pieces(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(ids, offsets, texts) of up to about AT_ONCE code points; texts shorter than least are left out.

    A long text comes in pieces that overlap by least - 1, so that each run lies in one piece.
    """
    ids, offsets, texts, size = [], [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None or i is None or len(text) < least:
                continue
            for at in range(0, len(text) - least + 1, AT_ONCE):
                part = text[at : at + AT_ONCE + least - 1]
                ids.append(i)
                offsets.append(at)
                texts.append(part)
                size += len(part)
                if size >= AT_ONCE:
                    yield ids, offsets, texts
                    ids, offsets, texts, size = [], [], [], 0
    if texts:
        yield ids, offsets, texts


def _digests(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, texts in pieces(batches, least):
            b = blocks(texts, least, whole=False)
            yield pa.RecordBatch.from_arrays([pa.array(b["h"]), pa.array(np.asarray(ids, dtype=np.int64)[b["text"]])], ["h", "id"])

    return run


def _placed(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offsets, texts in pieces(batches, least):
            b = blocks(texts, least)
            at = np.asarray(offsets, dtype=np.int64)[b["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(ids, dtype=np.int64)[b["text"]]), pa.array((b["first"] + at).astype(np.int32)), pa.array((b["last"] + at).astype(np.int32)), *[pa.array(b[k]) for k in ("h", "w", "x")]],
                ["id", "first", "last", "h", "w", "x"],
            )

    return run


def _cut(least: int) -> Callable:
    """From (a, text, wanted: array of b, first, last, h, c): a row of _EDGE for each wanted stretch of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = batch.column(2), batch.column(1).to_pylist()
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            wanted = lists.flatten()
            b, first, last, h, c = (wanted.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            row = np.repeat(np.arange(batch.num_rows), counts)
            found = [texts[r][f : e + least] for r, f, e in zip(row.tolist(), first.tolist(), last.tolist())]
            keep = np.flatnonzero([len(t) >= least for t in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_numpy()[row[keep]]), *[pa.array(v[keep]) for v in (b, first, h, c)], pa.array([found[i] for i in keep.tolist()], pa.string())],
                ["a", "b", "first", "h", "c", "stretch"],
            )

    return run


def _runs(least: int) -> Callable:
    """From (a, b, first, h, stretch): a row of _RUN for each run of the stretch, its digests mixed with h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                arrays = [codes_of(t) for t in part.column(4).to_pylist()]
                if not arrays:
                    continue
                sizes = np.array([len(x) for x in arrays])
                n = sizes - least + 1
                row = np.repeat(np.arange(len(arrays)), n)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(np.cumsum(sizes) - sizes, n) + inside
                codes, h = np.concatenate(arrays), part.column(3).to_numpy().view(np.uint64)[row]
                x, w = (Rolling(codes, base).of(start, start + least) ^ h for base in _BASES)
                yield pa.RecordBatch.from_arrays([pa.array(_mix(w).view(np.int64)), pa.array(_short(x)), pa.array(part.column(0).to_numpy()[row]), pa.array(part.column(1).to_numpy()[row]), pa.array((part.column(2).to_numpy()[row] + inside).astype(np.int32))], ["w", "x", "a", "b", "start"])

    return run


def shared_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200, origins: bool = True) -> DataFrame:
    """The runs of `least` code points that stand verbatim in another record too: key, first, last (starts of the first and last run of a row), earliest (smallest key with the same runs).

    With origins, runs of a copied block that a still earlier record has in another block come a second
    time, with that record as earliest; the smallest earliest of a run counts. Without them earliest is
    the smallest key with the same block, which is enough where only shared stretches are asked for.

    Steps, each linear in the input, none with pairs of records, and none with anything on the driver:
    1. Digests of units, grouped globally: which stand in more than one record.
    2. The texts once more: blocks of runs as places and digests, without text; those of shared units (a
       semi-join by the unit's digest) are stored in the shared folder.
    3. Blocks with the same digests in several records are shared as a whole, in one step however many copies there are.
    4. Blocks that stand in one record only, next to other blocks of the same unit (the ends of shared
       stretches), are compared run by run with them, one block standing for all with its digest.
       With origins so are copied blocks with each other, and what an earlier record has goes to all
       copies. Only these blocks' texts are read, by joining their places to the records.
    Blocks and runs are the same if their digests are: 63 bits of the unit and 96 of the block, 96 of a
    run. Keys must be whole numbers; rows of one key are one record. Null and empty texts, and texts
    shorter than least, share nothing; runs repeated inside one record only are not shared. Offsets are
    code points.
    """
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    shared = source.mapInArrow(_digests(least), "h bigint, id bigint").groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a != b").select("h")
    kept = Stored(source.mapInArrow(_placed(least), _BLOCK).join(shared, "h", "left_semi")).df
    # One number orders a class's blocks by record and place, another holds the first one's place: no block is longer than a unit's reach.
    order = F.col("id").cast("decimal(38,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("first")
    place = F.col("first").cast("bigint") * F.lit(least) + (F.col("last") - F.col("first"))
    classes = kept.groupBy("h", "w", "x").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min_by(place, order.cast("decimal(38,0)")).alias("place"))
    per_unit = classes.groupBy("h").agg(F.min("a").alias("ua"), F.max("b").alias("ub"), F.max(F.col("a") == F.col("b")).alias("open"), F.count("*").alias("n")).filter("ua != ub")
    full = classes.filter("a != b")
    block = ["h", "w", "x"]
    whole = kept.join(full.select(*block, "a"), block).select("id", "first", "last", F.col("a").alias("earliest"))
    open_ = per_unit.filter("n > 1" if origins else "open").select("h")
    # The class of a block by number; together with its smallest id no two are alike.
    number = F.xxhash64("h", "w", "x").alias("c")
    alone = kept.join(classes.filter("a = b").select(*block), block).join(open_, "h").select(F.col("id").alias("a"), F.col("id").alias("b"), "first", "last", "h", F.lit(0).cast("bigint").alias("c"))
    first = F.call_function("div", F.col("place"), F.lit(least)).cast("int")
    copied = full.join(open_, "h").select("a", "b", first.alias("first"), (first + F.pmod("place", F.lit(least))).cast("int").alias("last"), "h", number)
    wanted = alone.unionByName(copied).groupBy("a").agg(F.collect_list(F.struct("b", "first", "last", "h", "c")).alias("wanted"))  # of one record, bounded by its length
    edges = Stored(source.filter("text is not null").join(wanted, F.col("id") == F.col("a")).select("a", "text", "wanted").mapInArrow(_cut(least), _EDGE)).df
    parts = ["a", "b", "first", "h", "stretch"]
    common = edges.select(*parts).mapInArrow(_runs(least), _RUN).groupBy("w", "x").agg(F.min("a").alias("ea"), F.max("b").alias("eb"), F.max("a").alias("la")).filter("ea != eb").select("w", "x", F.col("ea").alias("earliest"), "la")
    common = Stored(common).df
    single = edges.filter("a = b").select(*parts).mapInArrow(_runs(least), _RUN).join(common, ["w", "x"])
    out = whole.unionByName(single.select(F.col("a").alias("id"), F.col("start").alias("first"), F.col("start").alias("last"), "earliest"))
    if origins:
        before = common.filter("earliest != la").select("w", "x", "earliest")
        late = edges.filter("a != b").select("a", F.col("c").alias("b"), F.lit(0).alias("first"), "h", "stretch").mapInArrow(_runs(least), _RUN).join(before, ["w", "x"]).filter("earliest < a")
        # Runs one after another with the same earliest record are one row; there are no more than a block has.
        step = F.col("start") - F.row_number().over(Window.partitionBy("a", "b", "earliest").orderBy("start"))
        ranges = late.withColumn("step", step).groupBy("a", "b", "earliest", "step").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
        members = kept.select("id", "first", *block).join(full.select(*block, "a"), block).select("id", F.col("first").alias("at"), "a", number)
        moved = members.join(ranges.withColumnRenamed("b", "c"), ["a", "c"])
        out = out.unionByName(moved.select("id", (F.col("at") + F.col("lo")).alias("first"), (F.col("at") + F.col("hi")).alias("last"), "earliest"))
    return out.withColumnRenamed("id", key)


def stretches(runs: DataFrame, key: str = "doc_id", least: int = 200) -> DataFrame:
    """The union of runs by record, as longest stretches: key, span_start, span_end (excluded). Stretches that touch or overlap are one.

    A record's runs are put in order together; their number is bounded by the record's own length.
    """
    spans = runs.select(key, F.col("first").alias("s"), (F.col("last") + least).alias("e"))
    w = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("island")


def shared_share(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each record how much of it is shared elsewhere: key, n_chars, n_spans, shared_chars, shared_share. Empty and null texts share 0 of 0 and have a null share."""
    per = spans.groupBy(key).agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sized = docs.select(key, F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars")).join(per, key, "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return sized.select(key, "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), shared.alias("shared_chars"), F.try_divide(shared, "n_chars").alias("shared_share"))


def repeats(runs: DataFrame, key: str = "doc_id", least: int = 200) -> DataFrame:
    """The stretches to remove if of equal blocks only the earliest record's is kept, with their original offsets: key, span_start, span_end."""
    return stretches(runs.filter(F.col("earliest") < F.col(key)), key, least)
