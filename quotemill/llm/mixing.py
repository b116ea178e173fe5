"""Records of several sources, combined so that each gives its target share of all tokens."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.session import Stored

#: Steps that the draw, a hash of the key of DIGITS digits, is cut into by each digit: the step that decides is cut again by the next digit.
STEPS, DIGITS = 256, 7
#: A cell's cut is fine enough when the step that decides holds no larger share of all tokens.
FINE = 1e-5
#: Rounds of proportional fitting after which it is reported as not settled, and how little factors or uses then still move.
ROUNDS, CLOSE = 10_000, 1e-9


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]], most: dict[tuple[str, ...], float], total: float) -> dict[tuple[str, ...], float]:
    """How often each cell's records are used, so that tokens by each axis come as near to targets * total as caps allow.

    cells: tokens by (source, language, topic). Iterative proportional fitting over the axes in turn,
    the first one last so that its marginals hold best; a cell at its cap stays there while the rest of
    its margin takes up the difference. The fitting ends when nothing moves any more: at the targets, or
    where caps keep it off them.
    """
    use = dict.fromkeys(cells, 1.0)
    axes = list(range(len(targets)))[::-1]
    for _ in range(ROUNDS):
        before = dict(use)
        for axis in axes:
            free: dict[str, float] = {}
            fixed: dict[str, float] = {}
            for c, tokens in cells.items():
                side = fixed if use[c] >= most[c] - 1e-12 else free
                side[c[axis]] = side.get(c[axis], 0.0) + tokens * use[c]
            factor = {}
            for value, share in targets[axis].items():
                now = free.get(value, 0.0) + fixed.get(value, 0.0)
                want = share * total
                if now <= 0:
                    continue
                # Too much: all of the margin shrinks. Too little: what isn't at its cap grows.
                factor[value] = want / now if want <= now or not fixed.get(value) else None
                if factor[value] is None:
                    factor[value] = (want - fixed[value]) / free[value] if free.get(value) else 1.0
            for c in cells:
                f = factor.get(c[axis], 1.0)
                use[c] = min(most[c], use[c] * f)
        if max(abs(use[c] - before[c]) / max(before[c], 1e-300) for c in use) < CLOSE:
            break
    else:
        warnings.warn(f"fitting not settled after {ROUNDS} rounds", stacklevel=2)
    return use


class Cut:
    """Where a cell's draw is cut: records with a smaller draw get one copy more. below holds the tokens before `at`, step those of the step that decides."""

    def __init__(self, want: float, whole: float) -> None:
        self.want, self.at, self.below, self.step, self.last = want, 0, 0.0, whole, False

    def descend(self, level: int, steps: dict[int, float]) -> None:
        """Goes on to the step of this level's digit in which the wanted tokens end."""
        size = STEPS ** (DIGITS - 1 - level)
        for digit in sorted(steps):
            if self.below + steps[digit] > self.want:
                self.at, self.step = self.at + digit * size, steps[digit]
                return
            self.below += steps[digit]
        self.at, self.step, self.last = self.at + STEPS * size, 0.0, True  # all of them


def settle(cuts: dict[tuple[str, ...], Cut], level: int) -> dict[tuple[str, ...], int]:
    """The draws below which each cell's records get one more: the deciding step goes in where that brings the cell nearer to its want.

    What is then over or short in a cell goes over to the next one of its source, so that the source's
    sum stays exact to a step of one cell.
    """
    out, carried = {}, {}
    size = STEPS ** (DIGITS - level)
    for c in sorted(cuts):
        cut = cuts[c]
        want = cut.want + carried.get(c[0], 0.0)
        more = not cut.last and abs(cut.below + cut.step - want) < abs(cut.below - want)
        out[c] = cut.at + size if more else cut.at
        carried[c[0]] = want - cut.below - (cut.step if more else 0.0)
    return out


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", budget: float | None = None) -> DataFrame:
    """How often each document is used: key, source, n_tokens, copies (1 or more).

    sizes: key, source, language, topic, n_tokens; targets: source, target_share, max_repeats. Tokens by
    source, language and topic are summed into cells (a small table: values of three columns), their
    weights are raked to the sources' target shares and to the languages' and topics' natural shares,
    and each document is drawn by its cell's weight: the whole part of it for sure, the rest if its draw,
    a hash of its key, lies below the cell's cut. The cut is found digit by digit of the draw, by sums of
    STEPS steps a cell, until the step that decides is finer than FINE, so a cell of any size is cut as
    finely as a small one, runs repeat, and no order or driver-side list of documents is needed. copies never exceeds max_repeats. Sources without a target, and targets without documents, give
    nothing; the shares of the others are then of what is left. budget is the total of tokens; by
    default the largest at which every target share can be met within its cap.

    Null languages and topics are values of their own, null sources have no target. Documents without
    tokens are never drawn.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("target_share > 0 and max_repeats > 0").collect()}
    spark = sizes.sparkSession
    rows = Stored(sizes.select(key, "source", F.coalesce("language", F.lit("?")).alias("language"), F.coalesce("topic", F.lit("?")).alias("topic"), "n_tokens").filter(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))).df
    cells = {(r["source"], r["language"], r["topic"]): float(r["n"]) for r in rows.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("n")).collect()}
    names = ("source", "language", "topic")
    schema = f"{key} {dict(sizes.dtypes)[key]}, source string, n_tokens int, copies int"
    if not cells:
        return spark.createDataFrame([], schema)
    tokens = [{}, {}, {}]
    for c, n in cells.items():
        for axis in range(3):
            tokens[axis][c[axis]] = tokens[axis].get(c[axis], 0.0) + n
    share = {s: wanted[s][0] for s in tokens[0]}
    whole = sum(share.values())
    share = {s: x / whole for s, x in share.items()}
    total = budget or min(wanted[s][1] * tokens[0][s] / share[s] for s in share)
    every = sum(cells.values())
    natural = [{v: n / every for v, n in tokens[axis].items()} for axis in (1, 2)]
    most = {c: float(wanted[c[0]][1]) for c in cells}
    use = rake(cells, [share, *natural], most, total)
    draw = F.col("_draw")
    rows = Stored(rows.withColumn("_draw", F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("draw")), 64 - 8 * DIGITS))).df
    sure = {c: min(int(use[c] + 1e-9), int(most[c])) for c in use}
    cuts = {c: Cut((use[c] - sure[c]) * cells[c] if sure[c] < most[c] else 0.0, cells[c]) for c in cells}
    level = 0
    while level < DIGITS:
        open_ = {c: cut for c, cut in cuts.items() if not cut.last and cut.step > FINE * total}
        if not open_:
            break
        # STEPS rows a cell, whatever the number of documents.
        size = STEPS ** (DIGITS - 1 - level)
        at = spark.createDataFrame([(*c, cut.at) for c, cut in open_.items()], "source string, language string, topic string, at bigint")
        within = rows.join(F.broadcast(at), list(names)).filter((draw >= F.col("at")) & (draw < F.col("at") + size * STEPS))
        steps: dict[tuple[str, ...], dict[int, float]] = {}
        for r in within.groupBy(*names, F.call_function("div", draw - F.col("at"), F.lit(size)).alias("digit")).agg(F.sum("n_tokens").alias("n")).collect():
            steps.setdefault((r["source"], r["language"], r["topic"]), {})[r["digit"]] = float(r["n"])
        for c, cut in cuts.items():
            cut.descend(level, steps[c] if c in open_ else {0: cut.step})
        level += 1
    plan = settle(cuts, level)
    weights = spark.createDataFrame([(*c, sure[c], int(most[c]), at) for c, at in plan.items()], "source string, language string, topic string, sure int, most int, at bigint")
    drawn = rows.join(F.broadcast(weights), list(names))  # a row a cell, bounded by the values of three small columns
    copies = F.least(F.col("most"), F.col("sure") + (draw < F.col("at")).cast("int"))
    return drawn.select(key, "source", F.col("n_tokens").cast("int").alias("n_tokens"), copies.alias("copies")).filter("copies > 0")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached: source, target_share, max_repeats, documents, tokens, most_copies, actual_share. Sources of targets without documents have 0."""
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = per.agg(F.sum("tokens").alias("whole")).first()["whole"]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return targets.join(per, "source", "left").select("source", "target_share", "max_repeats", zero("documents"), zero("tokens"), zero("most_copies"), (F.coalesce("tokens", F.lit(0)) / F.nullif(F.lit(whole).cast("double"), F.lit(0.0))).alias("actual_share"))
