"""Mixing sources to target weights by hash thresholds.

Each document has a hash that depends on its doc_id alone. A source's share is the set of documents
whose hash is at most a threshold, taken once more than the rest. The threshold is found from
sums of sizes by source and hash bucket: the bucket in which the budget ends is refined, level
by level, until one hash value is left. Nothing is sorted, and no row moves: the last step
is a filter against one row per source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import WORD, Scratch, fresh

HASH_BITS, LEVEL_BITS = 60, 12
#: Up to so many sources are sent to every task; beyond, the plan is joined.
BROADCAST_SOURCES = 100_000


def cycling_weights(n: int) -> list[int]:
    return [1 + i % 3 for i in range(n)]


def share_out(sizes: Sequence[int], weights: Sequence[int], total: int, cap: int) -> list[Fraction]:
    """total by weight; no share above cap times its source's size, the excess going to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: Fraction(cap * sizes[i], weights[i]))
    left, weight, out = total, sum(weights), [Fraction(0)] * len(sizes)
    for at, i in enumerate(order):
        if left * weights[i] > cap * sizes[i] * weight:
            out[i] = Fraction(cap * sizes[i])
            left, weight = left - cap * sizes[i], weight - weights[i]
        else:
            for j in order[at:]:
                out[j] = Fraction(left * weights[j], weight)
            break
    return out


def _hash(df: DataFrame, id_col: str, seed: str) -> Column:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(df[id_col].cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **terms) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    Sizes are counts of words. Sources in code point order, null last, get ``weights``; together
    they get ``share`` of all sizes. ``copies`` says how often the document is taken (0 to cap). The
    words taken from a source differ from its target by half a document's size at most (more only
    where several rows share one doc_id: they have one hash and are taken together). Null texts
    have size 0; a null doc_id hashes as the empty text. Ties can't arise between different hashes.
    An empty table gives an empty result; other columns are ignored. Reruns agree."""
    sized, plan = _plan(df, id_col, text_col, source_col, seed, **terms)
    copies = F.col("base") + (F.col("hash") <= F.col("threshold")).cast("int")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **terms) -> DataFrame:
    """The rows of df that the mix takes, with ``copies`` (1 to cap) as one more column (with underscores before the name if df has one of that name); all other columns
    stay. Null texts have size 0, a null source is a source of its own; rows that share a doc_id are taken together. An empty table gives an empty result."""
    _, plan = _plan(df, id_col, text_col, source_col, seed, **terms)
    s, base, threshold, copies = (fresh(df, c) for c in ("s", "base", "threshold", "copies"))
    plan = plan.select(F.col("s").alias(s), F.col("base").alias(base), F.col("threshold").alias(threshold))
    rows = df.join(plan, df[source_col].cast("string").eqNullSafe(plan[s]))
    rows = rows.withColumn(copies, F.col(base) + (_hash(rows, id_col, seed) <= F.col(threshold)).cast("int"))
    return rows.filter(F.col(copies) > 0).drop(s, base, threshold)


def _plan(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weights: Callable[[int], Sequence[int]] = cycling_weights, share: Fraction = Fraction(1), cap: int = 3) -> tuple[DataFrame, DataFrame]:
    """Sizes by row, and one row per source: s, source_size, target, base (times that each document is taken), threshold (hashes up to it are taken once more)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = df.select(
        df[id_col].alias("doc_id"), df[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _hash(df, id_col, seed).alias("hash"),
    )
    sized = scratch.save(sized, "sizes")

    per = sorted(((r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes, w = [n for _, n in per], list(weights(len(per)))
    targets = share_out(sizes, w, int(share * sum(sizes)), cap) if per else []
    base = [min(cap, t // n) if n else 0 for t, n in zip(targets, sizes, strict=True)]
    # Budgets are kept doubled and as whole numbers: a hash is taken if twice the sum before it plus its own sum is at most this.
    budget = [(2 * (t - b * n)).__floor__() for t, b, n in zip(targets, base, sizes, strict=True)]

    # state of the search by source: sum before the bucket, the bucket's number at its level
    state = {i: (0, 0) for i, b in enumerate(budget) if b > 0}
    threshold = {i: -1 for i in range(len(per))}
    names = {s: i for i, (s, _) in enumerate(per)}
    for level in range(HASH_BITS // LEVEL_BITS):
        if not state:
            break
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("hash", shift)
        rows = sized
        if level:
            bounds = spark.createDataFrame([(per[i][0], at) for i, (_, at) in state.items()], "source string, at long").withColumnsRenamed({"source": "s"})
            rows = sized.join(_sent(bounds, len(state)), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("at")))
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        start = spark.createDataFrame([(per[i][0], before, budget[i]) for i, (before, _) in state.items()], "s string, before long, budget long")
        ahead = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        run = sums.join(_sent(start, len(state)), F.col("source").eqNullSafe(F.col("s"))).withColumn("cum", F.col("before") + F.coalesce(ahead, F.lit(0)))
        # the first bucket that isn't taken as a whole; a bucket of one hash value is judged by the rule itself
        whole = F.when(F.col("lo") == F.col("hi"), 2 * F.col("cum") + F.col("n") <= F.col("budget")).otherwise(2 * (F.col("cum") + F.col("n")) <= F.col("budget"))
        edge = run.filter(~whole).groupBy("source").agg(F.min_by(F.struct("bucket", "cum", "lo", "hi"), "bucket").alias("e")).collect()
        found = {names[r["source"]]: r["e"] for r in edge}
        for i in list(state):
            if i not in found:  # all that is left of the source belongs to it
                threshold[i] = (1 << HASH_BITS) if not level else ((state[i][1] + 1) << (shift + LEVEL_BITS)) - 1
                del state[i]
            elif found[i]["lo"] == found[i]["hi"]:
                threshold[i] = found[i]["lo"] - 1
                del state[i]
            else:
                state[i] = (found[i]["cum"], found[i]["bucket"])

    plan = spark.createDataFrame([(per[i][0], sizes[i], float(targets[i]), int(base[i]), threshold[i]) for i in range(len(per))], "s string, source_size long, target double, base int, threshold long")
    return sized, _sent(plan, len(per))


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df
