"""SimHash near-deduplication with the generalised pigeonhole principle.

Fingerprints that differ in at most d bits must, for any cut of the bits into m parts with thresholds t_1 .. t_m
that sum to d - m + 1, differ in at most t_i bits of some part i. The parts group correlated bits (so that
skew stays within few parts), and the thresholds come from dynamic programming over estimated
candidate counts: the collisions of each part, counted on all fingerprints, carried on to larger thresholds by the
bits' own frequencies. Distinct fingerprints probe an index of parts; each hit is verified in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import Scratch, drop_rows, text_batches, text_bytes, text_key

BITS = 64
SHINGLE, MAX_BITS = 3, 3


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    import xxhash

    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        n = len(words)
        if n <= shingle:
            own = [digest(b" ".join(words), 42)] if n else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = (ends - [len(w) + 1 for w in words]).tolist()
            own = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)]
        hashes += own
        counts.append(len(own))
    return majority(np.array(hashes, np.uint64), np.array(counts))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes (of the given lengths), the bits that over half of the run has. No hash: zero."""
    if not len(hashes):
        return np.zeros(len(counts), np.uint64)
    # eight bits at a time, each in a byte of its own: runs of up to 255 hashes are summed without overflow
    first = np.cumsum(counts) - counts
    pieces = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), pieces)
    at = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    piece_of = np.flatnonzero(pieces)
    sums = np.zeros((len(counts), BITS), np.int64)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        by_piece = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums[piece_of, bit::8] = np.add.reduceat(by_piece, (np.cumsum(pieces) - pieces)[piece_of], axis=0)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            fp = fingerprints(text_bytes(batch.column(2)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_key", "fp"])

    return run


def _bit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.float64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += x.T @ x
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64), pa.int64())], ["i", "j", "n"])


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Cut the bits into m parts of near-equal width; each part grows by the bit that correlates most with it. both: of n, how many have bits i and j."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = (BITS - sum(map(len, parts))) // (m - k)
        rest = sorted(free)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        free.discard(part[0])
        while len(part) < width:
            b = max(sorted(free), key=lambda b: (corr[b, part].sum(), -b))
            part.append(b)
            free.discard(b)
        parts.append(sorted(part))
    return parts


def allocate(collisions: list[float], ratios: list[list[float]], distinct: int, budget: int) -> tuple[float, list[int]]:
    """Thresholds (from -1: the part isn't probed) that sum to budget at the least estimated cost, candidates and probes.

    collisions: ordered pairs that agree in the part; ratios: for each bit of the part, how much likelier two fingerprints differ in it than agree."""
    m = len(collisions)

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        ways = np.zeros(t + 1)  # elementary symmetric sums: one more bit may differ, or not
        ways[0] = 1
        for r in ratios[i]:
            ways[1:] += r * ways[:-1].copy()
        return collisions[i] * ways.sum() + distinct * sum(comb(len(ratios[i]), j) for j in range(t + 1))

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t in range(-1, budget + m + 1):
                if (after := spent + t) <= budget + (m - i - 1) and (after not in step or c + cost(i, t) < step[after][0]):
                    step[after] = (c + cost(i, t), [*chosen, t])
        best = step
    return best[budget]


@dataclass(frozen=True)
class Plan:
    parts: list[list[int]]
    thresholds: list[int]

    def mask(self, i: int) -> int:
        return _signed(sum(1 << b for b in self.parts[i]))

    def flips(self, i: int) -> list[int]:
        return [_signed(sum(1 << b for b in c)) for t in range(self.thresholds[i] + 1) for c in combinations(self.parts[i], t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def make_plan(prints: DataFrame, max_bits: int) -> Plan:
    """The best of the cuts into 2 to max_bits + 1 parts. prints: distinct fingerprints in column fp."""
    sums = prints.select("fp").mapInArrow(_bit_pairs, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in sums:
        both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    n = prints.count()
    cuts = {m: correlated_parts(both, n, m) for m in range(min(2, max_bits + 1), max_bits + 2)}
    masks = [(m, i, _signed(sum(1 << b for b in part))) for m, parts in cuts.items() for i, part in enumerate(parts)]
    keyed = prints.select(F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for m, i, mask in masks))).alias("x")).select("x.*")
    agree = {(r["m"], r["i"]): float(r["c"]) for r in keyed.groupBy("m", "i", "key").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("m", "i").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("c")).collect()}
    share = np.clip(np.diag(both) / max(n, 1), 0.01, 0.99)
    ratio = 2 * share * (1 - share) / (share**2 + (1 - share) ** 2)
    found = []
    for m, parts in cuts.items():
        # a part without any collision yet may have some by chance
        seen = [max(agree.get((m, i), 0.0), n * n / 2.0 ** len(part)) for i, part in enumerate(parts)]
        cost, thresholds = allocate(seen, [[float(ratio[b]) for b in part] for part in parts], n, max_bits - m + 1)
        found.append((cost, m, thresholds))
    _, m, thresholds = min(found)
    return Plan(cuts[m], thresholds)


def links(prints: DataFrame, plan: Plan, max_bits: int) -> DataFrame:
    """Each pair u < v of fingerprints that differ in at most max_bits bits, once. No candidate is left out, and none leaves the join unverified."""
    own = [i for i, t in enumerate(plan.thresholds) if t >= 0]
    entry = lambda i, flip: F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(plan.mask(i))).bitwiseXOR(F.lit(flip)).alias("key"))
    index = prints.select(F.col("fp").alias("v"), F.explode(F.array(*(entry(i, 0) for i in own))).alias("x")).select("v", "x.part", "x.key")
    probe = prints.select(F.col("fp").alias("u"), F.explode(F.array(*(entry(i, flip) for i in own for flip in plan.flips(i)))).alias("x")).select("u", F.col("x.part").alias("p"), F.col("x.key").alias("k"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    earlier: Column = F.lit(False)  # the pair was found by a part before this one
    for i in own:
        earlier = earlier | ((F.col("part") > i) & (F.bit_count(differ.bitwiseAND(F.lit(plan.mask(i)))) <= plan.thresholds[i]))
    on = (F.col("p") == F.col("part")) & (F.col("k") == F.col("key")) & (F.col("u") < F.col("v")) & (F.bit_count(differ) <= max_bits) & ~earlier
    return probe.join(index, on).select("u", "v")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, text_key, fp, component_id, kept.

    A row's group is all that can be reached by links between fingerprints of at most max_bits differing bits;
    component_id is its smallest doc_id (null only if all are), whose row is kept. Texts without words (null,
    empty) have fingerprint zero and link like any other. Rows equal in doc_id and text are kept or dropped together.
    An empty table gives an empty result; other columns are ignored."""
    scratch = Scratch(df.sparkSession, "simhash")
    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = scratch.save(rows.mapInArrow(_fingerprint_rows(shingle), "doc_id long, text_key long, fp long"), "fingerprints")
    own = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("text_key"))
    prints = scratch.save(rows.groupBy("fp").agg(F.min(own).alias("keep")), "distinct")
    edges = scratch.save(links(prints, make_plan(prints, max_bits), max_bits), "links")
    of = scratch.save(components(edges, scratch), "components")
    linked = scratch.save(of.join(prints, of["node"] == prints["fp"]).select("fp", "root", "keep"), "linked")
    roots = scratch.save(linked.groupBy("root").agg(F.min("keep").alias("group_keep")), "roots")
    grouped = scratch.save(linked.join(roots, "root").select("fp", "group_keep"), "grouped")
    all_prints = scratch.save(prints.join(grouped, "fp", "left").select("fp", F.coalesce("group_keep", "keep").alias("keep")), "keepers")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_key") == F.col("keep.text_key"))
    return rows.join(all_prints, "fp").select("doc_id", "text_key", "fp", F.col("keep.doc_id").alias("component_id"), kept.alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of df that near_groups keeps; all columns stay, under whatever names. Rows repeated as a whole (doc_id and text) leave one. Nulls, empty texts and
    ties are as in near_groups; an empty table gives an empty result."""
    scratch = Scratch(df.sparkSession, "simhash-filter")
    groups = near_groups(df, id_col, text_col, shingle, max_bits)
    return drop_rows(df, id_col, text_key(df[text_col]), groups.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "kept"), scratch)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
