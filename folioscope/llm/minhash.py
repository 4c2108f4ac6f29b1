"""Near copies by MinHash with tensored banding.

A text's set is that of its word shingles. Two collections of sketches are made, each sketch of a few minhashes; the tables' keys are all pairs of a sketch of the first and one of the second
collection. So 24 x 24 tables of eight minhashes each take 2 x 24 x 4 = 192 minhashes instead of 4,608. A pair of sets meets in some table if it shares a sketch of both collections: at a similarity
of 0.8 with a chance of 0.999994, above it with more.

A sketch that no other set has meets nothing, so keys are only formed from sketches that at least two sets have. In each bucket one set is the center, the same in as many
buckets as possible; each set is first compared with the center that it meets most often, twice over with other centers; then all pairs of a bucket that aren't in one group yet. Candidates pass by their sizes, by one bit of each minhash (a bound five standard deviations off) and by a parity sketch of the whole
sets (a bound that loses nothing), and every link is verified on the whole sets. Groups of copies thus cost as many comparisons as members, not as pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import Scratch, text_batches, text_bytes
from folioscope.llm.similar import shingle_set, verified

WORDS = 2
#: Sketches of a collection, and minhashes of a sketch.
SKETCHES, ROWS = 24, 4
#: Bits, one of each minhash, in which two sets of similarity 0.8 may differ: a tenth is expected, and five standard deviations (which one pair in 3.5 million exceeds).
BITS = 2 * SKETCHES * ROWS
MOST_BITS = round(BITS / 10 + 5 * (BITS * 0.09) ** 0.5)
STARS = 2
#: Numbers of a parity sketch, of 64 bits each.
PARITIES = 16

_DOCS = "doc_id long, text_key long, set_id long, n int, sketches array<long>, b0 long, b1 long, b2 long, parity array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def minhashes(grams: np.ndarray, seed: int = 7) -> np.ndarray:
    """The minhashes of one set, from the hashes of its shingles."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, (2, BITS, 1), dtype=np.uint64)
    a, out = 2 * a + np.uint64(1), np.full(BITS, np.iinfo(np.uint64).max)
    for k in range(0, len(grams), 512):  # products that stay in the processor's cache
        np.minimum(out, (a * grams[None, k : k + 512].view(np.uint64) + b).min(axis=1), out=out)
    return out


def sketch(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both collections' sketches, and one bit of each minhash, in three numbers."""
    of = np.arange(2 * SKETCHES, dtype=np.uint64)
    for row in least.reshape(2 * SKETCHES, ROWS).T:
        of = _mixed(of * np.uint64(0x9E3779B97F4A7C15) + row)
    bits = np.packbits((_mixed(least) & np.uint64(1)).astype(np.uint8))
    return of.view(np.int64), bits.view(np.int64)


def parity(grams: np.ndarray) -> np.ndarray:
    """For each of 1,024 places, whether an odd number of the set's shingles fall on it. Two sets' sketches differ in no more places than the sets do in shingles, by which pairs are ruled
    out without losing any: at a similarity of 4/5 the sets differ in a ninth of all their shingles at most."""
    at = (grams.view(np.uint64) >> np.uint64(20)) & np.uint64(64 * PARITIES - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * PARITIES) & 1).astype(np.uint8)).view(np.int64)


def _set_rows(words: int):
    """Columns doc_id, text_key, text -> the name, size and sketches of each text's set; a text without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_batches(batches, limit=2 << 20):
            known: dict[int, tuple] = {}
            rows = []
            for text in text_bytes(batch.column(2)):
                if not text.split(None, 1):
                    rows.append((0, 0, None, 0, 0, 0, None))
                    continue
                grams = shingle_set(text, words)
                name = xxhash.xxh3_64_intdigest(grams.tobytes())
                if name not in known:
                    of, bits = sketch(minhashes(grams))
                    known[name] = (name - (1 << 64) if name >> 63 else name, len(grams), of, *bits.tolist(), parity(grams))
                rows.append(known[name])
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [c.split()[0] for c in _DOCS.split(", ")])

    return run


def table_keys(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """key, set_id, n: the tables' keys of each set, of sketches that at least two sets have. sets: one row a set."""
    slots = sets.select("set_id", F.posexplode("sketches").alias("slot", "sketch"))
    shared = scratch.save(slots.groupBy("slot", "sketch").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("slot", "sketch"), "shared")
    alive = slots.join(shared, ["slot", "sketch"]).groupBy("set_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot"))).alias("alive"))
    some = lambda first: F.filter(F.sequence(F.lit(first), F.lit(first + SKETCHES - 1)), lambda s: F.expr("alive").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0)
    own = scratch.save(sets.select("set_id", "n", "sketches").join(alive, "set_id").withColumns({"x": some(0), "y": some(SKETCHES)}).filter("size(x) > 0 AND size(y) > 0"), "alive")
    scratch.drop(shared)
    rows = own.select("set_id", "n", "sketches", "y", F.explode("x").alias("i")).select("set_id", "n", "sketches", "i", F.explode("y").alias("j"))
    return rows.select(F.xxhash64("i", "j", F.col("sketches")[F.col("i")], F.col("sketches")[F.col("j")]).alias("key"), "set_id", "n")


def _near_sizes(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _near_bits(u: str, v: str) -> Column:
    return sum((F.bit_count(F.col(f"b{k}{u}").bitwiseXOR(F.col(f"b{k}{v}"))) for k in range(3)), F.lit(0)) <= MOST_BITS


def groups(sets: DataFrame, docs: DataFrame, rows: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the groups of set_ids: all similar sets that meet in any table's bucket are in one. sets: one row a set; docs: one row a text; rows: doc_id, text_key, text."""
    bits = sets.select("set_id", "b0", "b1", "b2")
    side = lambda c: bits.withColumnsRenamed({"set_id": c, **{f"b{k}": f"b{k}{c}" for k in range(3)}})
    keys = scratch.save(table_keys(sets, scratch), "keys")
    several = keys.groupBy("key").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).filter("a <> b").select("key")
    now = scratch.save(keys.join(several, "key", "left_semi").withColumn("root", F.col("set_id")), "buckets")
    scratch.drop(keys)
    found, of = None, components(now.select(F.col("set_id").alias("u"), F.col("set_id").alias("v")).limit(0), scratch)
    pair = (F.least("set_id", "center").alias("u"), F.greatest("set_id", "center").alias("v"))
    for step in range(STARS + 1):
        if step < STARS:
            order = F.struct(F.xxhash64(F.lit(step), "set_id").alias("o"), F.col("set_id").alias("center"), F.col("n").alias("m"), F.col("root").alias("other"))
            center = now.groupBy("key").agg(F.min(order).alias("c")).select("key", "c.center", "c.m", "c.other")
            met = now.join(center, "key").filter((F.col("root") != F.col("other")) & _near_sizes(F.col("n"), F.col("m"))).groupBy("set_id", "center").agg(F.count(F.lit(1)).alias("times"))
            met = met.join(side("set_id"), "set_id").join(side("center"), "center").filter(_near_bits("set_id", "center"))
            # the one that a set meets most often; the others come later, if they are needed
            met = met.groupBy("set_id").agg(F.max_by("center", F.struct("times", F.xxhash64(F.lit(step), "center"))).alias("center")).select(*pair).distinct()
        else:  # all that is left: each pair that meets in a table comes once, from the first sketch of the first collection that it shares
            whole = now.select("set_id", "root").distinct().join(sets.drop("keep"), "set_id").withColumnsRenamed({f"b{k}": f"b{k}u" for k in range(3)})
            whole = whole.select("*", *(F.col("parity")[k].alias(f"p{k}u") for k in range(PARITIES))).drop("parity")  # columns, so that the test compiles to straight code
            slots = scratch.save(whole, "open").select("*", F.posexplode(F.slice("sketches", 1, SKETCHES)).alias("i", "x"))
            several = slots.groupBy("i", "x").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("i", "x")
            slots = scratch.save(slots.join(several, ["i", "x"], "left_semi"), "open-slots")
            other = slots.select(*(F.col(c).alias(d) for c, d in (("i", "k"), ("x", "z"), ("set_id", "center"), ("n", "m"), ("root", "other"), ("sketches", "theirs"), *((f"{x}{k}u", f"{x}{k}v") for x, m in (("b", 3), ("p", PARITIES)) for k in range(m)))))
            shared = F.zip_with("sketches", "theirs", lambda x, z: x == z)
            first = (F.array_position(shared, F.lit(True)) == F.col("i") + 1) & F.exists(F.slice(shared, SKETCHES + 1, SKETCHES), lambda x: x)
            unlike = sum((F.bit_count(F.col(f"p{k}u").bitwiseXOR(F.col(f"p{k}v"))) for k in range(PARITIES)), F.lit(0))
            on = (F.col("set_id") < F.col("center")) & (F.col("root") != F.col("other")) & _near_sizes(F.col("n"), F.col("m")) & _near_bits("u", "v") & (9 * unlike <= F.col("n") + F.col("m")) & first
            met = slots.join(other, (F.col("i") == F.col("k")) & (F.col("x") == F.col("z")) & on).select(*pair)
        own = verified(met, docs, rows, words, scratch)
        if not own.isEmpty():
            found = own if found is None else found.unionByName(own)
            of = scratch.save(components(found, scratch), "groups")
        if step == STARS:
            return of
        named = now.drop("root").join(of, now["set_id"] == of["node"], "left").select("key", "set_id", "n", F.coalesce("root", "set_id").alias("root"))
        named = scratch.save(named, "named")
        several = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
        after = scratch.save(named.join(several, "key", "left_semi"), "open-buckets")
        scratch.drop(now, named)
        now = after
        if now.isEmpty():
            return of


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, text_key, set_id, n_shingles, component_id, kept.

    Texts whose sets of shingles have a similarity of 4/5 or more are linked; component_id is the smallest doc_id that links reach (null only if all are), whose row is kept. A text of fewer words than
    a shingle has its words as one; texts without words (null, empty) have no shingle, are linked with nothing, equal ones neither, and stay. Rows equal in doc_id and text are kept or dropped
    together. An empty table gives an empty result; other columns aren't read. Texts go through whole."""
    scratch = Scratch(df.sparkSession, "minhash")
    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    docs = scratch.save(rows.mapInArrow(_set_rows(words), _DOCS), "sets")
    own = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("text_key"))
    some = docs.filter("n > 0").drop("none")
    each = ("n", "sketches", "b0", "b1", "b2", "parity")
    sets = scratch.save(some.groupBy("set_id").agg(F.min(own).alias("keep"), *(F.any_value(c).alias(c) for c in each)), "distinct")
    of = groups(sets, some, rows, words, scratch)
    rooted = scratch.save(sets.select("set_id", "keep").join(of, sets["set_id"] == of["node"], "left").select("set_id", F.coalesce("root", "set_id").alias("root"), "keep"), "rooted")
    keep = rooted.groupBy("root").agg(F.min("keep").alias("group_keep"))
    group = scratch.save(rooted.join(keep, "root").select("set_id", "group_keep"), "keepers")
    columns = ("doc_id", "text_key", "set_id", F.col("n").cast("long").alias("n_shingles"))
    told = some.join(group, "set_id").select(*columns, F.col("group_keep.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("group_keep.doc_id")) & (F.col("text_key") == F.col("group_keep.text_key"))).alias("kept"))
    return told.unionByName(docs.filter("n = 0").select(*columns, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
