"""Near copies: SimHash links, verified by the similarity of word shingles, and then all that fingerprints miss.

Two texts are linked if their sets of word shingles have a Jaccard similarity of 4/5 or more. Fingerprints of these shingles find the closest copies (simhash.py: generalised
pigeonhole, probe and verify), but not all: at 0.8 the expected distance is about 10 of 64 bits, which no pigeonhole index affords. The rest comes from a prefix filter, which
loses none: under any order of the shingles, two sets that are similar enough share one of their first n - ceil(4n/5) + 1. Shingles that a sample
shows to be frequent come last in the order; the sample decides the cost only.

Only groups matter, so texts with close fingerprints are compared first, and texts that share a shingle with one of them each; then all pairs that
aren't in one group yet and whose shingles before the shared one, as far as any other text has them, leave room for enough. Each pair is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import simhash
from folioscope.llm.components import components
from folioscope.llm.shared import BROADCAST_KEYS, Scratch, drop_rows, text_batches, text_bytes, text_key
from folioscope.llm.simhash import majority

WORDS = 5
#: One in so many sets is sampled for frequent shingles; at most so many are told to tasks.
SAMPLE, FREQUENT = 16, 100_000


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, in order. A text of fewer words (none too) is one shingle."""
    import xxhash

    digest, own = xxhash.xxh64_intdigest, text.lower().split()
    if len(own) <= words:
        return np.array([digest(b" ".join(own), 42)], np.uint64).view(np.int64)
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = [0, *ends[: len(own) - words].tolist()]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64).view(np.int64))


def _set_rows(words: int, frequent: np.ndarray, ranks: np.ndarray):
    """Columns doc_id, text_key, text -> the name, size, fingerprint and prefix of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_batches(batches, limit=1 << 20):
            sets = [shingle_set(t, words) for t in text_bytes(batch.column(2))]
            names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            counts, grams = np.array([len(s) for s in sets], np.int64), np.concatenate(sets)
            prints = majority(grams.view(np.uint64), counts).view(np.int64)
            owner, _, prefix = prefixes(grams, counts, frequent, ranks)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.bincount(owner, minlength=len(sets))]).astype(np.int32)), pa.array(prefix))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(counts.astype(np.int32)), pa.array(prints), lists], ["doc_id", "text_key", "set_id", "n", "fp", "prefix"])

    return run


def _gram_rows(words: int):
    """Columns set_id, text -> the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, limit=1 << 20):
            sets = [shingle_set(t, words) for t in text_bytes(batch.column(1))]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["set_id", "grams"])

    return run


def prefixes(grams: np.ndarray, counts: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of grams (counts: their lengths): run, place and gram of each one in a prefix. frequent: sorted, ranks: their places at the order's end, from 1."""
    owner = np.repeat(np.arange(len(counts)), counts)
    rank = np.zeros(len(grams), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        rank = np.where(frequent[at] == grams, ranks[at], 0)
    order = np.lexsort((grams, rank, owner))
    place = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = place < np.repeat(counts - (4 * counts + 4) // 5 + 1, counts)
    return owner[own], place[own], grams[order][own]


def verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar enough. Whole sets are made for texts that are in a pair only, one text for each set."""
    pairs = scratch.save(pairs, "pairs")
    ids = pairs.select(F.col("u").alias("set_id")).unionByName(pairs.select(F.col("v").alias("set_id"))).distinct()
    one = sets.select("set_id", F.struct("doc_id", "text_key").alias("k")).join(ids, "set_id", "left_semi").groupBy("set_id").agg(F.min("k").alias("k"))
    keys = scratch.save(one.select("set_id", F.col("k.doc_id").alias("i"), F.col("k.text_key").alias("t")), "keys")
    sent = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    texts = rows.join(sent, rows["doc_id"].eqNullSafe(keys["i"]) & (rows["text_key"] == keys["t"])).select("set_id", "text")
    whole = scratch.save(texts.mapInArrow(_gram_rows(words), "set_id long, grams array<long>"), "whole")
    both = pairs.join(whole.withColumnsRenamed({"set_id": "u", "grams": "a"}), "u").join(whole.withColumnsRenamed({"set_id": "v", "grams": "b"}), "v")
    links = scratch.save(both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v").distinct(), "similar")
    scratch.drop(pairs, keys, whole)
    return links


def close_prints(sets: DataFrame, scratch: Scratch, max_bits: int) -> DataFrame:
    """Pairs (u, v) of set_ids to verify: each set with one of its fingerprint, and these ones where fingerprints differ in at most max_bits bits."""
    prints = scratch.save(sets.groupBy("fp").agg(F.min("set_id").alias("one"), F.max("set_id").alias("other")), "prints")
    links = scratch.save(simhash.links(prints.select("fp"), simhash.make_plan(prints, max_bits), max_bits), "print-links")
    ends = links.join(prints.select(F.col("fp").alias("u"), F.col("one").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("one").alias("b")), "v")
    several = prints.filter("one <> other").select("fp", "one")
    own = sets.select("fp", "set_id").join(several, "fp").filter("set_id <> one").select(F.col("one").alias("a"), F.col("set_id").alias("b"))
    return ends.select("a", "b").unionByName(own).filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def links(sets: DataFrame, rows: DataFrame, words: int, scratch: Scratch, max_bits: int = simhash.MAX_BITS) -> DataFrame:
    """Links (u, v) between set_ids; all similar pairs are linked, directly or by way of others, and nothing else is.

    sets: doc_id, text_key, set_id, n, fp, prefix; rows: doc_id, text_key, text."""
    entries = sets.select("set_id", "n", F.posexplode("prefix").alias("place", "gram"))
    by_set = Window.partitionBy("set_id")
    # found by sums that are formed where entries arise, and a join that Spark can split: no task needs all sets of a shingle
    shared = scratch.save(entries.groupBy("gram").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).filter("a <> b").select("gram"), "shared")
    met = entries.join(shared, "gram").distinct()
    # only shingles that another set has too are left: how many of them come before this one in its set, and how many there are
    met = scratch.save(met.withColumns({"nth": F.row_number().over(by_set.orderBy("place")) - 1, "k": F.count(F.lit(1)).over(by_set)}), "met")

    columns = ("set_id", "n", "place", "nth", "root")
    other = lambda df: df.select("gram", *(F.col(c).alias(f"{c}_v") for c in columns))
    # what both sets can share at most: as many as either has met before this shingle, and as many as either has from it on
    may = 9 * (F.least("nth", "nth_v") + F.least(F.col("n") - F.col("place"), F.col("n_v") - F.col("place_v"))) >= 4 * (F.col("n") + F.col("n_v"))
    apart = (F.col("root") != F.col("root_v")) & may
    pair = (F.least("set_id", "set_id_v").alias("u"), F.greatest("set_id", "set_id_v").alias("v"), F.least("n", "n_v").alias("n"), F.greatest("n", "n_v").alias("m"))
    often = lambda pairs, enough: pairs.filter(apart).select(*pair).groupBy("u", "v", "n", "m").agg(F.count(F.lit(1)).alias("shared")).filter(enough).select("u", "v")
    # fingerprints, and all with one of them where they meet three times: that with the least of its own, for it is closest to most; then all that is left
    named = met.withColumn("root", F.col("set_id"))
    central = named.groupBy("gram").agg(F.max_by(F.struct(*columns), F.struct("k", "set_id")).alias("x")).select("gram", "x.*")
    stars = often(named.join(other(central), "gram"), F.col("shared") > 2)
    found = verified(close_prints(sets, scratch, max_bits).unionByName(stars).distinct(), sets, rows, words, scratch)
    of = scratch.save(components(found, scratch), "star-components")
    named = scratch.save(met.join(of, met["set_id"] == of["node"], "left").select("gram", "set_id", "n", "place", "nth", F.coalesce("root", "set_id").alias("root")), "named")
    several = named.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("gram")
    named = scratch.save(named.join(several, "gram", "left_semi"), "open")
    # of what both share, all up to the end of the prefix that ends first is in both prefixes; the rest of that set comes on top
    enough = 9 * (F.col("shared") + F.floor((4 * F.col("m") + 4) / 5) - 1) >= 4 * (F.col("n") + F.col("m"))
    more = verified(often(named.join(other(named), "gram").filter(F.col("set_id") < F.col("set_id_v")), enough), sets, rows, words, scratch)
    scratch.drop(shared, met, named)
    return found.unionByName(more)


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each group that links reach, that of the smallest doc_id; all columns stay, under whatever names. Texts without words (null, empty) are alike.

    A group's row has a null doc_id only if all have; of equal doc_ids the text of the smaller hash stays. Rows repeated as a whole (doc_id and text) leave one. An
    empty table gives an empty result."""
    scratch = Scratch(df.sparkSession, "similar")
    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    some = rows.filter(F.pmod("text_key", F.lit(SAMPLE)) == 0).select("text_key", "text")
    sample = some.mapInArrow(_gram_rows(words), "set_id long, grams array<long>").select(F.explode("grams").alias("gram")).groupBy("gram").count().filter("count > 2")
    often = sorted((r["gram"], FREQUENT - k) for k, r in enumerate(sample.orderBy(F.desc("count"), "gram").limit(FREQUENT).collect()))
    frequent, ranks = (np.array([x[k] for x in often], np.int64) for k in (0, 1))
    sets = scratch.save(rows.mapInArrow(_set_rows(words, frequent, ranks), "doc_id long, text_key long, set_id long, n int, fp long, prefix array<long>"), "sets")
    of = scratch.save(components(links(sets, rows, words, scratch), scratch), "components")
    own = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("text_key"))
    least = sets.groupBy("set_id").agg(F.min(own).alias("keep"))
    rooted = scratch.save(least.join(of, least["set_id"] == of["node"], "left").select("set_id", F.coalesce("root", "set_id").alias("root"), "keep"), "rooted")
    keep = rooted.groupBy("root").agg(F.min("keep").alias("group_keep"))
    told = sets.select("doc_id", "text_key", "set_id").join(rooted.join(keep, "root").select("set_id", "group_keep"), "set_id")
    kept = F.col("doc_id").eqNullSafe(F.col("group_keep.doc_id")) & (F.col("text_key") == F.col("group_keep.text_key"))
    out = drop_rows(df, id_col, text_key(df[text_col]), told.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), kept.alias("kept")), Scratch(df.sparkSession, "similar-filter"))
    scratch.close()
    return out
