"""Exact deduplication by block naming, with DataFrame functions only.

Each normalised text is cut into blocks of fixed size. The distinct blocks are sorted and take integer
names; then adjacent pairs of names are named in the same way, level by level, until each document
has a single name. Two texts share (level, name) exactly if they are equal: no name rests on a hash.

The block contents are shuffled once, to find the distinct ones. Names travel back to the documents
by a 64-bit hash of the block; the names table itself shows which hashes stand for one block
only. Blocks behind any other hash are named and joined by their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, drop_rows, lower_ascii, text_key

BLOCK_BYTES = 8192


def _blocks(text: Column, size: int) -> Column:
    raw = text.cast("binary")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(text) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, *by: str) -> DataFrame:
    """Integer names in the order of each partition; the caller saves them before anything reads them."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id() * 2)


def block_names(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, block_bytes: int, hash_mask: int) -> tuple[DataFrame, DataFrame]:
    """(rows, ids): rows has rid, doc_id, text_key and sha of each input row; ids has rid, level and name."""
    text = lower_ascii(F.coalesce(df[text_col], F.lit("")))
    hashed = lambda block: F.xxhash64(block).bitwiseAND(F.lit(hash_mask))

    distinct = df.select(F.explode(_blocks(text, block_bytes)).alias("block")).distinct()
    names = scratch.save(_named(distinct, "block").select(hashed(F.col("block")).alias("h"), "name"), "block-names")
    by_hash = names.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    clash = by_hash.filter("n > 1").select("h")
    clashes = not clash.isEmpty()

    base = df.select(F.monotonically_increasing_id().alias("rid"), df[id_col].alias("doc_id"), text_key(df[text_col]).alias("text_key"), text.alias("t"))
    base = base.select("rid", "doc_id", "text_key", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), _blocks(F.col("t"), block_bytes).alias("blocks"))
    if not clashes:
        rows = scratch.save(base.select("rid", "doc_id", "text_key", "sha", F.transform("blocks", hashed).alias("hs")), "rows")
        cut = rows.select("rid", F.size("hs").alias("nb"), F.posexplode("hs").alias("i", "h"))
        level = cut.join(scratch.save(by_hash.select("h", "name"), "names-by-hash"), "h").select("rid", "nb", "i", "name")
    else:
        rows = scratch.save(base.select("rid", "doc_id", "text_key", "sha", F.transform("blocks", lambda b: F.struct(hashed(b).alias("h"), b.alias("b"))).alias("hs")), "rows")
        cut = rows.select("rid", F.size("hs").alias("nb"), F.posexplode("hs").alias("i", "x")).select("rid", "nb", "i", "x.h", "x.b")
        shared = cut.join(clash, "h")
        content = scratch.save(_named(shared.select("b").distinct(), "b").withColumn("name", F.col("name") + 1), "names-by-content")
        one = scratch.save(by_hash.filter("n = 1").select("h", "name"), "names-by-hash")
        level = cut.join(one, "h").select("rid", "nb", "i", "name").unionByName(shared.join(content, "b").select("rid", "nb", "i", "name"))
    level = scratch.save(level, "level-0")

    done, k = [level.filter("nb = 1").select("rid", F.lit(0).alias("level"), "name")], 0
    most = level.agg(F.max("nb")).first()[0] or 0
    level = level.filter("nb > 1")
    while (1 << k) < most:
        k += 1
        even = F.col("i") % 2 == 0
        pairs = level.groupBy("rid", "nb", F.floor(F.col("i") / 2).cast("int").alias("j")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = scratch.save(pairs, f"pairs-{k}")
        names = scratch.save(_named(pairs.select("a", "b").distinct(), "a", "b"), f"pair-names-{k}")
        level = scratch.save(pairs.join(names, ["a", "b"]).select("rid", "nb", F.col("j").alias("i"), "name"), f"level-{k}")
        done.append(level.filter(F.col("nb") <= (1 << k)).select("rid", F.lit(k).alias("level"), "name"))
        level = level.filter(F.col("nb") > (1 << k))
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return rows.select("rid", "doc_id", "text_key", "sha"), ids


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_mask: int = -1) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    doc_id stays. Null texts count as empty and are one group. A null doc_id is the smallest, so it
    stays only where its whole group has none (keep_id is then null). Of rows equal in text
    and doc_id just one has kept = true. An empty table gives an empty result; other columns are ignored.
    ``hash_mask`` shortens the hash by which names are looked up; the result doesn't depend on it."""
    return _groups(df, Scratch(df.sparkSession, "exact-dedup"), id_col, text_col, block_bytes, hash_mask).drop("text_key")


def _groups(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, block_bytes: int, hash_mask: int) -> DataFrame:
    rows, ids = block_names(df, scratch, id_col, text_col, block_bytes, hash_mask)
    told = scratch.save(rows.join(ids, "rid"), "identities")
    keep = told.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    keep = scratch.save(keep, "groups")
    return told.join(keep, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "text_key"
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input without the rows that exact_groups drops; all columns stay, under whatever names.

    Null texts count as empty; of texts that are equal but for the case of A-Z, that of the largest doc_id stays. Rows are found again by doc_id and a
    hash of their text; of rows repeated as a whole one stays. An empty table gives an empty result."""
    scratch = Scratch(df.sparkSession, "exact-dedup")
    groups = _groups(df, scratch, id_col, text_col, block_bytes, -1)
    out = drop_rows(df, id_col, text_key(df[text_col]), groups.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "kept"), Scratch(df.sparkSession, "exact-dedup-filter"))
    scratch.close()
    return out
