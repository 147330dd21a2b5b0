"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. A bucket sort names the blocks: the bucket is a 64-bit number computed
from the content, and contents that share a bucket are sorted and numbered inside it, so (bucket, number) is a name that two
different blocks never share. Then adjacent names are paired and the pairs are named in the same way, level by level, until one
name is left. Texts are equal exactly if their byte lengths and their last names are equal.

Whether a bucket holds several contents is looked up over all blocks and all pairs. With 64-bit buckets that happens a few times
in 10^10 blocks, if at all, so the numbers are joined in only where some exist; ``bucket_bits`` makes them frequent for tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import SPACE, bind, indices, packed
from barloom.session import stage, unstage

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Each run of white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _blocks(data: Column, size: int) -> Column:
    """The fixed-size blocks of a binary column; the empty text is one empty block."""
    return bind(data, lambda d: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.octet_length(d) - 1) / size), F.lit(0)).cast("int")),
        lambda i: F.substring(d, i * size + 1, F.lit(size))))


def _bucket(content: Column, bits: int) -> Column:
    return F.xxhash64(content) if bits >= 64 else F.pmod(F.xxhash64(content), F.lit(1 << bits))


def _numbers(contents: DataFrame) -> DataFrame | None:
    """(bucket, content, number) of the contents that share their bucket with another one; None if there are none.

    Contents are made distinct before the shuffle, so a block that a third of all texts holds is one row per task.
    """
    distinct = contents.select("bucket", "content").distinct()
    shared = stage(distinct.groupBy("bucket").count().filter("count > 1").select("bucket"), "buckets")
    if shared.isEmpty():
        return None
    return stage(distinct.join(shared, "bucket").withColumn(
        "number", F.row_number().over(Window.partitionBy("bucket").orderBy("content")) - 1), "numbers")


def _named(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (row_id, ..., contents) with the names of their contents: array of (bucket, number)."""
    keep = [c for c in rows.columns if c not in ("row_id", "contents", "buckets")]
    each = rows.select("row_id", F.posexplode(F.arrays_zip("buckets", "contents")).alias("at", "x")).select(
        "row_id", "at", F.col("x.buckets").alias("bucket"), F.col("x.contents").alias("content"))
    names = each.join(numbers, ["bucket", "content"], "left").groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("at", "bucket", F.coalesce("number", F.lit(0)).alias("number")))),
        lambda x: F.struct(x["bucket"].alias("bucket"), x["number"].alias("number"))).alias("names"))
    return rows.select("row_id", *keep).join(names, "row_id")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bits: int = 64) -> DataFrame:
    """One row per document: row_id, doc_id, n_bytes, text_sha256 and the name of its whole text (bucket, number).

    The result is a stored table. A document's blocks and names are arrays of its own row; only block contents (once, distinct)
    and pairs of names are shuffled.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    blocks = _blocks(F.col("text").cast("binary"), block_bytes)
    numbers = _numbers(text.select(F.explode(blocks).alias("content")).select(
        _bucket(F.col("content"), bucket_bits).alias("bucket"), "content"))
    facts = ["doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")]
    if numbers is None:
        rows = text.select(*facts, F.transform(blocks, lambda b: F.struct(
            _bucket(b, bucket_bits).alias("bucket"), F.lit(0).alias("number"))).alias("names"))
    else:
        rows = text.select(*facts, blocks.alias("contents")).withColumn(
            "buckets", F.transform("contents", lambda b: _bucket(b, bucket_bits)))
    rows = stage(rows.withColumn("row_id", F.monotonically_increasing_id()), "names")
    if numbers is not None:
        rows = stage(_named(rows, numbers), "names")
    depth = rows.agg(F.max(F.size("names"))).collect()[0][0] or 1
    while depth > 1:
        pairs = F.transform(indices(F.ceil(F.size("names") / 2)), lambda i: F.struct(
            F.get("names", i * 2).alias("left"), F.get("names", i * 2 + 1).alias("right")))
        several = F.size("contents") > 0
        paired = stage(rows.withColumn("contents", pairs).drop("names").withColumn(
            "buckets", F.transform("contents", lambda p: _bucket(p, bucket_bits))), "pairs")
        unstage(rows)
        numbers = _numbers(paired.filter(several).select(F.explode(F.arrays_zip("buckets", "contents")).alias("x")).select(
            F.col("x.buckets").alias("bucket"), F.col("x.contents").alias("content")))
        if numbers is None:
            rows = paired.withColumn("names", F.transform("buckets", lambda b: F.struct(
                b.alias("bucket"), F.lit(0).alias("number")))).drop("contents", "buckets")
        else:
            rows = stage(_named(paired, numbers), "names")
        depth = (depth + 1) // 2
    return stage(rows.select("row_id", "doc_id", "n_bytes", "text_sha256", F.col("names")[0]["bucket"].alias("bucket"),
                             F.col("names")[0]["number"].alias("number")), "identities")


def copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bits: int = 64) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays (nulls last); of repeated rows with that doc_id one row stays. Null texts equal
    empty ones. Both sides of the last join are stored tables, so that Spark can split the rows of a huge group of copies.
    """
    rows = identities(docs, block_bytes, bucket_bits)
    key = ["n_bytes", "bucket", "number"]
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    groups = stage(rows.groupBy(*key).agg(F.min(first).alias("first"), F.count("*").alias("group_size")).filter(
        "group_size > 1"), "groups")
    return rows.join(groups, key, "left").select(
        "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.row_id") == F.col("row_id"))).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; repeated rows leave one row."""
    kept = copies(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("sha"))
    stay = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    one = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.xxhash64("row")))
    return stay.withColumn("nth", one).filter("nth = 1").select("row.*")
