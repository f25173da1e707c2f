"""Exact de-duplication over an extendible-hash index kept as shared files. DataFrame functions only.

1. A text is reduced to its bytes without white space and hashed to a 64-bit key.
2. Equal texts are gathered by key *and bytes*: Spark's aggregation compares the bytes of texts that share a key, so two
   texts with colliding keys become two entries in the chain of that key. Copies are combined before the shuffle: a group
   holding a third of all rows arrives as one row per map task.
3. The directory starts at a small depth. Buckets with more than ``bucket_entries`` entries are split by one more bit of
   the key, again and again (directory doubling), until they fit. Bucket ids are key ranges: each owner task writes the
   entries of the buckets in its range, sorted, as one index file.
4. Every document finds its bucket in the directory, as its entry did, and looks its entry up by bucket, key and digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.shared import shared_table

MAX_DEPTH = 40


def normalised(text: Column) -> Column:
    """The text without characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _bits(key: Column, depth: Column | int) -> Column:
    """The leading bits of the key, as a number."""
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).bitwiseAND(F.lit((1 << MAX_DEPTH) - 1)) if depth == MAX_DEPTH else F.floor(
        _bits(key, MAX_DEPTH) / F.pow(F.lit(2.0), MAX_DEPTH - depth)).cast("long")


def directory(entries: DataFrame, bucket_entries: int, first_depth: int = 6, step: int = 2) -> DataFrame:
    """Splits overfull buckets until none is overfull: one row (depth, prefix, entries_in_bucket) per bucket.

    Buckets that fit are final; only the overfull ones go through the next doubling. ``step`` bits are taken per round.
    The counts come from keys alone, so one key with many texts (a chain) stops at the last depth.
    """
    depth, done = first_depth, None
    open_keys = entries.select("key")
    while True:
        counted = shared_table(open_keys.groupBy(_bits(F.col("key"), depth).alias("prefix")).agg(F.count("*").alias("entries_in_bucket")), "directory")
        fits = counted if depth >= MAX_DEPTH else counted.where(F.col("entries_in_bucket") <= bucket_entries)
        buckets = fits.select(F.lit(depth).alias("depth"), "prefix", "entries_in_bucket")
        done = buckets if done is None else done.unionByName(buckets)
        over = counted.where(F.col("entries_in_bucket") > bucket_entries).select("prefix")
        if depth >= MAX_DEPTH or over.isEmpty():
            return done
        open_keys = open_keys.withColumn("prefix", _bits(F.col("key"), depth)).join(over, "prefix", "left_semi").select("key")
        depth = min(depth + step, MAX_DEPTH)


def in_buckets(rows: DataFrame, buckets: DataFrame, depths: list[int]) -> DataFrame:
    """Adds ``bucket``, the first key bits of the bucket that holds the row's key.

    A row asks once per depth that occurs in the directory (one or two for evenly hashed keys) and exactly one answers.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _bits(F.col("key"), d).alias("prefix")) for d in depths])).alias("asked")
    known = buckets.select(F.struct("depth", "prefix").alias("asked"))
    start = (F.col("asked.prefix") * F.pow(F.lit(2.0), F.lit(MAX_DEPTH) - F.col("asked.depth"))).cast("long")
    return rows.select("*", asked).join(known, "asked").withColumn("bucket", start).drop("asked")


def build_index(documents: DataFrame, bucket_entries: int = 200_000) -> DataFrame:
    """The index: one entry per distinct normalised text.

    Columns: bucket (key range), key, chain (place among the entries of the key, from 0), digest (SHA-256 of the
    normalised text), group_size, keep_id and keep_size (the row that stays: most code points in the original text, then
    smallest doc_id; a null doc_id comes last).
    """
    return index_and_directory(documents, bucket_entries)[0]


def index_and_directory(documents: DataFrame, bucket_entries: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """``build_index`` with its directory and the depths that occur there (one at least)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = documents.select("doc_id", F.char_length(text).cast("long").alias("size"), normalised(F.col("text")).alias("plain"))
    # one number that orders rows by size, then by doc_id downwards; null doc_id below all others
    most, scale = F.lit(9223372036854775807).cast("decimal(20,0)"), F.lit("20000000000000000000").cast("decimal(20,0)")
    place = F.coalesce(most - F.col("doc_id").cast("decimal(20,0)") + 1, F.lit(0).cast("decimal(20,0)"))
    best = (F.col("size").cast("decimal(12,0)") * scale + place).cast("decimal(38,0)")
    gathered = (
        plain.select(F.xxhash64("plain").alias("key"), "plain", best.alias("best"))
        .groupBy("key", "plain").agg(F.max("best").alias("best"), F.count("*").alias("group_size"))
    )
    rest = F.col("best") % scale
    entries = shared_table(gathered.select(
        "key", F.unhex(F.sha2(F.col("plain"), 256)).alias("digest"), "group_size",
        F.when(rest > 0, (most + 1 - rest).cast("long")).alias("keep_id"), F.floor(F.col("best") / scale).cast("long").alias("keep_size"),
    ), "entries")
    buckets = directory(entries, bucket_entries)
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().limit(MAX_DEPTH).collect()) or [MAX_DEPTH]
    # an owner task holds whole key ranges, so a chain lies in one task and needs no further shuffle
    owned = in_buckets(entries, buckets, depths).repartitionByRange("bucket", "key")
    chain = (F.row_number().over(W.partitionBy("bucket", "key").orderBy("digest")) - 1).alias("chain")
    return shared_table(owned.select("bucket", "key", chain, "digest", "group_size", "keep_id", "keep_size"), "index"), buckets, depths


def exact_dedup(documents: DataFrame, bucket_entries: int = 200_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after removing white space of ``[\\x20\\x09-\\x0D]``; null counts as empty, and
    all empty texts form one group. Of equal texts the row with the most code points stays, then the smallest doc_id.
    Where the very row that stays occurs twice with the same doc_id and size, all its repeats are ``kept``. A group whose
    only doc_ids are null has keep_id null and keeps its longest rows. An empty table gives no rows; other columns are
    ignored.
    """
    index, buckets, depths = index_and_directory(documents, bucket_entries)
    text = F.coalesce(F.col("text"), F.lit(""))
    looked = documents.select("doc_id", F.char_length(text).cast("long").alias("n_points"), normalised(F.col("text")).alias("plain")).select(
        "doc_id", "n_points", F.xxhash64("plain").alias("key"), F.unhex(F.sha2(F.col("plain"), 256)).alias("digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_size"))
    return in_buckets(looked, buckets, depths).join(index, ["bucket", "key", "digest"]).select(
        "doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
