"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters whole rows into buckets of about ``bucket_bytes`` by a seeded hash of id and text. Pass 2 takes each
bucket into memory, puts it in a fixed order and applies Fisher-Yates (Spark's seeded ``shuffle``), so the buckets
laid end to end are one random order of all rows. Shard s of n holds the places from s * rows // n up to
(s + 1) * rows // n of that order: counts are at most one apart, and a bucket spreads over few shards.

A bucket's first place is the sum of the sizes of the buckets before it; these sizes come from ids and texts alone,
one small row for each bucket. The number of partitions is fixed and buckets are sorted in their partition before
the random numbers are drawn, so a task that runs again draws the same ones.

Null ids and texts are values like others; rows that agree in id and text share a bucket. Columns keep their names in
the struct ``doc``; they must be of orderable types (no maps). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.tables import partitions, prepare, shared_folder

SHARDS = 40
SEED = 20240607
#: Bytes of text (and 16 for each row) that a bucket aims at; a bucket is held in memory whole.
BUCKET_BYTES = 16 << 20
#: Buckets for each shuffle partition, at least: their random numbers even out.
BUCKETS_A_TASK = 8


def sized(docs: DataFrame, text_col: str = "text"):
    return F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long") + 16


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (the row as given, as a struct), shard, slot (its place in the shard, from 0)."""
    spark = prepare(docs.sparkSession)
    total, rows = docs.agg(F.coalesce(F.sum(sized(docs, text_col)), F.lit(0)), F.count("*")).first()
    tasks = partitions(spark)
    buckets = max(BUCKETS_A_TASK * tasks, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]), F.lit(buckets)).cast("int").alias("bucket")

    sizes = docs.select(bucket).groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    scattered = docs.select(bucket, F.struct(docs[id_col], docs[text_col], F.struct("*").alias("doc")).alias("entry")).repartition(tasks, "bucket")
    gathered = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("entry")).alias("entries")).sortWithinPartitions("bucket")
    shuffled = gathered.select("bucket", F.shuffle("entries", seed).alias("entries"))
    dealt = shuffled.join(places, "bucket").select("first", F.posexplode("entries").alias("at", "entry"))
    place = F.col("first") + F.col("at")
    shard = F.expr(f"cast(((first + at + 1) * {shards} - 1) div {max(rows, 1)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {rows}) div {shards}")
    return dealt.select("entry.doc", place.alias("place"), shard.alias("shard")).select("doc", "shard", (F.col("place") - start).alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Write the shards, each to a folder of its own, and read them back."""
    shuffled.write.partitionBy("shard").mode("overwrite").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    written = write_shards(external_shuffle(docs, shards), f"{shared_folder(prepare(docs.sparkSession))}/shards")
    return written.select(
        "doc.doc_id", (F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("doc.text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
