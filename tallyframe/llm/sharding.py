"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import BUCKET_ROWS, bucket_of, join_groups, materialize, running_before, seeded, small_or_shuffled


def interleave(docs: DataFrame, shards: int = 8, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Place every row of ``docs`` in one of ``shards`` shards of near equal counts.

    Returns ``doc_id, source, size, text_crc32, shard, slot``. Rows of each
    source are shuffled by a seeded hash of the text and ranked; all rows are then sorted
    by (rank + 1/2) / source count, ties by source, and cut into shards whose
    counts are at most one apart. Each shard, and each stretch of one, so
    holds every source in its share of the whole. Size is the UTF-8 bytes of
    the text and one; a null text has no bytes and the checksum of none.

    Equal texts have the same hash, so those of one source have neighbouring ranks, and
    those of several sources nearly equal fractions: they share a shard
    except where a cut falls between them. A group larger than a shard can't.

    Edge cases: null is a source like any other; null and empty texts are equal;
    rows of one text are ordered by id (null first), and equal rows are
    interchangeable; with fewer rows than shards the later shards stay empty; an
    empty table gives an empty result; extra columns, whatever their names, take no part.

    Plan: no window spans a whole source, a group of equal texts or the table. Ranks within a
    source are local ranks within hash buckets of about 500 rows, plus the
    rows of the source's earlier buckets; the rows of a text that repeats more often
    than that, under several ids, follow its bucket in buckets of their own, dealt by a hash
    of the id. Rows equal in source, text and id are one counted unit until ranks are given out.
    The global order is bucketed by the fractional rank in the same way.
    Only (source, bucket, count) rows meet per source, in two levels.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("sk"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        seeded(seed, F.md5(text)).alias("h"), seeded(seed, F.col(id_col)).alias("hid"),
    )
    thin = materialize(d, "shard-rows")
    counts = materialize(thin.groupBy("sk").agg(F.count(F.lit(1)).alias("n_source")), "shard-sources")
    rows = thin.join(small_or_shuffled(counts), "sk")
    rows = rows.withColumn("b", bucket_of(F.col("h"), F.ceil(F.col("n_source") / BUCKET_ROWS)))
    # rows of one source, text and id are equal: they are counted as one and told apart at the end
    units = rows.groupBy("sk", "b", "h", "doc_id", "hid", "size", "text_crc32", "source", "n_source").agg(F.count(F.lit(1)).alias("n"))
    units = materialize(units, "shard-units")
    large = units.groupBy("sk", "h").agg(F.count(F.lit(1)).alias("n_units")).filter(F.col("n_units") > BUCKET_ROWS)
    large = materialize(large.select("sk", "h", "n_units", F.ceil(F.col("n_units") / BUCKET_ROWS).alias("subs")), "shard-texts")
    n_large = large.count()
    if n_large:
        units = join_groups(units, large, ["sk", "h"], "n_units", "left")
        units = units.withColumn("text", F.when(F.col("subs").isNotNull(), F.col("h")).otherwise(-1)).withColumn("sub", F.coalesce(bucket_of(F.col("hid"), F.col("subs")), F.lit(0)))
    else:
        units = units.withColumns({"text": F.lit(-1).cast("long"), "sub": F.lit(0).cast("long")})
    bucket = ["b", "text", "sub"]
    per = running_before(units.groupBy("sk", *bucket).agg(F.sum("n").alias("in_b")), ["sk"], bucket, "in_b").drop("in_b")
    local = F.sum("n").over(Window.partitionBy("sk", *bucket).orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    units = units.withColumn("local", F.coalesce(local, F.lit(0))).join(per, ["sk", *bucket]).withColumn("first", F.col("before") + F.col("local"))
    # a unit of several rows takes that many neighbouring ranks, a bucket's worth at a time
    last = F.col("first") + F.col("n") - 1
    parts = units.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BUCKET_ROWS}"))))
    if units.filter(F.col("n") > BUCKET_ROWS).take(1):
        parts = parts.repartition("h", "doc_id", "part")
    start = F.col("first") + F.col("part") * BUCKET_ROWS
    ranks = parts.withColumn("rank", F.explode(F.sequence(start, F.least(start + BUCKET_ROWS - 1, last))))
    ranks = ranks.withColumn("frac", (F.col("rank") + F.lit(0.5)) / F.col("n_source"))
    rows = materialize(ranks.select("doc_id", "source", "size", "text_crc32", "frac"), "shard-ranks")
    n = rows.count()
    k = max(1, -(-n // BUCKET_ROWS))
    rows = rows.withColumn("fb", F.least(F.floor(F.col("frac") * k), F.lit(k - 1)).cast("long"))
    per = running_before(rows.groupBy(F.lit(0).alias("all"), "fb").agg(F.count(F.lit(1)).alias("n")), ["all"], ["fb"], "n").select("fb", "before")
    place = F.row_number().over(Window.partitionBy("fb").orderBy("frac", "source"))
    rows = rows.withColumn("local", place).join(per, "fb")
    pos = F.col("before") + F.col("local") - 1
    rows = rows.withColumn("pos", pos).withColumn("shard", F.expr(f"cast((pos * {shards}L) div greatest({n}L, 1L) as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return rows.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("pos") - first).cast("long").alias("slot"))
