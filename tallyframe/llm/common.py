"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.session import materialize  # noqa: F401  (used by the operators)

#: A side is broadcast only when its counted rows stay below this bound; thin
#: rows of at most ~64 bytes make that about 12 MB. Beyond it the same join
#: runs as a shuffle join.
BROADCAST_ROWS = 200_000
#: Rows a bucket of a bucketed ordering should hold on average.
BUCKET_ROWS = 500
#: Arrow batches are cut to this many rows so that long texts stay bounded.
ARROW_ROWS = 500
#: And to this many bytes, so that a few very long texts are a batch of their own.
ARROW_BYTES = 4 << 20

#: Word characters: everything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the rows and bytes of an Arrow batch, so a worker holds few whole texts at once.

    These are settings of the session, which Spark reads when the query runs: they stay lowered.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_or_shuffled(small: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a materialised frame for broadcast if its counted rows are within the bound."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def hot_size(groups: DataFrame, size: str) -> int:
    """A size (a power of two, 256 at least) that at most ``BROADCAST_ROWS`` rows of ``groups`` exceed.

    Decided from a histogram over the binary logarithm of the size: 64 rows at most reach the driver.
    """
    found = groups.filter(F.col(size) > 256).groupBy(F.floor(F.log2(F.col(size))).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    above, least = 0, 256
    for r in sorted(found, key=lambda r: -r["k"]):
        above += r["n"]
        if above > BROADCAST_ROWS:
            return 2 ** (r["k"] + 1)
    return least


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with the one row that the materialised ``groups`` hold per key.

    ``size`` is the column of ``groups`` that says how many rows share the
    key. If all groups are few they are broadcast. Otherwise only the hot
    ones are, as many as the bound allows, and the rest meets by a shuffle in
    which no key has more rows than the hot ones: a group with a third of all
    rows never lands in one task.
    """
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, how)
    least = hot_size(groups, size)
    key = [key] if isinstance(key, str) else key
    hot, rest = F.broadcast(groups.filter(F.col(size) >= least)), groups.filter(F.col(size) < least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(rest, key, how))


def drop_rows(df: DataFrame, drops: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys (null-safe) are not in the materialised frame ``drops``."""
    right = small_or_shuffled(drops.select(*[F.col(k).alias(f"__drop_{k}") for k in keys]))
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(right[f"__drop_{k}"])
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left_anti")


def keep_marked(docs: DataFrame, marked: DataFrame, keys: list[str], drops: DataFrame, repeats: DataFrame) -> DataFrame:
    """``docs`` without the rows named by ``drops``, and one row of each key in ``repeats``.

    ``marked`` is ``docs`` with the key columns ``keys`` added; both other
    frames hold these keys and are materialised. Rows with equal keys are
    equal in id and text. The texts are shuffled only where the named rows are
    too many to be broadcast.
    """
    rest = drop_rows(marked, drops, keys)
    if (n := repeats.count()):
        mine = small_or_shuffled(repeats.select(*[F.col(k).alias(f"__same_{k}") for k in keys]), n)
        same = None
        for k in keys:
            c = rest[k].eqNullSafe(mine[f"__same_{k}"])
            same = c if same is None else same & c
        once = rest.join(mine, same, "left_semi").dropDuplicates(keys)
        rest = drop_rows(rest, repeats, keys).unionByName(once)
    return rest.select(*docs.columns)


def seeded(seed: int, *parts: Column) -> Column:
    """A 60-bit non-negative pseudo-random long decided by seed and parts alone (null part: 'null')."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bucket_of(h: Column, buckets: Column) -> Column:
    """Bucket 0..buckets-1, monotone in the 60-bit value ``h``."""
    return F.least(F.floor(h.cast("double") / F.lit(float(2**60)) * buckets), buckets - 1).cast("long")


def running_before(df: DataFrame, keys: list[str], index: list[str], value: str, width: int = 1000) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same keys that come earlier by ``index``.

    The first column of ``index`` is a bucket number. Sums go in two levels, so that
    a task sees the buckets of one stretch of ``width``, or one sum per stretch.
    No key may be null.
    """
    d = df.withColumn("__top", F.floor(F.col(index[0]) / width))
    tops = d.groupBy(*keys, "__top").agg(F.sum(value).alias("__sum"))
    tops = tops.withColumn("__over", F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__top")) - F.col("__sum")).drop("__sum")
    under = F.sum(value).over(Window.partitionBy(*keys, "__top").orderBy(*index).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("before", F.coalesce(under, F.lit(0))).join(tops, [*keys, "__top"])
    return d.withColumn("before", F.col("before") + F.col("__over")).drop("__top", "__over")


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Written ``rows`` with ``name``: 0, 1, 2 ... within rows of the same (not null) keys, in no fixed order.

    Rows are counted within the tasks that read them first, so a key that
    holds most rows is spread over as many tasks as before.
    """
    pid, row, before = unused(rows, "__pid", "__row", "__before")
    d = materialize(rows.withColumns({pid: F.spark_partition_id().cast("long"), row: F.monotonically_increasing_id()}), "numbered")
    counts = running_before(d.groupBy(*keys, pid).agg(F.count(F.lit(1)).alias("__n")), keys, [pid], "__n").withColumnRenamed("before", before).drop("__n")
    local = F.row_number().over(Window.partitionBy(*keys, pid).orderBy(row)) - 1
    return d.withColumn(name, local).join(counts, [*keys, pid]).withColumn(name, F.col(name) + F.col(before)).drop(pid, row, before)
