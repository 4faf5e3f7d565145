"""Exact dedup: group by 128-bit content hash, keep one stable id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import join_groups, keep_marked, materialize, small_or_shuffled, unused


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 text."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Decide for every row of ``docs`` which row of its group of equal texts stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``. Texts are equal when their UTF-8 bytes are; null counts as
    the empty text. ``keep`` says whether the largest or smallest id stays.
    Extra columns, whatever their names, take no part.

    Edge cases: a null id never wins over an id, and stays only in a group
    without ids; rows that repeat both id and text each get a row with the
    same decision; an empty table gives an empty result.

    Plan: one scan writes the thin digests (id, hash, SHA-256). The hash
    groups are counted with map-side combine, so a group holding a third of
    all rows is one row per task. Only groups with two or more rows are
    checked byte by byte: their texts meet in ``min``/``max``, again combined
    before the shuffle. The counts come back by a join in which large groups
    are broadcast, so their rows are never gathered. Should two texts ever share a hash, the rows of that
    hash are grouped by the text itself.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    d = d.withColumn("__h", hash_of(F.col("__t")))
    digests = materialize(d.select("doc_id", "__h", F.sha2("__t", 256).alias("text_sha256")), "digests")
    best = F.max if keep == "max" else F.min
    group = [best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    many = materialize(digests.groupBy("__h").agg(*group).filter("group_size > 1"), "copies")
    n = many.count()
    collided = None
    if n:
        members = d.join(small_or_shuffled(many.select("__h"), n), "__h", "left_semi")
        odd = materialize(members.groupBy("__h").agg(F.min("__t").alias("a"), F.max("__t").alias("b")).filter("a <> b").select("__h"), "collisions")
        if (n_odd := odd.count()):
            collided = small_or_shuffled(odd, n_odd)
    out = digests if collided is None else digests.join(collided, "__h", "left_anti")
    out = _decide(join_groups(out, many, "__h", "group_size", "left"))
    if collided is not None:
        rows = d.join(collided, "__h", "left_semi")
        by_text = rows.groupBy("__t").agg(*group)
        rows = rows.select("doc_id", "__t", F.sha2("__t", 256).alias("text_sha256"))
        out = out.unionByName(_decide(rows.join(by_text, "__t", "left")))
    return out


def _decide(rows: DataFrame) -> DataFrame:
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` with one row of each group of equal texts, in its own columns.

    Rows that repeat both id and text become one. The texts are shuffled only
    where the dropped rows are too many to be broadcast.
    """
    decided = materialize(exact_dedup(docs, id_col, text_col, keep), "decisions")
    keys = unused(docs, "__id", "__sha")
    named = [F.col("doc_id").alias(keys[0]), F.col("text_sha256").alias(keys[1])]
    marked = docs.withColumns({keys[0]: F.col(id_col), keys[1]: F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
    drops = materialize(decided.filter("not kept").select(*named), "drops")
    twice = decided.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keep_marked(docs, marked, keys, drops, materialize(twice.select(*named), "repeats"))
