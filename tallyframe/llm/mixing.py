"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import BROADCAST_ROWS, BUCKET_ROWS, WORD, bucket_of, materialize, numbered, running_before, seeded, unused

WEIGHTS = (5, 2, 1)
#: Sources that a mixture may name: their table is collected and broadcast.
MAX_SOURCES = BROADCAST_ROWS


def water_fill(sizes: list[int], weights: list[float], total: int, max_epochs: int) -> list[float]:
    """Targets that share ``total`` by weight, none above ``max_epochs`` times its size.

    Clamp every source above its cap, share what is left by weight among the
    others, and repeat until no source is above.
    """
    caps = [max_epochs * s for s in sizes]
    capped = [False] * len(sizes)
    while True:
        left = total - sum(c for c, k in zip(caps, capped) if k)
        free = sum(w for w, k in zip(weights, capped) if not k)
        level = left / free if free else 0.0
        over = [i for i, k in enumerate(capped) if not k and level * weights[i] > caps[i]]
        if not over:
            return [float(c) if k else level * w for c, w, k in zip(caps, weights, capped)]
        for i in over:
            capped[i] = True


def cyclic_weights(sources: list) -> list[float]:
    """Weights 5, 2, 1, 5, 2, 1 ... for sources in code-point order, null last."""
    return [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))]


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _order(seed: int, id_col: str, text_col: str) -> Column:
    """The seeded place of a row within its source, by id and text."""
    return seeded(seed, F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def mix(docs: DataFrame, weights: Callable[[list], list[float]] = cyclic_weights, max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Plan a mixture of ``docs``: ``(rows, plan)``.

    ``rows`` has one row per document: ``doc_id, source, size, source_size,
    target, repeats, extra``: the mix takes ``repeats`` whole copies of the
    document and ``extra`` further words of it. ``plan`` has one row per
    source and lets :func:`apply_mix` decide each document from its own row,
    so no join on ids moves the texts. Size is the number of words; null text
    has none. Equal runs give equal results: the seeded order depends on ids
    and texts alone, not on partitions.

    The whole part of target / source size is taken as whole epochs. The
    fractional epoch is a seeded sample: documents in hash order up to the
    word where the target is reached; one document per source is cut there.

    Edge cases: null is a source of its own and comes last; a source without
    words gets target 0; ids that repeat or are null are told apart by their texts;
    rows that repeat both are interchangeable, and as many of them are taken as the
    target needs; an empty table gives empty frames; extra columns, whatever their
    names, take no part. More than ``MAX_SOURCES`` sources are refused.

    The table of sources is the mixture's configuration (weights are given
    per source on the driver) and is the only thing collected. Within a
    source, cumulative sizes come from buckets of the seeded hash of about
    500 rows, so a source with a third of all rows is many small buckets, whose
    sums are added up in two levels.
    """
    spark = docs.sparkSession
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _source_key(F.col(source_col)).alias("sk"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _order(seed, id_col, text_col).alias("h"),
    )
    thin = materialize(d, "mix-sizes")
    sources = materialize(thin.groupBy("source", "sk").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")), "mix-sources")
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"a mixture is configured for {MAX_SOURCES} sources at most")
    found = sorted(sources.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["s"] for r in found]
    targets = water_fill(sizes, weights([r["source"] for r in found]), sum(sizes), max_epochs)
    plan = []
    for r, t in zip(found, targets):
        whole = min(int(t // r["s"]), max_epochs) if r["s"] else 0
        plan.append((r["sk"], r["s"], float(t), whole, max(0, round(t) - whole * r["s"]), -(-r["n"] // BUCKET_ROWS)))
    plan = spark.createDataFrame(plan, "sk string, source_size long, target double, repeats long, fraction long, nb long")
    rows = thin.join(F.broadcast(plan), "sk").withColumn("b", bucket_of(F.col("h"), F.col("nb")))
    # the bucket of each source in which the fractional epoch ends, then the rows of one id and text in it
    sums = rows.groupBy("sk", "b").agg(F.sum("size").alias("in_b"), F.max("fraction").alias("fraction"))
    last = running_before(sums, ["sk"], ["b"], "in_b").filter("before < fraction and fraction <= before + in_b").select("sk", "b", "before")
    inner = rows.join(F.broadcast(last), ["sk", "b"])  # one row per source at most
    inner = inner.groupBy("sk", "before", "fraction", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    run = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("sk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    inner = inner.withColumn("cum", F.col("before") + F.coalesce(run, F.lit(0)))
    ends = inner.filter("cum < fraction and fraction <= cum + size * n")
    ends = ends.select("sk", F.col("h").alias("end_h"), F.col("doc_id").alias("end_id"), (F.col("fraction") - F.col("cum")).alias("end_words"), F.col("size").alias("end_size"), F.col("n").alias("end_n"))
    plan = materialize(plan.join(F.broadcast(materialize(ends, "mix-ends")), "sk", "left").drop("nb"), "mix-plan")
    taken = thin.join(F.broadcast(plan), "sk").withColumn("place", _place(F.col("h"), F.col("doc_id")))
    cut = F.least(F.col("end_words"), F.col("size"))
    extra = F.when(F.col("place") < 0, F.col("size")).when(F.col("place") == 0, cut).otherwise(0)
    out = taken.withColumn("extra", extra.cast("long"))
    tied = F.coalesce((F.col("place") == 0) & (F.col("end_n") > 1), F.lit(False))
    if plan.filter("end_n > 1").count():
        share = F.greatest(F.lit(0), F.least(F.col("size"), F.col("end_words") - F.col("k") * F.col("size")))
        out = out.filter(~tied).unionByName(numbered(taken.filter(tied), ["sk"], "k").withColumn("extra", share.cast("long")).drop("k"))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", "extra"), plan


def _place(h: Column, id_col: Column, prefix: str = "") -> Column:
    """-1: the row comes before the end of its source's fractional epoch, 0: at it, 1: after it."""
    end_h, end_id = F.col(f"{prefix}end_h"), F.col(f"{prefix}end_id")
    # null ids sort first, as in the window
    earlier = (h < end_h) | ((h == end_h) & F.when(id_col.isNull(), end_id.isNotNull()).otherwise(F.coalesce(id_col < end_id, F.lit(False))))
    return F.when(end_h.isNull(), 1).when((h == end_h) & id_col.eqNullSafe(end_id), 0).when(earlier, -1).otherwise(1)


def apply_mix(docs: DataFrame, plan: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` repeated as planned, with their own columns only.

    The one document per source that the fractional epoch cuts is taken whole
    if at least half of it is wanted; of rows that repeat its id and text, as many
    as the wanted words make, rounded. Only these rows are ever moved. Nulls,
    repeated rows and clashing names are as in :func:`mix`; an empty table gives
    an empty result.
    """
    cols = docs.columns
    # a suffix that no column of the input has
    key, h, place, copies = unused(docs, "__mix_sk", "__mix_h", "__mix_place", "__mix_copies")
    prefix = unused(docs, "__mix_plan")[0] + "_"
    while any(c.lower().startswith(prefix) for c in cols):
        prefix += "_"
    p = F.broadcast(plan.select(*[F.col(c).alias(key if c == "sk" else prefix + c) for c in plan.columns]))
    end = lambda c: F.col(f"{prefix}end_{c}")
    d = docs.withColumns({key: _source_key(F.col(source_col)), h: _order(seed, id_col, text_col)}).join(p, key)
    d = d.withColumn(place, _place(F.col(h), F.col(id_col), prefix))
    more = F.when(F.col(place) < 0, 1).when((F.col(place) == 0) & (2 * end("words") >= end("size")), 1).otherwise(0)
    out = d.withColumn(copies, F.col(f"{prefix}repeats") + more)
    if plan.filter("end_n > 1").count():
        tied = F.coalesce((F.col(place) == 0) & (end("n") > 1), F.lit(False))
        k = unused(out, "__mix_k")[0]
        some = numbered(d.filter(tied), [key], k)
        more = F.when(F.col(k) < F.round(end("words") / F.greatest(end("size"), F.lit(1))), 1).otherwise(0)
        out = out.filter(~tied).unionByName(some.withColumn(copies, F.col(f"{prefix}repeats") + more).drop(k))
    out = out.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long"))))
    return out.select(*cols)
