"""Exact top-k inner product search over length buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, short_batches, small_or_shuffled

#: Candidates a slab (the unit of a task) holds on average, and queries in a block.
SLAB_ROWS = 2_048
QUERY_ROWS = 32_768
#: Candidates of one length bucket inside a slab.
BUCKET = 128
#: Local cosine threshold from which coordinates prune better than lengths.
COSINE = 0.2


def top_k(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int, floor: np.ndarray | None = None, counts: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and ids and scores of its ``k`` best candidates other than itself.

    ``(ids, integer vectors)`` each. Candidates are sorted by length and cut
    into buckets. With t the query's k-th best score so far, or the ``floor``
    (a score that ``k`` other candidates are known to reach; nan: none), a
    candidate of a bucket needs a cosine of at least t / (|q| * longest of
    the bucket). Over 1, no later bucket can hold one. High thresholds prune
    by coordinates: over the query's largest coordinates F, a candidate's
    product is at most that of F and of the lengths of what F leaves of both
    vectors. Low ones prune by length alone. What is left is verified by its
    integer product. ``counts`` gets how many products that were, of how many pairs.
    """
    qid, q = queries
    cid, c = candidates
    exact = float(max(1, np.abs(q).max(initial=0))) * float(max(1, np.abs(c).max(initial=0))) * max(1, q.shape[1]) < 2**52
    # integer products below 2^52 are exact in doubles; larger ones are made of Python integers
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    norm = np.sqrt((cf * cf).sum(1))
    order = np.lexsort((cid, -norm))
    cid, cf, norm = cid[order], cf[order], norm[order]
    big = None if exact else c[order].astype(object)
    by_axis = np.ascontiguousarray(cf.T)
    squares = by_axis * by_axis
    starts = list(range(0, len(cid), BUCKET))
    slack = 1e-9
    verified = 0
    for n in range(len(qid)):
        v = qf[n]
        length = float(np.sqrt(v @ v))
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object)
        least = -np.inf if floor is None or np.isnan(floor[n]) else float(floor[n])
        focus = np.argsort(-np.abs(v), kind="stable")[: -(-len(v) // 2)]
        left = float(np.sqrt(max(0.0, length * length - v[focus] @ v[focus]))) + slack * length
        for s in starts:
            e = min(s + BUCKET, len(cid))
            rows = np.arange(s, e)
            need = max(least, float(best[-1])) if len(best) >= k else least
            if need > 0 and length > 0:
                longest = norm[s]
                if longest * length * (1 + slack) < need:
                    break  # length pruning: all later buckets are shorter still
                if need / (length * longest) >= COSINE:
                    rest = np.sqrt(np.maximum(0.0, norm[s:e] ** 2 * (1 + slack) - squares[focus, s:e].sum(0)))
                    bound = v[focus] @ by_axis[focus, s:e] + left * rest
                else:
                    bound = norm[s:e] * length
                rows = s + np.flatnonzero(bound + slack * length * longest >= need)
                if not len(rows):
                    continue
            ids = cid[rows]
            verified += len(rows)
            scores = cf[rows] @ v if exact else np.array([int(x @ q[n].astype(object)) for x in big[rows]], object)
            own = ids != qid[n]
            best_id, best = np.concatenate([best_id, ids[own]]), np.concatenate([best, scores[own]])
            top = np.array(sorted(range(len(best)), key=lambda i: (-best[i], best_id[i]))[:k], int) if not exact else np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
        yield int(qid[n]), best_id, best
    if counts is not None:
        counts["verified"] = counts.get("verified", 0) + verified
        counts["pairs"] = counts.get("pairs", 0) + len(qid) * len(cid)


def quantize(vector: Column) -> Column:
    """floor(1024 * x) of every component as long; null unless all components are finite and fit."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * 1024))
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < 2.0**52))
    return F.when(F.coalesce(ok, F.lit(False)), x.cast("array<long>"))


def top_k_search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other rows by integer inner product.

    Queries are the rows for which ``is_query`` (over the input's columns)
    holds; candidates are all rows with another id. Ties go to the smaller id.

    Edge cases: vectors that are null, hold a null or non-finite component, or
    one beyond 2^52 in size, and rows without id, take no part; vectors of
    another dimension are not comparable and don't meet; rows repeated with
    one id count once each as candidates; a zero query scores all by id; an
    empty table gives an empty result. Scores beyond 64 bits are clamped.

    Plan: candidates are dealt to slabs of about 2,048 rows: bands of similar
    length, each split by a hash of the id, so equal or equally long vectors
    spread out. Queries form blocks of at most about 32,768. Each query first
    meets one slab of the longest vectors; the k-th score found there is its first
    threshold. It then goes only to slabs whose longest vector can reach that, and takes
    the threshold along. A pair of block and slab is one task's work and returns k
    rows a query at most; a window per query merges them. Nothing is broadcast
    but one thin row per slab, or collected.
    """
    short_batches(vectors.sparkSession, 4096)
    v = vectors.withColumn("__q", is_query).select(F.col(id_col).cast("long").alias("vec_id"), quantize(F.col(vec_col)).alias("v"), F.coalesce("__q", F.lit(False)).alias("is_query"))
    v = v.filter("vec_id is not null and v is not null").withColumn("dim", F.size("v"))
    v = v.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = materialize(v, "vectors")
    # bands of length in powers of 1.25
    v = v.withColumn("band", F.when(F.col("len2") <= 0, -1).otherwise(F.floor(F.log("len2") / (2 * F.log(F.lit(1.25))))).cast("int"))
    bands = v.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"), F.max("len2").alias("longest"))
    bands = materialize(bands.select("dim", "band", "longest", F.ceil(F.col("n") / SLAB_ROWS).alias("parts")), "bands")
    c = v.join(small_or_shuffled(bands), ["dim", "band"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    q = v.filter("is_query").select("vec_id", "v", "dim", "len2")
    blocks = max(1, -(-q.count() // QUERY_ROWS))
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    slabs = bands.select("dim", "band", "longest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    key = ["dim", "band", "part", "block"]
    c = c.select(*key, "vec_id", "v")
    # one slab of the longest band of each dimension, by a hash of the block
    first = bands.groupBy("dim").agg(F.max_by(F.struct("band", "parts"), "band").alias("first"))
    first = first.select("dim", F.col("first.band").alias("band"), F.col("first.parts").alias("parts"))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        dim = int(key[0].as_py())
        both = []
        for t in (left, right):
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if dim else np.zeros(0, np.int64)
            both.append((t.column("vec_id").to_numpy(), flat.reshape(t.num_rows, dim)))
        # the threshold as a double, rounded down: a score is pruned only if it is below
        floor = np.nextafter(left.column("least").cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype(float), -np.inf)
        out = list(top_k(both[0], both[1], k, floor))
        clamp = lambda s: max(-(2**63), min(2**63 - 1, int(s)))
        return pa.table({
            "query_id": pa.array([i for i, ids, _ in out for _ in ids], pa.int64()),
            "vec_id": pa.array([int(x) for _, ids, _ in out for x in ids], pa.int64()),
            "score": pa.array([clamp(s) for _, _, best in out for s in best], pa.int64()),
        })

    def meet(asked: DataFrame) -> DataFrame:
        asked = asked.select(*[F.col(x).alias(x) for x in (*key, "vec_id", "v", "least")])
        return asked.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")

    probe = q.join(F.broadcast(first), "dim").withColumns({"part": F.pmod(F.xxhash64("block"), F.col("parts")), "least": F.lit(None).cast("long")})
    probed = materialize(meet(probe), "probed")
    # clamped scores are no thresholds
    reached = probed.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    reached = reached.filter((F.col("n") == k) & (F.abs("least") < 2**62)).select("vec_id", "least")
    rest = q.join(reached, "vec_id", "left").join(small_or_shuffled(materialize(slabs, "slabs")), "dim").join(F.broadcast(first.withColumnRenamed("band", "first_band").withColumnRenamed("parts", "first_parts")), "dim")
    seen = (F.col("band") == F.col("first_band")) & (F.col("part") == F.pmod(F.xxhash64("block"), F.col("first_parts")))
    can = F.coalesce(F.sqrt("len2") * F.sqrt("longest") * (1 + 1e-9) >= F.col("least"), F.lit(True))
    found = probed.unionByName(meet(rest.filter(~seen & can)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
