"""Near-duplicate groups: fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import join_groups, keep_marked, materialize, short_batches, small_or_shuffled, unused
from tallyframe.llm.components import connected_components
from tallyframe.llm.tokens import MAX_CHUNKS, Memo

BANDS = 32
#: Chance that a pair exactly at the threshold meets in no band.
MAX_MISS = 1e-5
#: Rows, and shingles, that one block of a large bucket or cluster holds.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 400_000
#: Rows of a group of several blocks that meet every block.
ANCHORS = 8

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
S30, S27, S31, S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts."""

    def __init__(self, words: int):
        self.words = words
        self.reset()

    def reset(self) -> None:
        self.memo, self.hashes = Memo(), np.zeros(1 << 12, np.uint64)

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.memo) > MAX_CHUNKS:
            self.reset()
        k = self.words
        split = [t.lower().split() for t in texts]  # bytes: A-Z only, six white-space bytes
        n = np.fromiter(map(len, split), np.int64, len(split))
        idx = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        fresh, self.memo.fresh = self.memo.fresh, []
        while len(self.memo) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        if fresh:
            self.hashes[len(self.memo) - len(fresh) : len(self.memo)] = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))
        h = self.hashes[idx]
        total = max(0, len(h) - k + 1)
        acc = np.zeros(total, np.uint64)
        for i in range(k):
            acc = mix(acc * M3 + h[i : i + total])
        ends = np.cumsum(n)
        out = []
        for end, count in zip(ends.tolist(), n.tolist()):
            start = end - count
            if count >= k:
                out.append(np.unique(acc[start : end - k + 1]))
            elif count:
                one = np.array([count], np.uint64) * M2
                for i in range(start, end):
                    one = mix(one * M3 + h[i : i + 1])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


class Sketcher:
    """Fast similarity sketch with ``t`` coordinates.

    In round i < t each element falls into one random bin with a random
    value; in round t + j every element falls into bin j. A coordinate keeps
    its smallest (round, value), so all are filled after 2t rounds at most,
    and usually after a few. Equal coordinates of two sketches estimate the
    Jaccard similarity with concentration as for independent samples.
    """

    def __init__(self, t: int, seed: int = 1):
        self.t = t
        self.seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * M3 + np.uint64(seed))

    def sketch(self, s: np.ndarray) -> np.ndarray:
        t, n = self.t, len(s)
        out = np.zeros(t, np.uint64)
        empty = np.ones(t, bool)
        i = 0
        while i < t and empty.any():
            rounds = min(t - i, max(1, -(-2 * t // n)))
            x = mix(s[None, :] ^ self.seeds[i : i + rounds, None])
            bins = ((x >> S32) * np.uint64(t)) >> S32
            order = np.arange(i, i + rounds, dtype=np.uint64)[:, None] << S32
            key = np.sort(((bins << np.uint64(42)) | order | (x & LOW)).ravel())
            b = (key >> np.uint64(42)).astype(np.int64)
            first = np.ones(len(b), bool)
            first[1:] = b[1:] != b[:-1]
            b, key = b[first], key[first]
            new = empty[b]
            out[b[new]] = key[new]
            empty[b] = False
            i += rounds
        for j in np.flatnonzero(empty):
            v = (mix(s ^ self.seeds[t + j]) & LOW).min()
            out[j] = (np.uint64(j) << np.uint64(42)) | (np.uint64(t + j) << S32) | v
        return mix(out)


def rows_per_band(percent: int, bands: int = BANDS, miss: float = MAX_MISS) -> int:
    """Most rows a band may have so that a pair at the threshold is missed with chance ``miss`` at most."""
    r = 1
    while (1 - (percent / 100) ** (r + 1)) ** bands <= miss:
        r += 1
    return r


def forest(alike, n: int, ask: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning edges of a graph on 0..n-1 whose ``alike(i)`` is the boolean row of i's links.

    Rows (those in ``ask``) are asked one by one, and none any more once all
    are one group.
    """
    label = np.arange(n)
    groups, edges = n, []
    for i in range(n) if ask is None else ask:
        if groups == 1:
            break
        other = np.flatnonzero(alike(i) & (label != label[i]))
        for g in dict.fromkeys(label[other].tolist()):
            j = int(other[np.flatnonzero(label[other] == g)[0]])
            edges.append((i, j))
            label[label == g] = label[i]
            groups -= 1
    return edges


def exact_links(sets: list[np.ndarray], percent: int, ask: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the pairs with 100 * intersection >= percent * union, from full sets.

    With ``ask``, of the pairs that hold one of these sets.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * inter >= percent * (n.sum() - inter) else []
    words, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), n)
    keep = count[at] > 1
    width = -(-max(1, int((count > 1).sum())) // 64) * 64
    bits = np.zeros((len(sets), width // 8), np.uint8)
    col = shared[at[keep]]
    np.bitwise_or.at(bits, (row[keep], col >> 3), (1 << (col & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)

    def alike(i: int) -> np.ndarray:
        inter = np.bitwise_count(bits & bits[i]).sum(1, dtype=np.int64)
        return 100 * inter >= percent * (n + n[i] - inter)

    return forest(alike, len(sets), ask)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[b.num_rows - 1] for k in range(keys)]
        cut = b.num_rows
        same = np.ones(b.num_rows, bool)
        for k, v in enumerate(last):
            same &= b.column(k).to_numpy(zero_copy_only=False) == v.as_py()
        if not same.all():
            cut = int(np.flatnonzero(~same)[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and any(held[-1].column(k)[held[-1].num_rows - 1] != v for k, v in enumerate(last)):
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _linked(batches: Iterator[pa.RecordBatch], links: Callable[[list[bytes], list[int] | None], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Edges of each group of rows ``(key, i, j, node, asked, payload)`` sorted by the first three."""
    for table in _groups(batches, 3):
        nodes, asked, load = table.column(3).to_numpy(), table.column(4).to_numpy(), table.column(5).to_pylist()
        new = np.ones(table.num_rows, bool)
        for k in range(3):
            c = table.column(k).to_numpy()
            new[1:] &= c[1:] == c[:-1]
        new[1:] = ~new[1:]
        starts = np.append(np.flatnonzero(new), table.num_rows).tolist()
        found: set[tuple[int, int]] = set()
        for lo, hi in zip(starts[:-1], starts[1:]):
            # an anchor is also a row of its own block, and a row may have come more than once
            first: dict[int, int] = {}
            ask: dict[int, int] = {}
            for r in range(lo, hi):
                at = first.setdefault(int(nodes[r]), len(first))
                if asked[r]:
                    ask[at] = r
            if len(first) < 2 or not ask:
                continue
            own, rows = list(first), {}
            for r in range(lo, hi):
                rows.setdefault(first[int(nodes[r])], load[r])
            for i, j in links([rows[k] for k in range(len(own))], None if len(ask) == len(own) else list(ask)):
                found.add((own[i], own[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])


def _block(node: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "node")


def _spanning(rows: DataFrame, load: Callable[[DataFrame], DataFrame], links: Callable) -> DataFrame:
    """``node, component``: components of the links inside the groups of ``rows(key, node, blocks)``.

    ``load`` adds the binary column ``payload`` to rows with a ``node``;
    ``links`` finds spanning edges among payloads.

    A group of one block is one unit of work. A larger one is dealt into its
    blocks by a hash of the node, and eight anchors (the least nodes of eight hash
    classes) meet every block, so n rows move n * (1 + 8 / block) times. What is then
    one component needs no further look inside. Rows of a large group outside its
    largest component, the rest, are asked against all rows of the group, block by
    block. So every pair of a group is either in one component or looked at,
    and no group is gathered in one task.
    """
    rows = materialize(rows, "groups")
    big = rows.filter("blocks > 1")
    salt = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(ANCHORS))
    anchors = materialize(big.groupBy("key", salt.alias("salt")).agg(F.min("node").alias("node")).select("key", "node", F.lit(True).alias("anchor")), "anchors")
    n_anchors = anchors.count()
    own = F.array(_block("node", F.col("blocks")))
    if n_anchors:
        dealt = rows.join(small_or_shuffled(anchors, n_anchors), ["key", "node"], "left")
        dealt = dealt.withColumn("parts", F.when(F.col("anchor"), F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).otherwise(own))
    else:
        dealt = rows.withColumn("parts", own)
    dealt = load(dealt).select("key", F.explode("parts").alias("i"), F.lit(0).alias("j"), "node", F.lit(True).alias("asked"), "payload")
    edges = _sorted(dealt).mapInArrow(lambda batches: _linked(batches, links), "a long, b long")
    stars = connected_components(edges)
    if not n_anchors:
        return stars
    of = big.join(stars, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    of = materialize(of, "large-groups")
    sizes = of.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    heads = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("head"), F.sum("n").alias("n")).withColumn("rest", F.col("n") - F.col("head.n"))
    heads = heads.filter("rest > 0").select("key", F.col("head.component").alias("head"), F.ceil(F.col("n") / (4 * BLOCK_ROWS)).alias("rows"), F.ceil(F.col("rest") / (4 * BLOCK_ROWS)).alias("asks"))
    heads = materialize(heads, "heads")
    n_heads = heads.count()
    if not n_heads:
        return stars
    here = of.join(small_or_shuffled(heads, n_heads), "key")
    row, ask = _block("node", F.col("rows")), _block("node", F.col("asks"))
    every = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    one = F.transform(every("asks"), lambda j: F.struct(row.alias("i"), j.alias("j"), F.lit(False).alias("asked")))
    two = F.transform(every("rows"), lambda i: F.struct(i.alias("i"), ask.alias("j"), F.lit(True).alias("asked")))
    here = here.withColumn("parts", F.when(F.col("component") == F.col("head"), one).otherwise(F.concat(one, two))).select("key", "node", "parts")
    here = load(here).select("key", "node", "payload", F.explode("parts").alias("part")).select("key", "part.i", "part.j", "node", "part.asked", "payload")
    more = _sorted(here).mapInArrow(lambda batches: _linked(batches, links), "a long, b long")
    return connected_components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _digest(s: np.ndarray) -> bytes:
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ M3).sum(dtype=np.uint64)]).tobytes()


def near_groups(docs: DataFrame, words: int = 3, percent: int = 85, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, text_key2, n_shingles, component_id, component`` for every row of ``docs``.

    See :func:`near_dedup`. ``component`` is the number of the component among
    those of two rows or more, whatever their ids (null: the row is alone);
    ``text_key`` and ``text_key2`` are two 64-bit hashes of the text.

    Plan:
    1. One pass writes thin rows: set size, 128-bit digest of the set,
       sketch bytes, band keys. Equal sets become one class with a number of its own
       (map-side combined), so exact copies cost nothing more. Links join
       classes, never ids: an id is only looked at for the smallest of a component.
    2. Band keys shared by two or more classes form buckets, whose sketches
       close enough are joined by spanning edges (see ``_spanning``), never by all pairs.
    3. Components of those edges are candidate clusters. Only a clustered class
       reads one of its texts again; the full sets meet by cluster and
       are verified exactly, one row of the bit matrix at a time until a
       block is one group.
    4. Components of the verified links give the result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    per_band = rows_per_band(percent, bands)
    t = bands * per_band
    p = percent / 100
    close = math.floor(t * max(0.0, p - 6 * math.sqrt(p * (1 - p) / t)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("text_key2"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher = Shingler(words), Sketcher(t)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * M3)
        for b in batches:
            sets = shingler.batch(b.column(2).cast(pa.binary()).to_pylist())
            digests, sketches, keys = [], [], []
            for s in sets:
                if not len(s):
                    digests.append(None), sketches.append(None), keys.append(None)
                    continue
                digests.append(_digest(s))
                v = sketcher.sketch(s)
                sketches.append((v & np.uint64(255)).astype(np.uint8).tobytes())
                v = v.reshape(bands, per_band)
                acc = salt
                for i in range(per_band):
                    acc = mix(acc * M3 + v[:, i])
                keys.append(acc.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "text_key2", "n_shingles", "digest", "sketch", "bands"],
            )

    thin = materialize(d.mapInArrow(sketch, "doc_id long, text_key long, text_key2 long, n_shingles long, digest binary, sketch binary, bands array<long>"), "sketches")
    # the class's least id, a text of that id, and what all its rows share; ids that are null come last
    late = F.coalesce("doc_id", F.lit(2**63 - 1))
    shared = [F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")]
    classes = thin.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.min_by("text_key", late).alias("text_key"), F.count(F.lit(1)).alias("copies"), *shared)
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    rows = join_groups(keyed, buckets, "key", "n").select("key", "node", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    sketches = classes.select("node", F.col("sketch").alias("payload"))

    def close_links(load: list[bytes], ask: list[int] | None) -> list[tuple[int, int]]:
        sk = np.frombuffer(b"".join(load), np.uint8).reshape(-1, t)
        if len(sk) == 2:
            return [(0, 1)] if (sk[0] == sk[1]).sum() >= close else []
        return forest(lambda i: (sk == sk[i]).sum(1) >= close, len(sk), ask)

    clusters = materialize(_spanning(rows, lambda r: r.join(sketches, "node"), close_links).select("node", F.col("component").alias("key")), "clusters")
    known = classes.select("node", "digest", "least_id", "text_key", "n_shingles").join(clusters, "node")
    known = materialize(known, "members")
    sizes = known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = materialize(sizes.select("key", "n", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("blocks")), "cluster-sizes")
    members = join_groups(known.select("key", "node"), sizes, "key", "n").select("key", "node", "blocks")
    wanted = known.select("node", "digest", F.col("least_id").alias("__id"), F.col("text_key").alias("__key"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows that repeat an id and text are all read here; one of each class goes on from a task
        shingler, seen = Shingler(words), set()
        for b in batches:
            sets = shingler.batch(b.column(2).cast(pa.binary()).to_pylist())
            out = []
            for k, (node, digest) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                # another text with the same 64-bit hash and id is told by its set
                if node not in seen and _digest(sets[k]) == digest:
                    seen.add(node)
                    out.append(k)
            rows = b.take(pa.array(out, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), *rows.columns[3:], pa.array([sets[k].tobytes() for k in out], pa.binary())], names=["node", *b.schema.names[3:], "payload"])

    def read_sets(rows: DataFrame) -> DataFrame:
        more = [c for c in rows.columns if c != "node"]
        chosen = materialize(wanted.join(rows, "node"), "texts-to-read")
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
        kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
        return d.join(small_or_shuffled(chosen), same).select("node", "digest", "text", *more).mapInArrow(shingle, f"node long{kinds}, payload binary")

    def exact(load: list[bytes], ask: list[int] | None) -> list[tuple[int, int]]:
        return exact_links([np.frombuffer(x, np.uint64) for x in load], percent, ask)

    stars = _spanning(members, read_sets, exact)
    linked = classes.select("node", "digest", "least_id", "copies").join(stars, "node", "left").filter("copies > 1 or component is not null")
    linked = materialize(linked.withColumn("component", F.coalesce("component", "node")), "components")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = join_groups(linked.select("component", "digest", "copies"), materialize(least, "least-ids"), "component", "n")
    linked = materialize(linked.select("digest", "copies", "component", "component_id", F.lit(True).alias("grouped")), "linked")
    # rows without shingles share no digest and are linked with nothing
    out = join_groups(thin.select("doc_id", "text_key", "text_key2", "n_shingles", "digest").filter("digest is not null"), linked, "digest", "copies", "left")
    out = out.select("doc_id", "text_key", "text_key2", "n_shingles", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")
    bare = thin.filter("digest is null").select("doc_id", "text_key", "text_key2", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return out.unionByName(bare)


def near_dedup(docs: DataFrame, words: int = 3, percent: int = 85, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a
    document's set holds its distinct shingles of ``words`` words, or its
    whole sequence where it has fewer. Documents are linked when 100 *
    intersection >= ``percent`` * union on full sets; a component's smallest
    id is kept. The plan is that of :func:`near_groups`.

    Edge cases: null or empty text, or white space alone, has no shingles
    and is linked with nothing; rows that repeat an id and text get equal
    rows; rows that share an id but not the text are rows of their own, and
    are linked only by their texts; a row without id is linked like any other, and
    its component's id is null if all its rows are without; an empty table gives an
    empty result; extra columns, whatever their names, take no part.
    """
    groups = near_groups(docs, words, percent, bands, id_col, text_col)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, in its own columns.

    Of a group the row with the smallest id stays (rows without id come last);
    of several such rows the one whose text has the smallest hash, and one of
    those that repeat both. Rows without shingles all stay. The texts are
    shuffled only where the dropped rows are too many to be broadcast. An empty
    table gives an empty result.
    """
    keys = unused(docs, "__id", "__text", "__text2")
    named = [F.col(c).alias(k) for c, k in zip(("doc_id", "text_key", "text_key2"), keys)]
    rows = materialize(near_groups(docs, words, percent, id_col=id_col, text_col=text_col).filter("component is not null"), "near-rows")
    # one row for each id and text; its component tells nothing but its group
    keyed = rows.groupBy("component", "doc_id", "text_key", "text_key2").agg(F.max("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    keyed = materialize(keyed, "near-keys")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    groups = keyed.groupBy("component").agg(F.min(F.when(first, F.col("text_key"))).alias("best"), F.count(F.lit(1)).alias("n_keys"))
    judged = join_groups(keyed, materialize(groups, "near-best"), "component", "n_keys")
    stays = first & (F.col("text_key") == F.col("best"))
    drops = materialize(judged.filter(~stays).select(*named), "near-drops")
    twice = materialize(judged.filter(stays & (F.col("n") > 1)).select(*named), "near-repeats")
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({keys[0]: F.col(id_col).cast("long"), keys[1]: F.xxhash64(text), keys[2]: F.xxhash64(F.lit(1), text)})
    return keep_marked(docs, marked, keys, drops, twice)
