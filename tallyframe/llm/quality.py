"""Quality classifier: naive Bayes features under a linear support vector machine."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import seeded, short_batches
from tallyframe.llm.tokens import MAX_CHUNKS, Memo, Ragged, worker_cache

BITS = 22
#: Labelled rows the fit reads at most (about; they are drawn by hash).
MAX_TRAIN = 8_000
MIN_DOCS = 5
#: Longest run of one chunk that has an indicator, and where these indicators start.
MAX_RUN, RUN_FEATURE = 5, 17
#: Bytes of text whose features are computed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
PARTS = re.compile(r"[^\W_]+|[\W_]+")


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of neighbours whose sizes sum to at most ``most``, or of a single larger one."""
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if len(sizes):
        yield lo, len(sizes)


def chunk_terms(chunk: bytes) -> list[int]:
    """Term numbers of a white-space chunk: letter-digit runs, sign runs, and their case."""
    text = chunk.decode()
    terms = []
    for part in PARTS.findall(text):
        terms.append(zlib.crc32(part.lower().encode()))
        if len(part) > 1 and part.isupper():
            terms.append(zlib.crc32(b"\x00upper"))
    return terms


class Featurizer:
    """Distinct unigrams and bigrams of terms, hashed to ``BITS`` bits, and runs of one chunk."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.chunks, self.rows = Memo(), Ragged()

    def batch(self, texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document index, feature) of each distinct feature; only those marked in ``known``."""
        if len(self.chunks) > MAX_CHUNKS:
            self.reset()
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        idx = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if self.chunks.fresh:
            fresh, self.chunks.fresh = self.chunks.fresh, []
            # crc32 is unsigned; the ragged store holds the same 32 bits signed
            self.rows.extend([[t - (1 << 32) if t >> 31 else t for t in chunk_terms(c)] for c in fresh])
        terms, lens = self.rows.take(idx)
        of_chunk = np.repeat(np.arange(len(texts)), n)
        doc = np.repeat(of_chunk, lens)
        terms = terms.view(np.uint32).astype(np.uint64)
        shift, mask = np.uint64(64 - BITS), np.uint64((1 << 64) - 1)
        one = (terms * np.uint64(0x9E3779B97F4A7C15)) & mask
        two = ((one[:-1] ^ (terms[1:] + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xD6E8FEB86659FD93)) & mask
        same = doc[:-1] == doc[1:]
        feats = [(one >> shift).astype(np.int64), (two[same] >> shift).astype(np.int64)]
        docs = [doc, doc[:-1][same]]
        # runs of one chunk, whatever the chunk: an n-gram whose parts are equal
        run = np.ones(len(idx), bool)
        for k in range(1, MAX_RUN):
            run = run[:-1] & (idx[k:] == idx[:-k]) & (of_chunk[k:] == of_chunk[:-k])
            docs.append(of_chunk[: len(run)][run])
            feats.append(np.full(len(docs[-1]), RUN_FEATURE + k, np.int64))
        feats, docs = np.concatenate(feats), np.concatenate(docs)
        if known is not None:
            keep = known[feats]
            feats, docs = feats[keep], docs[keep]
        key = np.unique((docs << BITS) | feats)
        return key >> BITS, key & ((1 << BITS) - 1)


def fit(flat: np.ndarray, ends: np.ndarray, labels: np.ndarray, c: float = 1.0, epochs: int = 10, alpha: float = 1.0, seed: int = 7) -> dict:
    """Log-count ratios, then hinge loss by dual coordinate descent, then a logistic scale.

    ``flat[ends[i]:ends[i + 1]]`` are the distinct features of document i.
    The weights come from four fifths of the rows and the logistic scale from
    the rest. With one class only, or too few rows, the model is the constant
    class share (1/2 if there is none). Features are numbered anew by the
    vocabulary of the sample, so that nothing but a count has the hash's size.
    """
    y = np.asarray(labels)
    n = len(y)
    if n < 10 or len(set(y.tolist())) < 2:
        p = float(y.mean()) if n else 0.5
        return {"feats": np.zeros(0, np.int64), "weights": np.zeros(0, np.float32), "ratio": np.zeros(0, np.float32), "bias": 0.0, "scale": 0.0, "shift": float(np.log((p + 1e-3) / (1 - p + 1e-3)))}
    least = min(MIN_DOCS, max(1, n // 20))
    seen = np.bincount(flat, minlength=1 << BITS) >= least
    feats = np.flatnonzero(seen)
    number = np.full(1 << BITS, -1, np.int32)
    number[feats] = np.arange(len(feats))
    rows = [r[r >= 0] for r in (number[flat[ends[i] : ends[i + 1]]] for i in range(n))]
    del seen, number
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    train, held = order[n // 5 :], order[: n // 5]
    if len(set(y[train].tolist())) < 2:
        train = held = order
    p, q = np.full(len(feats), alpha), np.full(len(feats), alpha)
    for i in train:
        (p if y[i] == 1 else q)[rows[i]] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    norm = np.array([max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows])
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y[train] == 0).mean(), (y[train] == 1).mean()])
    upper = c * 0.5 / share[y]
    w, bias, dual = np.zeros(len(feats)), 0.0, np.zeros(n)
    for _ in range(epochs):
        for i in rng.permutation(train):
            r = rows[i]
            x = ratio[r] / norm[i]
            gradient = sign[i] * (w[r] @ x + bias) - 1
            new = min(max(dual[i] - gradient / 2.0, 0.0), upper[i])  # |x|^2 with the constant is 2
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[r] += step * x
                bias += step
                dual[i] = new
    margin = np.array([w[rows[i]] @ ratio[rows[i]] / norm[i] + bias for i in held])
    a, b = _logistic(margin, y[held])
    return {"feats": feats, "weights": w.astype(np.float32), "ratio": ratio.astype(np.float32), "bias": bias, "scale": a, "shift": b}


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return float(a), float(b)



def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on a bounded sample of labelled documents.

    ``labels`` holds ids and 0/1 labels; rows without either take no part.
    About ``max_train`` of them, drawn by a seeded hash of the id, are joined
    with their texts (a broadcast of bounded size) and turned into features on
    the executors. The driver receives these features only.
    """
    spark = docs.sparkSession
    short_batches(spark)
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    n = lab.count()
    if n > max_train:
        lab = lab.filter(seeded(seed, F.col("doc_id")) < int(2**60 * (max_train / n)))
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.join(F.broadcast(lab), F.col("__id") == F.col("doc_id")).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer()
        for whole in batches:
            sizes = pc.binary_length(whole.column(2).cast(pa.binary())).to_numpy()
            for lo, hi in slices(sizes, SLICE_BYTES):
                b = whole.slice(lo, hi - lo)
                texts = b.column(2).cast(pa.binary()).to_pylist()
                doc, feat = featurizer.batch(texts)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                feats = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), feats], names=["doc_id", "label", "feats"])

    got = d.mapInArrow(run, "doc_id long, label int, feats array<int>").toArrow()
    # the order of arrival depends on the cluster; the fit must not
    got = got.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    y = got.column("label").to_numpy()
    lists = got.column("feats").combine_chunks()
    del got
    if not len(y):
        return fit(np.zeros(0, np.int32), np.zeros(1, np.int64), y)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return fit(lists.values.to_numpy(), lists.offsets.to_numpy(), y)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``, from its whole text alone.

    Edge cases: a null or empty text has no features and gets the model's
    constant; repeated rows get equal scores; an empty table an empty result.
    ``carry`` names columns to hand through instead of the bare id, and
    ``names`` the two new ones.

    One pass over the scan, no shuffle. A worker keeps one Arrow batch of
    texts, a bounded cache of chunks and the table of weights.
    """
    short_batches(docs.sparkSession)
    carry = carry or [id_col]
    d = docs.select(*carry) if text_col in carry else docs.select(*carry, text_col)
    at = d.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        # only the marks have the hash's size; weights are looked up by the place of a feature among the model's
        known = np.zeros(1 << BITS, bool)
        known[m["feats"]] = True
        weight, sq = m["weights"] * m["ratio"], m["ratio"] ** 2
        featurizer = worker_cache("features", Featurizer)
        for b in batches:
            texts = b.column(at).cast(pa.binary()).fill_null(b"")
            p = np.zeros(len(texts))
            for lo, hi in slices(pc.binary_length(texts).to_numpy(), SLICE_BYTES):
                part = texts[lo:hi].to_pylist()
                doc, feat = featurizer.batch(part, known)
                place = np.searchsorted(m["feats"], feat)
                top = np.bincount(doc, weight[place], len(part))
                norm = np.sqrt(np.bincount(doc, sq[place], len(part)))
                margin = top / np.maximum(norm, 1e-9) + m["bias"]
                p[lo:hi] = 1 / (1 + np.exp(-np.clip(m["scale"] * margin + m["shift"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*carry, *names])

    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    return d.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + f", `{names[0]}` double, `{names[1]}` int")


def fold(id_col, folds: int):
    """crc32 of the id as text, modulo ``folds`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds
