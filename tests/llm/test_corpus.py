import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm.mixing import apply_mix, cyclic_weights, mix, water_fill
from tallyframe.llm.sharding import interleave
from tallyframe.llm.topk_search import top_k, top_k_search


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "big", "big", "big", None, "é"]), i) for i in range(n)]
    rows += [(5, "w w", "a", 0), (5, "w w", "a", 0), (None, "w", "b", 0), (7_000, None, "big", 0), (7_001, "w " * 50_000, "tiny", 0), (7_002, "", "empty", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size long")


def test_water_fill_shares_and_caps():
    assert water_fill([100, 100], [1, 1], 200, 3) == [100.0, 100.0]
    got = water_fill([10, 90, 100], [5, 2, 1], 200, 3)
    assert got[0] == 30.0 and sum(got) == pytest.approx(200) and got[1] == pytest.approx(2 * got[2])
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(0, 1000) for _ in range(8)]
        t = water_fill(sizes, cyclic_weights(list(range(8))), sum(sizes), 3)
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-6 for x, s in zip(t, sizes))
    assert water_fill([], [], 0, 3) == []


def test_mix_meets_targets_and_reruns_agree(spark):
    rows, docs = corpus(spark)
    decided, plan = mix(docs)
    got = decided.collect()
    assert len(got) == len(rows)
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        words = r["size"] * r["repeats"] + r["extra"]
        assert 0 <= words <= 3 * r["size"]
        taken[r["source"]] += words
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5
        assert t <= 3 * size[s] + 1e-6
    again = mix(docs.repartition(9))[0]
    key = lambda d: sorted((str(r["doc_id"]), r["size"], r["repeats"], r["extra"]) for r in d)
    assert key(again.collect()) == key(got)
    out = apply_mix(docs, plan)
    assert out.columns == docs.columns
    counts = Counter(r["doc_id"] for r in out.collect())
    for r in got:
        if r["doc_id"] not in (5, None):
            assert r["repeats"] <= counts[r["doc_id"]] <= r["repeats"] + (r["extra"] > 0 or r["size"] == 0)


@pytest.mark.parametrize("ids", [[None], list(range(10)), [None, 4]])
def test_mix_meets_targets_on_ids_that_repeat_or_are_missing(spark, ids):
    rng = random.Random(6)
    texts = [" ".join(["w"] * n) for n in (1, 3, 10, 10)]
    rows = [(ids[i % len(ids)], rng.choice(texts) if i % 3 else "hot row", "a" if i % 7 == 0 else "b", "x", "y") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __MIX_SK string, before string")
    decided, plan = mix(docs)
    taken, target, epochs = Counter(), {}, {}
    for r in decided.collect():
        taken[r["source"]] += r["size"] * r["repeats"] + r["extra"]
        target[r["source"]], epochs[r["source"]] = r["target"], r["target"] / r["source_size"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert min(epochs.values()) < 1 < max(epochs.values())
    out = apply_mix(docs, plan)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - t) <= 10 for s, t in target.items())
    key = lambda d: sorted((str(r["doc_id"]), r["source"], r["size"], r["repeats"], r["extra"]) for r in d.collect())
    assert key(mix(docs.repartition(7))[0]) == key(decided)


def test_mix_of_nothing(spark):
    decided, plan = mix(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert decided.count() == 0 and plan.count() == 0


def test_shards_match_the_mixture(spark):
    rows, docs = corpus(spark)
    got = interleave(docs, shards=8).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    counts = [len(by[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    sources = Counter(r["source"] for r in got)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        for s, n in sources.items():
            assert abs(sum(r["source"] == s for r in rs) - n / 8) <= 2
    again = interleave(docs.repartition(5), shards=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def in_order(rows, shards, large):
    """Shard and slot of each row by plain sorting."""
    h = lambda *parts: int(hashlib.md5(":".join(["29", *parts]).encode()).hexdigest()[:15], 16)
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    bucket = lambda x, n: min(int(x / 2**60 * n), n - 1)
    n, ids = Counter(r[2] for r in rows), defaultdict(set)
    for i, t, s in rows:
        ids[s, t or ""].add(i)
    ranked = defaultdict(list)
    for i, t, s in rows:
        k = len(ids[s, t or ""])
        many = k > large
        a, b = h(md5(t)), h("null" if i is None else str(i))
        ranked[s].append((bucket(a, -(-n[s] // large)), a if many else -1, bucket(b, -(-k // large)) if many else 0, a, (i is not None, i or 0), t))
    placed = sorted(((k + 0.5) / n[s], (s is not None, s or ""), x[4], x[5]) for s, found in ranked.items() for k, x in enumerate(sorted(found, key=lambda x: x[:5])))
    total = len(rows)
    out = []
    for pos, (_, s, i, t) in enumerate(placed):
        shard = pos * shards // total
        out.append((i[1] if i[0] else None, s[1] if s[0] else None, len((t or "").encode()) + 1, shard, pos - -(-shard * total // shards)))
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [500, 5])
def test_shards_against_plain_sorting(spark, monkeypatch, large):
    """Also with large groups of one text, with ids that repeat or are null, and rows that repeat all."""
    from tallyframe.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", large)
    rng = random.Random(3)
    rows = [(rng.choice([None, i, i, 7]), rng.choice(["hot", "hot", f"t{i % 90}", None, ""]), rng.choice(["a", "b", "b", None])) for i in range(700)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, SHARD long")
    got = [(r["doc_id"], r["source"], r["size"], r["shard"], r["slot"]) for r in interleave(d, shards=8).collect()]
    assert sorted(got, key=str) == in_order(rows, 8, large)


def test_equal_texts_share_a_shard_but_at_cuts(spark):
    rows = [(i, f"text {i % 400}", "ab"[i % 2]) for i in range(1600)]
    got = interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    text = {i: t for i, t, _ in rows}
    where = defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(w) > 1 for w in where.values()) <= 2 * 7


def test_shards_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, "é", None), (2, None, None)], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["slot"]) for r in interleave(few).collect())
    assert [(a, b, d) for a, b, _, d in got] == [(1, 3, 0), (2, 1, 0)] and got[1][2] == 0
    assert interleave(few.limit(0)).count() == 0


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok[i] = [int(np.floor(1024 * float(x))) for x in v]
    out = []
    for q in ok:
        if q % 5:
            continue
        found = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_top_k_against_brute_force(spark, monkeypatch, scale):
    from tallyframe.llm import topk_search

    monkeypatch.setattr(topk_search, "SLAB_ROWS", 40)
    monkeypatch.setattr(topk_search, "BUCKET", 8)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 30)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (base[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=8) * 0.1) * scale]) for i in range(220)]
    rows += [(300 + i, [1.0] * 8) for i in range(60)] + [(400, None), (405, [None] * 8), (410, [float("nan")] * 8), (415, [float("inf")] + [0.0] * 7), (420, [0.0] * 8), (425, [1.0, 2.0]), (430, [2.0, 1.0]), (435, []), (440, [])]
    d = spark.createDataFrame([(i, v, "c") for i, v in rows] + [(None, [1.0] * 8, "c")], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in top_k_search(d, F.col("vec_id") % 5 == 0, k=10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 10)


def test_top_k_of_nothing(spark):
    assert top_k_search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0).count() == 0


def test_top_k_verifies_few_products():
    """Clustered vectors, vectors of unlike lengths, and a threshold known beforehand: pruning takes effect and loses nothing."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    close = np.floor(1024 * (centres[np.arange(2000) % 20] + 0.2 * rng.normal(size=(2000, 64)))).astype(np.int64)
    flat = np.floor(1024 * rng.normal(size=(2000, 64)) / 8).astype(np.int64)
    long = np.floor(flat * rng.exponential(size=(2000, 1))).astype(np.int64)
    ids = np.arange(2000)
    for vectors, most in ((close, 0.35), (long, 0.35), (flat, 0.6)):
        counts, known = {}, {}
        found = list(top_k((ids[:40], vectors[:40]), (ids, vectors), 10, None, counts))
        for n, got, scores in found:
            all_scores = vectors @ vectors[n]
            want = sorted((-s, i) for i, s in enumerate(all_scores.tolist()) if i != n)[:10]
            assert list(zip((-scores).tolist(), got.tolist())) == want
        assert counts["verified"] <= most * counts["pairs"]
        floor = np.array([scores[-1] for _, _, scores in found], float)
        again = list(top_k((ids[:40], vectors[:40]), (ids, vectors), 10, floor, known))
        assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(found, again)) and known["verified"] <= counts["verified"]
