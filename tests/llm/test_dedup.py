import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize
from tallyframe.llm.components import connected_components
from tallyframe.llm.exact_dedup import drop_copies, exact_dedup
from tallyframe.llm.minhash import Sketcher, drop_near_copies, exact_links, forest, near_dedup, rows_per_band

DOCS = "doc_id long, text string, keep_id string, __h string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


ROWS = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "A"), (5, "A"), (6, "a "), (None, "a"), (None, "z"), (7, "x" * 100_000), (8, "x" * 100_000)]


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_of", [None, lambda c: F.lit(b"same")])
def test_exact_dedup_also_with_colliding_hashes(spark, hash_of):
    kw = {} if hash_of is None else {"hash_of": hash_of}
    got = [tuple(r) for r in exact_dedup(docs(spark, ROWS), **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == expected_exact(ROWS)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_drop_copies_leaves_one_row_of_each_text(spark):
    got = drop_copies(docs(spark, ROWS))
    assert got.columns == ["doc_id", "text", "keep_id", "__h"]
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in ROWS})


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if any(x in e for e in edges if e[0] != e[1])}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def expected_near(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                comp[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        r = find(x)
        least[r] = min([v for v in (least.get(r), i) if v is not None], default=None)
    return sorted(((i, len(s), least[find(x)], i == least[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.choice([1, 2, 3, 8])):
            v = list(base)
            for _ in range(rng.randrange(0, 6)):
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append(" ".join(v).upper() if rng.random() < 0.2 else "\n".join(v))
    rows += [None, "", " \t ", "one", "ONE", "two words", "Two\x0bWords", "x " * 5000]
    rng.shuffle(rows)
    return [(10 * i, t) for i, t in enumerate(rows)] + [(10, rows[1]), (None, rows[2])]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_dedup_against_all_pairs(spark, k, percent):
    rows = corpus()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(docs(spark, rows), words=k, percent=percent).collect()]
    assert sorted(got, key=str) == expected_near(rows, k, percent)


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        v = list(base)
        for _ in range(changes):
            v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(v))
    return out


@pytest.mark.parametrize("changes", [3, 5, 8])
def test_near_dedup_of_large_groups_in_blocks(spark, monkeypatch, changes):
    """Groups of several blocks: all linked, partly linked and hardly linked, so that the rest is asked too."""
    from tallyframe.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rng = random.Random(changes)
    rows = list(enumerate(variants(rng, [f"b{i}" for i in range(150)], 60, changes)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == expected_near(rows, 3, 85)


def test_near_dedup_of_ids_that_repeat_or_are_missing(spark):
    """Ids that several texts share link nothing, and rows without id lose no link."""
    rng = random.Random(4)
    base = [[f"{c}{i}" for i in range(60)] for c in "abcdef"]
    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (2, variants(rng, base[1], 1, 1)[0]), (9, " ".join(base[2]))]
    rows += [(None, " ".join(base[3])), (30, variants(rng, base[3], 1, 1)[0]), (None, variants(rng, base[4], 1, 1)[0]), (None, " ".join(base[4])), (None, " ".join(base[5])), (None, None)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == expected_near(rows, 3, 85)


def test_drop_near_copies_keeps_one_row_of_each_group(spark):
    rng = random.Random(8)
    base = [[f"{c}{i}" for i in range(80)] for c in "abcdefg"]
    one = [" ".join(b) for b in base]
    two = [variants(rng, b, 1, 1)[0] for b in base]
    rows = [(5, one[0]), (5, one[1]), (2, two[1]), (9, one[2])]  # the ids of a and b repeat, a is like nothing
    rows += [(None, one[3]), (30, two[3])]  # a row without id is dropped for one with
    rows += [(None, one[4]), (None, two[4])]  # both without: one stays
    rows += [(7, one[5]), (7, two[5])]  # one id, near copies: one stays
    rows += [(8, one[6]), (8, one[6]), (8, one[6])]  # repeated rows: one stays
    rows += [(40, None), (40, None), (None, "")]  # nothing to compare: all stay
    names = "doc_id long, text string, __id string, __TEXT string, __drop___id string, component string"
    frame = spark.createDataFrame([(i, t, "x", "y", "z", "c") for i, t in rows], names)
    got = drop_near_copies(frame)
    assert got.columns == frame.columns
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert all(left[r] == 1 for r in [(5, one[0]), (2, two[1]), (9, one[2]), (30, two[3]), (8, one[6]), (None, "")]) and left[(40, None)] == 2
    assert left[(None, one[4])] + left[(None, two[4])] == 1 == left[(7, one[5])] + left[(7, two[5])]
    assert sum(left.values()) == 10
    assert drop_near_copies(frame.limit(0)).count() == 0


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    """Beyond the broadcast bound, and with a key that holds most rows and one that is null."""
    from tallyframe.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    keys = [1] * 3000 + [2] * 600 + list(range(10, 40)) + [None] * 5 + [99]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    groups = rows.filter("k is not null and k <> 99").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        got = Counter((r["i"], r["k"], r["n"]) for r in common.join_groups(rows, groups, "k", "n", how).collect())
        assert got == Counter((r["i"], r["k"], r["n"]) for r in rows.join(groups, "k", how).collect())


def test_near_dedup_of_nothing(spark):
    assert near_dedup(docs(spark, [])).count() == 0


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    sketcher, rng = Sketcher(224), np.random.default_rng(1)
    for n in (1, 2, 5, 50, 2000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        v = sketcher.sketch(np.unique(a))
        assert len(v) == 224 and (v == sketcher.sketch(np.unique(a))).all()
    errors = []
    for share in (0.5, 0.85, 0.95):
        common = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 1000 - len(common), dtype=np.uint64)])) for _ in range(2)]
        j = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        errors.append(abs((sketcher.sketch(sets[0]) == sketcher.sketch(sets[1])).mean() - j))
    assert max(errors) < 0.12


def test_bands_miss_few_pairs_at_the_threshold():
    for percent in (80, 85):
        r = rows_per_band(percent)
        assert (1 - (percent / 100) ** r) ** 32 <= 1e-5 < (1 - (percent / 100) ** (r + 1)) ** 32


def test_exact_links_span_what_all_pairs_span():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.05], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(30)]
    sets.append(rng.integers(0, 2**63, 50, dtype=np.uint64))
    links = exact_links(sets, 85)
    full = forest(lambda i: np.array([100 * len(np.intersect1d(sets[i], s)) >= 85 * len(np.union1d(sets[i], s)) for s in sets]), len(sets))
    assert len(links) == len(full)
    for i, j in links:
        assert 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))


def test_materialized_frames_keep_rows(spark):
    d = spark.range(10).withColumn("x", F.lit(None).cast("string"))
    assert Counter(r["id"] for r in materialize(d, "t").collect()) == Counter(range(10))


def test_components_never_return_unsettled(spark):
    path = spark.createDataFrame([((7 * i) % 101, (7 * (i + 1)) % 101) for i in range(100)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(path, max_rounds=1)
    got = connected_components(path).collect()
    assert len(got) == 101 and {r["component"] for r in got} == {0}
