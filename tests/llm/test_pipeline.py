import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tallyframe.llm import quality
from tallyframe.llm.mixing import cyclic_weights, water_fill

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, COLS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus():
    rng = random.Random(12)
    words = [a + b for a in ("the", "and", "en", "th", "ou") for b in ("ing", "er", "tion", "re", "ly", "nd")]
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) + ("$$$" if bad else "") for _ in range(rng.randrange(60, 200)))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    good = [r for r in rows if r[0] % 6]
    rows += [(1000 + i, r[1], "en", "s0", r[4]) for i, r in enumerate(good[:20])]
    near = [" ".join(w if k != 30 else "changed" for k, w in enumerate(r[1].split())) for r in good[20:40]]
    rows += [(2000 + i, t, "en", "s1", len(t)) for i, t in enumerate(near)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s9", 0)]
    return rows, labels


def plain_score(model, text):
    """The classifier's score of one text, feature by feature."""
    chunks, mask, feats = (text or "").encode().split(), (1 << 64) - 1, set()
    terms = [t for c in chunks for t in quality.chunk_terms(c)]
    ones = [t * 0x9E3779B97F4A7C15 & mask for t in terms]
    feats |= {x >> (64 - quality.BITS) for x in ones}
    feats |= {((x ^ (t + 0x632BE59BD9B4E019 & mask)) * 0xD6E8FEB86659FD93 & mask) >> (64 - quality.BITS) for x, t in zip(ones, terms[1:])}
    for k in range(1, quality.MAX_RUN):
        if any(len(set(chunks[i : i + k + 1])) == 1 for i in range(len(chunks) - k)):
            feats.add(quality.RUN_FEATURE + k)
    known = {f: n for n, f in enumerate(model["feats"].tolist())}
    own = [known[f] for f in feats if f in known]
    top = sum(float(model["weights"][n]) * float(model["ratio"][n]) for n in own)
    norm = math.sqrt(sum(float(model["ratio"][n]) ** 2 for n in own))
    return 1 / (1 + math.exp(-max(-30, min(30, model["scale"] * (top / max(norm, 1e-9) + model["bias"]) + model["shift"]))))


def plain_near(rows):
    """Ids kept of (id, text): the smallest of each component of all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return set(least.values())


def plain_mix(rows):
    """Copies of each (id, text, source), with ids that don't repeat."""
    by, out = defaultdict(list), Counter()
    for doc, text, source in rows:
        md5 = hashlib.md5((text or "").encode()).hexdigest()
        by[source].append((int(hashlib.md5(f"17:{doc}:{md5}".encode()).hexdigest()[:15], 16), doc, len((text or "").split())))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[2] for r in by[s]) for s in names]
    for s, size, target in zip(names, sizes, water_fill(sizes, cyclic_weights(names), sum(sizes), 3)):
        whole = min(int(target // size), 3) if size else 0
        left = max(0, round(target) - whole * size)
        for _, doc, n in sorted(by[s]):
            # whole while it fits; the one that is cut is whole if half of it is wanted
            out[doc] += whole + (left > 0 and (left > n or 2 * left >= n))
            left -= min(left, n) if left > 0 else 0
    return +out


def test_stages_against_a_plain_version(spark, tmp_path):
    rows, labels = corpus()
    folder = write(spark, tmp_path / "d", rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], folder)
        path = str(tmp_path / name)
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    ids = [Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    assert all(i % 6 for i in ids[1] if i < 300) and all(i in ids[1] for i in range(300) if i % 6)
    held = [(i, q, t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    model = quality.train(docs, spark.createDataFrame(held, "doc_id long, quality int, toxic int"))
    good = [r for r in rows if plain_score(model, r[1]) >= 0.5]
    assert ids[1] == Counter(r[0] for r in good)
    last = {}
    for r in good:
        last[r[1] or ""] = max(r[0], last.get(r[1] or "", -1))
    kept = [r for r in good if last[r[1] or ""] == r[0]]
    assert ids[2] == Counter(r[0] for r in kept)
    near = plain_near([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if r[0] in near]
    assert ids[3] == Counter(r[0] for r in kept) and not any(2000 <= i < 2020 for i in near)
    assert ids[4] == plain_mix([(r[0], r[1], r[3]) for r in kept]) and max(ids[4].values()) <= 3
    texts = {r[0]: r[1] or "" for r in rows}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = Counter()
    for r in seen[5].collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == Counter({i: n * (1 + len(tokenizer.encode(texts[i], add_special_tokens=False).ids)) for i, n in ids[4].items()})


def test_scores_against_a_plain_version(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, COLS)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = [*rows[:40], (9000, "a a a a a a", "", "", 0), (9001, "ÄÖ ß ١٢ $$$ x_y", "", "", 0), (9002, None, "", "", 0), (9003, "\u2003 \u00a0", "", "", 0)]
    for r in quality.score(spark.createDataFrame(odd, COLS), model, carry=["doc_id", "text"]).collect():
        want = plain_score(model, r["text"])
        assert abs(r["score"] - want) < 1e-4 and r["predicted"] == (r["score"] >= 0.5)


def test_run_applies_all_stages(spark, tmp_path):
    rows, labels = corpus()
    folder = write(spark, tmp_path / "d", rows[:120], labels[:120])
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and "ids" in got.columns
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_empty_tables_go_through(spark, tmp_path):
    folder = write(spark, tmp_path / "d", [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
