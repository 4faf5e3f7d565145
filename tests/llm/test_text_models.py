import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tallyframe.llm import langid, quality
from tallyframe.llm.html_text import extract, extract_text, vote
from tallyframe.llm.packing import SumOfSquares, pack
from tallyframe.llm.token_counts import Counter, count_tokens, read_vocabulary
from tallyframe.llm.tokens import ChunkTokenizer

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "don't WE'LL it's.", "<|endoftext|> x<|startoftext|>y", "İstanbul ΑΣ ΟΔΟΣ.", "é Éx", "a b c　d\x1ce", "日本語 12345 x1y2", "word*** $$$ a_b -- «q»", "x" * 30_000]


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("aAbBzéÉÖßñÑ .,'’!|_-0123İſΣσς日本́  \t\n<|>endoftext") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_chunk_tokenizer_equals_the_tokenizer():
    texts = ODD + noise(1500, 1)
    mine = ChunkTokenizer(BPE, max_chunks=200)
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    got = [list(x) for at in range(0, len(texts), 100) for x in mine.encode([t.encode() for t in texts[at : at + 100]])]
    assert got == want


def test_pack_is_an_exact_round_trip(spark):
    rng = random.Random(4)
    texts = [None, *ODD, *[" ".join(rng.choice(["the", "and", "anea", "entre"]) for _ in range(rng.randrange(1, 4000))) for _ in range(60)]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, "null id", "clash")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, offset string").coalesce(1), BPE).collect()
    tokenizer = Tokenizer.from_file(BPE)
    want = sorted((i if i is not None else -1, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _ in rows)
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    once = {i: ids for i, ids in want}
    for i, ps in pieces.items():
        covered = sorted((p["start"], p["ids"]) for p in ps)
        if i == 3:
            assert sum(p["length"] for p in ps) == 2 * len(once[3])
            continue
        assert [x for _, ids in covered for x in ids] == list(once[i])
    padding = 0
    for ps in windows.values():
        fill = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == fill and p["length"] == len(p["ids"])
            fill += p["length"]
        assert fill <= 2048
        padding += 0 if fill & (fill - 1) == 0 else 2048 - fill
    assert padding <= 0.01 * sum(p["length"] for p in got)


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_sum_of_squares_takes_the_cheapest_level():
    packer = SumOfSquares(size=10)
    for h in (3, 3, 6):
        list(packer.add("d", np.zeros(h, np.int32)))
    # 3 joins 6 (level 9) or 3 (level 6) or opens level 3; brute force over the squares
    before = packer.levels.copy()

    def squares(h):
        levels = before.copy()
        if h:
            levels[h] -= 1
        if h + 3 < 10:
            levels[h + 3] += 1
        return int((levels[1:10] ** 2).sum())

    open_levels = [0] + [h for h in range(1, 8) if before[h]]
    best = min(squares(h) for h in open_levels)
    list(packer.add("e", np.zeros(3, np.int32)))
    assert int((packer.levels[1:10] ** 2).sum()) == best


def test_full_streams_leave_no_padding_but_near_full_windows():
    packer, rng = SumOfSquares(size=64, max_open=16), np.random.default_rng(3)
    windows, total = [], 0
    for i in range(500):
        n = int(rng.integers(1, 150))
        total += n
        windows += list(packer.add(i, np.arange(n, dtype=np.int32)))
    windows += list(packer.close())
    fills = [sum(len(p[2]) for p in w) for w in windows]
    assert sum(fills) == total and max(fills) <= 64
    assert all(f & (f - 1) == 0 or f >= 0.99 * 64 for f in fills)


def test_token_counts_equal_a_unigram_tokenizer(spark):
    vocabulary = read_vocabulary(PIECES)
    reference = Tokenizer(models.Unigram([("<unk>", min(s for _, s in vocabulary) + 1), *vocabulary], 0, False))
    reference.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    texts = [t for t in ODD + noise(800, 2) if not any(c in t for c in "  　\x1c")]
    want = [len(e.ids) for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert list(Counter(vocabulary).batch([t.encode() for t in texts])) == want
    got = count_tokens(spark.createDataFrame([(1, None, 5), (2, "the the", 5), (None, "the", 5)], "doc_id long, text string, n_tokens long"), PIECES)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == [("1", 0), ("2", len(reference.encode("the the").ids)), ("None", len(reference.encode("the").ids))]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_token_counts_with_ties():
    words = [("ab", -2.0), ("a", -1.0), ("b", -1.0), ("abc", -3.0), ("c", -1.0), ("▁", 0.0)]
    reference = Tokenizer(models.Unigram([("<unk>", -20.0), *words], 0, False))
    for w in ("abc", "abcab", "aabbcc", "xab", "abxxyc"):
        assert Counter(words).count("▁" + w) == len(reference.encode("▁" + w).ids)


GOOD = ["the of and anea entre then", "over the and with thing", "and so the thing of then"]
BAD = ["$$$ the %%% and ***", "BUY NOW!! THE!!", "then then then then then then"]


def test_quality_separates_and_handles_odd_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(BAD if bad else GOOD) for _ in range(8)), i))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (10**9, 1)], "doc_id long, quality int")
    held = quality.fold(lab["doc_id"], 3) == 1
    model = quality.train(docs, lab.filter(~held))
    got = {r["doc_id"]: (r["s"], r["p"]) for r in quality.score(docs, model, names=("s", "p")).collect()}
    test = lab.filter(held & lab["quality"].isNotNull()).collect()
    assert np.mean([got[r["doc_id"]][1] == r["quality"] for r in test if r["doc_id"] in got]) > 0.95
    odd = quality.score(spark.createDataFrame([(1, None), (2, ""), (None, "x" * 10**5), (2, "")], "doc_id long, text string"), model).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    again = quality.train(docs.repartition(7), lab.filter(~held))
    assert np.allclose(again["weights"], model["weights"]) and again["bias"] == model["bias"]


def test_quality_without_labels_is_a_constant(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r["score"] == pytest.approx(0.5) for r in quality.score(docs, model).collect())


def test_languages(spark):
    rng = random.Random(8)
    stems = {"xx": ["thing", "over", "and", "the"], "yy": ["über", "straße", "und", "der"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "", "en", "ing"]) for _ in range(20)), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "über den", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model["langs"] == ["xx", "yy"]
    odd = [(1, None), (2, "123 !!"), (3, ""), (4, "strassenüberung unding"), (5, "thingover andoverthing"), (None, "der"), (7, "over " * 20_000)]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got == [(None, "yy"), (1, "und"), (2, "und"), (3, "und"), (4, "yy"), (5, "xx"), (7, "xx")]
    none = langid.train(docs.filter("lang = 'zz'"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content-12"><h2>Head&amp;line</h2><p>First   para&shy;graph &lt;b&gt; of the
article, long enough to win.<p>Second <b>bold</b> one<br>broken line, also long enough.<div class="ad-box">Buy</div><ul><li>point one</li><li>point two</li></ul>
<form><input value="x">Subscribe</form></div><aside>Related things</aside><div class="comments"><p>Nice! I liked this article a lot, really a lot, thanks for it all.</p></div><footer>&copy; me</footer><script>var a = "<p>no</p>";</script>"""
TEXT = "Head&line\nFirst para­graph <b> of the article, long enough to win.\nSecond bold one broken line, also long enough.\npoint one\npoint two"


def test_html_article_only():
    assert vote(PAGE)[0] == "html>body.with-sidebar>div"
    assert extract_text(PAGE, None) == TEXT
    assert extract_text("", None) == "" and extract_text("plain & simple", None) == "plain & simple"
    assert extract_text("<p>cut off &amp; <b>bol", None) == "cut off & bol"
    assert extract_text("<div>" * 3000 + "deep" + "</div>" * 10, None) == "deep"
    assert extract_text("<!-- never closed <p>x</p>", None) == ""
    assert extract_text('<p title="unclosed>a</p><p>b</p>', None) in ("a\nb", "b")


def test_html_consensus_of_a_host(spark):
    side = "<body><div class=main><p>short</p></div><div class=box><p>%s</p></div></body>" % ("long teaser text " * 20)
    usual = "<body><div class=main><p>%s</p></div><div class=box><p>teaser</p></div></body>" % ("the article text " * 20)
    pages = [(i, "http://A.example.com/x", usual, "c") for i in range(5)] + [(5, "https://a.example.com:80/y?z", side, "c"), (6, None, None, "c"), (7, "http://b.example.com", "", "c"), (0, "http://A.example.com/x", usual, "c")]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert got[0]["text"].startswith("the article text") and "teaser" not in got[0]["text"]
    assert got[0]["n_chars"] == len(got[0]["text"]) and got[6]["text"] == "" == got[7]["text"]
    assert got[5]["text"].startswith("long teaser")  # the host's path holds next to nothing here
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_the_whole_article():
    lead, long = "lead " * 20, "body text " * 200
    got = extract_text(f"<body><article><h1>Title</h1><p>{lead}</p><div class=entry-content><p>{long}</p></div></article></body>", None)
    assert got.split("\n") == ["Title", lead.strip(), long.strip()]
    parts = "<body><div class=content><section class=intro><p>%s</p></section><section class=body><p>%s</p></section></div><div class=box>teaser</div></body>"
    assert extract_text(parts % ("one " * 250, "two " * 225), None).split("\n") == [("one " * 250).strip(), ("two " * 225).strip()]
    assert "two" in extract_text(parts % ("one " * 250, "two"), None)
    assert "two" in extract_text("<body><main><section><p>%s</p></section><section class=b><p>%s</p></section></main></body>" % ("one " * 250, "two " * 20), None)
    deep = "<body><article><div class=a><div><p>%s</p></div></div><div class=b><div><div><p>%s</p></div></div></div></article></body>"
    assert "two" in extract_text(deep % ("one " * 250, "two " * 50), None)
    assert extract_text(f"<body><h1>T</h1><div class=entry><p>{long}</p></div></body>", None).startswith("T\n")


def test_html_table_layouts_and_link_lists():
    row = "<body><table><tr><td class=l>%s</td><td class=m><p>%s</p><p>end</p></td></tr></table></body>"
    links, long = '<a href="/x">some other page</a> ' * 30, "cell text " * 100
    assert extract_text(row % (links, long), None) == long.strip() + "\nend"
    assert "left part" in extract_text(row % ("left part " * 40, long), None)
    assert extract_text(f"<body><article><p>{long}</p><p>end</p></article><div class=blurb>Buy one, get one free today.</div></body>", None) == long.strip() + "\nend"


def test_html_narrow_host_path_loses_nothing():
    page = "<body><article><h1>Title</h1><p>%s</p><div class=entry-content><p>%s</p></div></article></body>" % ("lead " * 200, "body text " * 60)
    narrow = "html>body>article>div.entry-content"
    assert extract_text(page, narrow) == extract_text(page, None)
    assert extract_text(page, narrow).startswith("Title\nlead")


def test_language_ngrams_are_counted_over_all_words(spark):
    docs = spark.createDataFrame([(1, "aba " * 9 + "zqx " * 6, "xx"), (2, "bab " * 9 + "wvk " * 6, "yy")], "doc_id long, text string, lang string")
    model = langid.train(docs, max_words=1)
    assert model["tables"][0][0] == ["aba", "bab"]  # the known words are bounded
    assert {"zqx", " zqx ", "wvk"} <= {g for keys, _ in model["tables"] for g in keys}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "zqx"), (2, "wvk")], "doc_id long, text string"), model).collect()}
    assert got == {1: "xx", 2: "yy"}


@pytest.mark.parametrize("rows", [1, 30, 300])
def test_short_streams_are_hardly_cut(rows):
    """Of a stream of few documents nearly all tokens are placed whole: by the levels, or by merging open windows."""
    rng = np.random.default_rng(rows)
    packer, windows, lengths = SumOfSquares(), [], np.minimum(rng.lognormal(5.5, 1.2, rows).astype(int) + 1, 30_000)
    for i, n in enumerate(lengths):
        windows += list(packer.add(i, np.arange(n, dtype=np.int32)))
    windows += list(packer.close())
    pieces = {}
    for w in windows:
        fill = sum(len(p[2]) for p in w)
        assert fill <= 2048 and (fill >= 0.99 * 2048 or fill & (fill - 1) == 0)
        for doc, start, ids in w:
            assert (ids == np.arange(start, start + len(ids))).all()
            pieces.setdefault(doc, []).append((start, len(ids)))
    for i, n in enumerate(lengths):
        end = 0
        for start, k in sorted(pieces[i]):
            assert start == end
            end += k
        assert end == n
    assert sum(packer.tokens.values()) == lengths.sum()
    if rows == 300:
        assert packer.tokens["cut"] <= 0.05 * lengths.sum()


def test_html_class_words_never_judge_alone():
    body = "<p>The article text, which is long enough to be one.</p>"
    article = "The article text, which is long enough to be one."
    assert extract_text(f'<article class="print">{body}</article>', None) == article
    assert extract_text(f'<body><div id="search">{body}</div><div class="search">Find</div></body>', None) == article
    assert extract_text(f'<body><div class="share">Share it</div><div class="notice">Mind the gap.</div><div class="entry">{body}</div><div class="comments"><p>{"Long comment. " * 20}</p></div></body>', None) == article


def test_html_headline_in_the_header_of_an_article():
    body = "<p>The article text, which is long enough to be one.</p>"
    got = extract_text(f"<body><header><h1>Site</h1></header><article><header><h1>Headline</h1><p>By me</p><nav>Menu</nav></header>{body}</article></body>", None)
    assert got == "Headline\nThe article text, which is long enough to be one."


BLOCKS = ["Some sentence of the article, %d words long or so.", "Another one (no. %d) that says a little more than that.", "<b>Bold</b> words &amp; a <a href=x>link %d</a> in running text."]
PLAIN = ["Some sentence of the article, %d words long or so.", "Another one (no. %d) that says a little more than that.", "Bold words & a link %d in running text."]


def test_html_against_pages_made_from_known_articles():
    """Articles of known blocks in several layouts, among menus, adverts, forms, notices and comments."""
    rng = random.Random(21)
    for k in range(200):
        picks = [(rng.randrange(3), rng.randrange(1000)) for _ in range(rng.randrange(2, 12))]
        tag = rng.choice(["p", "p", "div", "blockquote"])
        inside = "".join(f"<{tag}>{BLOCKS[b] % n}</{tag}>" + rng.choice(["", "\n ", "<div class='ad'>Buy now!</div>", "<script>x('<p>')</script>"]) for b, n in picks)
        shell = rng.choice(["<article>%s</article>", "<main><div class='c1'>%s</div></main>", "<div id='content'>%s</div>", "<table><tr><td><a href=a>one</a> <a href=b>two</a></td><td class='m'>%s</td></tr></table>"])
        around = ["<header><h1>Site</h1></header>", "<nav><ul><li><a href=/>Home</a></li></ul></nav>", "<div class='cookie-banner'>We use cookies.</div>", "<div class='sidebar'><p>Older posts and more of them.</p></div>", "<aside>Tip</aside>"]
        below = ["<form><input><button>Send</button></form>", "<div id='comments'><p>First! I liked this one a lot, thank you.</p></div>", "<footer>(c) me</footer>"]
        page = "<html><body>" + "".join(rng.sample(around, rng.randrange(5))) + shell % inside + "".join(rng.sample(below, rng.randrange(3))) + "</body></html>"
        assert extract_text(page, None) == "\n".join(PLAIN[b] % n for b, n in picks), page


def plain_language(model, text):
    """Language and score of one text, word by word."""
    import regex

    logs = [(dict(zip(keys, range(len(keys)))), rows) for keys, rows in model["tables"]]
    sums, letters = np.zeros(len(model["langs"])), False
    for chunk in (text or "").encode().split():
        for word in regex.findall(r"\p{L}+", chunk.decode()):
            letters, word = True, word.lower()
            if word in logs[0][0]:
                sums += logs[0][1][logs[0][0][word]]
                continue
            padded = f" {word} "
            for k in range(min(langid.MAX_N, len(padded)), 0, -1):
                hits = [logs[k][0][padded[i : i + k]] for i in range(len(padded) - k + 1) if padded[i : i + k] in logs[k][0]]
                if hits:
                    sums += logs[k][1][hits].mean(0)
                    break
    if not letters:
        return "und", 0.0
    return model["langs"][int(sums.argmax())], float(1 / np.exp(sums - sums.max()).sum())


def test_languages_against_a_plain_version(spark):
    rng = random.Random(18)
    stems = {"xx": ["thing", "over", "and", "the"], "yy": ["über", "straße", "und", "der"], "zz": ["ça", "élan", "et", "ver"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "", "en", "ing", "e"]) for _ in range(15)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pool = [w for s in stems.values() for w in s] + ["straßen", "overund", "İstanbul", "e\u0301t", "42", "--", "q"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 8))) for _ in range(60)] + [None, "", "12 !!", "\u00a0"]
    odd = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred int, SCORE int")
    for r in langid.predict(odd, model).collect():
        lang, score = plain_language(model, texts[r["doc_id"]])
        assert abs(r["score"] - score) < 1e-3 and (r["lang_pred"] == lang or abs(score - 0.5) < 1e-3)


def test_slices_cover_every_text_once():
    import numpy as np

    from tallyframe.llm.quality import slices

    assert list(slices(np.array([], int), 5)) == []
    assert list(slices(np.array([2, 3, 1, 9, 0, 0, 5, 5]), 5)) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]
    assert list(slices(np.array([0, 0, 0]), 5)) == [(0, 3)]
