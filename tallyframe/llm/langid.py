"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, seeded, short_batches
from tallyframe.llm.tokens import MAX_CHUNKS, Memo, worker_cache

#: Documents of each language the fit reads at most (about; drawn by hash).
MAX_DOCS = 3_000
#: Known words kept for each language, by frequency; n-grams are counted over all words.
MAX_WORDS = 30_000
MAX_N = 5
#: Words and n-grams seen less often in the sampled rows, over all languages, are left to shorter n-grams.
MIN_WORD, MIN_GRAM = 2, 5
LETTERS = regex.compile(r"\p{L}+")


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Fit word and n-gram log frequencies from a bounded sample of labelled documents.

    Rows without language or text take no part. Words, and the n-grams of
    all words of the sampled rows, are counted in Spark. The driver gets the
    words among the ``max_words`` most frequent of any language, and the
    n-grams seen often enough to say something.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for lang, k in sorted(n.items()):
        share = F.when(F.col("lang") == lang, int(2**60 * min(1.0, max_docs / k))).otherwise(share)
    d = d.filter(seeded(seed, F.col("id")) < share)
    words = d.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    words = materialize(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    langs = sorted(n)
    of_langs = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    ranked = words.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    top = ranked.groupBy(F.col("word").alias("gram")).agg(*of_langs, F.min("r").alias("r"), F.sum("n").alias("n")).filter((F.col("r") <= max_words) & (F.col("n") >= MIN_WORD)).drop("r", "n")
    padded = words.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w")).withColumn("size", F.length("w"))
    # every start takes the n-grams of all lengths that fit
    starts = padded.select("lang", "n", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i"))
    lengths = starts.select("lang", "n", "w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_N), F.col("size") - F.col("i") + 1))).alias("k"))
    grams = lengths.select("lang", "n", F.substring("w", F.col("i"), F.col("k")).alias("gram")).groupBy("gram").agg(*of_langs, F.sum("n").alias("n")).filter(F.col("n") >= MIN_GRAM).drop("n")
    tables: list[tuple[list[str], np.ndarray]] = []
    counted = grams.toArrow() if langs else None
    size = pc.utf8_length(counted["gram"]) if langs else None
    for k in range(MAX_N + 1):
        found = (top.toArrow() if k == 0 else counted.filter(pc.equal(size, k))).sort_by("gram") if langs else None
        keys = found["gram"].to_pylist() if langs else []
        tables.append((keys, np.array([found[f"n{i}"].to_numpy() for i in range(len(langs))], float).reshape(len(langs), len(keys)).T))
    return {"langs": langs, "tables": [(keys, log_shares(counts)) for keys, counts in tables]}


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Log frequencies, add-half smoothed, of rows of counts by language."""
    return (np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * max(1, len(counts)))).astype(np.float32)


class Scorer:
    """Scores of white-space chunks, kept per worker."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.tables = [(dict(zip(keys, range(len(keys)))), logs) for keys, logs in model["tables"]]
        self.reset()

    def reset(self) -> None:
        self.chunks, self.scores = Memo(), np.zeros((1 << 12, len(self.langs) + 1), np.float32)

    def word(self, word: str) -> np.ndarray:
        words, logs = self.tables[0]
        if (i := words.get(word)) is not None:
            return logs[i]
        padded = f" {word} "
        for k in range(min(MAX_N, len(padded)), 0, -1):
            grams, logs = self.tables[k]
            found = [i for j in range(len(padded) - k + 1) if (i := grams.get(padded[j : j + k])) is not None]
            if found:
                return logs[found].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def chunk(self, chunk: bytes) -> np.ndarray:
        """The chunk's score for each language, and its number of letter runs."""
        out = np.zeros(len(self.langs) + 1, np.float32)
        for w in LETTERS.findall(chunk.decode()):
            out[:-1] += self.word(w.lower())
            out[-1] += 1
        return out

    def batch(self, texts: list[bytes]) -> np.ndarray:
        if len(self.chunks) > MAX_CHUNKS:
            self.reset()
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        idx = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        fresh, self.chunks.fresh = self.chunks.fresh, []
        while len(self.chunks) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for i, c in enumerate(fresh, len(self.chunks) - len(fresh)):
            self.scores[i] = self.chunk(c)
        sums = np.zeros((len(texts), len(self.langs) + 1))
        doc = np.repeat(np.arange(len(texts)), n)
        for k in range(sums.shape[1]):
            sums[:, k] = np.bincount(doc, self.scores[idx, k], len(texts))
        return sums


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    The language with the largest summed log frequency wins, ties going to
    the first in code-point order; the score is its posterior under equal
    priors. Null text, or text without a letter, gives ``und`` and score 0,
    as does a model that learned no language. Repeated rows get equal
    results; an empty table gives an empty result.

    One pass over the scan, no shuffle; the model's size is bounded by the
    fit's parameters.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = ("languages", uuid.uuid4().hex)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(key, lambda: Scorer(shared.value))
        for b in batches:
            sums = scorer.batch(b.column(1).cast(pa.binary()).to_pylist())
            letters, sums = sums[:, -1] > 0, sums[:, :-1]
            if scorer.langs:
                best = sums.argmax(1)
                p = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                pred = [scorer.langs[i] if ok else "und" for i, ok in zip(best, letters)]
            else:
                pred, p = ["und"] * len(sums), np.zeros(len(sums))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.where(letters, p, 0.0))], names=["doc_id", "lang_pred", "score"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
