"""From raw documents to packed training sequences, in five stages.

Each stage works on everything its predecessor kept and returns the columns
of ``documents``; the last returns packed pieces with their token ids.

In every stage null text counts as empty, extra columns of any name are
handed through, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import minhash, quality
from tallyframe.llm.common import materialize, table, unused
from tallyframe.llm.exact_dedup import drop_copies
from tallyframe.llm.mixing import apply_mix, mix
from tallyframe.llm.packing import pack


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows of two folds of three.

    A row is judged by its own text alone: repeated rows stay or go together,
    rows without id are judged like any other, empty texts as one. Without
    labels every row stays.
    """
    labels = table(spark, sf_dir, "labels").filter(quality.fold(F.col("doc_id"), 3) != 1)
    model = quality.train(docs, labels)
    names = tuple(unused(docs, "__score", "__predicted"))
    scored = quality.score(docs, model, carry=docs.columns, names=names)
    return scored.filter(F.col(names[1]) == 1).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id.

    An id wins over none; of rows that repeat both id and text one stays.
    """
    return drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the one with the smallest id.

    Rows are told apart by id and text, so an id that unlike texts share drops
    none of them; a row without id goes only if a like one stays. Rows without
    any word are linked with nothing and all stay.
    """
    return minhash.drop_near_copies(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights, three epochs at most.

    Null is a source of its own. Rows that repeat id and text share the
    repetitions that the target leaves them.
    """
    _, plan = mix(docs)
    return apply_mix(docs, plan)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048, with their ids.

    Every row is packed, repeated ones each; an empty text is its end mark.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the sketches; a test holds run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
