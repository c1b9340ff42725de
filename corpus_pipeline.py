"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. No SQL expresses the stages, so their results
are tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermalake.llm import langid, linededup, mixing, packing, simhash
from thermalake.llm.common import cut, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay, and `lang` says in which; the last stage packs by it.

    Texts without letters go, null and empty ones among them, and those most of
    whose letters the best language isn't written in. A score below 0.3, or 0.9
    divided by the number of languages if that is less, is too low as well. A
    missing label is filled in, and one that the text contradicts with a
    probability of 0.95 is replaced. If no language could be learned, all texts
    with letters stay as they are. Long texts are judged whole, repeated rows
    alike; an empty table gives an empty one; extra columns of any name are
    carried along.
    """
    return langid.accept(docs, langid.learn(docs), least=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that 5 documents share stay in the largest doc_id only.

    Null texts stay null; rows without a doc_id lose nothing; a text that loses
    all its lines becomes empty; repeated rows lose the same lines. n_chars
    follows the text. An empty table gives an empty one; extra columns of any
    name are carried along.
    """
    return linededup.drop_repeated_lines(docs, min_chars=40, min_docs=5, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within 2 bits stays, the one of the smallest doc_id.

    Null and empty texts are one group. Of rows that repeat the doc_id one
    stays. Rows without a doc_id can't be compared or named: all stay. An empty
    table gives an empty one; extra columns of any name are carried along.
    """
    return simhash.one_of_each_group(docs, shingle=3, max_bits=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document comes 0 to 2 times.

    A null source is a source; null and empty texts have no words and come as
    drawn. Of rows that repeat a doc_id, a text and a source, one comes as often
    as all of them together. An empty table gives an empty one; extra columns
    of any name are carried along.
    """
    return mixing.mixed_documents(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048, each of one language, with their ids; workers keep fewer words, as they hold other stages' tables too.

    Null texts count as empty ones, a null language is one, each row ends with
    the end token, and repeated rows are packed each on their own. An empty
    table gives an empty one; extra columns are not read.
    """
    return packing.pack_documents(docs, size=2048, end_id=1, known_words=200_000, by="lang")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is materialised before the next reads it."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
