"""A corpus pipeline: five stages, each one of the operators of nilas.llm, each on all that the one before kept.

What holds for every stage but the last: the columns of documents come out as
they went in, whatever else a table has; a null or empty text is a document of
no words, which passes the first three stages and is never taken by the mix;
repeated rows are documents of their own; null ids, langs and sources stay
null; texts are read whole; an empty table gives an empty one. n_chars follows
the text where a stage cuts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import line_dedup, mixing, ngram_join, packing, toxicity
from nilas.llm.common import discard, read_table, written
from nilas.llm.queries import held_out, vocabulary


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' columns, n_chars following the text."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; labels that are null or of unknown documents teach nothing."""
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), train=~held_out())
    scored = toxicity.score(docs, lexicon, keep=tuple(docs.columns)).where(F.col("predicted") == 0)
    return scored.select(*[F.col(f"_k_{c}").alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents share; repeated rows count as several documents."""
    return with_text(line_dedup.dedup_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one of the smallest id, of each group of linked documents; rows are told apart by a number, not by id."""
    keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    kept = ngram_join.similar(keyed, row_col="_row").where("kept").select(F.col("row").alias("_row"))
    return keyed.join(kept, "_row", "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and the run of words of one that is taken in part.

    Repeated rows are documents of their own; rows are told apart by a number, not by id.
    """
    keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    taken = mixing.mix(keyed, row_col="_row").where("taken > 0").select(F.col("row").alias("_row"), "size", "taken", "run_first")
    words = F.regexp_extract_all("text", F.lit(f"{mixing.WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    rest, first = (F.col("taken") % F.col("size")).cast("int"), F.col("run_first").cast("int")
    straight = F.least(rest, F.col("size").cast("int") - first)
    run = F.array_join(F.concat(F.slice(words, first + 1, straight), F.slice(words, F.lit(1), rest - straight)), "")
    copies = F.array_repeat("text", F.floor(F.col("taken") / F.col("size")).cast("int"))
    texts = F.when(rest > 0, F.concat(copies, F.array(run))).otherwise(copies)
    mixed = keyed.join(taken, "_row").withColumn("text", F.explode(texts))
    return with_text(mixed, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; ties are broken by id, piece and checksum."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing, learning and near-duplicate groups can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; what a stage has read is deleted once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
