"""Operator 7: dropping lines that many documents share.

Lines are keyed by their stripped, ASCII-lower-cased form, hashed to 128 bits
and counted once per document with map-side combining. Positions (not texts)
of lines with a frequent key meet again per document, and the text is put
together from the positions that stay.

A document is a row: repeated rows count as several documents and are cut alike;
their positions are gathered as a set, so repeats don't add to it. Null text is
one empty line, and empty keys are never dropped, so empty texts stay empty
texts. A text of any length is split whole. A line is frequent or not, so there
are no ties; ids are passed on, null or not. An empty table gives an empty one.
Columns of the input that are named like an output column are replaced by it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas.llm.common import ASCII_SPACE, dealt_anew, hash128


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """The documents without lines whose key stands in `min_docs` documents, with n_lines (before) and n_dropped."""
    doc = docs.withColumns(dict(zip(("_k1", "_k2"), hash128([F.col(id_col), F.col(text_col)]), strict=True)))
    keys = F.transform(lines_of(F.col(text_col)), key_of)
    h = lambda: dict(zip(("_h1", "_h2"), hash128(["_key"]), strict=True))
    frequent = (
        docs.select(F.explode(F.array_distinct(keys)).alias("_key"))
        .where(F.length("_key") >= max(1, min_chars))
        .withColumns(h())
        .groupBy("_h1", "_h2")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= min_docs)
    )
    places = (
        doc.select("_k1", "_k2", F.posexplode(keys).alias("_pos", "_key"))
        .where(F.length("_key") >= max(1, min_chars))
        .withColumns(h())
        .select("_k1", "_k2", "_pos", "_h1", "_h2")
    )
    dropped = (
        places.join(dealt_anew(frequent).select("_h1", "_h2"), ["_h1", "_h2"], "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_drop"))
    )
    lines = F.col("_lines")
    stay = F.when(
        F.col("_drop").isNotNull(),
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop")), lambda i: F.get(lines, i)),
    ).otherwise(lines)
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    out = (
        doc.join(dropped, ["_k1", "_k2"], "left")
        .withColumn("_lines", lines_of(F.col(text_col)))
        .withColumn("_stay", stay)
        .select(
            *others,
            F.array_join("_stay", "\n").alias(text_col),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_stay")).cast("long").alias("n_dropped"),
        )
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*names, "n_lines", "n_dropped")
