"""The corpus pipeline: quality, lines, near-duplicates, benchmark leaks, tokens.

Each stage takes the documents that the one before it kept, as a table of
doc_id, text, lang, source and n_chars, and works on all of them.  The first
four return the same columns; the last returns the tokens.  A row with a null
doc_id passes every stage but is a copy of nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import forget, settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null and empty texts are scored as any other; every row of a repeated doc_id is scored by its own text.  Without
    labels of both classes every score is 0.5 and all stay.  Columns other than COLUMNS go.  An empty table stays empty.
    """
    from tessera.llm.quality import quality_scores

    scores = quality_scores(docs, table(spark, sf_dir, "labels"), columns=COLUMNS[1:])
    return scores.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated and nearly repeated lines; a document that loses its last line goes.

    Null, empty and blank texts have no lines to lose and stay, as do rows with a null doc_id.  Repeated rows are one
    document, with one fate.  n_chars is counted again where a text changed.
    """
    from tessera.llm.line_dedup import line_duplicates

    out = line_duplicates(docs, columns=COLUMNS[2:])
    left = F.col("n_removed") < F.col("n_lines")
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long"))
    return out.where(left | (F.col("n_removed") == 0)).select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group of near-duplicates.

    Documents without words and rows with a null doc_id are in no group and stay.  A doc_id goes or stays with all of
    its rows.
    """
    from tessera.llm.near_dup import near_duplicates as groups

    gone = groups(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null, empty and wordless texts hold none and stay, as do rows with a null doc_id.  Without items all stay.
    """
    from tessera.llm.tiling import clean

    return clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left; decoding gives the text back.

    A null text is the empty one and gives no tokens; every row gives a row, repeated ones too.
    """
    from tessera.llm.bpe import encode_decode
    from tessera.llm.registry import tokenizer_files

    return encode_decode(docs, **tokenizer_files(), keep=("ids",))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", tokens)]

#: A trained classifier and a tokenizer are not SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
            if stored is not None:
                forget(stored)
            stored = docs
    return docs
