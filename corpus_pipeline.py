"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns
a DataFrame; all but the last return the columns of documents. ``run`` writes each
stage's rows as Parquet into the shared folder and rereads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import jaccard, language, lines, packing, quality
from tramline.llm.queries import tokenizer_path
from tramline.llm.shared import bounded_batches, materialize, table

#: Least share of a text's letters in its language; below it the language is not told.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the rows' column lang knows: those
    without a letter go, and those of which less than ``LEAST_SCORE`` of the letters
    are in it, as letters of a script that no such language uses. The language found
    is not written over the column lang. The verdict is a column of the row itself, so
    repeated rows and rows with a null id have one each. Null and empty texts go; an
    empty table stays empty."""
    model = language.train(docs)
    found = language.predicted_column(spark, model, F.col("text"), with_spans=False)
    names = [f"c{k}" for k in range(len(docs.columns))]
    marked = bounded_batches(docs).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], found.alias("found"))
    kept = marked.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SCORE))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the importance resampling, see ``quality.draw``: each row by
    a key of its own, rows equal in id and text together. Null and empty texts have
    weight 0. Without labels of both kinds all rows stay; an empty table stays empty."""
    return quality.draw(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out of texts; a document of which nothing but
    white space is left goes, as all of it stands in documents that stay.
    ``n_chars`` follows the text."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # the operator adds columns of its own
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    cut = lines.remove_repeated_passages(renamed, names["doc_id"], names["text"])
    text = F.col(names["text"])
    cut = cut.where((F.col("removed_words") == 0) | (F.length(F.regexp_replace(text, r"\s+", "")) > 0))
    if "n_chars" in names:
        cut = cut.withColumn(names["n_chars"], F.when(F.col("removed_words") > 0, F.length(text).cast("long")).otherwise(F.col(names["n_chars"])))
    return cut.select(*[F.col(n).alias(c) for c, n in names.items()])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the least id, and one
    of rows equal in id and text; see ``jaccard.keep_one_of_each``."""
    return jaccard.keep_one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequence and place. Null and empty texts
    have one token; repeated rows are packed each; an empty table gives none."""
    # the executors of a long job hold more already, so words are kept in a smaller cache
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), room=1)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, tokenizers and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
