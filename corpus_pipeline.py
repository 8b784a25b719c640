"""A training corpus from the documents table: language, lines, near copies, mixture, sequences.

Each stage works on all that its predecessor kept, is written as Parquet to the shared folder and read again. All but the last
return the columns of documents, with their values where the stage does not change them, whatever further columns there are.

Odd rows: null texts go in the first stage. Rows without an id keep all their lines, are copies of nothing and are mixed and
packed like others. Of rows with one id, near copies keep one, of several texts that with the smallest hash. Documents that have
lost all their words with their lines go. Empty tables give empty results.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoplane.llm import language, line_dedup, mixture, near_copies, packing
from stratoplane.shared_store import written
from stratoplane.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter go."""
    model = language.fit(docs, "text", "lang", "doc_id", ~language.held_out())
    return language.identified(docs, "text", model, ("_lang_pred", "_lang_score")).where(F.col("_lang_pred") != language.UNKNOWN).select(docs.columns)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document id holds; n_chars follows where lines went.

    A document of which nothing but blanks is left is gone: all its words are in other documents."""
    names = ("_all_lines", "_lines_gone", "_own_lines")
    kept = line_dedup.keep_lines(docs, line_dedup.keep_bitmaps(docs, "doc_id", "text"), "doc_id", "text", names)
    less = F.col("_lines_gone") > 0
    kept = kept.where(~less | (F.btrim("_own_lines", F.lit(line_dedup.BLANKS)) != ""))
    kept = kept.withColumn("text", F.when(less, F.col("_own_lines")).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(less, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate class, once; documents without an id stay."""
    classes = near_copies.near_classes(docs, "doc_id", "text")
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    one = marked.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("_mark").alias("_mark"))
    named = marked.join(one, ["doc_id", "_mark"], "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows of equal id, text and source share what is taken of all of them."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text", "source")))
    sized = written(mixture.with_size(docs.withColumn("_key", key), "_key", "text", "source"), "sizes")
    copies = mixture.mixed(sized, "_key", "source").groupBy("_key").agg(F.sum("copies").cast("long").alias("_copies")).where("_copies > 0")
    taken = docs.withColumn("_key", key).dropDuplicates(["_key"]).join(copies, "_key")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents of the mix, each with its sequence and place."""
    return packing.packed(written(packing.token_pieces(docs, "doc_id", "text"), "pieces"), "doc_id")


STAGES = [
    ("language", known_language),
    ("line_dedup", own_lines),
    ("near_copies", one_of_near_copies),
    ("mixture", mixed_sources),
    ("packing", sequences),
]

#: The classifier, the sampling and the search of these stages are not SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
