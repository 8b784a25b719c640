"""Removal of lines that repeat across documents, with DataFrame functions only.

A line's key is the line without blanks at its ends, A-Z lower-cased. Of keys of at least MIN_CHARS code points that several
documents hold, the smallest document id keeps its lines and all other documents lose theirs.

1. Every long enough line becomes (128-bit hash of the key, document, position).
2. The hashes are range-partitioned by (hash, salt of the document) with a secondary sort by document and position, and a
   window streams each run: rows of any but the run's first document are dropped for good. A hash of a third of all lines is
   SALTS runs (as many as shuffle partitions, if these are more), so no task takes all its rows.
3. The runs' first holders, at most a document for each salt, are range-partitioned by hash and streamed the same way.
4. Dropped positions, far fewer than lines, are gathered by document to a keep bitmap in run-length form; texts do not travel for
   it. ``keep_lines`` applies bitmaps to documents.

Null and empty texts are one empty line, which is too short to be dropped. A document's own repeats stay or go together. Rows
of one id count as one document; rows without an id keep all lines. Long texts are split whole, their lines travel as hashes.
Extra columns stay as they are, and so do columns with the names of results if others are given for these. Empty tables give
empty results.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared_store import written
from ..tables import table

MIN_CHARS, SALTS = 10, 64
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n_lines, pos, h1, h2 for every line whose key is long enough."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), _lines(F.translate(F.col(text_col), _UPPER, _LOWER)).alias("lines"))
    rows = lines.select("doc", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.char_length("key") >= MIN_CHARS)
    return rows.select("doc", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def _first_holders(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the first document of each key: range partitions in the order of key, document and position, streamed."""
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "doc", "pos")
    return dealt.withColumn("first_doc", F.first("doc").over(Window.partitionBy(*keys).orderBy("doc", "pos")))


def keep_bitmaps(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n_lines, keep: for each document that loses lines, the runs (start, len) of lines that stay.

    Documents that are not listed keep every line."""
    salts = max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = written(line_rows(docs, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts))), "lines")
    runs = written(_first_holders(rows, ["h1", "h2", "salt"]), "line-runs")
    later = runs.where("doc <> first_doc").select("doc", "n_lines", "pos")
    heads = _first_holders(runs.where("doc = first_doc").drop("salt", "first_doc"), ["h1", "h2"])
    dropped = later.unionByName(heads.where("doc <> first_doc").select("doc", "n_lines", "pos"))
    marks = dropped.groupBy("doc").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
    ends = marks.select("doc", "n_lines", F.concat(F.array(F.lit(-1)), "gone", F.array("n_lines")).alias("at"))
    between = F.transform(
        F.sequence(F.lit(1), F.size("at") - 1),
        lambda i: F.struct((F.element_at("at", i) + 1).alias("start"), (F.element_at("at", i + 1) - F.element_at("at", i) - 1).alias("len")),
    )
    return ends.select("doc", "n_lines", F.filter(between, lambda r: r["len"] > 0).alias("keep"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """docs with the numbers of lines and of dropped lines and the text of the kept lines, under these names."""
    found = docs.join(bitmaps.select(F.col("doc").alias("_doc"), F.col("keep").alias("_keep")), F.col(id_col) == F.col("_doc"), "left")
    lines = _lines(F.col(text_col))
    stay = F.flatten(F.transform("_keep", lambda r: F.slice(lines, r["start"] + 1, r["len"])))
    kept = F.aggregate("_keep", F.lit(0), lambda n, r: n + r["len"])
    listed = F.col("_keep").isNotNull()
    return (
        found.withColumn(names[0], F.size(lines).cast("long"))
        .withColumn(names[1], F.when(listed, F.col(names[0]) - kept).otherwise(0).cast("long"))
        .withColumn(names[2], F.when(listed, F.array_join(stay, "\n")).otherwise(F.coalesce(text_col, F.lit(""))))
        .drop("_doc", "_keep")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a smaller document id holds, as a digest of the text kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = keep_lines(docs, keep_bitmaps(docs, "doc_id", "text"), "doc_id", "text")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
 k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
 f AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
 m AS (SELECT k.doc_id, k.pos, k.line, f.keeper IS NOT NULL AND k.doc_id > f.keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
