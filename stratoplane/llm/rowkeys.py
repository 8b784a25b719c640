"""A key for every row of a table of files: the file and the row's place in it, the same in every read, however splits fall."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared_store import written


def _of_files(df: DataFrame) -> bool:
    """Whether df is columns and filters of one table of Parquet files, so that each row has a place of its own."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "parquet" in str(node.toString()).lower()


def keyed(df: DataFrame) -> DataFrame:
    """df with _file (a hash of the file's path) and _row (the place in it). Rows that do not come from files are written first."""
    held = df if _of_files(df) else written(df, "rows")
    return held.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
