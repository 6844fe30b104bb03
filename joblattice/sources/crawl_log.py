"""Crawl logs on disk -> crawl records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.crawl_log import successes
from ..schemas import CRAWL_RECORD

_CORRUPT = "_corrupt_record"


def read_crawl_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per file."""
    return spark.read.schema(CRAWL_RECORD).option("multiLine", True).json(path)


def read_crawl_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line; splittable, the layout for large logs."""
    return spark.read.schema(CRAWL_RECORD).json(path)


def read_successes(spark: SparkSession, path: str, lines_path: str) -> DataFrame:
    """Successful records of the array file, or of the line file when that is absent."""
    try:
        return successes(read_crawl_log(spark, path))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return successes(read_crawl_lines(spark, lines_path))


def read_tolerant(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Records of a log that may be missing or damaged; damaged documents give no rows.

    A document is a whole file that holds one array, or with ``multi_line=False`` a line
    that holds one record.
    """
    if multi_line:
        try:
            files = spark.read.text(path, wholetext=True)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], CRAWL_RECORD)
        return parse_crawl_text(files, "value").drop("pos")
    schema = T.StructType([*CRAWL_RECORD.fields, T.StructField(_CORRUPT, T.StringType())])
    try:
        raw = (spark.read.schema(schema).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", _CORRUPT).json(path))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CRAWL_RECORD)
    named = F.col("company").isNotNull()
    return raw.where(F.col(_CORRUPT).isNull() & named).drop(_CORRUPT)


def parse_crawl_text(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records held as JSON text in a column; text that is no JSON array gives no rows."""
    array = T.ArrayType(CRAWL_RECORD)
    listed = df.where(F.col(payload).rlike(r"^\s*\["))
    return (listed.select(*keep, F.posexplode(F.from_json(F.col(payload), array)).alias("pos", "r"))
            .select(*keep, "pos", "r.*").where(F.col("company").isNotNull()))
