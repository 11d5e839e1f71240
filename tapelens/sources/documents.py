"""Documents and logs: ledgers, transcripts, watchlists and the exports for the boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelens import schemas


def _ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines with the text of those that cannot be read in `_corrupt`."""
    return spark.read.schema(f"{schemas.LEDGER}, _corrupt string").option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def broken_ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of every ledger line that `read_ledger` skips."""
    lines = _ledger_lines(spark, path).select("*", F.col("_metadata.file_path").alias("path"))
    return lines.where("_corrupt is not null").select("path", F.col("_corrupt").alias("line"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines; blank lines are skipped, broken ones too (`broken_ledger_lines` lists
    them), missing fields get their defaults."""
    raw = _ledger_lines(spark, path).where("_corrupt is null").drop("_corrupt")
    unknown = {"phase": "?", "endpoint": "?", "transport": "?", "ts": "", "params_hash": "",
               "credits": 0}
    return raw.fillna(unknown)


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").option("ignoreNullFields", True).json(path)


def read_transcripts(spark: SparkSession, path: str, multi_line: bool = True,
                     extra: str = "") -> DataFrame:
    """Transcript files (one document per file, or one per line) with their path; an
    unreadable one is kept with a reason. `extra` names further fields to read."""
    schema = ", ".join(x for x in (extra, schemas.TRANSCRIPT, "_corrupt string") if x)
    raw = (spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").json(path)
           .withColumn("path", F.col("_metadata.file_path")))
    problem = F.when(F.col("_corrupt").isNotNull(), "unreadable document").when(
        F.col("symbol").isNull() | F.col("as_of").isNull(), "not a transcript")
    return raw.withColumn("problem", problem).drop("_corrupt")


def read_watchlists(spark: SparkSession, root: str, lists_glob: str = "*/watchlist.json",
                    logs_glob: str = "*/run.log") -> DataFrame:
    """Watchlist runs, one folder per date, with the lines of their run log.

    The date falls back to the folder name.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})/[^/]+$", 1)
    lists = (spark.read.schema(schemas.WATCHLIST).option("multiLine", True)
             .json(f"{root}/{lists_glob}").withColumn("_day", folder))
    logs = (spark.read.text(f"{root}/{logs_glob}", wholetext=True)
            .select(F.split(F.regexp_replace("value", r"\s+$", ""), "\n").alias("run_log"), folder.alias("_day")))
    return lists.join(logs, "_day", "left").withColumn(
        "as_of", F.coalesce("as_of", "_day")).withColumn(
        "n_candidates", F.size(F.coalesce("candidates", F.array()))).drop("_day")


def export_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON dataset, partitioned so a board reads only the day (or id) it shows."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)
