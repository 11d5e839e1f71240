"""Warehouse tables on Parquet: reads, idempotent upserts, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelens.operators import pit
from tapelens.schemas import TABLES, TableSpec

PART = "part"
UNDATED = "undated"
SLICES = 16
#: Months of a century and the slices are far below this.
MAX_PARTS = 5_000


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Exactly the table's columns, in order: missing ones null, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
        for c, kind in spec.types.items()])


def one_per_key(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Of rows that share a key, the one that sorts last by its other columns in table order."""
    rest = [c for c in spec.columns if c not in spec.key]
    if not rest:
        return rows.distinct()
    last = rows.groupBy(*spec.key).agg(F.max(F.struct(*rest)).alias("_last"))
    return last.select(*[F.col(c) if c in spec.key else F.col(f"_last.{c}") for c in spec.columns])


def merge(old: DataFrame, new: DataFrame, spec: TableSpec) -> DataFrame:
    """New rows replace old ones on the key (null equals null); keyless tables stay distinct."""
    if not spec.key:
        return old.unionByName(new).distinct()
    new = one_per_key(new, spec)
    fresh = new.select(*[F.col(k).alias(f"_new_{k}") for k in spec.key]).distinct()
    same = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in spec.key])
    return old.join(fresh, same, "left_anti").unionByName(new)


def sliced(spec: TableSpec) -> bool:
    """Whether the table is stored by slices of its key instead of by month."""
    return bool(spec.key) and spec.cut not in spec.key


def partition_value(spec: TableSpec) -> Column:
    """Where a row is stored. Equal keys share a partition, so an upsert rewrites only the
    months (or, for the identity table, the hash slices) that the new rows touch."""
    if sliced(spec):
        return F.format_string("h%02d", F.pmod(F.hash(*spec.key), F.lit(SLICES)))
    return F.coalesce(F.date_format(spec.cut, "yyyy-MM"), F.lit(UNDATED))


class Warehouse:
    """A directory with one partitioned Parquet dataset per table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.calendar: DataFrame | None = None

    def location(self, table: str) -> str:
        return f"{self.path}/{table}"

    def exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.location(table))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return path.getFileSystem(conf).exists(path)

    def _stored(self, table: str) -> DataFrame:
        spec = TABLES[table]
        if not self.exists(table):
            return self.spark.createDataFrame([], f"{spec.ddl}, {PART} string")
        return self.spark.read.schema(f"{spec.ddl}, {PART} string").parquet(self.location(table))

    def read(self, table: str, as_of=None, where: str | Column | None = None) -> DataFrame:
        """The table with its declared columns; a missing one is empty, not an error.

        An as-of date also leaves out the later months' folders.
        """
        spec, df = TABLES[table], self._stored(table)
        if as_of is not None:
            df = pit.pit_filter(df, table, as_of)
            if not sliced(spec):
                day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
                df = df.where((F.col(PART) <= F.date_format(day, "yyyy-MM")) | (F.col(PART) == UNDATED))
        df = df.select(*spec.columns)
        return df if where is None else df.where(where)

    def read_between(self, table: str, first: Column, last: Column) -> DataFrame:
        """The table from the folders that hold the days `first` to `last`."""
        spec, df = TABLES[table], self._stored(table)
        if not sliced(spec):
            df = df.where(F.col(PART).between(F.date_format(first, "yyyy-MM"), F.date_format(last, "yyyy-MM")))
        return df.select(*spec.columns)

    def __getitem__(self, table: str) -> DataFrame:
        return self.read(table)

    def upsert(self, table: str, rows: DataFrame, count: bool = True) -> int | None:
        """Merge rows in and return the size of the table afterwards, if it is to be counted.

        Only the folders that the batch touches are read and swapped in by the committer;
        running the same batch again changes nothing. Their names are months or hash slices,
        so the list that the driver holds is short whatever the batch; it is checked.
        """
        spec = TABLES[table]
        new = conform(rows, spec).withColumn(PART, partition_value(spec))
        touched = [row[0] for row in new.select(PART).distinct().limit(MAX_PARTS + 1).collect()]
        if len(touched) > MAX_PARTS:
            raise ValueError(f"{table}: a batch may touch {MAX_PARTS} folders")
        old = self._stored(table).where(F.col(PART).isin(*touched))
        merged = merge(old.select(*spec.columns), new.select(*spec.columns), spec)
        self.calendar = None
        write_sorted(merged.withColumn(PART, partition_value(spec)), spec, self.location(table))
        return self.read(table).count() if count else None

    def summary(self, as_of=None) -> DataFrame:
        return summarise({t: self.read(t, as_of) for t in TABLES})


def write_sorted(df: DataFrame, spec: TableSpec, location: str, mode: str = "overwrite") -> None:
    """Range-partition and sort on the key, so files carry narrow min/max statistics."""
    order = [PART, *(spec.key or spec.columns)]
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
       .write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy(PART).parquet(location))


def summarise(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and first and last known date per table: one aggregate each, no shuffle of rows."""
    parts = [
        df.agg(F.count("*").alias("rows"), F.min(TABLES[name].cut).alias("first"),
               F.max(TABLES[name].cut).alias("last"))
        .select(F.lit(name).alias("table_name"), "rows", "first", "last")
        for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def stamp_missing_date(df: DataFrame, pull_date, column: str = "as_of") -> DataFrame:
    """A fact without a date is known from the day it was pulled, not earlier."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(pull_date).cast("date")))


def sweep_to_table(endpoint: str, rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows of a daily sweep call in the shape of the table they belong to."""
    if endpoint == "fetch-most-traded-stocks":
        return rows.select(
            F.coalesce("trade_date", as_of).alias("trade_date"), "symbol",
            F.col("price").alias("close_price"), "volume",
            F.lit(None).cast("decimal(38,0)").alias("market_cap"))
    if endpoint == "fetch-companies-top-changes":
        return rows.where("last_close is not null").select(
            as_of.alias("trade_date"), "symbol", F.col("last_close").alias("close_price"))
    return rows


def known_symbols(tables) -> DataFrame:
    return tables["free_float"].where("symbol is not null").select("symbol").distinct()
