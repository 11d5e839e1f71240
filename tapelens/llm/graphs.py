"""Connected components over links between documents, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens.session import cut_lineage


ROWS_PER_PART = 50_000


def cut_small(df: DataFrame, rows: int) -> DataFrame:
    """Materialised with a number of partitions that suits at most `rows` narrow rows.

    Shuffles of small tables leave many tiny partitions, each of which would become a file, a
    task and a set of shuffle files in the next step.
    """
    return cut_lineage(df.coalesce(max(1, -(-rows // ROWS_PER_PART))))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c): the smallest vertex that each vertex reaches; only vertices with a link appear.

    Minimum labels spread over the links, then every label is replaced by the label of the
    vertex it names, so a chain of n links needs about log n rounds. Each round is written to
    the shared checkpoint folder. A star with any number of leaves is one aggregated row per
    task and key, and the joins start from plain tables, so that a hot centre can be split.
    """
    one_way = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("v"), F.col(b).alias("u"))
    rows = 2 * one_way.count()
    both = cut_small(one_way.union(one_way.select("u", "v")).distinct(), rows)
    labels = cut_small(both.groupBy("v").agg(F.min("u").alias("u")).select(
        "v", F.least("v", "u").alias("c")), rows)
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(
            F.min("c").alias("m"))
        spread = cut_small(labels.join(near, "v").select(
            "v", F.col("c").alias("old"), F.least("c", "m").alias("c")), rows)
        names = spread.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        new = cut_small(spread.join(names, "c").select("v", "old", F.col("cc").alias("c")), rows)
        labels = new.select("v", "c")
        if new.where(F.col("c") != F.col("old")).isEmpty():
            return labels
