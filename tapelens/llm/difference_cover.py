"""Suffix order of all documents by the difference cover modulo 3, as Spark jobs.

The sampled suffixes (places 1 and 2 modulo 3) are named by the sorted distinct triples of
symbols; names that are not unique are ordered by recursion on the string of names. A remaining
suffix is its symbol and the rank of the sampled suffix after it, so its place among the sampled
ones follows from two sorted unions. Equal strings of LENGTH bytes are then neighbours in the
order, and comparing each window with the next one finds every repeat.

Every step is a range sort, an equality join or a count; the driver holds one number per
partition. All suffixes take part, so the shuffles are many times the text; see the README for
figures and for what `suffix_dedup` does about it. Both find the same bytes.

Defined cases: as in `suffix_dedup`; windows never cross the end of a document, because only
windows inside one are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens.llm.suffix_dedup import LENGTH, Hashes, _raw, _texts
from tapelens.session import cut_lineage


def before(rows: DataFrame, order: list[str], amount: str) -> DataFrame:
    """`rows` with `before`: the sum of `amount` over all rows that come earlier in `order`.

    Each range partition adds up its own rows; the driver adds up the partitions.
    """
    names = rows.columns

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + batch[amount].cumsum()
            yield batch.assign(part_=part, before=ends - batch[amount])
            total = int(ends.iloc[-1]) if len(batch) else total

    ddl = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", part_ int, before long"
    summed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(local, ddl))
    sums = {r.part_: r.n for r in summed.groupBy("part_").agg(F.sum(amount).alias("n")).collect()}
    offset, starts = 0, []
    for part in range(max(sums, default=0) + 1):
        starts.append(offset)
        offset += sums.get(part, 0)
    shift = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("part_"))
    return summed.select(*names, (F.col("before") + shift).alias("before"))


def _following(symbols: DataFrame, reach: int) -> DataFrame:
    """at, s0, s1, ...: each place with the symbols after it, 0 beyond the end."""
    spread = symbols.select("sym", F.posexplode(F.array(*[F.col("at") - j for j in range(reach)])).alias("j", "start"))
    return spread.where("start >= 0").groupBy(F.col("start").alias("at")).agg(*[
        F.coalesce(F.max(F.when(F.col("j") == j, F.col("sym"))), F.lit(0)).alias(f"s{j}") for j in range(reach)])


def suffix_ranks(symbols: DataFrame) -> DataFrame:
    """at, rank (from 1) of the suffixes of a string given as (at, sym): places 0 to n-1, symbols from 1."""
    n = symbols.count()
    if n <= 2:
        rows = {r.at: r.sym for r in symbols.collect()}  # two rows at most
        order = sorted(rows, key=lambda i: [rows[j] for j in range(i, n)])
        return symbols.sparkSession.createDataFrame(
            [(at, rank) for rank, at in enumerate(order, 1)], "at long, rank long")
    padded = symbols
    if n % 3 == 1:  # a sampled suffix at the end keeps the two halves of the name string apart
        padded = symbols.unionByName(symbols.sparkSession.createDataFrame([(n, 0)], "at long, sym long"))
    triples = cut_lineage(_following(padded, 3))
    sampled = triples.where("at % 3 <> 0")
    kinds = sampled.select("s0", "s1", "s2").distinct().withColumn("one", F.lit(1).cast("long"))
    named = cut_lineage(sampled.join(
        before(kinds, ["s0", "s1", "s2"], "one").withColumn("name", F.col("before") + 1).drop("before", "one"),
        ["s0", "s1", "s2"]).select("at", "name"))
    if named.select("name").distinct().count() == named.count():
        ranks = named.withColumnRenamed("name", "rank")
    else:
        half = named.where("at % 3 = 1").count()
        place = F.when(F.col("at") % 3 == 1, F.floor(F.col("at") / 3)).otherwise(half + F.floor(F.col("at") / 3))
        inner = suffix_ranks(named.select(place.alias("at"), F.col("name").alias("sym")))
        back = F.when(F.col("at") < half, 3 * F.col("at") + 1).otherwise(3 * (F.col("at") - half) + 2)
        ranks = inner.select(back.alias("at"), "rank")
    ranks = cut_lineage(ranks)
    after = lambda j: ranks.select((F.col("at") - j).alias("at"), F.col("rank").alias(f"r{j}"))
    keyed = cut_lineage(triples.where(F.col("at") < n).join(ranks, "at", "left").join(after(1), "at", "left").join(
        after(2), "at", "left").select("at", "s0", "s1", "rank", *[
            F.coalesce(f"r{j}", F.lit(0)).alias(f"r{j}") for j in (1, 2)],
        (F.col("at") % 3).alias("kind"), (F.col("at") % 3 == 0).cast("long").alias("rest"),
        F.lit(1).cast("long").alias("one")))
    remaining = keyed.where("kind = 0")
    with_one = before(keyed.where("kind <> 2"), ["s0", "r1"], "rest")
    with_two = before(keyed.where("kind <> 1"), ["s0", "s1", "r2"], "rest")
    sample_before = [
        before(keyed.where(f"kind <> {3 - k}").withColumn("held", (F.col("kind") == k).cast("long")),
               order, "held").where("kind = 0").select("at", F.col("before").alias(f"b{k}"))
        for k, order in ((1, ["s0", "r1"]), (2, ["s0", "s1", "r2"]))]
    own = before(remaining, ["s0", "r1"], "one").select("at", F.col("before").alias("b0"))
    rest = own.join(sample_before[0], "at").join(sample_before[1], "at").select(
        "at", (F.col("b0") + F.col("b1") + F.col("b2") + 1).alias("rank"))
    sample = with_one.where("kind = 1").unionByName(with_two.where("kind = 2")).select(
        "at", "before", "rank")
    # the padding suffix, where there is one, is the smallest sampled one and leaves
    sample = sample.select("at", (F.col("before") + F.col("rank") - (1 if n % 3 == 1 else 0)).alias("rank"))
    return cut_lineage(rest.unionByName(sample))


def symbols_of(docs: DataFrame) -> DataFrame:
    """at (place in all texts end to end), sym, and for windows inside a document its id_, key_, start and hash."""
    texts = _texts(docs).select("id_", "key_", "text", F.monotonically_increasing_id().alias("row_"),
                                (F.octet_length("text") + 1).cast("long").alias("size"))
    placed = before(cut_lineage(texts), ["row_"], "size")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, key, text, base in zip(batch["id_"], batch["key_"], batch["text"], batch["before"]):
                raw = _raw(text)
                start = np.arange(len(raw) + 1)
                frame = pd.DataFrame({"at": base + start, "sym": np.append(raw.astype(np.int64) + 2, 1),
                                      "id_": i, "key_": key, "start": start})
                window = np.zeros(len(start), np.int64)
                inside = start[:max(len(raw) - LENGTH + 1, 0)]
                if len(inside):
                    window[inside] = Hashes(raw, 1).of(inside, inside + LENGTH).view(np.int64)
                yield frame.assign(inside=np.arange(len(start)) < len(inside), window=window)

    return placed.select("id_", "key_", "text", "before").mapInPandas(
        rows, "at long, sym long, id_ long, key_ long, start long, inside boolean, window long")


def covered(docs: DataFrame) -> DataFrame:
    """id_, key_, start, stop of every window that starts elsewhere too."""
    places = cut_lineage(symbols_of(docs))
    ranks = suffix_ranks(places.select("at", "sym"))
    inside = places.where("inside").join(ranks, "at").withColumn("one", F.lit(1).cast("long"))
    line = cut_lineage(before(inside.select("rank", "one", "at", "window", "id_", "key_", "start"), ["rank"], "one"))
    after = line.select((F.col("before") - 1).alias("before"), F.col("window").alias("next"))
    ahead = line.select((F.col("before") + 1).alias("before"), F.col("window").alias("last"))
    near = line.join(after, "before", "left").join(ahead, "before", "left")
    return near.where((F.col("window") == F.col("next")) | (F.col("window") == F.col("last"))).select(
        "id_", "key_", "start", (F.col("start") + LENGTH).alias("stop"))
