"""Jaccard join of documents on word shingles by the size-aware heavy-light method.

Sets are small or large. Small sets enumerate fixed-size subsets (SUBSET shingles) and meet under
equal subsets; large sets scan the inverted lists of single shingles, against each other and
against the small sets within reach. Where small ends is chosen by cost: per size, the number of
subsets against the lengths of the lists. Overlap bounds make both sides exact and cheap: two sets
with similarity t share at least t times the larger size, so in any common order their first k
shared members lie among the first n - ceil(t n) + k of either set; only those take part.

Steps, all as Spark jobs:

1. one pass over the texts: size, digest and the lowest hashes of every set (about 0.3 n); documents
   with equal sets are one class from here on;
2. a set that shares with the other sets fewer of its lowest hashes than any similar one would has no
   partner and ends here (a shared passage is not enough, so its list is never joined);
3. each remaining set is compared with the centre it shares most of them with, so groups of copies
   close with one pair per member; sets that share enough with another component stay open;
4. the members of open sets are ordered with the rarest first, costs are summed up per size in at
   most 64 * BUCKETS buckets, the boundary is chosen and subsets and lists are made;
5. each holder of an open list or subset is compared with one member of the largest component
   there; what is still apart and meets is compared in full, as far as sizes and places in the order
   allow the overlap.

Links inside a component cannot change the result, so no group is expanded into all its pairs;
every pair of different components that may be similar is compared. Pages of one template that
differ by just too much remain candidates of each other: their number is that of such pairs.

Defined cases: a null or empty text has an empty set and is linked with nothing; with fewer words
than a shingle, the whole word sequence is the only one; rows with a null `doc_id` take no part
(component null); rows that share a `doc_id` are one document, linked by any of its texts; ties
go to the smaller `doc_id`; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelens.llm.base import whole_text
from tapelens.llm.graphs import components, cut_small
from tapelens.llm.minmax_dedup import _hash_set, _WordHash, in_components, one_partner_each, open_keys
from tapelens.llm.suffix_dedup import MAP_BITS, name_map, stored
from tapelens.session import cut_lineage, scratch_dir

SHINGLE_WORDS, PERCENT, SUBSET = 5, 80, 2
#: A set shows the shingles among which n // SHOWN shared ones must lie.
SHOWN = 10
BUCKETS = 8  # per doubling of the size
BROADCAST_ROWS = 500_000


def _need(n, percent: int):
    """Least overlap of a set of n members with any similar one."""
    return -(-percent * n // 100)


def marks_of(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set and its lowest hashes, for every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHash()
        for batch in batches:
            sizes, digests, lowest = [], [], []
            for text in batch["text"]:
                found = _hash_set(text, shingle_words, known)
                n = len(found)
                sizes.append(n)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                lowest.append(found[:n - _need(n, percent) + max(1, n // SHOWN)].view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": sizes, "digest": digests, "lowest": lowest})

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(
        rows, "doc_id long, n long, digest binary, lowest array<long>")


def looked_up(rows: DataFrame, keys: DataFrame, on: list[str], how: str, size: int) -> DataFrame:
    """`rows` joined with `keys`, which are broadcast only where their number is known to be small."""
    return rows.join(F.broadcast(keys) if size <= BROADCAST_ROWS else keys, on, how)


def shown_members(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n, s: the lowest hashes of each class that other classes show too.

    A bit map of fixed size spares the shuffle of most others; the join is exact.
    """
    copies = marks.join(classes, "digest").where("doc_id <> id").select("doc_id", "digest")
    copies = cut_lineage(copies)
    chosen = looked_up(marks, copies, ["doc_id", "digest"], "left_anti", copies.count())
    shared = cut_lineage(chosen.select(F.explode("lowest").alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("k")).where("k > 1").select("name"))
    known = marks.sparkSession.sparkContext.broadcast(name_map(shared))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_may_be(known.value, lowest) for lowest in batch["lowest"]]
            yield _spread(batch[["doc_id", "n"]], found).rename(columns={"doc_id": "id"})

    likely = chosen.select("doc_id", "n", "lowest").mapInPandas(rows, "id long, n long, name long")
    return likely.join(shared, "name", "left_semi").select("id", "n", F.col("name").alias("s")).distinct()


def _may_be(bits: bytes, names: np.ndarray) -> np.ndarray:
    """Those of `names` that have their bit set in the map."""
    words, low = np.frombuffer(bits, np.uint64), names.view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)
    return names[(words[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1]


def _spread(about: pd.DataFrame, names: list[np.ndarray]) -> pd.DataFrame:
    """One row per name, with the columns of its row in `about`."""
    return about.loc[about.index.repeat([len(x) for x in names])].assign(
        name=np.concatenate([*names, np.empty(0, np.int64)]))


def enough(rows: DataFrame, percent: int) -> DataFrame:
    """id of every set with as many rows as any similar one would share."""
    least = F.greatest(F.lit(1), F.floor(_least(F.col("n"), percent) / SHOWN))
    return rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("id").distinct()


def _least(n: Column, percent: int) -> Column:
    return F.ceil(percent * n / 100)


def shared_sets(docs: DataFrame, ids: DataFrame, size: int, shingle_words: int, folder: str) -> DataFrame:
    """id, n (size), set_ (a hash) and hashes of the documents in `ids`, one row per document and set."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHash()
        for batch in batches:
            found = [_hash_set(text, shingle_words, known).view(np.int64) for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n": [len(s) for s in found], "set_": [
                int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=7).digest()) for s in found], "shingles": found})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    sets = stored(looked_up(texts, ids, ["id"], "left_semi", size).mapInPandas(
        rows, "id long, n long, set_ long, shingles array<long>"), folder, "rows")
    if sets.groupBy("id", "set_").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        return sets
    return stored(sets.dropDuplicates(["id", "set_"]), folder, "sets")


def ordered(sets: DataFrame, percent: int, k: int) -> DataFrame:
    """id, n, m, s, place: the members of each set among which its first k shared ones must lie.

    The rarest come first. Members of one set only cannot be shared: they use places up and have no
    row; m counts the others.
    """
    held = cut_lineage(sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(
        F.count(F.lit(1)).alias("df")).where("df > 1"))
    known = sets.sparkSession.sparkContext.broadcast(name_map(held.select(F.col("s").alias("name"))))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members that other sets may have, of sets with enough of them."""
        for batch in batches:
            found = [_may_be(known.value, shingles) for shingles in batch["shingles"]]
            yield _spread(batch[["id", "set_", "n"]], [
                x if len(x) >= _need(n, percent) else x[:0] for n, x in zip(batch["n"], found)])

    each = sets.mapInPandas(rows, "id long, set_ long, n long, name long").withColumnRenamed("name", "s")
    own = Window.partitionBy("id", "set_")
    ranked = each.join(held, "s").select("*", F.row_number().over(own.orderBy("df", "s")).alias("place"),
                                         F.count(F.lit(1)).over(own).alias("m"))
    reach = F.col("n") - _least(F.col("n"), percent) + k
    return ranked.where((F.col("m") >= _least(F.col("n"), percent)) & (
        F.col("place") <= reach - (F.col("n") - F.col("m")))).withColumn(
        "single", F.col("place") <= reach - (F.col("n") - F.col("m")) - (k - 1)).drop("df")


def _bucket(n: Column) -> Column:
    return F.floor(F.log2(n) * BUCKETS).cast("int")


def boundary(rows: DataFrame, k: int) -> int:
    """The size bucket up to which subsets cost less than lists; at most 64 * BUCKETS sums come here.

    Lists cost an entry per member and every other entry that it meets. Subsets cost an entry for each
    and, at most, what their rarer members meet in the lists.
    """
    lists = rows.groupBy("s").agg((F.count(F.lit(1)) - 1).cast("double").alias("others"))
    per_set = rows.join(lists, "s").groupBy("id", "set_", "n").agg(
        F.count(F.lit(1)).cast("double").alias("p"), F.sum("others").alias("met"),
        F.sum(F.col("others") * F.col("place")).alias("placed"),
        F.sum(F.when(F.col("single"), F.col("others") + 1)).alias("scan"))
    ways = F.lit(1.0)
    for i in range(k):
        ways = ways * (F.col("p") - i) / (i + 1)
    costs = sorted((r.b, r.subsets, r.scan or 0.0) for r in per_set.groupBy(_bucket(F.col("n")).alias("b")).agg(
        F.sum(ways + F.col("p") * F.col("met") - F.col("placed")).alias("subsets"), F.sum("scan").alias("scan")).collect())
    best, total = -1, sum(scan for _, _, scan in costs)
    least = total
    for b, made, scan in costs:
        total += made - scan
        if total < least:
            best, least = b, total
    return best


def meetings(rows: DataFrame, limit: int, percent: int, k: int) -> DataFrame:
    """s (a subset or a shingle), id, n, m, place, large: the entries under which sets meet."""
    large = _bucket(F.col("n")) > limit
    marked = rows.withColumn("large", large)
    # a small set can meet a large one only if the smallest large one is not out of its reach
    near = _bucket(F.floor(F.col("n") * 100 / percent)) > limit
    lists = marked.where(F.col("single") & near).select(
        F.xxhash64(F.lit(1), "s").alias("s"), "id", "n", "m", "place", "large", F.lit(True).alias("listed"))
    small = marked.where(~F.col("large")).groupBy("id", "set_", "n", "m").agg(
        F.array_sort(F.collect_list(F.struct("place", "s"))).alias("own"))
    chosen = F.transform("own", lambda x: F.struct(x["place"].alias("place"), F.xxhash64(F.lit(2), x["s"]).alias("key")))
    for _ in range(k - 1):  # every subset grows by each later member
        chosen = F.flatten(F.transform(chosen, lambda have: F.transform(
            F.filter("own", lambda x: x["place"] > have["place"]),
            lambda x: F.struct(x["place"].alias("place"), F.xxhash64(have["key"], x["s"]).alias("key")))))
    subsets = small.select("id", "n", "m", F.explode(chosen).alias("x")).select(
        F.col("x.key").alias("s"), "id", "n", "m", F.col("x.place").alias("place"),
        F.lit(False).alias("large"), F.lit(False).alias("listed"))
    return lists.unionByName(subsets)


def to_centres(met: DataFrame) -> DataFrame:
    """Each set with the smallest id of its lists that it meets most often."""
    centre = met.groupBy("s").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("b <> last").select("s", "b")
    counted = met.join(centre, "s").where("id <> b").groupBy("id", "b").agg(F.count(F.lit(1)).alias("k"))
    return counted.groupBy("id").agg(F.max(F.struct("k", (-F.col("b")).alias("minus"))).alias("best")).select(
        F.col("id").alias("a"), (-F.col("best.minus")).alias("b"))


def across(met: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that meet and whose sizes and places allow the overlap.

    A pair is taken where its first shared members are: none lies before them, so the rest after
    the last of them bounds the overlap.
    """
    open_ = met.join(open_keys(met, "s"), "s")
    few = open_.where("c <> largest").select("s", *[F.col(name).alias(f"{name}_a") for name in (
        "id", "n", "c", "m", "place", "large")])
    need = F.ceil(percent * (F.col("n") + F.col("n_a")) / (100 + percent))
    most = F.when(F.col("listed"), 1).otherwise(SUBSET) + F.least(
        F.col("m") - F.col("place"), F.col("m_a") - F.col("place_a"))
    pairs = open_.join(few, "s").where(
        (F.col("c") != F.col("c_a")) & ((F.col("c") == F.col("largest")) | (F.col("id") < F.col("id_a")))
        & (~F.col("listed") | F.col("large") | F.col("large_a")) & (F.least("m", "m_a") >= need) & (most >= need))
    return pairs.select(F.col("id_a").alias("a"), F.col("id").alias("b")).distinct()


def confirmed(sets: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of `size` pairs (a, b) that are similar enough, by the full sets."""
    of_a = looked_up(sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a")),
                     pairs, ["a"], "inner", size)
    ends = looked_up(sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b")),
                     pairs.select("b").distinct(), ["b"], "left_semi", size)
    met = of_a.join(ends, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return met.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"),
                      F.size(F.array_intersect("of_a", "of_b")).alias("shared")).where(
        100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).select("a", "b").distinct()


def similar_documents(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT,
                      subset: int = SUBSET) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    if not 50 < percent <= 100 or subset != 2:
        raise ValueError("subsets of two shingles need a similarity above 50 percent")
    folder = scratch_dir(docs.sparkSession)
    marks = stored(marks_of(docs, shingle_words, percent), folder, "marks")
    linked = marks.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = cut_lineage(linked.groupBy("digest").agg(F.min("doc_id").alias("id")))
    of_row = linked.select("doc_id", "digest").join(classes, "digest")
    several = marks.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    same = cut_lineage(of_row.join(several, "doc_id", "left_semi").select(
        F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b"))

    shown = stored(shown_members(linked, classes), folder, "shown")
    ids = cut_lineage(enough(shown, percent))
    size = ids.count()
    sets = shared_sets(docs, ids, size, shingle_words, folder)
    shown = stored(looked_up(shown, ids, ["id"], "left_semi", size), folder, "alive")

    def linked_by(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(pairs, folder, name)
        return cut_small(confirmed(sets, pairs, pairs.count(), percent), size)

    links = cut_small(linked_by(to_centres(shown), "centres").unionAll(same), size)
    labels = components(links)

    placed = in_components(shown, labels)
    pool = cut_lineage(enough(placed.join(open_keys(placed, "s"), "s"), percent))
    rows = stored(ordered(looked_up(sets, pool, ["id"], "left_semi", size), percent, subset), folder, "ordered")
    met = stored(meetings(rows, boundary(rows, subset), percent, subset), folder, "met")
    met = stored(met.join(met.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "s", "left_semi"), folder, "shared")
    for name, pairs in ("one", one_partner_each), ("across", lambda entries: across(entries, percent)):
        more = linked_by(pairs(in_components(met, labels)), name)
        if not more.isEmpty():
            links = cut_small(links.unionAll(more), size)
            labels = components(links)

    reached = classes.join(labels.select(F.col("v").alias("id"), "c"), "id", "left").select(
        "digest", F.coalesce("c", "id").alias("component_id"))
    # a document with several texts is in the labels itself
    found = marks.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(reached, "digest", "left").join(
        labels.join(several, labels["v"] == several["doc_id"], "left_semi").select(
            F.col("v").alias("doc_id"), F.col("c").alias("own_")), "doc_id", "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(
        F.col("doc_id").isNotNull(), F.least("own_", alone)).alias("component_id"))
