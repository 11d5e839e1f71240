"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes is evaluated once and gives two signature values, its
minimum and its maximum (a maximum is the minimum of the reversed order, so either value agrees
between two documents with probability equal to their Jaccard similarity). Bands mix both
kinds; documents that share a band are candidates, and every link is confirmed on the full
shingle sets.

Steps, all as Spark jobs:
1. signature rows per document (Arrow batches, the text never leaves this stage);
2. documents with equal shingle sets fall into one class by an aggregation; one document
   stands for its class from here on;
3. every class is compared with the centre it shares most bands with (a bucket names its
   smallest class as centre): one pair per class, whatever the size of a bucket;
4. components over the confirmed links;
5. documents of buckets that still hold several components are searched for links across
   components (links inside one cannot change the result): a similar pair must share one of
   the rarest shingles of both. One round pairs each holder of such a shingle with one member of
   the largest component that holds it, which closes most cases with few pairs; then all
   documents that share one and are still apart are compared, unless its places in the
   order or the counts of their shared shingles by bucket rule the pair out.

So no link that the bands can find is lost and no bucket is expanded into all its pairs.
A pair at the threshold 0.8 misses all 32 bands of 4 values with probability 5e-8.

Defined cases: a null or empty text has an empty set and is linked with nothing; a document
with fewer words than a shingle has its whole word sequence as its only shingle; rows with a
null `doc_id` take no part in linking (component null, kept); each row of a shared `doc_id` links
by its own set; ties go to the smaller `doc_id`; an empty table gives an empty result; extra
columns are ignored. `keep_one_of_each` judges rows by their texts alone, whatever their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelens.llm.base import whole_text
from tapelens.llm.graphs import components, cut_small
from tapelens.session import cut_lineage

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, BAND_VALUES = 32, 4
BUCKETS = 128
PERMUTATIONS = BANDS * BAND_VALUES // 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHE_WORDS = 1 << 20


def _words(text: str) -> list[bytes]:
    """bytes.split() divides at exactly \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    """word -> 64-bit hash; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _hash_set(text: str, k: int, known: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
    size = min(k, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total = _mixed(total + hashes[i:i + count])
    return np.unique(total)


def _signature(shingles: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Band hashes from the minimum and maximum of each permutation a*x+c modulo 2^64."""
    low = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(scale), np.uint64)
    for at in range(0, len(shingles), 2048):
        values = shingles[at:at + 2048, None] * scale + shift
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    both = np.stack([low, high], axis=1).reshape(BANDS, BAND_VALUES)
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_VALUES):
        band = _mixed(band + both[:, i])
    return band.view(np.int64)


def signatures(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set and band hashes of every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale, shift = _odd_numbers(PERMUTATIONS, 11), _odd_numbers(PERMUTATIONS, 12)
        known = _WordHash()
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch["text"]:
                found = _hash_set(text, shingle_words, known)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest())
                bands.append(_signature(found, scale, shift) if len(found) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes,
                                "digest": digests, "bands": bands})

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(
        rows, "doc_id long, n_shingles long, digest string, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle_words: int) -> DataFrame:
    """id and sorted distinct shingle hashes of the documents in `ids`."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHash()
        for batch in batches:
            found = [_hash_set(text, shingle_words, known).view(np.int64) for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "shingles": found})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    return texts.join(ids, "id", "left_semi").mapInPandas(rows, "id long, shingles array<long>")


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    counted = met.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("both"),
                         F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    return counted.where(100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).select(
        "a", "b").distinct()


def rare_shared(sets: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """The shingles of each pool document that any similar pool document must share one of.

    With shingles ordered by how many pool documents have them, two sets with J >= t have a common
    member among the first n - ceil(t * n) + 1 of either. Shingles of one document alone come
    first and cannot be shared, so they only use places up; a document with too many of them
    has no row.
    """
    each = sets.join(pool, "id").select(
        "id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    held_by = each.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = Window.partitionBy("id")
    ranked = each.join(held_by, "s").select(
        "*", F.row_number().over(own.orderBy("k", "s")).alias("place"),
        F.count(F.lit(1)).over(own).alias("m"))
    first = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    return ranked.where(F.col("place") <= first - (F.col("n") - F.col("m"))).select("id", "n", "m", "s", "place")


def in_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with the component c of each id; an id without a link is its own."""
    return rows.join(labels.select(F.col("v").alias("id"), "c"), "id", "left").withColumn(
        "c", F.coalesce("c", "id"))


def open_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys held by several components, with the component that holds most rows."""
    per_component = rows.groupBy(key, "c").agg(F.count(F.lit(1)).alias("k"))
    return per_component.groupBy(key).agg(
        F.max(F.struct("k", "c")).alias("most"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").select(key, F.col("most.c").alias("largest"))


def one_partner_each(rows: DataFrame) -> DataFrame:
    """For each open rare shingle, one member of its largest component for every other holder."""
    met = rows.join(open_keys(rows, "s"), "s")
    chosen = met.where("c = largest").groupBy("s").agg(
        F.min(F.struct(F.xxhash64("id", "s").alias("h"), "id")).alias("one"))
    return met.where("c <> largest").join(chosen, "s").select(
        F.col("id").alias("a"), F.col("one.id").alias("b")).distinct()


def bucket_counts(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """id and, per bucket of the hash, how many shingles it shares with any other of `ids`."""
    each = sets.join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("s"))
    twice = each.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("s")
    spots = each.join(twice, "s").groupBy("id", F.pmod("s", F.lit(BUCKETS)).cast("int").alias("at")).agg(
        F.count(F.lit(1)).cast("int").alias("k"))
    counts = F.map_from_entries(F.collect_list(F.struct("at", "k")))
    return spots.groupBy("id").agg(counts.alias("by")).select("id", F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda at: F.coalesce(F.try_element_at("by", at), F.lit(0))).alias("counts"))


def across_components(rows: DataFrame, percent: int, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) in different components that share a rare shingle and may be similar.

    `need` is the overlap that the two sizes ask for. A pair that reaches it shares one of the
    first m - need + 1 shingles of either, and a shared shingle at two places of the common
    order bounds the overlap: up to it as many as the earlier place allows, after it as many as
    the shorter rest has. Near misses of one template pass these bounds; they lack different
    parts of it, so two sets also have no more in common than the smaller counts of their
    buckets add up to.
    """
    met = rows.join(open_keys(rows, "s"), "s")
    met = met.join(bucket_counts(sets, met.select("id").distinct()), "id")
    small = met.where("c <> largest").select("s", *[
        F.col(name).alias(f"{name}_a") for name in ("id", "n", "c", "m", "place", "counts")])
    need = F.ceil(percent * (F.col("n") + F.col("n_a")) / (100 + percent))
    most = F.least("place", "place_a") + F.least(F.col("m") - F.col("place"), F.col("m_a") - F.col("place_a"))
    common = F.aggregate(F.zip_with("counts", "counts_a", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    across = met.join(small, "s").where(
        (F.col("c") != F.col("c_a"))
        & ((F.col("c") == F.col("largest")) | (F.col("id") < F.col("id_a")))
        & (F.col("place") <= F.col("m") - need + 1) & (F.col("place_a") <= F.col("m_a") - need + 1)
        & (most >= need) & (common >= need))
    return across.select(F.col("id_a").alias("a"), F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    marks = cut_lineage(signatures(docs, shingle_words))
    linked = marks.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut_lineage(linked.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")))

    spread = classes.select("id", "n", F.explode("bands").alias("band"))
    shared = cut_lineage(spread.groupBy("band").agg(
        F.min("id").alias("centre"), F.max("id").alias("last")).where("centre <> last")
        .select("band", "centre"))
    members = cut_lineage(spread.join(shared, "band").select("id", "band", "centre"))
    size = members.count()
    first = members.where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("k"))
    pairs = cut_small(first.groupBy("id").agg(
        F.max(F.struct("k", (-F.col("centre")).alias("minus"))).alias("best"))
        .select(F.col("id").alias("a"), (-F.col("best.minus")).alias("b")), size)
    sets = cut_lineage(shingle_sets(docs, members.select("id").distinct(), shingle_words))
    links = cut_small(confirmed(sets, pairs, percent), size)
    labels = components(links)

    placed = in_components(members, labels)
    pool = cut_small(placed.join(open_keys(placed, "band"), "band").select("id").distinct(), size)
    rare = cut_lineage(rare_shared(sets, pool, percent))
    for partners in (one_partner_each, across_components):
        found = partners(cut_lineage(in_components(rare, labels)), *(
            [percent, sets] if partners is across_components else []))
        more = cut_small(confirmed(sets, found, percent), size)
        if not more.isEmpty():
            links = cut_small(links.unionAll(more), size)
            labels = components(links)

    of_class = cut_lineage(classes.select("digest", "id").join(
        labels.withColumnRenamed("v", "id"), "id", "left")
        .select("digest", F.coalesce("c", "id").alias("component_id")))
    with_class = marks.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return with_class.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                     percent: int = PERCENT) -> DataFrame:
    """One row of every component stays, that with the smallest id (null ids last).

    Rows are judged by their texts: rows with one id and different texts are documents of their own,
    copies under a null id are copies. Rows with equal id and text are one.
    """
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                     F.coalesce(F.octet_length("text"), F.lit(-1)), whole_text())
    rows = docs.select(row.alias("doc_id"), F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id")).alias("first"), "text")
    found = near_duplicates(rows.select("doc_id", "text"), shingle_words, percent).where("n_shingles > 0")
    placed = found.select("doc_id", "component_id").distinct().join(
        rows.select("doc_id", "first").distinct(), "doc_id")
    best = placed.groupBy("component_id").agg(F.min(F.struct("first", "doc_id")).alias("best_"))
    dropped = cut_lineage(placed.join(best, "component_id").where(F.col("doc_id") != F.col("best_.doc_id"))
                          .select(F.col("doc_id").alias("row_")))
    names = [F.col(f"`{name}`") for name in docs.columns]
    marked = docs.select(F.struct(*names).alias("whole_"), row.alias("row_")).join(dropped, "row_", "left_anti")
    return marked.dropDuplicates(["row_"]).select("whole_.*")
