"""Benchmark passages in documents: item-sized windows, SimHash, Hamming blocks, exact check.

A window of a document has as many words as the item it is compared with. Only windows that
share a shingle with some item of that length can be similar at all; their places come from one
join on shingles. Each such window gets a 64-bit SimHash of its weighted shingles (a weight is a
shingle's count in the window). Fingerprints are cut into eight blocks of eight bits, and the
item side is joined under every block value at most two bits away: two fingerprints at a
distance of up to RADIUS = 8 * (2 + 1) - 1 bits agree so in one block at least, so the join
finds all of them. Candidates are verified by the exact weighted Jaccard similarity of their
shingles. At a similarity of 0.8 the expected distance is 10 bits with a deviation of 3; RADIUS is
more than four deviations away.

Defined cases: a null or empty text or item matches nothing; an item with fewer words than a
shingle is one shingle of its own length; a document shorter than the item is one window; a row
with a null `doc_id` is searched like the others and reported under null; repeated rows are
reported once per id and text; of equally similar windows the first is reported; empty tables
give an empty result; extra columns are ignored. Lanes of the fingerprint hold up to 65,535
shingles; longer items keep exact verification, but a less accurate fingerprint.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.llm.base import bits_of, whole_text, word_list
from tapelens.session import cut_lineage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_FLIPS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_FLIPS + 1) - 1
#: Tables of the benchmark side are broadcast up to so many bytes of all their rows.
BROADCAST_BYTES = 64 << 20
_LANES = 0x0001000100010001


def _shingles(words: Column, size: Column | int) -> Column:
    """All runs of `size` words as strings; none where there are fewer words."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(words) >= size, F.transform(
        F.sequence(F.lit(1), F.size(words) - size + 1),
        lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(
        F.array().cast("array<string>"))


def _placed(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """`keep`, place (from 1) and hash of every run of `size` words of column `words`."""
    count = F.greatest(F.size("words") - (size - 1), F.lit(0))
    grams = F.arrays_zip(*[F.slice("words", j + 1, count).alias(f"w{j}") for j in range(size)])
    return rows.select(*keep, F.posexplode(grams).alias("at", "gram")).select(
        *keep, (F.col("at") + 1).alias("at"),
        F.xxhash64(*[F.col(f"gram.w{j}") for j in range(size)]).alias("h"))


def simhash(shingles: Column) -> Column:
    """64 majority bits over the hashes of all shingles, repeated ones counted again.

    Sixteen sums hold four counters each: sum k adds bits k, k+16, k+32 and k+48 of a hash.
    """
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def lanes(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total + F.shiftrightunsigned(
            h, k).bitwiseAND(F.lit(_LANES)))

    return F.struct(F.size(shingles).alias("m"), *[lanes(k).alias(f"s{k}") for k in range(16)])


def _majority(sums: str) -> Column:
    def lane(bit: int) -> Column:
        total = F.col(f"{sums}.s{bit % 16}")
        return F.shiftrightunsigned(total, 16 * (bit // 16)).bitwiseAND(F.lit(0xFFFF))

    flags = [2 * lane(bit) > F.col(f"{sums}.m") for bit in range(63)]
    top = F.when(2 * lane(63) > F.col(f"{sums}.m"), F.lit(-(1 << 63)).cast("long")).otherwise(
        F.lit(0).cast("long"))
    return bits_of(flags).bitwiseOR(top)


def _with_simhash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sums_", simhash(F.col("shingles"))).withColumn(
        "fingerprint", _majority("sums_")).drop("sums_")


def _block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _near_values() -> list[int]:
    return [mask for mask in range(1 << BLOCK_BITS) if mask.bit_count() <= BLOCK_FLIPS]


def _sized(side: DataFrame) -> DataFrame:
    """With a broadcast hint only below the documented number of bytes, a plain join beyond."""
    held = F.lit(8 * (1 + len(side.columns))).cast("long")
    for name, kind in side.dtypes:
        if kind == "string":
            held = held + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            held = held + F.coalesce(F.aggregate(name, F.lit(0).cast("long"), lambda n, s: n + 16 + F.octet_length(s)), F.lit(0))
    return F.broadcast(side) if (side.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES else side


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle arrays: shared counts over the counts of either."""
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    shared = F.when(distinct, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x))))
    return shared.cast("double") / (F.size(a) + F.size(b) - shared)


def items_of(benchmark: DataFrame) -> DataFrame:
    words = benchmark.select(
        "item_id", word_list(F.lower(whole_text())).alias("words")).where(F.size("words") > 0)
    sized = words.withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(SHINGLE_WORDS)))
    return _with_simhash(sized.withColumn("shingles", _shingles(F.col("words"), F.col("k"))))


def _document_texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id_"),
        F.xxhash64(whole_text()).alias("hash_"), whole_text().alias("text"))


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All item-sized windows that share a shingle with an item of their size."""
    texts, lowered = _document_texts(docs), word_list(F.lower(F.col("text")))
    words = texts.select("id_", "hash_", lowered.alias("words")).withColumn("of", F.size("words"))
    found = []
    for size in sorted(row.k for row in items.select("k").distinct().collect()):  # at most five values
        known = _placed(items.where(F.col("k") == size), ["n", "k"], size).select("n", "k", "h").distinct()
        found.append(_placed(words, ["id_", "hash_", "of"], size).join(_sized(known), "h").select(
            "id_", "hash_", "n", "k", "of", "at"))
    if not found:
        return texts.where(F.lit(False)).select(
            "doc_id", "id_", "hash_", F.lit(0).alias("n"), F.lit(0).alias("start"),
            F.array().cast("array<string>").alias("shingles"))
    anchors = functools.reduce(DataFrame.unionAll, found)
    first = F.greatest(F.lit(1), F.col("at") - F.col("n") + F.col("k"))
    last = F.least(F.col("at"), F.greatest(F.lit(1), F.col("of") - F.col("n") + 1))
    starts = cut_lineage(anchors.groupBy("id_", "hash_", "n", "k").agg(F.array_distinct(F.flatten(
        F.collect_set(F.sequence(first, last)))).alias("starts")))
    cut = texts.join(starts, ["id_", "hash_"]).dropDuplicates(["id_", "hash_", "n"]).withColumn(
        "words", lowered)
    each = cut.select("doc_id", "id_", "hash_", "n", "k", "words", F.explode("starts").alias("start"))
    return each.withColumn("window", F.slice("words", F.col("start"), F.col("n"))).select(
        "doc_id", "id_", "hash_", "n", "start", _shingles(F.col("window"), F.col("k")).alias("shingles"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Per document and item found in it: the best window and its similarity."""
    items = cut_lineage(items_of(benchmark).withColumn("item_row", F.monotonically_increasing_id()))
    near = F.array(*[F.lit(mask) for mask in _near_values()])
    sides = items.select(
        "item_row", "n", F.col("fingerprint").alias("item_fingerprint"),
        F.posexplode(F.array(*[_block(F.col("fingerprint"), i) for i in range(BLOCKS)]))
        .alias("block", "part"))
    keys = sides.select("*", F.explode(near).alias("mask")).withColumn(
        "value", F.col("part").bitwiseXOR(F.col("mask"))).drop("part", "mask")
    prints = _with_simhash(windows(docs, items))
    parts = prints.select("*", F.posexplode(F.array(*[
        _block(F.col("fingerprint"), i) for i in range(BLOCKS)])).alias("block", "value"))
    met = parts.join(_sized(keys), ["n", "block", "value"])
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    first_block = F.coalesce(*[
        F.when(F.bit_count(_block(apart, i)) <= BLOCK_FLIPS, F.lit(i)) for i in range(BLOCKS)])
    candidates = met.where((F.col("block") == first_block) & (F.bit_count(apart) <= RADIUS))
    texts = items.select("item_row", "item_id", F.col("shingles").alias("item_shingles"))
    scored = candidates.join(_sized(texts), "item_row").withColumn(
        "similarity", similarity(F.col("shingles"), F.col("item_shingles"))).where(
        F.col("similarity") >= threshold)
    best = scored.groupBy("id_", "hash_", "doc_id", "item_id", "n").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("minus"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.minus")).cast("long").alias("start_word"),
                       F.col("n").cast("long").alias("n_words"),
                       F.col("best.similarity").alias("similarity"), "id_", "hash_")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Documents without a benchmark passage, with the columns they came with."""
    bad = cut_lineage(contaminated(docs, benchmark, threshold).select("id_", "hash_").distinct())
    keyed = docs.withColumn("id_", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(
        "hash_", F.xxhash64(whole_text()))
    return keyed.join(bad, ["id_", "hash_"], "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns])
