"""Prefix trie of conversations by collapsing whole sequences.

A node is a distinct sequence of first turns. Its key is the exclusive or of two 64-bit hashes of
every (place, role, text) in it, so keys of all prefixes come from running totals and no prefix is
ever written out. Steps, all as Spark jobs:

1. identical conversations fall into one weighted sequence, by the key of the whole; the list of
   their ids is hashed as a sorted stream;
2. sequences that are a proper prefix of another one leave by an anti-join, the rest are leaves;
3. the prefixes of each sequence, with its weight, are added up per node;
4. sums over subtrees: each node belongs to the smallest leaf below it, so the nodes of one leaf
   are the lower end of its path. What lies below a node is the total of all leaves below it
   minus what its own leaf holds above it: one more aggregation of prefixes, linear in the turns.

A conversation or a sequence of any length, and a node with any number of members or children,
is never gathered; only the hash of an end list reads one list in one task, as a stream.

Defined cases: turns are ordered by turn (null first), then role and text; repeated rows are turns
of their own; null role and text are empty; rows with a null `conv_id` belong to no conversation;
without any conversation there is no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.llm.turns import numbered, running
from tapelens.session import cut_lineage

BORROWED = 6  # a conversation takes fewer than this many turns of its group's first one
GROUP = 100
KEY = ["k1", "k2", "depth"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def hashed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), a and b (hashes of role and text), len (code points of the text)."""
    said = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return numbered(said, "conv_id").select(
        "conv_id", "pos", F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "role", "text").alias("b"), F.length("text").cast("long").alias("len"))


def shared_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and their turns rebuilt from the first ones of their group of GROUP ids.

    A conversation c keeps its turns after the first h = crc32(c) % BORROWED and takes the first h
    of conversation c - c % GROUP in their place.
    """
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < BORROWED - 1)).groupBy(
        F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "len"))).alias("first"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    ids = turns.select("conv_id").distinct().select(
        "conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    plan = cut_lineage(ids.join(heads, "base", "left").select(
        "conv_id", "h", F.filter("first", lambda t: t["pos"] < F.col("h")).alias("taken")).select(
        "conv_id", "h", F.coalesce("taken", F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,len:bigint>>"))
        .alias("taken")))
    taken = plan.select("conv_id", F.inline("taken"))
    own = turns.join(plan.select("conv_id", "h", F.size("taken").alias("n")), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "a", "b", "len")
    return plan.select("conv_id"), taken.unionByName(own)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def end_hashes(whole: DataFrame) -> DataFrame:
    """k1, k2, depth, ends_sha256: the ids of each sequence, ascending and comma-joined, hashed.

    A list passes through one task in order; the task holds a hash state and one batch.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*KEY, "ends_sha256"]
        at, state = None, None
        for batch in batches:
            done = []
            keys = batch[KEY].to_numpy()
            ids = batch["conv_id"].astype(str).to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for begin, end in zip(starts, [*starts[1:], len(keys)]):
                key, part = tuple(int(x) for x in keys[begin]), ",".join(ids[begin:end]).encode()
                if key == at:
                    state.update(b"," + part)
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(part)
            yield pd.DataFrame(done, columns=names)
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=names)

    return whole.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInPandas(
        rows, "k1 long, k2 long, depth long, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the conversations in `ids` with `turns` (conv_id, pos, a, b, len)."""
    marked = cut_lineage(turns.select(
        "conv_id", "pos", "len", F.xxhash64(F.lit(1), "pos", "a").alias("k1"),
        F.xxhash64(F.lit(2), "pos", "b").alias("k2")))
    whole = cut_lineage(ids.join(marked.groupBy("conv_id").agg(
        F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.count(F.lit(1)).alias("depth")), "conv_id", "left")
        .select("conv_id", *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in KEY]))
    sequences = cut_lineage(whole.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")))

    # the prefixes of one conversation of each sequence, the root included
    below = marked.join(sequences.select("conv_id"), "conv_id", "left_semi").withColumn(
        "t1", F.col("k1")).withColumn("t2", F.col("k2"))
    keyed = running(below, "conv_id", "pos", ["k1", "k2"], F.bit_xor, _xor)
    zero = F.lit(0).cast("long")
    paths = cut_lineage(keyed.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", _xor(F.col("k1"), F.col("t1")).alias("p1"),
        _xor(F.col("k2"), F.col("t2")).alias("p2"), "len").unionByName(sequences.select(
            "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"),
            zero.alias("len"))))

    proper = paths.join(sequences.select("conv_id", F.col("depth").alias("n")), "conv_id").where("depth < n")
    leaves = cut_lineage(sequences.join(proper.select(*KEY).distinct(), KEY, "left_anti").select(
        "conv_id", F.lit(1).cast("long").alias("leaf")))
    weighted = paths.join(sequences.select("conv_id", "weight"), "conv_id").join(leaves, "conv_id", "left")
    nodes = cut_lineage(weighted.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.coalesce(F.sum("leaf"), zero).alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("len").alias("len"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("len")).drop("len"))

    per_leaf = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("total"))
    under = paths.join(per_leaf, "conv_id").groupBy(*KEY).agg(F.sum("total").alias("under"))
    # the nodes of a leaf are the lower end of its path; `up_to` includes the node itself
    up_to = running(nodes.select("owner", *KEY, "saved"), "owner", "depth", ["saved"], F.sum,
                    lambda a, b: a + b).select(*KEY, F.col("saved").alias("up_to"))
    children = nodes.where("depth > 0").groupBy(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"),
                           F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(under, KEY).join(up_to, KEY).join(children, KEY, "left").join(end_hashes(whole), KEY, "left")
            .join(parents, ["p1", "p2", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("under") - F.col("up_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")))


def shared_prefixes(turns: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt with the beginnings of their groups."""
    hashed = cut_lineage(hashed_turns(turns))
    return trie(*shared_beginnings(hashed))
