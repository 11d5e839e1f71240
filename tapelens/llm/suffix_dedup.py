"""Repeated byte strings of at least LENGTH bytes, within and across documents.

Two equal strings of LENGTH bytes must meet at a sampled place. The sample is a difference cover
that follows the content: of the 151 grams of 50 bytes in a window of 200 bytes the one with the
smallest hash is its anchor, so equal windows have equal anchors at equal offsets, and about one
byte in 75 is an anchor. Steps, all as Spark jobs:

1. anchors are named by their gram; names that occur once end here, with all windows they cover;
2. an anchor's stretch is the union of the windows it is the anchor of; equal stretches under one
   name cover each other whole, whatever their number, by a count;
3. stretches that are alone under a repeated name, with one of each repeated kind, are sorted by
   the bytes after and before their anchor; adjacent ones share the longest prefixes, which
   covers most windows and bounds the others; under names where some are left, the possible
   windows are named by two hashes (gram and 200 bytes, 128 bits together) and counted;
4. per document, covered stretches and windows are merged and the rest is hashed.

No group is gathered: a name's stretches are sorted and read in order, and one text at a time is
in memory. See the README for why the sample is not the fixed one modulo 3.

Defined cases: a null text is empty; a text shorter than LENGTH has nothing removed; repeated
rows (same id and text) are two documents and cover each other; rows with a null `doc_id` take
part like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelens.llm.base import whole_text
from tapelens.session import cut_lineage, scratch_dir

LENGTH, GRAM = 200, 50
_SPAN = LENGTH - GRAM + 1
_PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: Bits of the map of repeated names that tasks look at before they send an anchor on.
MAP_BITS = 27
_MAP_PART = 1 << 15  # words of 64 bits
_ROOTS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, 1 << 16)
        root = np.full(size, _ROOTS[which], np.uint64)
        back = np.full(size, pow(_ROOTS[which], -1, 1 << 64), np.uint64)
        root[0] = back[0] = 1
        _POWERS[which] = np.cumprod(root), np.cumprod(back)
    return _POWERS[which]


class Hashes:
    """64-bit hashes of any stretch of a piece of text, from one running sum."""

    def __init__(self, raw: np.ndarray, which: int):
        up, self.down = _powers(which, len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (self.total[stop] - self.total[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` consecutive ones, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors_of(raw: np.ndarray) -> Iterator[tuple[int, Hashes, Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of a text: its offset, hashes, and of each anchor its name, place, first and last window.

    Pieces overlap so that every window lies in exactly one of them.
    """
    for begin in range(0, max(len(raw) - LENGTH + 1, 0), _PIECE):
        piece = raw[begin:begin + _PIECE + LENGTH - 1]
        one, two = Hashes(piece, 0), Hashes(piece, 1)
        at = np.arange(len(piece) - GRAM + 1)
        grams = one.of(at, at + GRAM)
        # the high bits of the hash, then the place: the leftmost of equal ones is the least
        least = _sliding_least((grams & ~_PLACE) | at.astype(np.uint64), _SPAN)
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        yield begin, one, two, grams[place[first]], place[first], first, last


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _texts(docs: DataFrame) -> DataFrame:
    """id_ and key_ tell documents apart: the id, and a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id_"),
                       F.xxhash64(whole_text()).alias("key_"), whole_text().alias("text"))


def anchor_names(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [name for text in batch["text"] for _, _, _, name, *_ in anchors_of(_raw(text))]
            yield pd.DataFrame({"name": np.concatenate(found or [np.empty(0, np.uint64)]).view(np.int64)})

    return docs.select(whole_text().alias("text")).mapInPandas(rows, "name long")


def name_map(names: DataFrame) -> bytes:
    """A bit map of fixed size (16 MB) in which every name of `names` has its bit set.

    Tasks pack its parts; the driver only puts the parts side by side.

    It only spares the shuffle of names that cannot be repeated; an exact join follows. With very
    many names most bits are set and it spares less.
    """
    bit = F.col("name").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = names.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        found = np.zeros(_MAP_PART, np.int64)
        found[group["word"].to_numpy(np.int64) - part * _MAP_PART] = group["bits"].to_numpy(np.int64)
        return pd.DataFrame({"part": [part], "bits": [found.tobytes()]})

    whole = bytearray(1 << (MAP_BITS - 3))
    for row in words.withColumn("part", F.expr(f"word div {_MAP_PART}")).groupBy("part").applyInPandas(
            packed, "part int, bits binary").toLocalIterator():
        whole[row.part * _MAP_PART * 8:(row.part + 1) * _MAP_PART * 8] = row.bits
    return bytes(whole)


def stretches(docs: DataFrame, names: DataFrame) -> DataFrame:
    """name, content (hash of the stretch and of the anchor's place in it), id_, key_, start, stop.

    Only anchors that may have one of `names`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(name_map(names))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            parts = []
            for i, key, text in zip(batch["id_"], batch["key_"], batch["text"]):
                for begin, one, two, name, place, first, last in anchors_of(_raw(text)):
                    bit = name & np.uint64((1 << MAP_BITS) - 1)
                    may = (known[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    if not may.any():
                        continue
                    name, place, first, last = name[may], place[may], first[may], last[may]
                    whole = two.of(first, last + LENGTH) ^ (
                        (place - first + (last - first) * 4096).astype(np.uint64) * np.uint64(_ROOTS[0]))
                    parts.append(pd.DataFrame({
                        "name": name.view(np.int64), "content": whole.view(np.int64), "id_": i, "key_": key,
                        "start": first + begin, "stop": last + LENGTH + begin}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return _texts(docs).select("id_", "key_", "text").mapInPandas(
        rows, "name long, content long, id_ long, key_ long, start long, stop long")


def _per_stretch(docs: DataFrame, lone: DataFrame, rows, ddl: str) -> DataFrame:
    """Texts with the array `wanted` of what `lone` says about each, through `rows`."""
    about = lone.groupBy("id_", "key_").agg(F.collect_set(F.struct(
        *[c for c in lone.columns if c not in ("id_", "key_")])).alias("wanted"))
    return _texts(docs).select("id_", "key_", "text").join(about, ["id_", "key_"]).mapInPandas(rows, ddl)


def contexts(docs: DataFrame, lone: DataFrame) -> DataFrame:
    """Of the stretches in `lone` the anchor's place and the bytes before (reversed) and from it on."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for i, key, text, wanted in zip(batch["id_"], batch["key_"], batch["text"], batch["wanted"]):
                raw, starts = _raw(text), [w["start"] for w in wanted]
                whole, back = raw.tobytes(), raw[::-1].tobytes()
                for begin, _, _, name, place, first, last in anchors_of(raw):
                    for j in np.flatnonzero(np.isin(first + begin, starts)):
                        at, low, high = (int(x[j]) + begin for x in (place, first, last))
                        made.append((int(name[j].view(np.int64)), i, key, at,
                                     back[len(whole) - at:len(whole) - low], whole[at:high + LENGTH]))
            yield pd.DataFrame(made, columns=["name", "id_", "key_", "at", "left", "right"])

    return _per_stretch(docs, lone, rows, "name long, id_ long, key_ long, at long, left binary, right binary")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def neighbours(found: DataFrame) -> DataFrame:
    """name, id_, key_, at, low, high, spans, open.

    Under one name, the stretch that sorts next by the bytes after the anchor shares most of them,
    the one that sorts next by the bytes before it most of those. A window that starts t bytes
    before its anchor needs t shared bytes before and LENGTH - t after it, so only t from
    LENGTH - (most shared after) to (most shared before) can be shared: `low` to `high`. What one
    neighbour shares on both sides is covered: `spans`. `open` says whether some t is left.
    """
    ties = ["id_", "key_", "at"]
    after = Window.partitionBy("name").orderBy("right", "left", *ties)
    ahead = Window.partitionBy("name").orderBy("left", "right", *ties)
    both = F.struct("left", "right")
    beside = found.select("*", F.lag(both).over(after).alias("a1"), F.lead(both).over(after).alias("a2"),
                          F.lag(both).over(ahead).alias("b1"), F.lead(both).over(ahead).alias("b2"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for r in batch.itertuples(index=False):
                shared = [(common(r.left, y["left"]), common(r.right, y["right"]))
                          for y in (r.a1, r.a2, r.b1, r.b2) if y is not None]
                low = LENGTH - max((after for _, after in shared), default=0)
                high = max((ahead for ahead, _ in shared), default=-1)
                runs = [(LENGTH - y, x) for x, y in shared if LENGTH - y <= x]
                done = merged(np.array([x for x, _ in runs], np.int64), np.array([y + 1 for _, y in runs], np.int64))
                rest = high - low + 1 - sum(y - x for x, y in done)
                made.append((r.name, r.id_, r.key_, r.at, low, high,
                             [{"start": r.at - y + 1, "stop": r.at - x + LENGTH} for x, y in done], rest > 0))
            yield pd.DataFrame(made, columns=["name", "id_", "key_", "at", "low", "high", "spans", "open"])

    return beside.mapInPandas(rows, "name long, id_ long, key_ long, at long, low long, high long, "
                                    "spans array<struct<start:long,stop:long>>, open boolean")


def windows(docs: DataFrame, lone: DataFrame) -> DataFrame:
    """name, window (its hash), id_, key_, start of the windows that `lone` (name, at, low, high) asks for."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for i, key, text, wanted in zip(batch["id_"], batch["key_"], batch["text"], batch["wanted"]):
                raw = _raw(text)
                for w in wanted:
                    begin = w["at"] - w["high"]
                    start = np.arange(w["high"] - w["low"] + 1)
                    hashes = Hashes(raw[begin:w["at"] - w["low"] + LENGTH], 1).of(start, start + LENGTH)
                    parts.append(pd.DataFrame({"name": w["name"], "window": hashes.view(np.int64),
                                               "id_": i, "key_": key, "start": start + begin}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return _per_stretch(docs, lone, rows, "name long, window long, id_ long, key_ long, start long")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows as a compact table in the shared folder."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def covered(docs: DataFrame) -> DataFrame:
    """id_, key_ and stretches [start, stop) that occur elsewhere too; they may overlap."""
    folder = scratch_dir(docs.sparkSession)
    repeated = stored(anchor_names(docs).groupBy("name").agg(F.count(F.lit(1)).alias("k"))
                      .where("k > 1").select("name"), folder, "names")
    found = stored(stretches(docs, repeated).join(repeated, "name"), folder, "stretches")
    kinds = cut_lineage(found.groupBy("name", "content").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct("id_", "key_", "start")).alias("one")))
    whole = found.join(kinds.where("k > 1").select("name", "content"), ["name", "content"], "left_semi")
    open_names = cut_lineage(kinds.groupBy("name").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("k").alias("k")).where("kinds > 1 and k = 1").select("name"))
    lone = cut_lineage(kinds.join(open_names, "name").select("one.*", "k"))
    beside = stored(neighbours(contexts(docs, lone.select("id_", "key_", "start"))), folder, "neighbours")
    undone = beside.where("open").select("name").distinct()
    asked = beside.join(undone, "name").where("low <= high").select("id_", "key_", "name", "at", "low", "high")
    each = stored(windows(docs, asked), folder, "windows")
    shared = cut_lineage(each.groupBy("name", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                         .select("name", "window"))
    single = each.join(shared, ["name", "window"], "left_semi")
    near = beside.select("id_", "key_", F.inline("spans"))
    return whole.select("id_", "key_", "start", "stop").unionAll(near).unionAll(
        single.select("id_", "key_", "start", (F.col("start") + LENGTH).alias("stop")))


def merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    runs: list[tuple[int, int]] = []
    for i in np.argsort(start, kind="stable"):
        if runs and start[i] <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], int(stop[i])))
        else:
            runs.append((int(start[i]), int(stop[i])))
    return runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept_sha256 (of the remaining bytes) of every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text, parts in zip(batch["text"], batch["parts"]):
                raw = text.encode("utf-8", "surrogatepass")
                parts = [] if parts is None else list(parts)
                runs = merged(np.array([p["start"] for p in parts], np.int64),
                              np.array([p["stop"] for p in parts], np.int64))
                ends = [0, *(stop for _, stop in runs)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(raw)]))
                made.append((len(raw), sum(b - a for a, b in runs), len(runs),
                             ",".join(f"{a}:{b}" for a, b in runs), hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(made, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame

    parts = covered(docs).groupBy("id_", "key_").agg(
        F.collect_set(F.struct("start", "stop")).alias("parts"))
    joined = _texts(docs).join(parts, ["id_", "key_"], "left").select("doc_id", "text", "parts")
    return joined.mapInPandas(
        rows, "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept_sha256 string")
