"""Character spans of regular expressions, as columns.

A span is (start, end, kind, text) in code points, end exclusive. Places come from the pieces
between the matches, so a text is read twice at most, and once where nothing matches.

The state of a fold is copied at each step, so no fold gathers all matches of a text: `_running` folds
blocks of BLOCK items. Parts of a text are cut out of chunks (`chunks`, `cut`), never counted from
its start.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelens.functions.scalar import let

SPAN = "struct<start:int,end:int,kind:string,text:string>"
NO_SPANS = f"array<{SPAN}>"
#: Items of a block, characters of a chunk.
BLOCK, CHUNK = 128, 1024


def none() -> Column:
    return F.array().cast(NO_SPANS)


def _running(items: Column, zero: Column, state: str, advance: Callable[[Column, Column], Column],
             emit: Callable[[Column, Column], Column], made: str = NO_SPANS) -> Column:
    """What `emit` (an array) gives for every item and the state before it, in the order of `items`.

    `advance` gives the next state. A first pass carries the state from block to block, a second
    one folds every block from the state at its start.
    """
    empty = F.array().cast(made)

    def of(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")),
                             lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(items) == 0, empty).otherwise(let(blocks, of_blocks))

    def of_blocks(blocks: Column) -> Column:
        entries = F.aggregate(blocks, F.struct(
            zero.cast(state).alias("at"), F.array().cast(f"array<{state}>").alias("seen")),
            lambda s, block: F.struct(
                F.aggregate(block, s["at"], lambda t, item: advance(t, item).cast(state)).alias("at"),
                F.concat(s["seen"], F.array(s["at"])).alias("seen")),
            lambda s: s["seen"])
        return F.flatten(F.zip_with(blocks, entries, of_block))

    def of_block(block: Column, entry: Column) -> Column:
        return F.aggregate(block, F.struct(entry.alias("at"), empty.alias("out")), lambda s, item: F.struct(
            advance(s["at"], item).cast(state).alias("at"),
            F.concat(s["out"], emit(s["at"], item).cast(made)).alias("out")), lambda s: s["out"])

    return let(items, of)


def chunks(body: str | Column) -> Column:
    """The text in parts of CHUNK characters (the last may be shorter)."""
    return F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters `start` to `end` (exclusive; places from 0) of a text given in `chunks`."""
    first = F.floor(start / CHUNK).cast("int")
    count = F.floor(F.greatest(end - 1, start) / CHUNK).cast("int") - first + 1
    return F.when(end > start, F.substring(F.array_join(F.slice(parts, first + 1, count), ""),
                                           start - first * CHUNK + 1, end - start)).otherwise("")


def find(body: str, pattern: str, kind: str, holds: Callable[[Column], Column] | None = None,
         ahead: bool = False) -> Column:
    """Leftmost non-overlapping matches of `pattern` in column `body`; those failing `holds` go.

    With `ahead`, the pattern consumes one character and the span is its group 1, seen by looking
    ahead from there: spans may overlap.
    """
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(1 if ahead else 0))
    before = F.slice(F.split(body, pattern, -1), 1, F.size(found))

    def advance(at: Column, piece: Column) -> Column:
        return at + F.length(piece["before"]) + (F.lit(1) if ahead else F.length(piece["found"]))

    def emit(at: Column, piece: Column) -> Column:
        start = at + F.length(piece["before"])
        return F.array(F.struct(start.alias("start"), (start + F.length(piece["found"])).alias("end"),
                                F.lit(kind).alias("kind"), piece["found"].alias("text")))

    placed = _running(F.arrays_zip(before.alias("before"), found.alias("found")), F.lit(0), "int", advance, emit)
    kept = placed if holds is None else F.filter(placed, lambda span: holds(span["text"]))
    return F.when(F.col(body).rlike(pattern), kept).otherwise(none())


def apart(spans: Column) -> Column:
    """Spans by start, without those that begin inside an earlier one that stays."""

    def advance(at: Column, span: Column) -> Column:
        return F.when(span["start"] >= at, span["end"]).otherwise(at)

    def emit(at: Column, span: Column) -> Column:
        return F.when(span["start"] >= at, F.array(span).cast(NO_SPANS)).otherwise(none())

    return _running(spans, F.lit(0), "int", advance, emit)


def beside(spans: Column, others: Column) -> Column:
    """Those of `spans` (none overlapping the next) that overlap none of `others`, in one sweep by start.

    A span waits until the next one starts, or one of `others` inside it drops it; an earlier one of
    `others` hides it by the furthest end so far. A last span after all texts ends the sweep.
    """
    nothing, behind = F.lit(None).cast(SPAN), F.lit(2**31 - 1)

    def listed(them: Column, rank: int) -> Column:
        return F.transform(them, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s.alias("span")))

    def advance(state: Column, item: Column) -> Column:
        own, span, waits = item["rank"] == 1, item["span"], state["waits"]
        still = F.when(waits["end"] > span["start"], nothing).otherwise(waits)
        fresh = F.when(span["start"] >= state["cover"], span.cast(SPAN)).otherwise(nothing)
        return F.struct(
            F.when(own, state["cover"]).otherwise(F.greatest(state["cover"], span["end"])).alias("cover"),
            F.when(own, fresh).otherwise(still).alias("waits"))

    def emit(state: Column, item: Column) -> Column:
        ready = (item["rank"] == 1) & state["waits"].isNotNull()
        return F.when(ready, F.array(state["waits"]).cast(NO_SPANS)).otherwise(none())

    last = F.array(F.struct(behind.alias("start"), behind.alias("end"), F.lit("").alias("kind"),
                            F.lit("").alias("text"))).cast(NO_SPANS)
    items = F.array_sort(F.concat(listed(others, 0), listed(F.concat(spans, last), 1)))
    swept = _running(items, F.struct(F.lit(0).alias("cover"), nothing.alias("waits")),
                     f"struct<cover:int,waits:{SPAN}>", advance, emit)
    return F.when(F.size(spans) == 0, none()).otherwise(swept)


def ordered(spans: Column, kinds: Sequence[str], by_kind: bool = False) -> Column:
    """Spans by start, then kind as listed; or by kind as listed, then start."""
    listed = F.array(*[F.lit(kind) for kind in kinds])

    def key(span: Column) -> Column:
        rank, start = F.array_position(listed, span["kind"]).cast("int"), span["start"]
        first, second = (rank, start) if by_kind else (start, rank)
        return F.struct(first.alias("a"), second.alias("b"), span.alias("span"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: x["span"])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(body: str, spans: Column, label: str) -> Column:
    """The text with every run of overlapping spans (sorted by start) replaced by `label`."""

    places = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    end = F.array(F.struct(F.length(body).alias("start"), F.length(body).alias("end")))

    def advance(at: Column, span: Column) -> Column:
        return F.greatest(at, span["end"])

    def of(parts: Column) -> Column:
        def emit(at: Column, span: Column) -> Column:
            put = F.when(span["end"] > span["start"], F.lit(label)).otherwise("")
            return F.when(span["start"] >= at, F.array(F.concat(cut(parts, at, span["start"]), put))) \
                .otherwise(F.array().cast("array<string>"))

        return F.array_join(_running(F.concat(places, end), F.lit(0), "int", advance, emit, "array<string>"), "")

    return F.when(F.size(spans) == 0, F.col(body)).otherwise(let(chunks(body), of))
