"""Repair of conversation structure by weighted CYK parsing over spans of turns.

A repaired conversation is an optional system turn and then user and assistant turns in pairs, or
nothing. The grammar is in Chomsky normal form: its nonterminals are pairs [p, q] of places in
that order (0 nothing yet, 1 after system, 2 after user, 3 after assistant), for the spans of turns
that can be repaired so as to lead from p to q:

    [p, r] -> [p, q] [q, r]          [p, q] -> one turn          start: [0, 0] or [0, 3]

with a cost and a letter for what is done to a turn: keep (K, 0), change its role to user or
assistant (R, 2), delete it (D, 3, the only choice for a blank or repeated turn); a turn that stays
though its text is cut off costs 1 more. Inserting an empty turn (I, 2) needs no turn at all, so
the cell of the empty span is closed over insertions first and then multiplied to both sides of
every turn. A cell holds, per nonterminal, the least (cost, letters). Letters of equal cost over one
span have equally many letters that are not I and equally many I, so none is the beginning of
another and the least whole consists of least parts.

Every nonterminal splits at any place of its span, so one split per span is enough: spans are
joined in pairs, bottom-up by length, inside blocks of BLOCK turns, then BLOCK blocks at a time.
The letters of a conversation, one byte per turn, are one string in the result and in a task; its
texts are not: the repaired turns are made from a sorted stream.

Defined cases: null role and text are one space (such a text is blank); turns are ordered by turn
(null first), then role and text; turns without a conversation id are one conversation of their
own; a role is judged by its first letter; a conversation without turns has cost 0 and no letters; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.llm.turns import numbered
from tapelens.session import cut_lineage

BLOCK = 256
KEEP, RENAME, DELETE, INSERT = "KRDI"
RENAME_COST, DELETE_COST, INSERT_COST, CUT_COST = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
START = ((0, 0), (0, 3))
FOLLOWS = ("su", "ua", "au")

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(entries: Iterator[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    cell: Cell = {}
    for pair, entry in entries:
        if pair not in cell or entry < cell[pair]:
            cell[pair] = entry
    return cell


def product(x: Cell, y: Cell) -> Cell:
    """[p, r] -> [p, q] [q, r]."""
    return _least(((p, r), (a + b, done + then)) for (p, q), (a, done) in x.items()
                  for (q2, r), (b, then) in y.items() if q == q2)


def _insertions() -> Cell:
    """The empty span, closed over insertions."""
    one = {(p, q): (INSERT_COST, INSERT) for (p, role), q in NEXT.items() if role != "s"}
    cell = one | {(p, p): (0, "") for p in range(4)}
    while (more := product(cell, cell)) != cell:
        cell = more
    return cell


EMPTY_SPAN = _insertions()


def _one_turn(code: str) -> Cell:
    """Cell of a turn: its role's letter, then its fault (b blank, d repeated, t cut off, or a dot)."""
    role, fault = code
    moves = [((p, p), (DELETE_COST, DELETE)) for p in range(4)]
    if fault not in "bd":
        extra = CUT_COST if fault == "t" else 0
        moves += [((p, q), (extra, KEEP)) for (p, to), q in NEXT.items() if to == role]
        moves += [((p, q), (extra + RENAME_COST, RENAME)) for (p, to), q in NEXT.items() if to != "s"]
    return product(product(EMPTY_SPAN, _least(iter(moves))), EMPTY_SPAN)


@functools.lru_cache(maxsize=1 << 13)
def cell_of(span: str) -> Cell:
    """Cell of a span of at most BLOCK turns, two characters each, from its two halves."""
    turns = len(span) // 2
    if turns == 1:
        return _one_turn(span)
    middle = turns // 2 * 2
    return product(cell_of(span[:middle]), cell_of(span[middle:]))


def parsed(cell: Cell) -> tuple[int, str]:
    """Least cost and letters of a whole conversation."""
    return min(cell[pair] for pair in START if pair in cell)


PAIRS = sorted(EMPTY_SPAN | _one_turn("s.") | _one_turn("u.") | _one_turn("a."))
_SUMMARY = ["blank", "duplicate", "truncated", "illegal"]
_CELLS = ("key_ string, block long, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string, costs array<int>, letters array<string>")


def _row(key: str, block: int, counts: list[int], first: str, last: str, cell: Cell) -> tuple:
    return (key, block, *counts, first, last, [cell.get(pair, (-1, ""))[0] for pair in PAIRS],
            [cell.get(pair, (-1, ""))[1] for pair in PAIRS])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[part.split()[0] for part in _CELLS.split(", ")])


def classified(turns: DataFrame) -> DataFrame:
    """key_, pos, turn, opens, role_ (first letter), fault_ (b, t or a dot) and same_ (hash of role and text)."""
    ended = F.rtrim("text", F.lit(BLANKS))
    placed = numbered(turns.select("key_", "turn", "role", "text"), "key_")
    return placed.select(
        "key_", "pos", "turn", "opens",
        F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("x").alias("role_"),
        F.when(ended == "", "b").when(F.right(ended, F.lit(1)).isin(*STOPS), ".").otherwise("t").alias("fault_"),
        F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("same_"))


def keyed(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key_"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def blocks_of(marked: DataFrame) -> DataFrame:
    """key_, block and its turns as a string of two characters each."""
    seen = marked.groupBy("key_", "same_").agg(F.min("pos").alias("first_"))
    fault = F.when((F.col("fault_") != "b") & (F.col("pos") > F.col("first_")), "d").otherwise(F.col("fault_"))
    return marked.join(seen, ["key_", "same_"]).groupBy("key_", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("role_", fault).alias("code")))),
                                 lambda t: t["code"]), "").alias("span"))


def cells(marked: DataFrame) -> DataFrame:
    """One cell per conversation, with counts of faults and of illegal neighbours."""
    longest = marked.agg(F.max("pos")).first()[0] or 0

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, block, span in zip(batch["key_"], batch["block"], batch["span"]):
                roles, faults = span[::2], span[1::2]
                pairs = sum(a + b not in FOLLOWS for a, b in zip(roles, roles[1:]))
                rows.append(_row(key, block, [faults.count(f) for f in "bdt"] + [pairs], roles[0], roles[-1], cell_of(span)))
            yield _frame(rows)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Neighbouring cells of sorted blocks, as long as they belong to one larger block."""
        at, state = None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own = {pair: (cost, letters) for pair, cost, letters in zip(PAIRS, row.costs, row.letters) if cost >= 0}
                counts = [getattr(row, name) for name in _SUMMARY]
                if at == (row.key_, row.block // BLOCK):
                    before, first, last, cell = state
                    counts = [a + b for a, b in zip(before, counts)]
                    counts[3] += last + row.first not in FOLLOWS
                    state = counts, first, row.last, product(cell, own)
                    continue
                if at is not None:
                    rows.append(_row(*at, *state))
                at, state = (row.key_, row.block // BLOCK), (counts, row.first, row.last, own)
            yield _frame(rows)
        if at is not None:
            yield _frame([_row(*at, *state)])

    made = blocks_of(marked).mapInPandas(leaves, _CELLS)
    last_block = longest // BLOCK
    while last_block > 0:
        made = made.repartition("key_", F.expr(f"block div {BLOCK}")).sortWithinPartitions("key_", "block").mapInPandas(
            joined, _CELLS)
        last_block //= BLOCK
    return made


def reports(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (letters) of each id in `everyone`."""
    marked = cut_lineage(classified(keyed(turns)))

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [parsed({pair: (int(cost), done) for pair, cost, done in zip(PAIRS, costs, letters) if cost >= 0})
                    for costs, letters in zip(batch["costs"], batch["letters"])]
            yield batch[["key_", *_SUMMARY]].assign(cost=[c for c, _ in best], audit=[a for _, a in best])

    best = cells(marked).mapInPandas(
        least, "key_ string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    spread = marked.groupBy("key_").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_if(F.col("opens") & F.col("turn").isNotNull()), F.lit(0)).alias("gaps"))
    ids = everyone.select("conv_id").distinct().select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key_"))
    counted = ["gaps", *_SUMMARY, "cost"]
    return ids.join(spread, "key_", "left").join(best, "key_", "left").select(
        "key_", "conv_id", *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counted],
        F.coalesce("audit", F.lit("")).alias("audit"))


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, object]]:
    """('head', row of the report) and ('turn', (role, text)) events of sorted heads and turns.

    A head comes before its turns; what is left of its letters when the next one comes are insertions.
    """
    letters, at, asks_user = "", 0, True

    def insertions():
        nonlocal at, asks_user
        while at < len(letters) and letters[at] == INSERT:
            yield "turn", ("user" if asks_user else "assistant", "")
            at, asks_user = at + 1, not asks_user

    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.kind == 0:
                yield from insertions()
                letters, at, asks_user = row.audit, 0, True
                yield "head", row
                continue
            yield from insertions()
            done, at = letters[at], at + 1
            if done == DELETE:
                continue
            role = row.role if done == KEEP else "user" if asks_user else "assistant"
            asks_user = role[0] != "u"
            yield "turn", (role, row.text)
    yield from insertions()


def _stream(turns: DataFrame, report: DataFrame) -> DataFrame:
    """Each conversation's report and then its turns in order, in one task as a sorted stream."""
    said = keyed(turns).withColumn("kind", F.lit(1))
    return report.withColumn("kind", F.lit(0)).unionByName(said, allowMissingColumns=True).repartition(
        "key_").sortWithinPartitions("key_", "kind", F.asc_nulls_first("turn"), "role", "text")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of the repaired conversations."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, conv, place = [], None, 0
        for event, value in _replayed(batches):
            if event == "head":
                conv, place = None if pd.isna(value.conv_id) else int(value.conv_id), 0
                continue
            made.append((conv, place, *value))
            place += 1
            if len(made) == 1000:
                yield _turn_frame(made)
                made = []
        yield _turn_frame(made)

    return _stream(turns, reports(turns, turns)).mapInPandas(rows, "conv_id long, place long, role string, text string")


def _turn_frame(made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(made, columns=["conv_id", "place", "role", "text"]).astype({"conv_id": "Int64"})


def repair_digests(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """The report of every conversation in `everyone`, with the hash of its repaired turns."""
    names = ["conv_id", "gaps", *_SUMMARY, "cost", "audit"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, head, state, empty = [], None, None, True

        def frame() -> pd.DataFrame:
            return pd.DataFrame(made, columns=[*names, "repaired_sha256"]).astype({"conv_id": "Int64"})

        for event, value in _replayed(batches):
            if event == "turn":
                state.update(("" if empty else "\n").encode() + f"{value[0]}:{value[1]}".encode("utf-8", "surrogatepass"))
                empty = False
                continue
            if head is not None:
                made.append((*head, state.hexdigest()))
            if len(made) == 1000:
                yield frame()
                made = []
            head = [None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in (getattr(value, n) for n in names)]
            state, empty = hashlib.sha256(), True
        if head is not None:
            made.append((*head, state.hexdigest()))
        yield frame()

    return _stream(turns, reports(turns, everyone)).mapInPandas(
        rows, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
              "audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage, by crc32 of `conv_id:turn` modulo 20; nulls are one space.

    0 drops a turn, 1 empties its text, 2 takes its stops out, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text: Column = F.coalesce("text", space)
    return turns.select("conv_id", "turn", "role", "text", fate.alias("fate_")).where("fate_ <> 0").select(
        "conv_id", "turn", F.when(F.col("fate_") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("fate_") == 1, "").when(F.col("fate_") == 2, F.regexp_replace(text, f"[{STOPS}]", ""))
        .otherwise(text).alias("text"),
        F.explode(F.when(F.col("fate_") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy_")
    ).drop("copy_")
