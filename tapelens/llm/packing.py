"""Token sequences packed by the sum-of-squares rule.

A document (its ids and one end id) longer than a sequence is cut into whole sequences, of which
only the first piece may be shorter; so at most one piece per document has to be packed. Pieces
are dealt at random into blocks of bounded size that Spark packs in parallel. Inside a block,
longest first, a piece goes into the open sequence for which the sum over residual gaps of
(open sequences with that gap) squared becomes smallest; a new sequence is opened only where no
open one has room. A block ends with about one sequence that is not full.

Ids come from the tokenizer file named by its path. They are computed by a faster engine
from the ranks in that file; unusually long unbroken runs, on which that engine is slow, and
files of another kind go through the file's own library. Both give the same ids.

Defined cases: a null or empty text is the end id alone; repeated rows and null `doc_id`s are
documents of their own; ties go to the smaller gap and the piece listed first; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens.llm.base import whole_text
from tapelens.session import cut_lineage

CAPACITY = 1024
END_ID = 2
BLOCK_ROWS = 8192
#: Unbroken runs from this many characters go through the file's own library.
LONG_RUN = 4096
#: The split into words that a byte-level file with `use_regex` stands for (fixed value).
BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def default_tokenizer() -> str:
    """The file of the public byte-level vocabulary; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids as unsigned 32-bit numbers, without special tokens added."""
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if (spec.get("normalizer") or model.get("type", "BPE") != "BPE" or model.get("ignore_merges")
            or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
            or not before.get("use_regex", True)):
        return plain
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(pair), -1) for pair in pairs]
    if any(a >= b for a, b in zip([-1, *made], made)):
        return plain  # ids do not follow the order of the merges
    of_character = _byte_characters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(of_character[c] for c in token): i
             for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks,
                             special_tokens=special)

    def ids(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and (
                max(map(len, text.split()), default=0) >= LONG_RUN
                or text.isspace() or " " * LONG_RUN in text or "\n" * LONG_RUN in text):
            return plain(text)
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    return ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            made = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                ids = np.concatenate([encode(text), end])
                count = -(-len(ids) // capacity)
                cuts = [0, *range(len(ids) - capacity * (count - 1), len(ids) + 1, capacity)]
                for i, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                    made.append((doc_id, i, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            frame = pd.DataFrame(made, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(
        rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size; the longest is placed first.

    Moving a bin from gap h to gap h-s changes the sum by 2 * (n[h-s] - n[h] + 1); a bin that
    becomes full leaves the sum, which changes it by 1 - 2 * n[h].
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    of_bin, offset, bins = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        here = open_bins[size:]
        change = 2 * (open_bins[:len(here)] - here + 1)
        change[0] -= 1
        usable = np.flatnonzero(here[:-1])
        if len(usable):
            gap = size + int(usable[change[usable].argmin()])
            chosen = waiting[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, chosen, bins = capacity, bins, bins + 1
        of_bin[at], offset[at] = chosen, capacity - gap
        if gap > size:
            waiting[gap - size].append(chosen)
            open_bins[gap - size] += 1
    return of_bin, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` (with a `length` of 1 to `capacity`) with sequence_id and offset.

    Whole sequences keep to themselves and get a negative id; the others are packed by block.
    """
    numbered = cut_lineage(rows.withColumn("row_", F.monotonically_increasing_id()))
    full = numbered.where(F.col("length") == capacity).select(
        *rows.columns, (-1 - F.col("row_")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = numbered.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // block_rows))

    def place(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("row_", ignore_index=True)
        of_bin, offset = sum_of_squares(block["length"].to_numpy(), capacity)
        number = block["block_"].to_numpy() * np.int64(block_rows * 4) + of_bin
        return block[["row_"]].assign(sequence_id=number, offset=offset)

    dealt = short.select("row_", "length", F.pmod(F.xxhash64("row_"), F.lit(blocks)).alias("block_"))
    placed = dealt.groupBy("block_").applyInPandas(place, "row_ long, sequence_id long, offset long")
    packed = short.join(placed, "row_").select(*rows.columns, "sequence_id", "offset")
    return full.unionByName(packed)
