import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapelens.llm import packing

PATH = packing.default_tokenizer()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_equal_those_of_the_file(plain):
    rng = random.Random(1)
    alphabet = "ab' \n\t'sé日٣½!? 　\x1c\x85😀S0<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["x<|endoftext|>y", " " * 9000, "a" * 9000, "\n" * 9000, "word " * 9000]
    encode = packing.encoder(PATH)
    for text in texts:
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_a_file_whose_ids_do_not_follow_its_merges(tmp_path):
    vocab = {c: i for i, c in enumerate("abc")} | {"bc": 3, "ab": 4}
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": ["a b", "b c"]}, "added_tokens": [],
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True, "trim_offsets": True}}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    assert packing.encoder(str(path))("abc").tolist() == [4, 2]


def test_pieces_and_sequences(spark, plain):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 900)))
             for _ in range(150)] + [None, "", "tail " * 5000, "tail " * 1023]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a"), (None, "a")], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as row_", "2 as length")
    rows = packing.pack(packing.pieces(docs, PATH), block_rows=40).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 1024)))
        assert all(p.length == 1024 for p in pieces[1:]) and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    for members in by_sequence.values():
        end = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
    assert len(by_doc[None]) == 2
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 1024) + 5 + 1
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0


def test_sum_of_squares_choice():
    sizes = np.array([6, 5, 4, 5, 4, 3, 3])
    bins, offset = packing.sum_of_squares(sizes, 10)
    assert max(bins) + 1 == 3
    for b in set(bins):
        assert sizes[bins == b].sum() <= 10
