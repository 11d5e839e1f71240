import hashlib
import random
import zlib

from tapelens.llm import prefix_trie

FIELDS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [r[2:] for r in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        whole[c] = tuple(said.get(c - base, [])[:h] + said[c][h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p] for p in nodes}
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in children[p])
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(whole[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]),
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(turns):
    return sorted((tuple(r) for r in prefix_trie.shared_prefixes(turns).collect()), key=repr)


def test_nodes_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None]))
            for c in range(150) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", "same") for c in (400, 401, 402, 407) for t in range(8)]
    rows += [(500, 0, "user", "head"), (503, None, "user", "x"), (503, 2, "b", "y"), (503, 2, "a", "z"), (503, 2, "a", "z")]
    rows += [(-3, 0, "user", "minus"), (None, 0, "user", "lost"), (611, 0, "user", "x"), (700, 5, "user", "😀" * 50000)]
    turns = spark.createDataFrame(rows, FIELDS).selectExpr("*", "'clash' as k1", "1 as pos", "2 as depth").repartition(3)
    assert nodes_of(turns) == brute(rows)


def test_long_conversation_spans_blocks(spark):
    rows = [(c, t, "user", f"t{t}") for c, n in ((0, 2600), (1, 2600), (2, 1300)) for t in range(n)]
    rows += [(3, t, "user", f"t{t}" if t < 1100 else "other") for t in range(1200)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.shared_prefixes(spark.createDataFrame(rows, FIELDS)).collect()}
    assert len(got) == 1 + 2600 + 100
    assert (got[0, 1100].n_convs, got[0, 1100].n_children, got[0, 1100].n_leaves) == (4, 2, 2)
    assert (got[0, 1300].n_convs, got[0, 1301].n_convs, got[3, 1101].parent_conv_id) == (3, 2, 0)
    ends = {d: got[0, d].ends_sha256 for d in (1300, 2600)}
    assert ends == {1300: hashlib.sha256(b"2").hexdigest(), 2600: hashlib.sha256(b"0,1").hexdigest()}
    lengths = [len(f"t{t}") for t in range(2600)]
    assert got[0, 0].saved_tokens == sum((2 + (t < 1300) - 1 + (t < 1100)) * n for t, n in enumerate(lengths))


def test_turnless_conversation_and_empty_table(spark):
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(alone, 0, "user", "gone")]
    assert nodes_of(spark.createDataFrame(rows, FIELDS)) == brute(rows)
    assert nodes_of(spark.createDataFrame([], FIELDS)) == []
