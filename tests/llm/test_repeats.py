import hashlib
import random

from tapelens.llm import difference_cover, suffix_dedup


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for p in range(len(b) - 199):
            seen[b[p:p + 200]] = seen.get(b[p:p + 200], 0) + 1
    out = []
    for b in raw:
        hit = [False] * len(b)
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                hit[p:p + 200] = [True] * 200
        kept = bytes(c for c, h in zip(b, hit) if not h)
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    passage = word(320)
    made = [word(rng.randint(0, 900)) for _ in range(20)]
    made += [word(rng.randint(0, 300)) + passage[rng.randint(0, 60):rng.randint(180, 320)] + word(rng.randint(0, 300))
             for _ in range(40)]
    whole = word(700)
    made += [whole, whole, whole[:350] + "!" + whole[350:], whole[:199], whole[-200:], "a" * 500, "ab" * 300, "a" * 199, "a" * 200]
    made += [word(500) + whole[100:400] * 2, None, "", "x" * 700000]
    return made


def test_removed_bytes_match_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr(
        "*", "'x' as name", "1 as start", "2 as key_")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, want in enumerate(brute([t if t is None or len(t) < 10**5 else t[:1000] for t in rows])[:-1]):
        assert got[i] == want, i
    assert got[len(rows) - 1][:3] == (700000, 700000, 1)


def test_repeated_rows_null_ids_empty_table(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(260))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:210]), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(0, 210), (1, 260), (1, 260), (2, 0)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_difference_cover_orders_suffixes(spark):
    rng = random.Random(2)
    for text in ("mississippi!", "".join(rng.choice("ab") for _ in range(31))):
        rows = [(i, ord(c)) for i, c in enumerate(text)]
        got = {r.at: r.rank for r in difference_cover.suffix_ranks(
            spark.createDataFrame(rows, "at long, sym long")).collect()}
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert [got[i] for i in want] == list(range(1, len(text) + 1)), text


def test_difference_cover_finds_the_same_bytes(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    passage = word(230)
    docs = spark.createDataFrame([(1, word(150) + passage + word(60)), (2, passage[10:220]), (3, "a" * 250), (4, None)],
                                 "doc_id long, text string")
    got, want = [{(r.id_, i) for r in found.covered(docs).collect() for i in range(r.start, r.stop)}
                 for found in (difference_cover, suffix_dedup)]
    assert got == want and len(got) > 600
