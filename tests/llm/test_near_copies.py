import random

from tapelens.llm import minmax_dedup

rng = random.Random(3)


def edited(words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return words


def corpus():
    docs, common = [], [f"c{i}" for i in range(60)]
    for _ in range(12):
        base = [f"w{rng.random()}" for _ in range(120)]
        docs += [base, base, *[edited(base, rng.randint(1, 6)) for _ in range(9)]]
    hub = [f"h{i}" for i in range(150)]
    docs += [edited(hub, rng.randint(3, 8)) for _ in range(60)]
    docs += [common + [f"u{rng.random()}" for _ in range(40)] for _ in range(40)]
    docs += [["A", "b"], ["a", "B"], ["a", "b", "c"], [], ["x"] * 50, ["x"] * 60]
    return [" ".join(d) for d in docs] + [None, "\t\n"]


def brute(texts, k, percent):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_components_match_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "*", "'clash' as bands", "1 as id")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(docs, 4).collect()}
    assert got == brute(texts, 4, 80)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text, "a"), (5, text, "a"), (None, text, "b"), (9, text, "c"), (7, None, "d")],
                                 "doc_id long, text string, lang string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    stay = minmax_dedup.keep_one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in stay.collect()) == [5, 7]  # the copy under a null id is a copy
    assert minmax_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_rows_are_kept_by_their_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "uvw")
    rows = [(1, one, "a"), (1, two, "b"), (2, two + " more", "c"), (None, three, "d"), (None, three, "e"), (None, one, "f"),
            (4, None, "g"), (4, "", "h"), (4, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as row_", "2 as first")
    stay = minmax_dedup.keep_one_of_each(docs)
    assert stay.columns == docs.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in stay.collect())
    assert got == sorted([(1, one), (1, two), (-1, three), (4, ""), (4, "")])


def test_near_misses_of_one_template_are_no_candidates(spark):
    """Texts with three edits in different places share 116 of 146 shingles; 0.8 asks for 130."""
    template = [f"t{i}" for i in range(150)]
    texts = []
    for _ in range(80):
        words = list(template)
        for at in rng.sample(range(5, 145, 10), 3):
            words[at] = f"new{rng.random()}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = docs.selectExpr("doc_id as id")
    sets = minmax_dedup.shingle_sets(docs, ids, 5)
    rows = minmax_dedup.rare_shared(sets, ids, 80).selectExpr("*", "id as c")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in minmax_dedup.across_components(rows, 80, sets).collect()}
    of = [{tuple(t.split()[i:i + 5]) for i in range(146)} for t in texts]
    linked = {(a, b) for b in range(80) for a in range(b) if 100 * len(of[a] & of[b]) >= 80 * len(of[a] | of[b])}
    assert linked <= found and len(found) <= 2 * len(linked) + 80 < 80 * 79 / 4
