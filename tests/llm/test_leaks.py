from tapelens.llm import decontaminate

ITEM = [f"q{i}" for i in range(40)]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "9 as n", "'x' as words")


def test_windows_found_exact_edited_and_clean(spark):
    noise = [f"n{i}" for i in range(300)]
    edited = ITEM[:20] + ["other"] + ITEM[21:]  # five of 36 shingles change: 31 / 41 < 0.8
    ends = ["other"] + ITEM[1:-1] + ["word"]  # two change: 34 / 38 >= 0.8
    texts = [noise + ITEM + noise, " ".join(noise + edited), ends, noise, None, "", ITEM[:36], "q1 q2", noise + ["tiny", "item"],
             [w.upper() for w in ITEM] * 2]
    docs = rows(spark, [t if t is None or isinstance(t, str) else " ".join(t) for t in texts])
    items = spark.createDataFrame([(1, " ".join(ITEM)), (2, "Tiny item"), (3, None), (4, ""), (5, " ".join(ITEM))],
                                  "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(0, 1), (0, 5), (2, 1), (2, 5), (6, 1), (6, 5), (8, 2), (9, 1), (9, 5)}
    assert (got[0, 1].start_word, got[0, 1].n_words, got[0, 1].similarity) == (301, 40, 1.0)
    assert got[2, 1].similarity == 34 / 38 and got[6, 1].similarity == 32 / 36
    assert got[9, 1].start_word == 1
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 7}


def test_empty_sides_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, " ".join(ITEM)), (None, " ".join(ITEM)), (None, "clean text")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(None, 1)]
    assert [r.text for r in decontaminate.drop_contaminated(docs, items).collect()] == ["clean text"]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_hamming_blocks_cover_the_radius(spark):
    import random

    rng = random.Random(4)
    near = set(decontaminate._near_values())
    for _ in range(2000):
        flips = rng.sample(range(64), decontaminate.RADIUS)
        blocks = [sum(1 << (f % 8) for f in flips if f // 8 == i) for i in range(8)]
        assert any(b in near for b in blocks)


def test_broadcasts_are_bounded_by_bytes_and_keys_carry_no_shingles(spark, monkeypatch):
    hinted = lambda side: "broadcast" in side._jdf.queryExecution().logical().toString()
    long_rows = spark.range(20).selectExpr("id", "array_repeat(repeat('x', 1000000), 5) as shingles")
    assert not hinted(decontaminate._sized(long_rows)) and hinted(decontaminate._sized(spark.range(20)))
    seen, sized = [], decontaminate._sized
    monkeypatch.setattr(decontaminate, "_sized", lambda side: seen.append(side.columns) or sized(side))
    one, two = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    items = spark.createDataFrame([(7, one), (7, two), (None, two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"z {two}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.similarity) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 7, 1.0), (2, 0, 1.0), (2, 7, 1.0)]
    assert all("item_shingles" not in columns for columns in seen if "block" in columns)
