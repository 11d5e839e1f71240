import random

import corpus_pipeline
from tapelens.llm import jobs


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n=60: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    base, item, secret = text(), text(30), text(20) + " token = abcdefgh12345678 " + text(20)
    rows = [(1, base), (2, base), (3, base + " extra"), (4, "too short"), (5, text(40) + " " + item + " " + text(40)),
            (6, secret), (7, text()), (8, "# " * 50 + text(20)), (9, None), (10, text(3000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        left.append({r.doc_id: r.text for r in now.collect()})
    assert [set(x) for x in left] == [{1, 2, 3, 5, 6, 7, 10}, {1, 5, 6, 7, 10}, {1, 6, 7, 10}, {1, 6, 7, 10}]
    assert "[SECRET]" in left[3][6] and "abcdefgh12345678" not in left[3][6]
    assert all(left[3][i] == left[2][i] for i in (1, 7, 10))
    out = jobs.QUERIES["pipeline"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 6, 7, 10} and max(r.piece for r in out) > 2


def test_all_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
