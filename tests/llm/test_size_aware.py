import random

import pytest

from tapelens.llm import size_aware_join as join

from .test_near_copies import brute, corpus, edited

FIELDS = "doc_id long, text string"


def small_and_large():
    """Short texts of few frequent words, templates, and a passage in texts of their own."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["buy", "now", "here"]) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [passage + " " + " ".join(f"o{rng.random()}" for _ in range(rng.randint(10, 90))) for _ in range(40)]
    template = [f"t{i}" for i in range(150)]
    texts += [" ".join(edited(template, 4)) for _ in range(50)]
    for n in (6, 8, 10, 14, 20, 30):
        base = [f"b{n}.{i}" for i in range(n)]
        texts += [" ".join(base[:n - cut]) for cut in range(4) if n > cut] + [" ".join(edited(base, 1)) for _ in range(3)]
    return texts


@pytest.mark.parametrize("texts", [corpus(), small_and_large()], ids=["copies", "sizes"])
def test_components_match_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), FIELDS).selectExpr("*", "'clash' as s", "1 as id", "2 as n")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.similar_documents(docs).collect()}
    assert got == brute(texts, 5, 80)


@pytest.mark.parametrize("limit", [-1, 30, 400])
def test_any_boundary_gives_the_same(spark, monkeypatch, limit):
    texts = small_and_large()
    monkeypatch.setattr(join, "boundary", lambda rows, k: limit)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.similar_documents(
        spark.createDataFrame(list(enumerate(texts)), FIELDS)).collect()}
    assert got == brute(texts, 5, 80)


def test_shared_ids_null_ids_and_empty_table(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "vw")
    rows = [(5, one), (5, two), (9, one + " more"), (3, two + " more"), (None, one), (7, None), (8, " \n"), (6, two), (6, None)]
    docs = spark.createDataFrame(rows, FIELDS)
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in join.similar_documents(docs).collect()), key=repr)
    assert got == sorted([(-1, 36, None), (3, 37, 3), (5, 36, 3), (5, 36, 3), (6, 0, 3), (6, 36, 3), (7, 0, 7), (8, 0, 8),
                          (9, 37, 3)], key=repr)
    assert join.similar_documents(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        join.similar_documents(docs, percent=40)
