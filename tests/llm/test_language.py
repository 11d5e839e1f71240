import random
import zlib

import numpy as np

from tapelens.llm import language_codes

SYLLABLES = {"aa": "ba be bi bo bu", "bb": "sch pf tz eu ng", "cc": "ción rr ll que ñ", "dd": "eau oux èr ch qu",
             "ee": "th sh wh ing ly", "ff": "ae oe kj fj sk", "gg": "ij oo uu ee zw", "hh": "ø å æ hv gj"}


def corpus(langs, n=60):
    rng, rows = random.Random(8), []
    for lang in langs:
        parts = SYLLABLES[lang].split()
        for _ in range(n):
            rows.append((len(rows), " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
                                             for _ in range(30)), lang))
    return rows


def test_codewords_differ_in_many_bits():
    for k in (2, 3, 4, 6, 9, 20):
        code = language_codes.codewords(k)
        apart = ((code[:, None] != code[None]).sum(axis=2) + 99 * np.eye(k)).min()
        assert apart >= (1 if k == 2 else 2 if k == 3 else 4)


def test_held_out_accuracy(spark):
    for langs in (list(SYLLABLES), ["aa", "cc"], ["ee"]):
        docs = spark.createDataFrame(corpus(langs), "doc_id long, text string, lang string").selectExpr(
            "*", "1.5 as score", "'x' as lang_pred")
        truth = {r.doc_id: r.lang for r in docs.collect()}
        got = language_codes.identify(docs).collect()
        test = [r for r in got if r.held_out]
        assert {r.doc_id for r in test} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
        assert np.mean([truth[r.doc_id] == r.lang_pred for r in test]) > 0.97
        assert all(0 <= r.score <= 1 for r in got)


def test_undetermined_nulls_and_no_labels(spark):
    rows = [*corpus(["aa", "bb"]), (None, None, "aa"), (900, "123 !?", None), (901, "", None), (None, "ba be bi bo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in language_codes.identify(docs).collect() if r.doc_id is None or r.doc_id >= 900}
    assert {(None, "und", True), (None, "aa", True)} <= got
    assert {p for i, p, _ in got if i is not None} == {"und"}
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in language_codes.identify(unlabelled).collect()} == {("und", 0.0)}
    assert language_codes.identify(docs.limit(0)).collect() == []
