import re

from pyspark.sql import functions as F

from tapelens.llm import quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit))


TEXTS = ["", None, " \n\t", "one", "a b c d e a b c d e", "x " * 40, "a b c d e f\n" * 3 + "\n\n",
         "é😀 # | <b> $%&*", "a b c d e f g a b c d e", "\x0b\x0cword\x1c word", "w " * 60000 + "end"]


def test_measurements_match_brute_force(spark):
    rows = [(i, t, "en", 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words_ string, n_words int")
    got = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    for i, text in enumerate(TEXTS[:-1]):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
    assert got[len(TEXTS) - 1].n_repeat_words == 60000


def test_policies_and_ablations_use_bits_only(spark):
    bits = [0, 1, 2, 3, 4, 4]
    rows = spark.createDataFrame([(b,) for b in bits], "failure_bits long")
    kept = quality_rules.apply_policies(rows).agg(
        F.sum(F.col("kept_base").cast("int")), F.sum(F.col("kept_v1").cast("int"))).first()
    assert tuple(kept) == (3, 1)
    found = {(r.policy, r.rule): r for r in quality_rules.ablations(rows).collect()}
    assert found["base", "few_words"].n_only_reason == 1 and found["base", "few_words"].n_failing == 2
    assert found["v1", "symbols"].n_only_reason == 2 and found["v1", "symbols"].n_kept == 1


def test_filter_keeps_columns_and_rows(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good, "x"), (1, good, "x"), (None, good, "y"), (2, "short", "z")],
                                 "doc_id long, text string, windows_ string")
    out = quality_rules.keep_passing(docs)
    assert out.columns == docs.columns and out.count() == 3
    assert quality_rules.keep_passing(docs.limit(0)).count() == 0
