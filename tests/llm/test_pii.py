import hashlib
import random
import re

from pyspark.sql import functions as F

from tapelens.llm import jobs, pii, spans

KINDS = ("email", "ip", "card", "phone")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in found.split(".")),
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def expected(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind in KINDS
            for m in re.finditer(PLAIN[kind], text or "") if holds(kind, m[0])]


def texts():
    rng = random.Random(5)
    parts = ["a@b.c", "@", "x.y@", "d-e.f", "_d@e.f", " ", "é", "+", "1", "+1 (2", "4242424242424242",
             "4242 4242-4242 4242", "255.1.2.3", "256.1.1.1", ".4", "0001.2.3.4", "-", "79927398713",
             ")", "\n", "Ж", "+49 30 1234567", "😀", "a.b.c", "%"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    fixed = ["a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "x" * 30000 + "@a.b", "1" * 5000, "+1" * 4000,
             "a@b" + ".c" * 20000, "1 " * 20000, "card 378282246310005 paid", "378282246310005",
             "IBAN DE89 3704 0044 0532 0130 00 ok", "DE88370400440532013000", "", None]
    return made + fixed


def test_spans_match_the_plain_patterns(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in jobs.op7(spark, str(tmp_path)).collect()}
    for doc_id, text in rows:
        want = expected(text)
        row = got[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(w.startswith(k) for w in want) for k in KINDS]
        assert set(want) <= set(row.spans.split(",") if row.spans else [])
    by_text = {text: got[i].spans for i, text in rows}
    assert by_text["card 378282246310005 paid"] == "short_card:5:20"
    assert by_text["378282246310005"] == ""
    assert by_text["IBAN DE89 3704 0044 0532 0130 00 ok"] == "iban:5:32"
    assert by_text["DE88370400440532013000"] == ""


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, base string, added string, body_ string")
    assert pii.scan(docs).collect() == []
    docs = spark.createDataFrame([(None, "a@b.cc", "x", "y"), (None, "a@b.cc", "x", "y")],
                                 "doc_id long, text string, base string, found string")
    assert [len(r.base) for r in pii.scan(docs).collect()] == [1, 1]


DE, DE_SPACED, AMEX = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "378282246310005"


def test_what_follows_after_a_space_is_no_part_of_the_number(spark, tmp_path):
    cases = {
        **{f"{iban} {after}": f"iban:0:{len(iban)}" for iban in (DE, DE_SPACED) for after in (
            "Please pay", "BIC COBADEFFXXX", "2 times", "12/27", "A", "ok", "1000")},
        f"account {DE} 2 times": "iban:8:30",
        f"{DE} {DE_SPACED} X": "iban:0:22,iban:23:50",
        f"BE12 {DE_SPACED} X": "iban:5:32",
        f"{DE}1": "", f"{DE}x": "", "ZZ89370400440532013000": "",
        "GB82 WEST 1234 5698 7654 32 NO9386011117947 FR1420041010050500013M02606 7":
            "iban:0:27,iban:28:43,iban:44:71",
        **{f"card {AMEX} {after}": "short_card:5:20" for after in ("12/27", "1234", "Total 5", "7")},
        f"card {AMEX}-12/27": "short_card:5:20", f"card {AMEX}-1": "",
        "card 3782 822463 10005 12/27": "short_card:5:22",
        "card 3782-822463-10005 12/27": "short_card:5:22",
        "card 2 3782 822463 10005": "short_card:7:24",
        "card 30569309025904 12/27": "short_card:5:19",
        "card 4222222222222 12/27": "short_card:5:18",
        "card 4222 222 222 222 12/27": "short_card:5:21",
        f"visa {AMEX} 4222222222222 12/27": "short_card:5:20,short_card:21:34",
        "card 37 8282246 310005": "short_card:5:22",
    }
    rows = list(enumerate(cases))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in jobs.op7(spark, str(tmp_path)).collect()}
    assert {text: ",".join(s for s in got[i].split(",") if s.startswith(pii.ADDED_KINDS))
            for i, text in rows} == cases


def test_a_text_with_very_many_matches(spark):
    count = 100_000
    text = " ".join(f"a{i % 10}@b.c" for i in range(count)) + " visa 378282246310005 " + "378282246310005, " * 2000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.scan(docs).selectExpr("base", "found").first()
    assert [(s.start, s.end) for s in row.base] == [(7 * i, 7 * i + 6) for i in range(count)]
    assert {s.text for s in row.found if s.kind == "short_card"} == {"378282246310005"}


def test_loose_spans_beside_sure_ones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        cuts = sorted(rng.sample(range(60), 2 * rng.randint(0, 6)))
        sure = [sorted(rng.sample(range(60), 2)) for _ in range(rng.randint(0, 3))]
        rows.append((i, list(zip(cuts[::2], cuts[1::2])), [tuple(s) for s in sure]))
    made = spark.createDataFrame(rows, "i int, own array<struct<a:int,b:int>>, sure array<struct<a:int,b:int>>")
    span = "{0} -> named_struct('start', {0}.a, 'end', {0}.b, 'kind', 'k', 'text', '')".format("s")
    placed = made.selectExpr("i", f"transform(own, {span}) own", f"transform(sure, {span}) sure")
    got = {r.i: [(s.start, s.end) for s in r.kept]
           for r in placed.select("i", spans.beside(F.col("own"), F.col("sure")).alias("kept")).collect()}
    for i, own, sure in rows:
        assert got[i] == [o for o in own if all(s[1] <= o[0] or o[1] <= s[0] for s in sure)], (own, sure)
