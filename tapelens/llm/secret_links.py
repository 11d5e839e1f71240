"""Secrets: certain spans by pattern, weak ones by linking complementary parts of a credential.

Base kinds (assign, access, hex) are reported as their patterns decide. Three weak kinds are only
proposed: `id` (a user name or client id that is assigned a value), `key` (a long bare token
with upper-case and lower-case letters and digits) and `endpoint` (an address to connect to).
A credential has an identifier, a secret and perhaps an endpoint; an interval join links the
parts of a text that lie at most SCOPE characters apart, and a weak part is reported only when
its complement is linked: a key with an identifier, an id with a secret, an endpoint with both.

The join compares parts that share a stretch of SCOPE characters: each weak part is listed under
every stretch it could reach, each part under those it covers. A stretch has room for a bounded
number of parts, so a text with very many parts gives work in proportion to its length, spread
over the cluster by document and stretch.

Defined cases: a null or empty text has no spans; rows with a null `doc_id` are scanned like
others; rows with the same id and text are linked once and each get the result; of a weak part
that overlaps a base span nothing is reported; ties at one start are ordered by kind; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.llm import spans
from tapelens.llm.base import whole_text
from tapelens.session import cut_lineage

#: Fixed kinds in the order of the listing.
BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("id", "key", "endpoint")
SCOPE = 200
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ID = (r"(?i:(?<![a-z0-9])(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?))"
      r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._+-]{3,}")
KEY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ENDPOINT = (r"(?i:(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"
            r"|(?<![a-z0-9])(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9][a-z0-9.-]*(?::[0-9]+)?)")
#: What a kind is in a credential.
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier",
        "id": "identifier", "endpoint": "endpoint"}


def _key_like(found: Column) -> Column:
    return found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]")


def _key_columns(text: Column) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id_"),
            F.xxhash64(text).alias("hash_")]


def parts_of(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base and weak spans of every row, without the text; keyed by id and hash of the text."""
    value = F.regexp_extract
    read = docs.select(*keep, *_key_columns(whole_text()), whole_text().alias("body_"))
    made = read.select(
        *keep, "id_", "hash_",
        spans.find("body_", ASSIGN, "assign", lambda t: F.length(value(t, ASSIGN, 2)) >= 8).alias("assign_"),
        spans.find("body_", ACCESS, "access").alias("access_"),
        spans.find("body_", HEX, "hex").alias("hex_"),
        spans.find("body_", ID, "id").alias("user_"),
        spans.find("body_", KEY, "key", _key_like).alias("bare_"),
        spans.find("body_", ENDPOINT, "endpoint").alias("endpoint_"))
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return made.select(
        *keep, "id_", "hash_",
        F.transform(spans.ordered(F.concat("assign_", "access_", "hex_"), BASE_KINDS), bare).alias("base"),
        F.transform(F.concat("user_", "bare_", "endpoint_"), bare).alias("weak"))


def linked(parts: DataFrame) -> DataFrame:
    """Weak parts with their complement in scope: id_, hash_ and array `added`."""
    with_weak = parts.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).select(
        "id_", "hash_", F.explode(F.concat("base", "weak")).alias("part")).distinct()
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    each = with_weak.select("id_", "hash_", "part", F.element_at(role, F.col("part.kind")).alias("role"))

    def stretches(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(start, F.lit(0)) / SCOPE), F.floor((end - 1) / SCOPE)))

    weak = each.where(F.col("part.kind").isin(*WEAK_KINDS)).select(
        "id_", "hash_", F.col("part").alias("own"),
        stretches(F.col("part.start") - SCOPE, F.col("part.end") + SCOPE).alias("stretch"))
    other = each.select("*", stretches(F.col("part.start"), F.col("part.end")).alias("stretch"))
    gap = F.greatest("own.start", "part.start") - F.least("own.end", "part.end")
    met = weak.join(other, ["id_", "hash_", "stretch"]).where((F.col("own") != F.col("part")) & (gap <= SCOPE))
    seen = lambda name: F.max(F.when(F.col("role") == name, 1).otherwise(0)) == 1
    per_part = met.groupBy("id_", "hash_", "own").agg(
        seen("identifier").alias("identifier"), seen("secret").alias("secret"),
        F.max(F.when((gap < 0) & F.col("part.kind").isin(*BASE_KINDS), 1).otherwise(0)).alias("covered"))
    complete = F.when(F.col("own.kind") == "key", F.col("identifier")).when(
        F.col("own.kind") == "id", F.col("secret")).otherwise(F.col("identifier") & F.col("secret"))
    return per_part.where(complete & (F.col("covered") == 0)).groupBy("id_", "hash_").agg(
        F.collect_list("own").alias("added"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, `base` spans and `found` spans (base and linked), sorted by start, then kind."""
    parts = cut_lineage(parts_of(docs))
    open_rows, done = parts.where(F.size("weak") > 0), parts.where(F.size("weak") == 0)
    joined = open_rows.join(cut_lineage(linked(open_rows)), ["id_", "hash_"], "left")
    found = spans.ordered(F.concat("base", F.coalesce("added", F.array().cast(
        "array<struct<start:int,end:int,kind:string>>"))), BASE_KINDS + WEAK_KINDS)
    columns = ["doc_id", "id_", "hash_", "base"]
    return joined.select(*columns, found.alias("found")).unionAll(
        done.select(*columns, F.col("base").alias("found")))


def redact(docs: DataFrame, label: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced by `label`; other texts are unchanged.

    `n_chars`, where there is one, follows the new text. A null text stays null.
    """
    names = docs.columns
    parts = cut_lineage(parts_of(docs, ()))
    hits = parts.where(F.size("base") + F.size("weak") > 0).dropDuplicates(["id_", "hash_"])
    links = linked(hits)
    found = cut_lineage(hits.join(links, ["id_", "hash_"], "left").select(
        "id_", "hash_", spans.ordered(F.concat("base", F.coalesce("added", F.array().cast(
            "array<struct<start:int,end:int,kind:string>>"))), BASE_KINDS + WEAK_KINDS).alias("found_"))
        .where(F.size("found_") > 0))
    keyed = docs.select("*", *_key_columns(whole_text()))
    clean = F.when(F.col("found_").isNull(), F.col("text")).otherwise(
        spans.replaced("text", F.col("found_"), label))
    out = keyed.join(found, ["id_", "hash_"], "left").withColumn("text", clean)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(
            F.col("found_").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{n}`") for n in names])
