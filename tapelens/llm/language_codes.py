"""Language of a text by error-correcting output codes.

Every language has a codeword. One binary classifier per bit (ridge regression on hashed byte
2- and 3-gram frequencies of the lower-cased text) says which side of the bit a text is on; the
language whose codeword is nearest under a loss weighted by how well each bit was learned wins.
A text whose two nearest codewords are almost equally far is flagged ambiguous.

Training reads a sample of labelled rows, about SAMPLE_PER_LANGUAGE of each language and at most about
TRAINING_ROWS in all, in equal shares: the system solved on the driver has one row for each (rates
come from counts over all labelled rows; rows are chosen by a hash). Predictions read whole texts in
Arrow batches and need no shuffle; the model is a matrix of fixed size per bit.

Defined cases: a null text or one without a letter is `und` with score 0 and not ambiguous; with
no labelled rows every text is `und`; with one language every text with a letter is that
language; a null `doc_id` counts as the empty text when rows are split; repeated rows are
predicted each; ties go to the language first in order; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
SAMPLE_PER_LANGUAGE = 500
TRAINING_ROWS = 6000
DIMENSIONS_LOG2 = 12
RIDGE = 0.02
AMBIGUOUS_BELOW = 0.15
_MILLION = 1_000_000


def codewords(classes: int) -> np.ndarray:
    """One row of +1/-1 per class. All distinct two-way splits for up to six classes; beyond,
    the best of many seeded random codes by the least distance between two rows."""
    if classes <= 1:
        return np.zeros((classes, 0))
    if classes <= 6:
        splits = np.arange(1, 1 << (classes - 1))
        bits = (splits[None, :] >> np.arange(classes)[:, None]) & 1
        return 1.0 - 2.0 * bits
    rng, length = np.random.default_rng(7), int(np.ceil(15 * np.log2(classes)))
    best, apart = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, length))
        if np.any(np.abs(code.sum(axis=0)) == classes):
            continue
        least = ((length - code @ code.T) / 2 + length * np.eye(classes)).min()
        if least > apart:
            best, apart = code, least
    return best


def features(text: str) -> np.ndarray:
    """Unit-length square roots of hashed byte 2- and 3-gram counts of the whole text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    size, shift = 1 << DIMENSIONS_LOG2, np.uint32(32 - DIMENSIONS_LOG2)
    counts = np.zeros(size)
    if len(raw) >= 2:
        pairs = (raw[:-1] << np.uint32(8)) | raw[1:]
        counts += np.bincount((pairs * np.uint32(2654435761)) >> shift, minlength=size)
        triples = (pairs[:-1] << np.uint32(8)) | raw[2:] | np.uint32(1 << 24)
        counts += np.bincount((triples * np.uint32(2246822519)) >> shift, minlength=size)
    root = np.sqrt(counts)
    return (root / max(np.linalg.norm(root), 1e-9)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language index, score and ambiguity of each row of bit margins."""
        if not self.code.shape[1]:
            rows = len(margins)
            return np.zeros(rows, int), np.ones(rows), np.zeros(rows, bool)
        agreement = margins[:, None, :] * self.code[None, :, :]
        far = (np.exp(-np.clip(agreement, -3, 3)) * self.trust).sum(axis=2)
        near = np.exp(-4 * (far - far.min(axis=1, keepdims=True)))
        share = near / near.sum(axis=1, keepdims=True)
        best = far.argmin(axis=1)
        two = np.sort(far, axis=1)[:, :2]
        return best, share[np.arange(len(best)), best], two[:, 1] - two[:, 0] < AMBIGUOUS_BELOW


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> pd.DataFrame:
    """lang and features of about `per_language` labelled rows of each language, TRAINING_ROWS in all."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "x": []})
    per_language = max(1, min(per_language, TRAINING_ROWS // len(counts)))
    rates = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (
        lang, min(_MILLION, -(-per_language * _MILLION // n)))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(_MILLION))
    chosen = labelled.where(draw < F.element_at(rates, F.col("lang"))).select("lang", "text")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "x": [features(t).tobytes() for t in batch["text"]]})

    return chosen.mapInPandas(rows, "lang string, x binary").toPandas()


def fit(sample: pd.DataFrame) -> Model:
    languages = sorted(sample["lang"].unique())
    code = codewords(len(languages))
    if len(languages) <= 1:
        return Model(languages, code, np.zeros((1 << DIMENSIONS_LOG2, 0), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(v, np.float32) for v in sample["x"]]).astype(np.float64)
    label = sample["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    target = code[label]
    balance = np.sqrt(len(label) / (len(languages) * np.bincount(label)[label]))[:, None]
    scaled = x * balance
    gram = scaled @ scaled.T + RIDGE * len(label) / 100 * np.eye(len(label))
    dual = np.linalg.solve(gram, target * balance)
    weights = (scaled.T @ dual).astype(np.float32)
    # the residual of leaving each row out tells how far a bit can be trusted
    inverse = np.diagonal(np.linalg.inv(gram))[:, None]
    left_out = target * balance - dual / inverse
    right = ((left_out * target) > 0).mean(axis=0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(languages, code, weights, trust / trust.sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in batch["text"]], bool)
            lang = np.full(len(batch), UNDETERMINED, object)
            score, unsure = np.zeros(len(batch)), np.zeros(len(batch), bool)
            if model.languages and lettered.any():
                margins = np.stack([features(t) @ model.weights for t in batch["text"][lettered]])
                best, share, close = model.decode(margins)
                lang[lettered] = np.array(model.languages, object)[best]
                score[lettered], unsure[lettered] = share, close
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                "lang_pred": lang, "score": score, "ambiguous": unsure})

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInPandas(
        rows, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    return predict(docs, fit(training_sample(docs, per_language)))
