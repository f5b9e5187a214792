"""Quality classifier: a Bradley-Terry model over preference pairs.

A document's strength is linear in features of its text.  A document labelled
1 is preferred to one labelled 0, and the weights minimise the logistic loss
on the pairs' feature differences.  Documents are accepted from a quantile of
the training strengths upwards.

Learning sees a bounded sample of the labelled rows (``sample_rows``, chosen
by a hash of the id); scoring sees every whole text.  What counts as a common
word is learnt from the sample, too: the words that most of its texts hold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep, wrapped
from .batches import texts_of

#: Labelled rows that the model is fitted on, in expectation.
SAMPLE_ROWS = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
#: Words that count as common, those that most texts of the sample hold.
COMMON_WORDS = 200
#: The score from which a document is accepted.
ACCEPT = 0.7
RIDGE = 1e-3
SEED = 20

FEATURES = (
    "log_words",
    "symbols_per_word",
    "pipes_per_word",
    "exclamations_per_word",
    "upper_share",
    "digit_share",
    "wide_share",
    "word_length",
    "distinct_exponent",
    "most_frequent_share",
    "repeated_line_share",
    "common_share",
    "is_tiny",
)


def _bare(word: bytes) -> bytes:
    return word.lower().rstrip(b".,;:!?")


def features(text: bytes | None, common: frozenset[bytes] = frozenset()) -> list[float]:
    """Features of a whole UTF-8 text, each of a bounded range; ``common`` are bare words."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = at[65:91].sum() + at[97:123].sum()
    symbols = sum(int(at[c]) for c in b"#*$%&<>")
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        math.log1p(n) / 10,
        min(symbols / n, 3.0),
        min(int(at[124]) / n, 1.0),
        min(int(at[33]) / n, 2.0),
        float(at[65:91].sum() / max(letters, 1)),
        float(at[48:58].sum() / len(text)),
        float(at[128:].sum() / len(text)),
        min(len(text) / n, 20.0) / 10,
        math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if _bare(w) in common) / n,
        1.0 if n < 20 else 0.0,
    ]


@dataclass(frozen=True)
class Model:
    """Strength ``weights . x``; ``score`` is 0.7 at the accepted quantile."""

    weights: tuple[float, ...]
    cut: float
    common: frozenset[bytes] = frozenset()

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip(x @ np.array(self.weights) - self.cut, -30, 30)
        score = 1 / (1 + np.exp(-(math.log(ACCEPT / (1 - ACCEPT)) + strength)))
        return np.where(strength >= 0, np.maximum(score, ACCEPT), np.minimum(score, np.nextafter(ACCEPT, 0)))


def preference_pairs(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Feature differences of drawn pairs, good less bad, in units of ``scale``, which comes second."""
    good, bad = x[label == 1], x[label == 0]
    scale = np.maximum(x.std(axis=0), 1e-6)
    rng = np.random.default_rng(SEED)
    return (good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]) / scale, scale


def fit(x: np.ndarray, label: np.ndarray, common: frozenset[bytes] = frozenset()) -> Model:
    """Fits the pairs by Newton's method and picks the quantile to accept from.

    The quantile is the one that tells the training labels apart best (mean
    of both classes' hit rates); of several, the lowest.  Without labels of
    both kinds nothing is learnt and every text scores exactly 0.7.
    """
    good, bad = x[label == 1], x[label == 0]
    if not len(good) or not len(bad):
        return Model((0.0,) * len(FEATURES), 0.0)
    pairs, scale = preference_pairs(x, label)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(pairs @ w, -30, 30)))
        gradient = -(pairs * p[:, None]).mean(axis=0) + RIDGE * w
        hessian = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    strength = x @ w
    order = np.argsort(strength, kind="stable")
    ranked, is_bad = strength[order], label[order] == 0
    # accept from position k: bad ones before it and good ones from it on are told right
    told = np.append(0, np.cumsum(is_bad)) / len(bad) + 1 - np.append(0, np.cumsum(~is_bad)) / len(good)
    k = int(np.argmax(told))
    cut = (ranked[k - 1] + ranked[k]) / 2 if 0 < k < len(ranked) else ranked[min(k, len(ranked) - 1)]
    return Model(tuple(float(v) for v in w), float(cut), common)


def _score_udf(model: Model):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(t, model.common) for t in texts_of(texts)], dtype=float)
        return pa.array(model.scores(x.reshape(-1, len(FEATURES))))

    return score


def _feature_udf(common: frozenset[bytes]):
    @F.arrow_udf("array<double>")
    def values(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, common) for t in texts_of(texts)], pa.list_(pa.float64()))

    return values


def remainder(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 marks the held-out rows."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4


def _held_words(batches):
    """The bare words of each text, each once."""
    for batch in batches:
        words = [sorted({_bare(w) for w in (t or b"").split()}) for t in texts_of(batch.column(0))]
        flat = pa.array([w for held in words for w in held], pa.binary())
        yield pa.RecordBatch.from_arrays([flat], ["w"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learns from labelled rows that aren't held out, of about ``sample_rows`` ids.

    Labels other than 0 and 1 and null ids are ignored; an id labelled twice
    counts once, with its smaller label; an id with several texts counts once,
    with their mean features.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & (remainder(F.col(id_col)) != 2))
    total = usable.count()
    share = min(1.0, sample_rows / max(total, 1))
    chosen = (
        usable.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 30)) < int(share * (1 << 30)))
        .groupBy(F.col(id_col).alias("id_"))
        .agg(F.min(label_col).alias("label"))
    )
    # about sample_rows texts
    texts = keep(
        docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id_")  # about sample_rows rows of two numbers
        .select("id_", "label", "text"),
        "labelled-texts",
    )
    held = texts.select("text").mapInArrow(_held_words, "w binary").groupBy("w").count()
    most = held.orderBy(F.desc("count"), "w").limit(COMMON_WORDS).collect()
    common = frozenset(bytes(r.w) for r in most)
    sample = (
        texts.select("id_", "label", _feature_udf(common)("text").alias("x"))
        .groupBy("id_")
        .agg(F.first("label").alias("label"), *[F.avg(F.col("x")[k]).alias(f"x{k}") for k in range(len(FEATURES))])
        .toPandas()
        .sort_values("id_")
    )
    x = sample[[f"x{k}" for k in range(len(FEATURES))]].to_numpy(dtype=float).reshape(-1, len(FEATURES))
    return fit(x, sample["label"].to_numpy(dtype=int), common)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text."""
    return docs.withColumn(score_col, _score_udf(model)(F.col(text_col).cast("string")))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each input row.

    Null and empty texts are scored like any other, and very long ones whole.
    Rows that repeat an id each have the score of their own text.  A score of
    exactly ``ACCEPT`` is accepted.  A null id is held out of nothing
    (``held_out`` false).  Other columns, whatever their names, are not read.
    An empty table gives an empty one.
    """
    model = train(docs, labels, id_col, text_col, sample_rows=sample_rows)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(slim, model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def quality_accepted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The rows of ``docs`` whose score is accepted, with their own columns.

    The edge cases are those of :func:`quality_scores`; rows are judged one by
    one, so null ids and repeated rows stay or go by their texts.
    """
    model = train(docs, labels, id_col, text_col, sample_rows=sample_rows)
    return scored(wrapped(docs), model, f"row.`{text_col}`").where(F.col("score") >= ACCEPT).select("row.*")
