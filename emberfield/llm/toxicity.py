"""Toxicity: non-negative positive-unlabelled learning of a linear classifier over hashed words and word starts."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import bounded_sample, by_batch, sampled_texts, strings

FEATURE_BITS = 18
STARTS = (5, 6, 7)
#: Rows of a fit at most: confirmed toxic documents, and documents used as unlabelled.
MAX_FIT_POSITIVE = 5_000
MAX_FIT_UNLABELLED = 8_000
THRESHOLD = 0.3
FOLDS, HELD_FOLD = 4, 2
EPOCHS, RATE, DECAY, BATCH = 120, 0.03, 5e-4, 1024
#: Features the classifier may weigh: those that most clearly come oftener in toxic documents than elsewhere.
MOST_FEATURES, LEAST_Z = 4096, 5.0


class FeatureTable(dict):
    """A lower-cased word in UTF-8 -> the feature numbers of the word and of its starts."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        letters = word.strip(_MARKS).decode("utf-8", "replace")
        names = [letters, *[f"{letters[:n]}*" for n in STARTS if len(letters) >= n]] if letters else []
        found = tuple(zlib.crc32(x.encode()) & ((1 << FEATURE_BITS) - 1) for x in names)
        if len(self) < 500_000 and len(word) <= 64:
            self[word] = found
        return found


_MARKS = b".,;:!?\"'()[]{}|#*$%&<>-_/\\+=~^`@"
_TABLE = FeatureTable()


def features(text: str) -> np.ndarray:
    """The distinct features of a whole text, in order."""
    words = set(text.lower().encode("utf-8", "surrogatepass").split())
    found: set[int] = set()
    found.update(*map(_TABLE.__getitem__, words))
    return np.fromiter(found, np.int64, len(found))


@dataclass
class Linear:
    """Weights per feature, for the logarithm of the number of features, and an offset."""

    weights: np.ndarray
    offset: float
    per_width: float

    def raw(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() + self.per_width * np.log1p(len(found))) + self.offset

    def score(self, texts: list[str]) -> np.ndarray:
        raw = np.array([self.raw(features(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 5) -> Linear:
    """Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with logistic loss.

    ``prior`` is the share of positives among the unlabelled. Where the corrected negative risk of a step falls below
    zero, the step goes against it, as the non-negative estimator does. Adam over shuffled batches with a fixed seed.
    Only features that come clearly oftener in positives than in unlabelled texts get a weight.
    Without positives every score is near zero.
    """
    size = 1 << FEATURE_BITS
    model = Linear(np.zeros(size), -4.0, 0.0)
    if not positive or not unlabelled:
        return model
    prior = float(np.clip(prior, 1e-4, 0.9))
    share = lambda docs: (np.bincount(np.concatenate(docs), minlength=size) + 0.5) / (len(docs) + 1)
    p, u = share(positive), share(unlabelled)
    z = (p - u) / np.sqrt(u * (1 - u) * (1 / len(positive) + 1 / len(unlabelled)))
    names = np.sort(np.argsort(-z, kind="stable")[:MOST_FEATURES])
    names = names[z[names] >= LEAST_Z]
    place = np.full(size, -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    widths = np.log1p([len(d) for d in [*positive, *unlabelled]])
    docs = [(p := place[d])[p >= 0] for d in [*positive, *unlabelled]]
    lengths = np.array([len(d) for d in docs])
    starts, flat = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(docs)
    is_positive = np.arange(len(docs)) < len(positive)
    rng = np.random.default_rng(seed)
    w = np.zeros(len(names) + 2)
    w[-1] = np.log(prior / (1 - prior))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    n_p, n_u = len(positive), len(unlabelled)
    steps = max(1, (n_p + n_u) // BATCH)
    for _ in range(EPOCHS):
        order_p, order_u = rng.permutation(n_p), rng.permutation(n_u) + n_p
        for part_p, part_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps)):
            if not len(part_p) or not len(part_u):
                continue
            rows = np.concatenate([part_p, part_u])
            owner = np.repeat(np.arange(len(rows)), lengths[rows])
            offsets = np.arange(lengths[rows].sum()) - np.repeat(np.cumsum(lengths[rows]) - lengths[rows], lengths[rows])
            columns = flat[np.repeat(starts[rows], lengths[rows]) + offsets]
            z = np.bincount(owner, w[columns], len(rows)) + w[-2] * widths[rows] + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            pos = is_positive[rows]
            loss_as_negative = np.logaddexp(0, z)
            negative_risk = loss_as_negative[~pos].mean() - prior * loss_as_negative[pos].mean()
            slope = np.where(pos, -prior * p / len(part_p), p / len(part_u))
            if negative_risk >= 0:
                slope = slope + np.where(pos, -prior * (1 - p) / len(part_p), 0)
            else:
                slope = -slope
            grad = np.concatenate([np.bincount(columns, slope[owner], len(names)), [slope @ widths[rows], slope.sum()]])
            grad[:-2] += DECAY * w[:-2]
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights[names], model.per_width, model.offset = w[:-2], float(w[-2]), float(w[-1])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are never learnt from (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_FIT_POSITIVE,
                 max_unlabelled: int = MAX_FIT_UNLABELLED) -> Linear:
    """The classifier from confirmed toxic documents and documents taken as unlabelled, held-out ones excepted.

    The class prior is the toxic share of all labelled rows outside the held-out fold. Both samples have a documented
    bound, are drawn by hash from all rows, and only their features reach the driver.
    """
    known = labels.where(~held_out(F.col("doc_id"))).where("toxic is not null and doc_id is not null").select("doc_id", "toxic")
    n, toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("int"))).first()
    free = docs.where(~held_out(F.col("doc_id"))).where("doc_id is not null")
    known = known.where("toxic = 1").select("doc_id").distinct()
    parts = []
    for ids, bound, positive in ((known, max_positive, 1), (free.select("doc_id").distinct(), max_unlabelled, 0)):
        chosen = bounded_sample(ids, bound, "doc_id").select(F.col("doc_id").alias("sample_id"), F.lit(positive).alias("positive"))
        parts.append(sampled_texts(free, chosen, bound, "positive"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.sort(features(t)).astype("<i4").tobytes() for t in strings(batch.column(2))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(found, pa.binary())], ["doc_id", "digest", "positive", "found"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, digest string, positive int, found binary"
    measured = by_batch(parts[0].unionByName(parts[1]), run, schema).dropDuplicates(["doc_id", "digest", "positive"])
    got = sorted((r["positive"], bytes(r["found"])) for r in measured.select("positive", "found").collect())
    side = lambda k: [np.frombuffer(x, "<i4") for p, x in got if p == k]
    return fit_nnpu(side(1), side(0), (toxic or 0) / max(n, 1))


def toxicity_scores(docs: DataFrame, model: Linear, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Null and empty texts get the score of a text without features. Repeated rows repeat; other columns are ignored; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(strings(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = by_batch(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
