"""Quality rules: fixed limits, then boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import SPACES, bounded_sample, by_batch, sampled_texts, strings
from .trees import FlatTrees, fit_trees

#: Labelled documents that a fit may use at most.
MAX_FIT_ROWS = 20_000
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: A document stays if its score reaches this.
KEEP_FROM = 0.5
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "line_words")
#: More symbols, copied lines, repeated words, capitals and marks never raise the score.
SIGNS = np.array([0, 0, -1, -1, -1, -1, 0, -1, 0, 0])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of consecutive words found at least twice, the first one included.

    Equal windows have equal hashes, so texts without two equal hashes are done. Otherwise windows are ranked exactly:
    words, then pairs of ranks for widths 2 and 4, then the last word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    first: dict[bytes, int] = {}
    word = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    rank, width = word, 1
    while width * 2 <= window:
        pair = rank[:-width] * (rank.max() + 1) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1], width * 2
    for i in range(width, window):
        pair = rank[: len(rank) - 1] * (word.max() + 1) + word[i: i + len(rank) - 1]
        rank = np.unique(pair, return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """(counts of COUNTS, values of FEATURES) of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    symbols = sum(data.count(bytes([b])) for b in SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    marks = data.count(b"!") + data.count(b"?")
    c, w = max(chars, 1), max(n, 1)
    values = [np.log1p(n), chars / w, symbols / w, dups / max(len(lines), 1), repeats / w, upper / c, digits / c, marks / w,
              len(set(words)) / w, n / max(len(lines), 1)]
    return [n, chars, symbols, dups, repeats], values


def judge(texts: list[str], model: FlatTrees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, base_failed, score, kept) of the texts."""
    counts, values = zip(*map(measure, texts))
    counts = np.array(counts, np.int64)
    failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])
    score = model.score(np.array(values))
    return counts, failed, score, ~failed & (score >= KEEP_FROM)


def fit_quality(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> FlatTrees:
    """Trees for ``labels.quality`` from at most ``max_fit_rows`` labelled documents, the only thing the driver collects.

    Rows without a label or an id are not used; without both classes the score is constant. The sample of
    labels has a fixed bound and is broadcast, so texts are measured where they are read. An id's texts count once
    each, and what they make of the sample is bounded by hash again.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    known = bounded_sample(known, max_fit_rows, "doc_id", "quality").withColumnRenamed("doc_id", "sample_id")
    rows = sampled_texts(docs, known, max_fit_rows, "quality")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([measure(t)[1] for t in strings(batch.column(2))])
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, values.T), batch.column(3)], ["doc_id", "digest", *FEATURES, "quality"])

    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}, digest string", *[f"{f} double" for f in FEATURES], "quality int"])
    measured = by_batch(rows.withColumn("quality", F.col("quality").cast("int")), run, schema)
    measured = measured.dropDuplicates(["doc_id", "digest", "quality"])
    got = np.array(measured.select(*FEATURES, "quality").collect(), float).reshape(-1, len(FEATURES) + 1)
    got = got[np.lexsort(got.T)]
    return fit_trees(got[:, :-1], got[:, -1], SIGNS)


def quality_report(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept of every row.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated windows; such documents and those that
    the trees score below ``KEEP_FROM`` are not kept. Null counts as empty, which fails; repeated rows
    repeat; other columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, failed, score, kept = judge(strings(batch.column(1)), model)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(kept)],
            ["doc_id", *COUNTS, "base_failed", "score", "kept"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    schema = ", ".join([f"doc_id {kind}", *[f"{c} long" for c in COUNTS], "base_failed boolean, score double, kept boolean"])
    return by_batch(docs.select("doc_id", "text"), run, schema)


def keep_good(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """The rows of ``docs`` that the rules and the trees keep, unchanged."""
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge(strings(batch.column(at)), model)[3]))

    return by_batch(docs, run, docs.schema)
