"""Samples of a fit over tables whose doc_ids repeat."""

import random
import zlib

import numpy as np
from helpers import awkward

from emberfield.llm import quality, toxicity


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def repeated_documents(spark):
    docs = [(i, prose(i)) for i in range(200)] * 2
    labels = spark.createDataFrame([(i, int(i >= 80), int(i < 60)) for i in range(200)], "doc_id long, quality int, toxic int")
    return awkward(spark, docs), labels


def test_quality_sample_is_not_cut_by_label(spark, monkeypatch):
    docs, labels = repeated_documents(spark)
    seen = []
    monkeypatch.setattr(quality, "fit_trees", lambda x, y, signs: seen.append(y))
    quality.fit_quality(docs, labels, max_fit_rows=200)
    assert len(seen[0]) == 200 and seen[0].sum() == 120
    many = awkward(spark, [(5, prose(i)) for i in range(300)])
    quality.fit_quality(many, labels, max_fit_rows=50)
    assert len(seen[1]) == 50 and (seen[1] == 0).all()


def test_toxicity_sample_counts_each_text_once(spark, monkeypatch):
    docs, labels = repeated_documents(spark)
    seen = []
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda positive, plain, prior: seen.append((positive, plain)))
    toxicity.fit_toxicity(docs, labels)
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_FOLD]
    positive, plain = seen[0]
    assert len(positive) == sum(i < 60 for i in free) and len(plain) == len(free)
    assert len({np.asarray(x).tobytes() for x in plain}) == len(free)
