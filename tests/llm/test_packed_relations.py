"""Numbers and words of a stored relation are compressed and come back whole."""

import numpy as np
import pyarrow as pa

from emberfield.llm import collocations


def test_relations_take_less_than_their_numbers():
    rng = np.random.default_rng(1)
    item = np.minimum(rng.zipf(1.3, 200_000), 80_000)
    at = np.cumsum(1 + (rng.random(200_000) < 0.1))
    words = [b"word%d" % i for i in range(50_000)]
    row = collocations._relation("en", at, item, np.arange(50_000), np.ones(50_000, np.int64), words)
    step, items, _, counts, text = (pa.scalar(b, pa.binary()) for b in row[1:6])
    assert (np.cumsum(collocations._unpacked(step)) == at).all()
    assert (collocations._unpacked(items) == item).all()
    assert (collocations._unpacked(counts) == 1).all()
    assert collocations._word_list(text).cast(pa.binary()).to_pylist() == words
    assert len(row[1]) + len(row[2]) < 200_000 * 3
    assert len(row[4]) < 1000


def test_empty_numbers():
    assert len(collocations._unpacked(pa.scalar(collocations._packed(np.empty(0, np.int64)), pa.binary()))) == 0
