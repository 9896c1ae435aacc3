"""Texts are cut in blocks as if each stood alone, and no run is left out that another one needs for its length."""

import random

import numpy as np
import pyarrow as pa

from emberfield.llm import substring
from helpers import awkward


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_blocks_are_cut_like_single_texts(monkeypatch):
    rng = random.Random(15)
    texts = [None, "", "x", "x" * 3000, "again " * 200, "", "é" * 300, *[prose(rng, rng.randrange(1, 400)) for _ in range(60)], "", None]
    for size in (1, 5000, 1 << 18):
        monkeypatch.setattr(substring, "BLOCK_BYTES", size)
        blocks, got = list(substring._blocks(pa.array(["left out", *texts]).slice(1))), []
        assert size < 1 << 18 or len(blocks) == 1  # few calls, however many texts
        for first, data, until in blocks:
            starts, ends, sums = substring._cut(data, until)
            row = np.searchsorted(until, ends)
            opens = np.append(0, until)[row]
            got += zip((first + row).tolist(), (ends - opens).tolist(), sums.tolist(), [data[a:b] for a, b in zip(starts, ends)])
        assert [(i, e) for i, e, _, _ in got] == [(i, e) for i, t in enumerate(texts) for e in substring.chunk_ends(np.frombuffer((t or "").encode(), np.uint8)).tolist()]
        sums = {}
        assert all(sums.setdefault(s, piece) == piece for _, _, s, piece in got) and len(set(sums.values())) == len(sums)


def test_no_chunk_is_less_equal_than_its_bytes():
    """``most_bytes`` is never below the bytes that are equal beside two copies of a chunk."""
    rng = random.Random(16)
    for _ in range(300):
        chunk, sides = prose(rng, 5), [(prose(rng, 9)[:rng.randrange(40)], prose(rng, 9)[:rng.randrange(40)]) for _ in range(2)]
        same = [rng.randrange(0, 40) for _ in range(2)]
        common = [prose(rng, 12)[:n] for n in same]
        found = []
        for before, after in sides:
            data = np.frombuffer((before + common[0] + chunk + common[1] + after).encode(), np.uint8)
            at = np.array([len(before) + same[0]])
            found.append(substring._hashes_beside(substring._widths(data, *substring.BESIDE), at, at + len(chunk)))
        differ = found[0] ^ found[1]
        for side in (0, 1):
            assert substring.most_bytes(differ, side)[0] >= min(same[side], substring.CONTEXT - 1)


def test_runs_that_touch_count_together(spark, monkeypatch):
    """Leaving out runs early changes no stretch."""
    rng = random.Random(17)
    pool = [prose(rng, n) for n in (4, 6, 8, 10, 12, 14) for _ in range(30)]
    rows = [(i, " ".join(rng.choice([prose(rng, 1), rng.choice(pool), rng.choice(pool)]) for _ in range(60))) for i in range(80)]
    found = lambda: sorted((r.doc_id, r.start, r.stop, r.n_chunks, r.first_doc_ids) for r in substring.repeated_spans(awkward(spark, rows)).collect())
    runs = lambda: substring._runs(substring.keyed(awkward(spark, rows)), substring.LEAST_BYTES).count()
    early, kept = found(), runs()
    joined = substring._joined
    monkeypatch.setattr(substring, "_joined", lambda hits, least_bytes: joined(hits, 0))
    assert len(early) > 100 and found() == early and runs() > kept
