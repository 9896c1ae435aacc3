"""Collocations, vector codes and nearest neighbours against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.llm import codes, collocations, neighbours
from helpers import awkward, empty, read

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_of(rows, least, per_lang=2000, covered=80):
    """The contract in plain Python."""
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, found in f.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        rows = []
        for p, a in candidates.items():
            if 100 * inside[p] >= covered * a and inside[p]:
                continue
            score, k = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        rows.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:per_lang], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations_random(spark):
    rng = random.Random(5)
    words = ["a", "B", "b", "é", "日本", "x\x1cy", "\x85", "über", "A1", "--"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";a ", " : "]) for _ in range(rng.randrange(60))), rng.choice([None, "und", "de", "fr"])) for _ in range(80)]
    rows += [(None, "de"), ("", None), (" ", "x"), ("la la la la la la", "es"), ("la la la la la la", "es")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for least, per_lang in ((3, 2000), (8, 7)):
        assert rows_of(collocations.collocations(df, least=least, per_lang=per_lang)) == phrases_of(rows, least, per_lang)


def test_collocations_cut_text(spark, monkeypatch):
    """Long texts are split into words segment by segment and lose nothing between them."""
    text = ("one two three four. " * 50 + "x" * 300 + " ") * 3
    for size in (1, 7, 100):
        monkeypatch.setattr(collocations, "SEGMENT_BYTES", size)
        coded, words = collocations._coded([text.encode(), b"", b"four  one"])
        assert [words[c] for c in coded if c] == [w for p in re.split(r"\.", text) for w in p.encode().split()] + [b"four", b"one"]


def test_collocations_shuffled_keys(spark, monkeypatch):
    docs = read(spark, "documents")
    monkeypatch.setattr(collocations, "BROADCAST_KEYS", 0)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert rows_of(collocations.collocations(docs)) == phrases_of(rows, 30)


def test_collocations_key_ranges(spark, monkeypatch):
    """Ranges of few keys, merged several times, give the rows of one range."""
    rows = [(" ".join(f"w{(i * 7 + j * j) % 23}" for j in range(60)), "en" if i % 3 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    monkeypatch.setattr(collocations, "RANGE_KEYS", 16)
    monkeypatch.setattr(collocations, "RELATION_BYTES", 2000)
    assert rows_of(collocations.collocations(docs, least=5)) == phrases_of(rows, 5)
    numbers = np.array([0, 1, 255, 256, 70_000, 1 << 40])
    assert (collocations._from_planes(collocations._planes(numbers)) == numbers).all()


def test_collocations_send_phrases_in_packs(spark):
    """Passing phrases are neither stored as text nor shuffled a row each, and are counted per language."""
    docs = spark.createDataFrame([(i, "a b c d " * 40, "en" if i % 2 else None) for i in range(50)], "doc_id long, text string, lang string").coalesce(2)
    relations = collocations.occurrences(docs)
    assert "done" not in relations.columns
    for bits in (0, 3):
        counted = collocations._counted(relations, 1, 30, bits)
        assert sorted(map(tuple, counted.collect())) == sorted((lang, w, 1000) for lang in ("en", "und") for w in "abcd")
        assert "HashAggregate" not in counted._jdf.queryExecution().executedPlan().toString()
    assert collocations._counted(relations, 1, 1001, 0).collect() == []


def test_collocations_key_collisions(spark, monkeypatch):
    """Equal keys of different phrases cost work but change no count."""
    monkeypatch.setattr(collocations, "_keys", lambda lang, tuples, words: np.arange(len(tuples), dtype=np.int64) % 3)
    docs = awkward(spark, [(i, "a b c d. a b" if i % 2 else f"z{i} b c") for i in range(12)])
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert rows_of(collocations.collocations(docs, least=4)) == phrases_of(rows, 4)


def test_collocations_awkward(spark):
    docs = awkward(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert rows_of(collocations.collocations(docs, least=2)) == phrases_of(rows, 2)
    assert collocations.collocations(empty(docs)).collect() == []


def coded(rows, parts=8, entries=16, rounds=6):
    """The contract in Python integers: rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * w:(p + 1) * w])
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = tuple(sum(c) // len(g) for c in zip(*g))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, by = [], Counter()
    for i, v, lab in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        by[lab] += sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
    return sorted((i, c, e, by[lab], digest) for i, c, e, lab in out)


VECTORS = "vec_id long, embedding array<float>, label int, code string, region int, `n` long"


def code_rows(df):
    return sorted(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect())


@pytest.mark.parametrize("n, width", [(300, 16), (9, 8), (120, 32)])
def test_codes_exact(spark, n, width):
    rng = np.random.default_rng(n)
    values = np.float32(rng.normal(size=(n, width)) * rng.choice([0.001, 1, 200], size=(n, 1)))
    values[n // 3:n // 2] = values[0]
    rows = [(int(i), [float(x) for x in v], None if i % 7 == 0 else int(i % 3)) for i, v in zip(rng.permutation(n), values)]
    rows += [(10_000, None, 1), (10_001, [None] + [0.0] * (width - 1), 1), (10_002, [math.nan] * width, 2), (10_003, [math.inf] * width, None)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], VECTORS).repartition(3)
    for block_rows in (1, 8, 32):
        assert code_rows(codes.vector_codes(df, block_rows=block_rows)) == coded(rows)


def test_codes_awkward(spark):
    lists = [(1, [1.0] * 8), (2, [1.0] * 3), (2, [1.0] * 3), (None, [0.5] * 11), (3, []), (4, [3e38] * 8), (5, [-3e38] * 8)]
    df = spark.createDataFrame([(i, v, None, None, None, None) for i, v in lists], VECTORS)
    got = codes.vector_codes(df).collect()
    assert len(got) == len(lists)
    assert all(len(r["code"]) == 16 and r["error"] == 0 for r in got)  # fewer different rows than entries
    assert codes.vector_codes(empty(df)).collect() == []


def test_hilbert_neighbours():
    """Along the curve, every step goes to a neighbouring point of the grid."""
    for width, bits in ((2, 2), (3, 2), (4, 1)):
        side, most = 1 << bits, (1 << min(16, 64 // width)) - 1
        grid = np.indices((side,) * width).reshape(width, -1).T
        spread = grid * (most // (side - 1))  # over all bits of the key
        walked = grid[codes.hilbert_order(spread)]
        assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()
    same = np.zeros((5, 40), np.int32)
    assert codes.hilbert_order(same).tolist() == [0, 1, 2, 3, 4]


def test_shortlists_keep_the_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (200, 4)).astype(np.int32)
    order, low, high, total = codes._blocks(x, 8)
    row = {"x": x[None].tobytes(), "blocked": order.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "total": total.tobytes()}
    chunk, book = codes.Chunk(row, 0, 1, 4, 8), rng.integers(-50, 50, (16, 4)).astype(np.int64)
    listed = chunk.shortlists(book)
    away = ((x[order][:, None, :].astype(np.int64) - book) ** 2).sum(2)
    assert listed[chunk.block, away.argmin(1)].all() and not listed.all()
    n, sums = chunk.gathered(book)
    assert n.tolist() == np.bincount(away.argmin(1), minlength=16).tolist()
    assert all((sums[e] == x[order][away.argmin(1) == e].sum(0)).all() for e in range(16))


def nearest(rows, queries, k):
    """Brute force in doubles, components added in order."""
    usable = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in usable:
        if i not in queries:
            continue
        scored = []
        for j, w in usable:
            if (j, w) != (i, v):
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                scored.append((-s, j))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def neighbour_rows(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect())


def test_neighbours_exact_at_factor_one(spark):
    rng = np.random.default_rng(1)
    values = np.float32(rng.normal(size=(900, 6)) * rng.choice([0.1, 1, 5], size=(900, 1)))
    values[100:400] = values[100]  # a third of all rows is one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [(5000, None), (5001, [None] * 6), (5002, [math.nan] * 6), (5020, [0.0] * 6), (None, [1.0] * 6), (20, rows[20][1]), (40, rows[41][1])]
    df = spark.createDataFrame([(i, v, None, "c", 1, 2) for i, v in rows], VECTORS).repartition(3)
    expected = nearest(rows, set(range(0, 6000, 20)), 20)
    for shard_rows in (100_000, 64):
        index = neighbours.build_index(df, shard_rows=shard_rows)
        assert index.rows.groupBy("region", "shard").count().agg(F.max("count")).first()[0] <= 2 * shard_rows
        assert neighbour_rows(index.search(df.where("vec_id % 20 = 0"), relax=1.0)) == expected


def test_neighbours_recall(spark):
    df = read(spark, "embeddings", "/root/testdata/sf0.1")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    queries = set(range(0, 2000, 20))
    expected = {(q, j) for q, _, j, _ in nearest(rows, queries, 20)}
    index = neighbours.build_index(df, shard_rows=256)
    got = neighbour_rows(index.search(df.where("vec_id % 20 = 0")))
    assert len(got) == len(expected) and len({(q, j) for q, _, j, _ in got} & expected) >= 0.95 * len(expected)
    scores = {(q, j): s for q, _, j, s in nearest(rows, queries, 2000)}
    assert all(scores[q, j] == s for q, _, j, s in got)


def test_neighbours_awkward(spark):
    lists = [(1, [1.0]), (2, [2.0, 1.0]), (3, [])]
    df = spark.createDataFrame([(i, v, None, None, None, None) for i, v in lists], VECTORS)
    assert neighbour_rows(neighbours.nearest_neighbours(df, df)) == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]
    assert neighbours.nearest_neighbours(empty(df), empty(df)).collect() == []
    assert neighbours.nearest_neighbours(df, empty(df)).collect() == []
    assert neighbours.nearest_neighbours(empty(df), df).collect() == []
