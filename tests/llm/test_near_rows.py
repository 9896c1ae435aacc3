"""Near copies among rows that share or lack a doc_id."""

import random

from helpers import awkward

from emberfield.llm import simhash


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_near_copies_go_row_by_row(spark):
    rows = [(1, prose(1)), (None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(1)), (8, prose(4))]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(awkward(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)
