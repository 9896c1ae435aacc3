"""Stored steps leave no shuffle files behind for the driver's garbage collection."""

import os
import time

from emberfield.llm import collocations, substring
from emberfield.session import shuffles_freed
from helpers import awkward

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {os.path.join(d, f) for top in folders for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def left_by(spark, step):
    """New shuffle files that stay after ``step``; files are deleted in the background."""
    before, result = shuffle_files(spark), step()
    for _ in range(20):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    return new, result


def texts(spark):
    return awkward(spark, [(i, " ".join(f"w{(i + k) % 40}" for k in range(60))) for i in range(200)])


def test_passages_leave_no_shuffle_files(spark):
    new, spans = left_by(spark, lambda: substring.stretches(substring.keyed(texts(spark))))
    assert not new
    assert spans.count() > 100


def test_phrases_leave_no_shuffle_files(spark):
    new, (phrases, _) = left_by(spark, lambda: collocations.frequent_phrases(texts(spark)))
    assert not new
    assert phrases.count() > 40


def test_the_setting_comes_back(spark):
    before = spark.conf.get(SETTING)
    with shuffles_freed(spark), shuffles_freed(spark):
        assert spark.conf.get(SETTING) == "true"
    assert spark.conf.get(SETTING) == before
