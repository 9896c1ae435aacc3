"""The merge works out confirmations once."""

from emberfield.operators import coincidence
from emberfield.plans import views


def test_merge_reads_stored_confirmations(spark):
    rows = views.hotspots(spark, "/root/testdata/sf0.001")
    merged = coincidence.merge_coincident(rows)
    names = {f.rsplit("/", 2)[1].rsplit("-", 1)[0] for f in merged.inputFiles()}
    assert "flagged" in names and not names & {"sites", "marked", "blocks", "detections"}
    assert merged.columns == [*rows.columns, "co_confirmed"]
    flags = {r[0]: r[1] for r in coincidence.with_co_confirmed(rows).select("detection_id", "co_confirmed").collect()}
    assert all(flags[r[0]] == r[1] for r in merged.select("detection_id", "co_confirmed").collect())
