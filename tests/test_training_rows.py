"""Training rows are narrow, and one pass over them gives all labels."""

from pyspark.sql import functions as F

from emberfield.operators import landuse, learning, shapes
from emberfield.plans import registry, views


def test_training_rows_hold_what_models_read(spark, monkeypatch):
    rows = registry._training_rows(spark, "/root/testdata/sf0.001")
    assert {"detection_id", "category", "frp", "land_use_type", "scan"} <= set(rows.columns)
    assert not {"latitude", "acq_date", "satellite_source", "bright_ti4"} & set(rows.columns)
    read = []
    fit = learning.StringIndexer.fit
    monkeypatch.setattr(learning.StringIndexer, "fit", lambda self, df: read.extend(df.inputFiles()) or fit(self, df))
    index, _, target = learning.encoders(learning.prepared(rows)).stages
    assert read and all("/labels-" in f for f in read)
    for column, labels in (*zip(index.getInputCols(), index.labelsArray), ("category", target.labels)):
        assert list(labels) == sorted(r[0] for r in rows.select(column).distinct().collect())


def test_labels_and_split_are_stored_once(spark):
    rows = registry._training_rows(spark, "/root/testdata/sf0.001")
    encoded, _ = learning.encoded(rows, split=True)
    for df in (rows, encoded):
        assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = learning.stratified_split(rows).select("detection_id", "category", "is_test")
    assert encoded.select("detection_id", "category", "is_test").exceptAll(want).count() == 0 == want.count() - encoded.count()


def test_settled_rows_are_not_moved(spark):
    """The wide cells' ranks are looked up; classes are those of the areas by id, also outside all and without a place."""
    df, areas = views.hotspots(spark, "/root/testdata/sf0.001"), views.landuse(spark, "/root/testdata/sf0.001")
    got = landuse.with_land_use(df, areas)
    assert "Exchange hashpartitioning(detection_id" not in got._jdf.queryExecution().executedPlan().toString()
    order = F.array(*[F.lit(c) for c in landuse.CLASS_PRIORITY])
    place = F.array_position(order, landuse.land_class(F.col("landuse")))
    least = shapes.least_containing(shapes.placed_rows(df), shapes.edges_of(areas), F.when(place > 0, place)).collect()
    want = {r["detection_id"]: landuse.CLASS_PRIORITY[r["rank"] - 1] for r in least}
    rows = got.collect()
    assert len(rows) == df.count() and all(r["land_use_type"] == want.get(r["detection_id"], "unknown") for r in rows)
    assert 0 < len(want) < len(rows)
