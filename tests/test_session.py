from pathlib import Path

import pytest

from peerscope import session
from peerscope.session import materialize, temporary_tables


def tables(spark):
    root = Path(session.shared_dir(spark).removeprefix("file:")) / "peerscope" / spark.sparkContext.applicationId
    return {str(p.parent) for p in root.rglob("_SUCCESS")}


def test_tables_go_with_their_step(spark):
    before = tables(spark)
    with temporary_tables(spark):
        inner = materialize(spark.range(5), "inner")
        with temporary_tables(spark):
            deepest = materialize(inner.filter("id > 1"), "deepest")
            assert deepest.count() == 3 and len(tables(spark) - before) == 2
        kept = materialize(inner.filter("id > 2"), "kept", keep=True)
        assert len(tables(spark) - before) == 2 and inner.count() == 5
    assert len(tables(spark) - before) == 1 and kept.count() == 2
    materialize(spark.range(2), "outside")
    assert len(tables(spark) - before) == 2


def test_tables_of_a_failed_step_go(spark):
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), temporary_tables(spark):
        materialize(spark.range(5), "inner")
        raise ZeroDivisionError
    assert tables(spark) == before


def test_a_silhouette_leaves_nothing(spark):
    from tests.test_bounded_silhouette import blobs, labelled
    from tests.test_clusters import frame
    from peerscope.operators.bounded_silhouette import estimate_silhouette

    points, labels = blobs(1, clusters=3, each=20)
    before = tables(spark)
    assert estimate_silhouette(frame(spark, points), labelled(spark, labels), piece_rows=16).silhouette > 0
    assert tables(spark) == before
