import pytest

import tallyfold as tf


def segments(spark, rows):
    return spark.createDataFrame(rows, "customerid string, country string, recency long, monetary double, segment string")


@pytest.fixture(scope="module")
def many(spark):
    kinds = ("Low-Value", "Mid-Value", "High-Value")
    return segments(spark, [(f"c{i}", "x", i % 50, float(i * 7 % 400), kinds[0 if i > 3 else i % 3]) for i in range(3000)])


def test_thinned_points_are_bounded_and_keep_every_segment(many):
    every = {(r.x, r.y, r.segment, r.colour) for r in tf.scatter(many, "recency", "monetary").collect()}
    for per_cell in (1, 4):
        thin = tf.scatter(many, "recency", "monetary", grid=5, per_cell=per_cell).collect()
        found = {(r.x, r.y, r.segment, r.colour) for r in thin}
        assert found <= every and {r.segment for r in thin} == {"Low-Value", "Mid-Value", "High-Value"}
        assert 25 <= len(thin) <= 75 * per_cell
        cells = {(min(int(r.x / 49 * 5), 4), min(int(r.y / 399 * 5), 4)) for r in thin}
        assert len(cells) == 25


def test_thinned_points_do_not_depend_on_the_layout(many):
    first, second = (
        sorted(map(str, tf.scatter(df, "recency", "monetary", grid=7, per_cell=2).collect())) for df in (many, many.repartition(13, "monetary"))
    )
    assert first == second


def test_one_place_and_no_points(spark):
    same = segments(spark, [("a", "x", 1, 2.0, "Low-Value"), ("b", "x", 1, 2.0, "Low-Value")])
    assert [(r.x, r.y) for r in tf.scatter(same, "recency", "monetary", grid=9).collect()] == [(1.0, 2.0)]
    assert tf.scatter(same, "recency", "monetary", country="y", grid=9).collect() == []
