import pytest

from axisframe.shape import IncompatibleShapes, Shape, batch, channel, concat_shapes, dual, instance, merge_shapes, non_batch, primal, shape_spec, spatial


def test_construction_and_selection():
    s = merge_shapes(batch(b=10), spatial(x=4, y=3), channel(vector="x,y"))
    assert s.names == ("b", "x", "y", "vector") and s.volume == 240
    assert spatial(s).names == ("x", "y") and non_batch(s).names == ("x", "y", "vector")
    assert s.only("y,x", reorder=True).names == ("y", "x") and s.without("b").rank == 3
    assert s["vector"].labels == ("x", "y") and s["vector"].size == 2


def test_dual_prefix_and_primal():
    assert dual("x").names == ("~x",)
    assert primal(merge_shapes(dual(x=2), instance(x=2))).names == ("x",)


def test_merge_checks_sizes_and_label_order():
    assert merge_shapes(spatial(x=3), spatial("x"))["x"].size == 3
    with pytest.raises(IncompatibleShapes):
        merge_shapes(spatial(x=3), spatial(x=4))
    with pytest.raises(IncompatibleShapes):
        merge_shapes(channel(v="x,y"), channel(v="y,x"))


def test_canonical_order_and_unknown_volume():
    assert merge_shapes(channel("c"), batch("b"), spatial("x")).kinds == ("batch", "spatial", "channel")
    assert spatial("x").volume is None and not spatial("x").well_defined
    assert Shape().volume == 1


def test_json_and_spec_round_trip():
    s = shape_spec("b:b=5,x:s=4,vector:c=(x,y)")
    assert s == concat_shapes(batch(b=5), spatial(x=4), channel(vector="x,y"))
    assert Shape.from_json(s.to_json()) == s


def test_repeated_names_are_refused():
    with pytest.raises(ValueError):
        concat_shapes(spatial("x"), batch("x"))
