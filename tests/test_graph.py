import pytest

from rasterloom.operators.node import EngineError
from rasterloom.plans.commands import Journal
from rasterloom.plans.graph import Graph, Group, Node, registry_manifest
from tests.test_raster import picture, values

TEXT = '{"nodes": [{"id": "s", "type": "image_source"}, {"id": "a", "type": "exposure", "params": {"exposure": 1.0}}, {"id": "b", "type": "invert"}], "wires": [{"from": "s", "to": "a"}, {"from": "a", "to": "b"}]}'


def test_render_and_round_trip(spark):
    g = Graph.from_json(TEXT)
    assert Graph.from_json(g.to_json()).to_json() == g.to_json()
    assert values(g.render("b", {"s": picture(spark, [[0.1, 0.4]])}))[0] == pytest.approx([0.8, 0.2])
    assert g.order() == ["s", "a", "b"]
    with pytest.raises(EngineError):
        g.render("b", {})


def test_wiring_is_checked():
    g = Graph.from_json(TEXT)
    for bad in (("b", "a"), ("a", "a"), ("s", "a", "nowhere"), ("a", "s"), ("x", "a")):
        with pytest.raises(EngineError):
            g.connect(*bad)
    g.add(Node("c", "invert"))
    old = g.connect("s", "b")
    assert old.from_id == "a" and g.incoming("b") == {"in": "s"}


def test_equal_nodes_have_equal_keys():
    g = Graph.from_json(TEXT)
    g.add(Node("a2", "exposure", {"exposure": 1.0}))
    g.connect("s", "a2")
    k = g.keys()
    assert k["a"] == k["a2"]
    g.set_param("a2", "exposure", 2.0)
    assert g.keys()["a2"] != k["a"]


def test_undo_redo_and_batches():
    j = Journal()
    j.apply(("create_node", "s", "image_source"))
    j.apply(("batch", [("create_node", "a", "exposure"), ("connect", "s", "a"), ("set_param", "a", "exposure", 1.0)]))
    full = j.graph.to_json()
    j.apply(("delete_node", "a"))
    assert j.undo() and j.graph.to_json() == full
    assert j.redo() and "a" not in j.graph.nodes and not j.redo()
    assert j.undo() and j.undo() and list(j.graph.nodes) == ["s"]
    j.apply(("rename_node", "s", "source"))
    assert not j.undone
    before = j.graph.to_json()
    with pytest.raises(EngineError):
        j.apply(("batch", [("create_node", "b", "invert"), ("connect", "b", "b")]))
    assert j.graph.to_json() == before
    while j.undo():
        pass
    assert not j.graph.nodes


def test_groups(spark):
    recipe = Group(Graph.from_json('{"nodes": [{"id": "a", "type": "exposure", "params": {"exposure": 1.0}}, {"id": "b", "type": "invert"}], "wires": [{"from": "a", "to": "b"}]}'), {"in": ("a", "in")}, "b", {"gain": ("a", "exposure")})
    g = Graph()
    g.add(Node("s", "image_source"))
    one, two = recipe.place(g, "one.", {"in": "s"}), recipe.place(g, "two.", {"in": "s"}, {"gain": 2.0})
    p = picture(spark, [[0.1]])
    assert values(g.render(one, {"s": p}))[0] == pytest.approx([0.8]) and values(g.render(two, {"s": p}))[0] == pytest.approx([0.6])


def test_manifest():
    found = {n["type"]: n for n in registry_manifest()}
    assert found["blend"]["params"]["mode"]["choices"][0] == "normal" and found["blend"]["needs"] == ["base"]
