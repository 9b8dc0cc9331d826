"""Connected components, whatever the numbering of their nodes."""

import random

from rasterloom.operators import graph


def by_force(edges):
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {x: root(x) for x in label}


def rounds_of(spark, edges, monkeypatch):
    seen, own = [], graph.written

    def counted(df, name):
        seen.append(name)
        return own(df, name)

    monkeypatch.setattr(graph, "written", counted)
    got = {r["id"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    return got, len(seen) - 1


def test_path_of_permuted_nodes_takes_few_rounds(spark, monkeypatch):
    nodes = list(range(2000))
    random.Random(1).shuffle(nodes)
    edges = list(zip(nodes, nodes[1:], strict=False))
    got, rounds = rounds_of(spark, edges, monkeypatch)
    assert set(got.values()) == {0} and len(got) == 2000 and rounds <= 20


def test_path_with_least_ids_at_its_ends(spark, monkeypatch):
    nodes = [0, *range(2, 600), 1]
    got, rounds = rounds_of(spark, list(zip(nodes, nodes[1:], strict=False)), monkeypatch)
    assert set(got.values()) == {0} and rounds <= 20


def test_random_graphs_stars_loops_and_nothing(spark, monkeypatch):
    rng = random.Random(2)
    for n, m in ((60, 30), (60, 70), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        assert rounds_of(spark, edges, monkeypatch)[0] == by_force(edges)
    edges = [(7, k) for k in range(100)] + [(500, 500), (7, 3), (7, 3)]
    assert rounds_of(spark, edges, monkeypatch)[0] == by_force(edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_mesh_is_one_tree_before_any_round(spark, monkeypatch):
    """Edges of a sheet of 40 x 40 vertices meet in one chunk, so no round of labelling sees them."""
    edges = [(r * 40 + c, (r + i) * 40 + c + j) for r in range(39) for c in range(39) for i, j in ((0, 1), (1, 0))]
    got, rounds = rounds_of(spark, edges, monkeypatch)
    assert got == by_force(edges) and rounds == 1


def test_trees_of_many_chunks_are_linked(spark, monkeypatch):
    """A path over many blocks of ids, and ids in more than two chunks."""
    nodes = [k * 5000 for k in range(60)]
    edges = [*zip(nodes, nodes[1:], strict=False), *((3, 5000 * k + 1) for k in range(40)), (7, 7)]
    assert rounds_of(spark, edges, monkeypatch)[0] == by_force(edges)
