"""Components of graphs in which a node hangs between two smaller ones."""

from itertools import combinations

from tagloom.llm._graph import components


def parts(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in root)


def test_a_node_between_two_roots_joins_them(spark):
    edges = [(3, 1), (3, 2), (4, 0), (4, 2)]
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == [(n, 0) for n in range(5)]


def test_every_graph_of_four_edges_on_five_nodes(spark):
    graphs = list(combinations(combinations(range(5), 2), 4))
    edges = [(10 * k + b, 10 * k + a) for k, g in enumerate(graphs) for a, b in g]
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == parts(edges)


def test_no_edges_give_no_nodes(spark):
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_a_star_takes_two_stages_of_edges(spark):
    """Where every edge ends in a root from the start, no round is made."""
    tracker = spark.sparkContext.statusTracker()
    edges = spark.createDataFrame([(i, 0) for i in range(1, 50)], "u long, v long")
    spark.sparkContext.setJobGroup("a star", "")
    out = components(edges)
    jobs = len(tracker.getJobIdsForGroup("a star"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 50 and 0 < jobs <= 8
