from weftgraph.operators import graph as G


def test_cycles_longer_than_eight(spark):
    ring = [(f"n{i:02}", f"n{(i + 1) % 10:02}") for i in range(10)]
    edges = spark.createDataFrame([*ring, ("n03", "n02"), ("n05", "n05")], "src string, dst string")
    lengths = lambda df: sorted(r.length for r in df.collect())
    assert lengths(G.simple_cycles(edges)) == [1, 2, 10]
    assert lengths(G.call_cycles(edges)) == [2]


def test_components_by_rounds_equal_those_of_one_task(spark):
    import random

    from weftgraph.operators.graph import scc

    rnd = random.Random(3)
    edges = spark.createDataFrame([(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(100)], "src string, dst string")
    one = sorted(map(tuple, scc(edges).collect()))
    assert one == sorted(map(tuple, scc(edges, one_task=0).collect())) and len({c for _, c in one}) < len(one)
    reach = {a: {a} for a, _ in one}
    pairs = [tuple(r) for r in edges.collect()]
    for _ in reach:
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    assert all(c == min(x for x in reach[a] if a in reach[x]) for a, c in one)


def test_walks_equal_the_frontier(spark):
    import random

    from weftgraph.operators.graph import simple_cycles

    rnd = random.Random(5)
    edges = spark.createDataFrame([(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(24)], "src string, dst string")
    for most, least in ((None, 1), (4, 2)):
        one = sorted(map(tuple, simple_cycles(edges, most, least).collect()))
        assert one and one == sorted(map(tuple, simple_cycles(edges, most, least, walked=0).collect()))
