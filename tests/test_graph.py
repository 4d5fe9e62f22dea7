"""Graph jobs against brute force on small graphs."""

import random

import pytest

from weftwork.plans import graph as G


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def closure(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[n] = seen
    return reach


@pytest.mark.parametrize("seed", range(4))
def test_cycles_and_reach_on_random_graphs(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randint(0, 14)}", f"n{rnd.randint(0, 14)}") for _ in range(18)]
    reach = closure([p for p in pairs if p[0] != p[1]])
    got = {r["node"]: r["component"] for r in G.components(edges_of(spark, pairs)).collect()}
    assert set(got) == {n for n, r in reach.items() if n in r}
    assert all((got[a] == got[b]) == (b in reach[a] and a in reach[b]) for a in got for b in got)
    seed_node = pairs[0][0]
    seeds = spark.createDataFrame([(seed_node,)], "node string")
    assert {r["node"] for r in G.reachable(edges_of(spark, pairs), seeds).collect()} == closure(pairs)[seed_node] | {seed_node}


def test_node_between_two_cycles_is_no_member(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "x"), ("s", "s")]
    assert {r["node"] for r in G.cycle_members(edges_of(spark, pairs)).collect()} == {"a", "b", "x", "y"}


def test_acyclic_graph_has_no_components(spark):
    assert G.components(edges_of(spark, [("a", "b"), ("b", "c")])).count() == 0
    assert G.components(edges_of(spark, [])).count() == 0


def test_shortest_path_prefers_fewest_hops_then_names(spark):
    pairs = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "x"), ("x", "y"), ("y", "e")]
    row = G.shortest_paths(edges_of(spark, pairs), "a", "e").first()
    assert (row["hops"], row["path"]) == (3, ["a", "b", "d", "e"])
    assert G.shortest_paths(edges_of(spark, pairs), "e", "a").count() == 0


def test_levels_with_a_cycle_and_ranks(spark):
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("c", "d"), ("e", "d")], "node string, depends_on string")
    ranks = spark.createDataFrame([(n, 4 if n == "a" else 0) for n in "abcdef"], "node string, rank int")
    got = {r["node"]: r["level"] for r in G.levels(deps, ranks).collect()}
    assert got == {"a": 4, "b": 5, "c": 6, "d": 0, "e": 1, "f": 0}


ENTRY = ("entry_order int, layer string, recipe string, workflow string, target string, execution_order int, "
         "sources array<struct<table:string,active:boolean,day_offset:int>>, lookup_tables array<string>, "
         "targets_write_mode array<struct<target_table:string,write_mode:string>>, "
         "target_partition array<struct<target_table:string,partition_type:string,partition_key:string,subpartition_key:string>>")


def test_relationship_graph(spark, rows):
    entries = spark.createDataFrame([
        (1, "ODS", "r1", " ", "T1", 1, [("S", True, 0)], ["L"], [("T2", "LATE")], []),
        (2, "DWH", "r2", "wf", "T2", 1, [("T1", True, 0), ("T1", True, 0)], [], [("T2", "APPEND")], [("T2", "DAILY", "D", "")]),
        (3, "CDM", "r3", "wf", "T2", 2, [("T2", False, 3)], ["L"], [], [])], ENTRY)
    paths = spark.createDataFrame([("r1", "ODS/m1/r1"), ("r1", "ZZ/m/r1")], "recipe string, path string")
    edges = G.graph_edges(entries)
    assert edges.count() == 8
    nodes = {r["id"]: r for r in G.graph_nodes(entries, paths).collect()}
    assert len(nodes) == 7
    assert nodes["table:T2"]["layer"] == "DWH" and nodes["table:T2"]["write_mode"] == "LATE" and nodes["table:T2"]["partition_type"] == "DAILY"
    assert nodes["table:L"]["layer"] == "ODS" and nodes["table:S"]["write_mode"] is None
    assert nodes["recipe:r1"]["mapping_path"] == "ODS/m1" and not nodes["recipe:r2"]["has_recipe"]
    assert rows(G.recipe_deps(edges)) == [("recipe:r2", "recipe:r1"), ("recipe:r3", "recipe:r2")]
    assert rows(G.clusters(G.graph_nodes(entries, paths))) == [("UNGROUPED", "r1"), ("wf", "r2"), ("wf", "r3")]
    assert rows(G.degree_report(G.links(edges)).filter("is_fan_in"), "node") == [("recipe:r1",), ("recipe:r3",), ("table:T2",)]
