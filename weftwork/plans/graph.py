"""Graph jobs over an edge table ``(src, dst)``.

Iterative jobs join a frontier with the edges and write each round to the
checkpoint folder. The edges are shuffled anew in each round on purpose: a kept
partitioning would pin a hub's edges to one task, a fresh shuffle lets AQE split them. Only counts come to the driver, results are relations (a hub with a
third of all edges is never gathered into one row), and rounds end when the frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import cut


class Gathered:
    """The union of checkpointed rounds; rewritten as one now and then so the plan stays short."""

    MERGE_AFTER = 16

    def __init__(self, first: DataFrame):
        self.df, self._parts = first, 1

    def add(self, part: DataFrame) -> None:
        self.df, self._parts = self.df.union(part), self._parts + 1
        if self._parts >= self.MERGE_AFTER:
            self.df, self._parts = cut(self.df), 1


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct (node, neighbour) in both directions."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(
        edges.select("dst", "src")).distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every node reachable from ``seeds`` (column ``node``), seeds included."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(seeds.select("node").distinct())
    seen = Gathered(frontier)
    while True:
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.df, "node", "left_anti"))
        if frontier.isEmpty():
            return seen.df
        seen.add(frontier)


def shortest_paths(edges: DataFrame, source: str, target: str | None = None) -> DataFrame:
    """(node, hops, path) from ``source``; among equally short paths the smallest by name. Stops at ``target`` if given."""
    edges = cut(edges.select("src", "dst").distinct())
    start = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.lit(0).alias("hops"),
                                               F.array(F.lit(source)).alias("path"))
    frontier = cut(start)
    seen = Gathered(frontier)
    while True:
        step = (frontier.join(edges, frontier["node"] == edges["src"])
                .groupBy(F.col("dst").alias("node"))
                .agg(F.min("hops").alias("h"), F.min("path").alias("p"))
                .select("node", (F.col("h") + 1).alias("hops"), F.concat("p", F.array("node")).alias("path")))
        frontier = cut(step.join(seen.df.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
        if target is not None and not frontier.filter(F.col("node") == target).isEmpty():
            break
    return seen.df if target is None else seen.df.filter(F.col("node") == target)


def levels(deps: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, level): at least the node's own ``rank`` and one more than every node it depends on.

    ``deps`` holds (node, depends_on); ``ranks`` (node, rank). Dependencies that
    lie on a cycle are left out, so the rounds end after the longest chain.
    """
    deps = deps.select("node", "depends_on").distinct().filter(F.col("node") != F.col("depends_on"))
    knots = components(deps.select(F.col("node").alias("src"), F.col("depends_on").alias("dst")))
    left, right = (knots.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}")) for n in ("node", "depends_on"))
    deps = cut(deps.join(left, "node", "left").join(right, "depends_on", "left")
               .filter(~F.coalesce(F.col("c_node") == F.col("c_depends_on"), F.lit(False))).select("node", "depends_on"))
    now = moved = cut(ranks.select("node", F.col("rank").alias("level")))
    while True:  # only nodes whose level rose can raise others
        floor = (deps.join(moved.withColumnRenamed("node", "depends_on"), "depends_on")
                 .groupBy("node").agg((F.max("level") + 1).alias("floor")))
        raised = cut(now.join(floor, "node", "left").select(
            "node", F.greatest("level", "floor").alias("level"), (F.col("floor") > F.col("level")).alias("moved")))
        now, moved = raised.select("node", "level"), raised.filter("moved").select("node", "level")
        if moved.isEmpty():
            return now


def workflow_levels(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(workflow, task, level): the dense rank of the task's execution order inside its workflow, pushed behind what it depends on there.

    ``tasks`` holds (workflow, task, execution_order), NULL order reads as 0; ``deps`` (task, depends_on), of which only those inside one
    workflow count.
    """
    tasks = tasks.select("workflow", "task", F.coalesce("execution_order", F.lit(0)).alias("execution_order"))
    orders = tasks.select("workflow", "execution_order").distinct()  # a workflow's distinct orders, not its tasks
    rank = F.dense_rank().over(Window.partitionBy("workflow").orderBy("execution_order")) - 1
    node = lambda workflow, task: F.to_json(F.struct(F.col(workflow).alias("w"), F.col(task).alias("t")))
    ranked = cut(tasks.join(orders.withColumn("rank", rank), ["workflow", "execution_order"]).withColumn("node", node("workflow", "task")))
    other = tasks.select(F.col("workflow").alias("w2"), F.col("task").alias("depends_on"))
    inside = (deps.join(tasks.select("workflow", "task"), "task").join(other, "depends_on").filter(F.col("workflow") == F.col("w2"))
              .select(node("workflow", "task").alias("node"), node("workflow", "depends_on").alias("depends_on")))
    found = levels(inside, ranked.select("node", "rank"))
    return ranked.join(found, "node").select("workflow", "task", "level")


def trim(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without an incoming or an outgoing edge are removed again and again."""
    size = edges.count()
    while size:
        inner = edges.select(F.col("src").alias("n")).intersect(edges.select("dst"))
        edges = cut(edges.join(inner, edges["src"] == inner["n"], "left_semi")
                    .join(inner.withColumnRenamed("n", "m"), F.col("dst") == F.col("m"), "left_semi"))
        left = edges.count()
        if left == size:
            break
        size = left
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every strongly connected component of two or more nodes.

    Colouring: the largest node name floods forwards, and from each node that
    kept its own name the same colour is walked backwards; what is met is one
    component. Memory stays linear in the edges, unlike a transitive closure.
    """
    edges = cut(edges.select("src", "dst").distinct().filter(F.col("src") != F.col("dst")))
    found = None
    while True:
        edges = trim(edges)
        if edges.isEmpty():
            break
        colour = moved = cut(nodes_of(edges).withColumn("colour", F.col("node")))
        while True:  # only nodes that changed colour pass it on
            pushed = (edges.join(moved.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"))
                      .agg(F.max("colour").alias("c")))
            step = cut(colour.join(pushed, "node", "left").select(
                "node", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("moved")))
            colour, moved = step.select("node", "colour"), step.filter("moved").select("node", "colour")
            if moved.isEmpty():
                break
        same = (edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src")
                .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
                .filter(F.col("cs") == F.col("cd")))
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = reachable(back, colour.filter(F.col("node") == F.col("colour")).select("node"))
        done = cut(members.join(colour, "node").select("node", F.col("colour").alias("component")))
        found = done if found is None else found.union(done)
        edges = cut(edges.join(done, edges["src"] == done["node"], "left_anti")
                    .join(done, F.col("dst") == done["node"], "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    sized = found.groupBy("component").count().filter("count > 1").select("component")
    return found.join(sized, "component", "left_semi").select("node", "component")


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes that take part in a cycle of two or more nodes."""
    return components(edges).select("node")


def degree_report(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, and flags) by distinct neighbours; one aggregate over both ends of each edge."""
    distinct = edges.select("src", "dst").distinct()
    ends = distinct.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(
        distinct.select("dst", F.lit(1), F.lit(0)))
    return (ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
            .select("node", "fan_in", "fan_out", (F.col("fan_in") >= 2).alias("is_fan_in"),
                    (F.col("fan_out") >= 2).alias("is_fan_out"), (F.col("fan_in") == 0).alias("source_only"),
                    (F.col("fan_out") == 0).alias("no_consumer")))


# --- the relationship graph of control entries -------------------------------


def graph_edges(entries: DataFrame) -> DataFrame:
    """Distinct (from, to, kind): source and lookup tables into recipes, recipes into targets."""
    recipe = F.concat(F.lit("recipe:"), "recipe")
    table = lambda c: F.concat(F.lit("table:"), c)
    links = F.concat(
        F.array(F.struct(recipe.alias("from"), table(F.col("target")).alias("to"), F.lit("writes").alias("kind"))),
        F.transform("sources", lambda s: F.struct(table(s["table"]).alias("from"), recipe.alias("to"), F.lit("source").alias("kind"))),
        F.transform("lookup_tables", lambda t: F.struct(table(t).alias("from"), recipe.alias("to"), F.lit("lookup").alias("kind"))))
    return entries.select(F.explode(links).alias("e")).select("e.*").distinct()


def links(edges: DataFrame) -> DataFrame:
    """Relationship edges as plain (src, dst) for the graph jobs."""
    return edges.select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def graph_nodes(entries: DataFrame, recipe_paths: DataFrame, order: str = "entry_order") -> DataFrame:
    """Table and recipe nodes of the graph.

    A table's layer is its first writer's, else that of the first entry naming it; write mode
    and partition type come from the first entry in the whole list that
    declares them. ``recipe_paths`` holds the (recipe, path) of known recipe files.
    """
    paths = recipe_paths.groupBy("recipe").agg(F.min("path").alias("path"))
    recipes = (entries.groupBy("recipe")
               .agg(F.min_by(F.struct("layer", "workflow", "execution_order"), order).alias("e"))
               .join(paths, "recipe", "left")
               .select(F.concat(F.lit("recipe:"), "recipe").alias("id"), F.lit("recipe").alias("kind"),
                       F.col("recipe").alias("name"), F.col("e.layer").alias("layer"),
                       F.regexp_replace("path", r"/[^/]*$", "").alias("mapping_path"),
                       F.col("path").isNotNull().alias("has_recipe"), F.col("e.workflow").alias("workflow"),
                       F.col("e.execution_order").alias("execution_order"),
                       F.lit(None).cast("string").alias("write_mode"), F.lit(None).cast("string").alias("partition_type")))
    named = F.concat(F.array(F.struct(F.col("target").alias("t"), F.lit(True).alias("w"))),
                     F.transform("sources", lambda s: F.struct(s["table"].alias("t"), F.lit(False).alias("w"))),
                     F.transform("lookup_tables", lambda t: F.struct(t.alias("t"), F.lit(False).alias("w"))))
    mentions = entries.select(order, "layer", F.explode(named).alias("m")).select("m.t", "m.w", order, "layer")
    # One aggregate finds the writer's layer and the fallback: writers sort before readers.
    tables = mentions.groupBy("t").agg(F.min_by("layer", F.struct(~F.col("w"), F.col(order))).alias("layer"))
    first = lambda column, field: (
        entries.select(order, F.posexplode(column).alias("p", "x")).groupBy(F.col("x.target_table").alias("t"))
        .agg(F.min_by(F.col(f"x.{field}"), F.struct(order, "p")).alias(field)))
    tables = (tables.join(first("targets_write_mode", "write_mode"), "t", "left")
              .join(first("target_partition", "partition_type"), "t", "left")
              .select(F.concat(F.lit("table:"), "t").alias("id"), F.lit("table").alias("kind"), F.col("t").alias("name"),
                      "layer", F.lit(None).cast("string").alias("mapping_path"), F.lit(None).cast("boolean").alias("has_recipe"),
                      F.lit(None).cast("string").alias("workflow"), F.lit(None).cast("int").alias("execution_order"),
                      "write_mode", "partition_type"))
    return recipes.unionByName(tables)


def recipe_deps(edges: DataFrame) -> DataFrame:
    """(recipe, depends_on): the recipe reads, as source or lookup, a table the other writes."""
    reads = edges.filter(F.col("kind") != "writes").select(F.col("from").alias("t"), F.col("to").alias("recipe"))
    writes = edges.filter(F.col("kind") == "writes").select(F.col("to").alias("t"), F.col("from").alias("depends_on"))
    return (reads.distinct().join(writes.distinct(), "t").filter(F.col("recipe") != F.col("depends_on"))
            .select("recipe", "depends_on").distinct())


UNGROUPED = "UNGROUPED"


def workflow_of(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNGROUPED))


def clusters(nodes: DataFrame) -> DataFrame:
    """(workflow, recipe); a blank workflow is UNGROUPED."""
    return nodes.filter(F.col("kind") == "recipe").select(workflow_of(F.col("workflow")).alias("workflow"), F.col("name").alias("recipe"))
