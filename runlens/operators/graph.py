"""Graph operators as loops of joins over all DAGs at once.

`edges` has the graph columns (dag_id unless told otherwise), upstream and
downstream. A loop runs once per level of the deepest graph; each step is a
join against the edges and ends in a checkpoint, so plans stay short and a
lost executor costs one step.
"""

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import blocks
from runlens.functions.skew import unbroadcast
from runlens.operators.sets import affected_teardowns
from runlens.session import cut_lineage, scratch

DAG = ("dag_id",)
# Levels of nodes on a cycle or behind one, and of seeds without an edge.
_CYCLIC, _ALONE = -1, -2


def adjacency(tasks: DataFrame) -> DataFrame:
    """Edge table of the catalog; upstreams that are no task of the DAG are dropped."""
    declared = tasks.select(
        "dag_id", F.explode("upstream").alias("upstream"), F.col("task_id").alias("downstream")
    )
    known = tasks.select("dag_id", F.col("task_id").alias("upstream"))
    return declared.join(unbroadcast(known), ["dag_id", "upstream"], "left_semi").select(
        "dag_id", "upstream", "downstream"
    )


def teardown_pairs(tasks: DataFrame) -> DataFrame:
    """(dag_id, teardown, setup) of every task that names a setup."""
    return tasks.filter(F.coalesce("teardown", F.lit("")) != "").select(
        "dag_id", F.col("task_id").alias("teardown"), F.col("teardown").alias("setup")
    )


def descendants(edges: DataFrame, seeds: DataFrame, graph: tuple = DAG) -> DataFrame:
    """Each seed (column `root`) with itself and all it leads to, and the BFS depth.

    Nodes are taken in the order of their level (`peel`), so all ways to a node have
    arrived when its turn comes: it is expanded once, and what it passes on is filed
    under the levels of the nodes behind it. Each level reads its own file and no
    other, and shuffles once. Nodes on a cycle or behind one have no level; what
    reaches them goes round in a loop of its own, until nothing gets nearer.
    """
    graph = list(graph)
    spark = edges.sparkSession
    pair, at = [*graph, "root", "node"], [*graph, "node"]
    links = cut_lineage(edges.select(*graph, "upstream", "downstream").distinct())
    levels, rest = peel(links, graph=tuple(graph))
    place = cut_lineage(levels.unionByName(rest.withColumn("level", F.lit(_CYCLIC))))
    step = cut_lineage(
        links.withColumnRenamed("downstream", "node").join(unbroadcast(place), at).select(
            *graph, F.col("upstream").alias("node"), F.col("node").alias("next"), F.col("level").alias("next_level")
        )
    )
    start = seeds.select(*graph, "root").distinct().select(*graph, "root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    mail = f"{scratch(spark)}/mail-{uuid.uuid4().hex}"
    filed = start.join(unbroadcast(place), at, "left").select(*pair, "depth", F.coalesce("level", F.lit(_ALONE)).alias("level"))
    filed.write.partitionBy("level").parquet(mail)

    def arrived(level: int) -> DataFrame | None:
        """The nearest way from every seed to the nodes of a level; None if there is no way."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{mail}/level={level}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return spark.read.schema(start.schema).parquet(f"{mail}/level={level}").groupBy(*pair).agg(F.min("depth").alias("depth"))

    def passed_on(rows: DataFrame) -> DataFrame:
        return rows.join(unbroadcast(step), at).select(
            *graph, "root", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("next_level").alias("level")
        )

    for level in range((place.agg(F.max("level")).first()[0] or 0) + 1):
        rows = arrived(level)
        if rows is not None:
            passed_on(rows).write.mode("append").partitionBy("level").parquet(mail)
    known = arrived(_CYCLIC)
    if known is not None:
        known = frontier = cut_lineage(known)
        while not frontier.isEmpty():
            found = passed_on(frontier).groupBy(*pair).agg(F.min("depth").alias("depth"))
            nearest = known.withColumnRenamed("depth", "__known")
            frontier = cut_lineage(
                found.join(unbroadcast(nearest), pair, "left").filter(F.col("__known").isNull() | (F.col("depth") < F.col("__known"))).drop("__known")
            )
            known = cut_lineage(known.unionByName(frontier).groupBy(*pair).agg(F.min("depth").alias("depth")))
    out = spark.read.schema(filed.schema).parquet(mail).filter(F.col("level") != _CYCLIC).groupBy(*pair).agg(F.min("depth").alias("depth"))
    return out if known is None else out.unionByName(known)


def _nodes(edges: DataFrame, graph: list[str]) -> DataFrame:
    ends = [edges.select(*graph, F.col(side).alias("node")) for side in ("upstream", "downstream")]
    return ends[0].unionByName(ends[1]).distinct()


def peel(
    edges: DataFrame, nodes: DataFrame | None = None, graph: tuple = DAG
) -> tuple[DataFrame, DataFrame]:
    """Take away nodes without open upstreams, level by level.

    Returns (levels, rest): levels has (graph.., node, level) with the length
    of the longest path to the node, rest has the nodes never freed, which
    are those on a cycle or behind one.
    """
    graph = list(graph)
    node_key = [*graph, "node"]
    links = cut_lineage(edges.select(*graph, "upstream", "downstream").distinct())
    nodes = _nodes(links, graph) if nodes is None else nodes.select(*node_key).distinct()
    open_links = links.groupBy(*graph, F.col("downstream").alias("node")).agg(
        F.count(F.lit(1)).alias("open")
    )
    rest = cut_lineage(
        nodes.join(unbroadcast(open_links), node_key, "left").select(
            *node_key, F.coalesce("open", F.lit(0)).alias("open")
        )
    )
    steps = links.withColumnRenamed("upstream", "node")
    levels = []
    while True:
        free = rest.filter("open = 0").select(*node_key)
        if free.isEmpty():
            break
        levels.append(free.withColumn("level", F.lit(len(levels))))
        closed = free.join(unbroadcast(steps), node_key).groupBy(
            *graph, F.col("downstream").alias("node")
        ).agg(F.count(F.lit(1)).alias("closed"))
        rest = cut_lineage(
            rest.filter("open > 0").join(unbroadcast(closed), node_key, "left").select(
                *node_key, (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")
            )
        )
    rest = rest.select(*node_key)
    if not levels:
        return rest.withColumn("level", F.lit(0)).filter(F.lit(False)), rest
    return reduce(DataFrame.unionByName, levels), rest


def find_cycles(
    edges: DataFrame, nodes: DataFrame | None = None, graph: tuple = DAG
) -> DataFrame:
    """Nodes on a cycle or behind one, per graph."""
    return peel(edges, nodes, graph)[1]


def topo_levels(
    edges: DataFrame, nodes: DataFrame | None = None, graph: tuple = DAG
) -> DataFrame:
    """Longest-path level of each node and its place in the (level, id) order."""
    levels = peel(edges, nodes, graph)[0]
    return blocks.ranked(levels, list(graph), ["level", "node"], "topo_order")


def execution_order(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """The lexically smallest order of every DAG in which upstreams come first.

    This order is sequential by nature. A group is the task list of one DAG,
    which was one document before; use `topo_levels` where any valid order
    will do. DAGs with a cycle give only the tasks before it.
    """
    import heapq

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting = {task: set() for task in pdf["task_id"]}
        follow: dict[str, list[str]] = {}
        for task, ups in zip(pdf["task_id"], pdf["ups"]):
            for up in ups if ups is not None else ():
                waiting[task].add(up)
                follow.setdefault(up, []).append(task)
        ready = [task for task, ups in waiting.items() if not ups]
        heapq.heapify(ready)
        done = []
        while ready:
            task = heapq.heappop(ready)
            done.append(task)
            for later in follow.get(task, ()):
                waiting[later].discard(task)
                if not waiting[later]:
                    heapq.heappush(ready, later)
        return pd.DataFrame({
            "dag_id": pdf["dag_id"].iloc[:1].repeat(len(done)).to_numpy(),
            "task_id": done,
            "position": range(1, len(done) + 1),
        })

    ups = edges.distinct().groupBy("dag_id", F.col("downstream").alias("task_id")).agg(
        F.collect_list("upstream").alias("ups")
    )
    listed = tasks.select("dag_id", "task_id").distinct().join(ups, ["dag_id", "task_id"], "left")
    return listed.groupBy("dag_id").applyInPandas(
        order, "dag_id string, task_id string, position long"
    )


def teardown_deps(edges: DataFrame, teardowns: DataFrame) -> DataFrame:
    """(dag_id, teardown, dep): the setup and all it leads to, teardowns left out."""
    marks = teardowns.select("dag_id", F.col("teardown").alias("downstream")).distinct()
    normal = edges.join(unbroadcast(marks), ["dag_id", "downstream"], "left_anti")
    seeds = teardowns.select("dag_id", F.col("setup").alias("root"))
    reach = descendants(normal, seeds)
    return teardowns.join(
        unbroadcast(reach.select("dag_id", F.col("root").alias("setup"), F.col("node").alias("dep"))),
        ["dag_id", "setup"],
    ).select("dag_id", "teardown", "dep")


def clear_set(
    tasks: DataFrame, edges: DataFrame, teardowns: DataFrame, requests: DataFrame
) -> DataFrame:
    """Tasks that clear requests (dag_id, run_id, task_id, downstream) reset.

    Gives (dag_id, run_id, task_id, reason). A run with a request for an
    unknown task is left alone and gives `unknown_task` rows only.
    """
    key = ["dag_id", "run_id", "task_id"]
    unknown = requests.join(
        tasks.select("dag_id", "task_id").distinct(), ["dag_id", "task_id"], "left_anti"
    ).select(*key).distinct()
    valid = requests.join(
        unknown.select("dag_id", "run_id").distinct(), ["dag_id", "run_id"], "left_anti"
    )
    asked = valid.select(*key).distinct()
    deep = valid.filter("downstream").select("dag_id", "run_id", F.col("task_id").alias("root"))
    reach = descendants(edges, deep)
    below = deep.distinct().join(reach, ["dag_id", "root"]).select(
        "dag_id", "run_id", F.col("node").alias("task_id")
    ).distinct()
    touched = asked.withColumn("reason", F.lit("requested")).unionByName(
        below.join(asked, key, "left_anti").withColumn("reason", F.lit("downstream"))
    )
    again = affected_teardowns(teardown_deps(edges, teardowns), touched.select(*key))
    return (
        touched.unionByName(again.withColumn("reason", F.lit("teardown")))
        .unionByName(unknown.withColumn("reason", F.lit("unknown_task")))
    )


def mark_effects(
    edges: DataFrame, teardowns: DataFrame, requests: DataFrame
) -> DataFrame:
    """Effects of forcing tasks to a state: the marks, and the teardowns to fire again."""
    from runlens.operators.filters import markable

    key = ["dag_id", "run_id", "task_id"]
    marks = markable(requests).select(*key, "state")
    again = affected_teardowns(teardown_deps(edges, teardowns), marks.select(*key).distinct())
    return marks.withColumn("effect", F.lit("marked")).unionByName(
        again.withColumns({"state": F.lit("none"), "effect": F.lit("teardown_cleared")})
    )


def flatten_group_rows(rows: DataFrame) -> DataFrame:
    """Nested actions, held as JSON, to leaf tasks.

    `rows` has (dag_id, actions) with `actions` the JSON array of a DAG. One
    pass per nesting depth; a group without actions is a leaf itself.
    """
    as_list = "array<string>"
    current = rows.select(
        "dag_id", F.lit("").alias("group_path"),
        F.explode(F.from_json("actions", as_list)).alias("action"),
    )
    leaves = []
    while True:
        inner = F.get_json_object("action", "$.actions")
        is_group = inner.isNotNull() & (inner != "[]")
        marked = cut_lineage(current.withColumn("is_group", is_group))
        leaves.append(marked.filter(~F.col("is_group")).drop("is_group"))
        groups = marked.filter("is_group")
        if groups.isEmpty():
            break
        name = F.get_json_object("action", "$.id")
        current = groups.select(
            "dag_id", F.concat_ws("/", F.nullif("group_path", F.lit("")), name).alias("group_path"),
            F.explode(F.from_json(F.get_json_object("action", "$.actions"), as_list)).alias("action"),
        )
    field = lambda name: F.get_json_object("action", f"$.{name}")
    return reduce(DataFrame.unionByName, leaves).select(
        "dag_id", field("id").alias("task_id"), field("type").alias("type"),
        "group_path", "action",
    )


