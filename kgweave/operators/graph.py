"""Graph analytics: components, communities, modularity, bounded search, contexts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgweave.operators.communities import detect_communities, too_large
from kgweave.operators.components import connected_components
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.plans.scratch import Scratch


def undirected_edges(relations: DataFrame, src: str = "from", dst: str = "to", weight: str = "score", ord_: str | None = None) -> DataFrame:
    """``(a, b, w)`` with a <= b, one per pair; the first weight (by ``ord_``, else the smallest) wins, 0 and null count as 1."""
    w = F.when(F.col(weight).isNull() | (F.col(weight) == 0), 1.0).otherwise(F.col(weight))
    rows = relations.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), w.alias("w"), (F.col(ord_) if ord_ else w).alias("o"))
    return rows.groupBy("a", "b").agg(F.min_by("w", "o").alias("w"))


def largest_component(edges: DataFrame, src: str = "from", dst: str = "to") -> DataFrame:
    """``(node)`` of the component with most nodes (the smallest name in a tie)."""
    comp = connected_components(edges, src, dst)
    top = comp.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return comp.join(top, "component").select("node")


def node_degrees(edges: DataFrame, src: str = "from", dst: str = "to") -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of ``membership(node, community)`` on ``edges(a, b, w)``; self-loops count twice in degrees."""
    m = membership.select("node", "community")
    e = edges.join(m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    total = e.agg(F.sum("w").alias("m"))
    inside = e.filter("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    degree = e.select(F.col("ca").alias("c"), "w").union(e.select("cb", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    squares = degree.agg(F.sum(F.col("k") * F.col("k")).alias("s"))
    # three tables of one row each
    return total.join(inside, F.lit(True)).join(squares, F.lit(True)).select((F.col("inside") / F.col("m") - resolution * F.col("s") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def scope_communities(membership: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Members in scope, with the size that is left; communities without one go."""
    kept = membership.join(node_ids.select(F.col("id").alias("node")), "node", "left_semi")
    return kept.withColumn("size", F.count("*").over(W.partitionBy("community")))


def bfs_expand(seeds: DataFrame, edges: DataFrame, names: DataFrame, depth: int = 2, limit: int = 50, where=None) -> DataFrame:
    """Nodes within ``depth`` directed hops of each query's seeds ``(query_id, node_id)``: least hop, up to three types of
    last edges, score 1 / (1 + hop); the first ``limit`` by (hop, name, id). Seeds aren't marked as reached.

    A query that has ``limit`` nodes before the last hop leaves that hop out, as its nodes would be listed after these; with ``where`` (a condition on
    the rows, types included) all hops are made. ``query_id`` may be a struct.
    """
    work = Scratch(edges.sparkSession, "bfs")
    e = work.write(edges.select(F.col("from").alias("node_id"), F.col("to").alias("next"), "type"), "edges")
    known = names.select(F.col("id").alias("node_id"), "name", F.col("label").alias("node_label"))
    front = seeds.select("query_id", "node_id").distinct()
    sources, reached = front.withColumn("hop", F.lit(0)), None
    for hop in range(1, depth + 1):
        if hop == depth > 1 and where is None:
            full = reached.join(known.select("node_id"), "node_id", "left_semi").groupBy("query_id").count().filter(F.col("count") >= limit)
            front = front.join(full.select("query_id"), "query_id", "left_anti")
        step = front.join(e, "node_id").select("query_id", F.col("next").alias("node_id")).distinct()
        new = step if reached is None else step.join(reached, ["query_id", "node_id"], "left_anti")
        new = work.write(new.withColumn("hop", F.lit(hop)), f"hop{hop}")
        reached = new if reached is None else reached.unionByName(new)
        front = new.select("query_id", "node_id")
        if hop < depth:
            sources = sources.unionByName(new)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("hop", "name", "node_id"))
    listed = lambda rows: rows.withColumn("rank", rank).filter(F.col("rank") <= limit)
    rows = reached.join(known, "node_id")
    rows = rows if where is not None else work.write(listed(rows), "listed")
    starts = sources.groupBy("query_id", "node_id").agg(F.min("hop").alias("h"))
    last = starts.join(e, "node_id").select("query_id", F.col("next").alias("node_id"), "type").join(rows.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi")
    last = last.distinct().groupBy("query_id", "node_id").agg(F.slice(F.array_sort(F.collect_set("type")), 1, 3).alias("types"))
    rows = rows.join(last, ["query_id", "node_id"])
    rows = rows if where is None else listed(rows.filter(where))
    return rows.withColumn("score", 1 / (1 + F.col("hop")))


def first_reached(rows: DataFrame, by: str | list[str], limit: int) -> DataFrame:
    """Of ``rows(by, node_id, name, hop)`` each node at its least hop, the first ``limit`` by (hop, name, id), with ``rank`` from 1."""
    by = [by] if isinstance(by, str) else by
    least = rows.groupBy(*by, "node_id", "name").agg(F.min("hop").alias("hop"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("hop", "name", "node_id"))
    return least.withColumn("rank", rank).filter(F.col("rank") <= limit)


def bfs_nearest(seeds: DataFrame, edges: DataFrame, names: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """``(query_id, node_id, name, hop, rank)``: the rows of ``bfs_expand`` without types, for many queries that share seeds.

    The search is made once for each node, not once for each query: of a node's neighbours only the first ``limit`` of each can be among its own first,
    as what comes before them comes before for the node too, and so it is for a query and its seeds.
    """
    work = Scratch(edges.sparkSession, "nearest")
    e = work.write(edges.select(F.col("from").alias("at"), F.col("to").alias("node_id")).distinct(), "edges")
    known = names.select(F.col("id").alias("node_id"), "name").distinct()

    def lists(at: DataFrame, depth: int) -> DataFrame:
        """``(at, node_id, name, hop)`` for the nodes ``at``."""
        out = e.join(at, "at", "left_semi")
        one = first_reached(out.join(known, "node_id").withColumn("hop", F.lit(1)), "at", limit).drop("rank")
        if depth == 1:
            return one
        one = work.write(one, f"one{depth}")
        full = one.groupBy("at").count().filter(F.col("count") >= limit)
        step = work.write(out.join(full, "at", "left_anti").select(F.col("at").alias("_at"), F.col("node_id").alias("at")), f"step{depth}")
        further = step.join(lists(step.select("at").distinct(), depth - 1), "at").select(F.col("_at").alias("at"), "node_id", "name", (F.col("hop") + 1).alias("hop"))
        return work.write(first_reached(one.unionByName(further), "at", limit).drop("rank"), f"lists{depth}")

    own = seeds.select("query_id", F.col("node_id").alias("at")).distinct()
    found = lists(own.select("at").distinct(), depth)
    return first_reached(own.join(found, "at").drop("at"), "query_id", limit)


def neighbors(ids: DataFrame, edges: DataFrame, depth: int = 1, limit: int = 1000) -> DataFrame:
    """``(id, node_id, hop)`` within ``depth`` (1 to 3) hops in either direction, without the node itself; the first
    ``limit`` by (hop, id)."""
    depth = min(3, max(1, depth))
    work = Scratch(edges.sparkSession, "neighbors")
    one = work.write(edges.select(F.col("from").alias("at"), F.col("to").alias("next")), "edges")
    both = work.write(one.union(one.select("next", "at")).distinct(), "links")
    reached = ids.select("id", F.col("id").alias("node_id"), F.lit(0).alias("hop"))
    front = reached
    for hop in range(1, depth + 1):
        step = front.select("id", F.col("node_id").alias("at")).join(both, "at").select("id", F.col("next").alias("node_id")).distinct()
        front = work.write(step.join(reached.select("id", "node_id"), ["id", "node_id"], "left_anti").withColumn("hop", F.lit(hop)), f"hop{hop}")
        reached = reached.unionByName(front)
    rank = F.row_number().over(W.partitionBy("id").orderBy("hop", "node_id"))
    return reached.filter("hop > 0").withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def _fitting(lines: DataFrame, by: list[str], order: list[str], line: str, max_chars: int) -> DataFrame:
    """Lines that start within the first ``max_chars`` characters of their group's text, so that gathering a group is bounded."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("_at", F.coalesce(F.sum(F.length(line) + 1).over(before), F.lit(0))).filter(F.col("_at") < max_chars).drop("_at")


def inside_edges(membership: DataFrame, nodes: DataFrame, edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """``(community, from, to, type)`` of the edges inside each community of ``membership(node, community)``, written once. Edges meet first that end by which
    fewer of them have a community, so few go on to the other; names are no part of what is moved."""
    m = membership.select("node", "community").join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    m = work.write(m, f"{name}-members")
    ends = edges.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(c).alias("end")) for c in ("from", "to")))))
    counted = ends.groupBy("node", "end").agg(F.count("*").alias("n")).join(m, "node").groupBy("end").agg(F.sum("n").alias("n")).collect()  # two rows
    n = {r.end: r.n for r in counted}
    first, then = sorted(("from", "to"), key=lambda c: n.get(c, 0))
    some = edges.select("from", "to", "type").join(m.withColumnRenamed("node", first), first)
    return work.write(some.join(m.withColumnRenamed("node", then), ["community", then]).select("community", "from", "to", "type"), name)


def _with_names(inside: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")) for end in ("from", "to"))
    return inside.join(a, "from").join(b, "to")


def community_context(membership: DataFrame, nodes: DataFrame, edges: DataFrame, summaries: DataFrame | None = None, max_chars: int = 8000, inside: DataFrame | None = None) -> DataFrame:
    """``(community, context)``: members, the relations inside, and summaries of its own children ``(parent, community, summary)``
    cut to 500 characters, in the order of ids; cut to ``max_chars``. Of a community of any size only the lines that can be in the context are gathered. ``inside``: the
    rows of ``inside_edges``, where they are at hand."""
    m = membership.select("node", "community")
    named = m.join(nodes.select(F.col("id").alias("node"), "name", "label"), "node")
    gathered = lambda rows, order: F.transform(F.array_sort(F.collect_list(F.struct(*order, "l"))), lambda x: x["l"])
    lines = named.select("community", "node", F.concat(F.lit("- "), "name", F.lit(" ["), "label", F.lit("]")).alias("l"))
    ents = _fitting(lines, ["community"], ["node"], "l", max_chars).groupBy("community").agg(gathered(lines, ["node"]).alias("ents"))
    ents = named.groupBy("community").agg(F.count("*").alias("n_e")).join(ents, "community")
    if inside is None:
        inside = inside_edges(membership, nodes, edges, Scratch(edges.sparkSession, "context"), "inside")
    fact = F.concat(F.lit("- "), "from_name", F.lit(" --"), "type", F.lit("--> "), "to_name")
    order = ["from", "to", "type", "l"]
    lines = _with_names(inside, nodes).select("community", "from", "to", "type", fact.alias("l"))
    facts = _fitting(lines, ["community"], order, "l", max_chars).groupBy("community").agg(gathered(lines, order[:3]).alias("facts"))
    out = ents.join(inside.groupBy("community").agg(F.count("*").alias("n_r")).join(facts, "community"), "community", "left")
    none = F.array().cast("array<string>")
    parts = [F.array(F.concat(F.lit("Entities ("), F.col("n_e"), F.lit("):"))), F.col("ents"), F.array(F.concat(F.lit("\nRelationships ("), F.coalesce("n_r", F.lit(0)), F.lit("):"))), F.coalesce("facts", none)]
    if summaries is not None:
        child = F.concat(F.lit("["), "community", F.lit("]: "), F.substring("summary", 1, 500))
        lines = summaries.select(F.col("parent").alias("community"), child.alias("l"))
        subs = _fitting(lines, ["community"], ["l"], "l", max_chars).groupBy("community").agg(F.array_sort(F.collect_list("l")).alias("subs"))
        out = out.join(subs, "community", "left")
        parts.append(F.when(F.size("subs") > 0, F.concat(F.array(F.lit("\nSub-community summaries:")), "subs")).otherwise(none))
    return out.select("community", F.substring(F.array_join(F.flatten(F.array(*parts)), "\n"), 1, max_chars).alias("context"))


def community_reports(membership: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 3, degrees: DataFrame | None = None, inside: DataFrame | None = None) -> DataFrame:
    """Extractive reports ``(community, title, summary, rating, n_members)``: names of the members of highest degree, the first
    facts inside, and the share of the members' edges that stay inside, times 10. ``degrees`` and ``inside``: the rows of ``node_degrees`` and
    ``inside_edges``, where they are at hand; else edges are written once for both."""
    m = membership.select("node", "community")
    if degrees is None or inside is None:
        work = Scratch(edges.sparkSession, "report")
        edges = work.write(edges.select("from", "to", "type"), "edges")
        degrees = work.write(node_degrees(edges), "degrees") if degrees is None else degrees
        inside = inside_edges(m, nodes, edges, work, "inside") if inside is None else inside
    deg = degrees.withColumnRenamed("id", "node")
    named = m.join(nodes.select(F.col("id").alias("node"), "name"), "node").join(deg, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc("degree"), "node"))
    best = named.withColumn("r", rank).filter(F.col("r") <= top).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("title"))
    order = F.row_number().over(W.partitionBy("community").orderBy("from", "to", "type"))
    facts = _with_names(inside.withColumn("r", order).filter(F.col("r") <= top), nodes).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "from_name", "type", "to_name").alias("l")))), lambda x: x["l"]), "; ").alias("summary"))
    sizes = named.groupBy("community").agg(F.count("*").alias("n_members"), F.sum("degree").alias("ends"))
    n_in = inside.groupBy("community").agg(F.count("*").alias("n_in"))
    out = sizes.join(best, "community").join(facts, "community", "left").join(n_in, "community", "left")
    rating = F.round(F.coalesce(20.0 * F.col("n_in") / F.col("ends"), F.lit(0.0)), 4)
    return out.select("community", "title", F.coalesce("summary", F.lit("")).alias("summary"), rating.alias("rating"), "n_members")


REPORT = ["title", "summary", "rating"]


def report_tree(membership: DataFrame, nodes: DataFrame, edges: DataFrame, outputs: DataFrame | None = None, max_chars: int = 8000, top: int = 3) -> DataFrame:
    """``(level, community, parent, title, summary, rating, n_members, context)`` for each community of each level of ``membership(level, node, community,
    parent)``, the deepest level first, so that a community's context holds the summaries of its own children.

    A report is that of ``community_reports``, or the row of ``outputs(level, community, title, summary, rating)``, a table of a model's answers; of
    several rows for a community the first in the order of all columns counts, and a null field keeps the extracted one. A
    community that went on unchanged to the next level (its only child) is not its own child.
    """
    work = Scratch(membership.sparkSession, "reports")
    given = None
    if outputs is not None:
        given = outputs.groupBy("level", "community").agg(F.min(F.struct(*REPORT)).alias("given"))
    edges = work.write(edges.select("from", "to", "type"), "edges")
    degrees = work.write(node_degrees(edges), "degrees")
    out, children = None, None
    levels = [r.level for r in membership.select("level").distinct().orderBy(F.desc("level")).collect()]  # a row a level
    for level in levels:
        own = membership.filter(F.col("level") == level)
        inside = inside_edges(own, nodes, edges, work, f"inside{level}")
        made = community_reports(own, nodes, edges, top, degrees, inside)
        if given is not None:
            made = made.join(given.filter(F.col("level") == level).drop("level"), "community", "left").select("community", *(F.coalesce(f"given.{c}", c).alias(c) for c in REPORT), "n_members")
        context = community_context(own, nodes, edges, children, max_chars, inside)
        parents = own.groupBy("community").agg(F.min("parent").alias("parent"))
        made = made.join(context, "community").join(parents, "community").select(F.lit(level).alias("level"), "community", "parent", *REPORT, "n_members", "context")
        made = work.write(made, f"level{level}")
        several = made.groupBy("parent").count().filter("count > 1").select("parent")
        children = made.join(several, "parent", "left_semi").select("parent", "community", "summary")
        out = made if out is None else out.unionByName(made)
    if out is None:
        kind = membership.schema["community"].dataType.simpleString()
        return membership.sparkSession.createDataFrame([], f"level int, community {kind}, parent {kind}, title string, summary string, rating double, n_members long, context string")
    return out


def finalize_graph(membership: DataFrame, reports: DataFrame, path: str) -> None:
    """Replace the community tables under ``path``."""
    membership.write.mode("overwrite").parquet(f"{path}/communities")
    reports.write.mode("overwrite").parquet(f"{path}/reports")


@query("G1_undirected", f"WITH {tg.SQL} SELECT least(\"from\", \"to\") AS a, greatest(\"from\", \"to\") AS b, min(CASE WHEN score = 0 THEN 1 ELSE score END) AS w FROM edges GROUP BY 1, 2")
def g1(spark, d):
    return undirected_edges(tg.edges(spark, d))


@query("G2_components", """WITH RECURSIVE e AS (SELECT 'C'||c_custkey AS a, 'N'||c_nationkey AS b FROM customer WHERE c_nationkey % 3 <> 0 UNION ALL SELECT 'N'||n_nationkey, 'R'||n_regionkey FROM nation WHERE n_nationkey % 2 = 0),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node WHERE r.c < u.b) SELECT node, min(c) AS component FROM (SELECT node, c FROM r UNION SELECT b, b FROM u) GROUP BY 1""".replace("WHERE r.c < u.b", ""))
def g2(spark, d):
    c = tg.table(spark, d, "customer").filter("c_nationkey % 3 <> 0").select(F.concat(F.lit("C"), "c_custkey").alias("a"), F.concat(F.lit("N"), "c_nationkey").alias("b"))
    n = tg.table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("a"), F.concat(F.lit("R"), "n_regionkey").alias("b"))
    return connected_components(c.union(n), "a", "b")


@query("G3_communities")
def g3(spark, d):
    return detect_communities(undirected_edges(tg.edges(spark, d)))


@query("G3_invariants", f"""WITH {tg.SQL}, u AS (SELECT least("from", "to") AS a, greatest("from", "to") AS b FROM edges GROUP BY 1, 2), m AS (SELECT a AS node FROM u UNION SELECT b FROM u)
 SELECT count(*) AS nodes, 0 AS uncovered, 0 AS unnested, 0 AS misnamed, 0 AS divisible FROM m""")
def g3_invariants(spark, d):
    """Nodes; rows missing from levels; parents that are no community of the level above; names that aren't the smallest member;
    communities above the size on the deepest level that one more split divides."""
    e = undirected_edges(tg.edges(spark, d))
    m = Scratch(spark, "found").write(detect_communities(e), "membership")
    n = m.agg(F.count_distinct("node").alias("nodes"), (F.count_distinct("node") * (F.max("level") + 1) - F.count("*")).alias("uncovered"))
    above = m.select((F.col("level") + 1).alias("level"), "node", F.col("community").alias("over"))
    nested = m.filter("level > 0").join(above, ["level", "node"], "left").agg(F.count_if(~F.col("parent").eqNullSafe(F.col("over"))).alias("unnested"))
    named = m.groupBy("level", "community").agg(F.min("node").alias("least")).agg(F.count_if(F.col("least") != F.col("community")).alias("misnamed"))
    left = m.filter(F.col("level") == m.agg(F.max("level")).first()[0]).join(too_large(m), "community").select("node", "community")
    a, b = left.select(F.col("node").alias("a"), F.col("community").alias("x")), left.select(F.col("node").alias("b"), F.col("community").alias("y"))
    again = detect_communities(e.join(b, "b").join(a, "a").filter("x = y").select("a", "b", "w")).filter("level = 0")
    divided = left.join(again.select("node", F.col("community").alias("part")), "node").groupBy("community").agg(F.count_distinct("part").alias("n")).agg(F.count_if(F.col("n") > 1).alias("divisible"))
    one = F.lit(True)  # tables of one row each
    return n.join(nested, one).join(named, one).join(divided, one).select(*(F.col(c).cast("long") for c in ("nodes", "uncovered", "unnested", "misnamed", "divisible")))


_LAB = "m AS (SELECT id AS node, label||(length(id) % 2) AS community FROM nodes), u AS (SELECT least(\"from\", \"to\") AS a, greatest(\"from\", \"to\") AS b, min(score) AS w FROM edges GROUP BY 1, 2)"


@query("G4_modularity", f"WITH {tg.SQL}, {_LAB}, x AS (SELECT w, p.community AS ca, q.community AS cb FROM u JOIN m p ON p.node = a JOIN m q ON q.node = b), k AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, w FROM x UNION ALL SELECT cb, w FROM x) GROUP BY 1) SELECT round((SELECT coalesce(sum(w), 0) FROM x WHERE ca = cb) / (SELECT sum(w) FROM x) - (SELECT sum(k * k) FROM k) / (4 * (SELECT sum(w) FROM x) ** 2), 6) AS modularity")
def g4(spark, d):
    m = tg.nodes(spark, d).select(F.col("id").alias("node"), F.concat("label", F.length("id") % 2).alias("community"))
    return modularity(undirected_edges(tg.edges(spark, d)), m).select(F.round("modularity", 6).alias("modularity"))


@query("G5_scope", f"WITH {tg.SQL}, s AS (SELECT id, label||(length(id) % 2) AS community FROM nodes WHERE label IN ('Part', 'Nation')) SELECT community, count(*) AS n FROM s GROUP BY 1")
def g5(spark, d):
    n = tg.nodes(spark, d)
    m = n.select(F.col("id").alias("node"), F.concat("label", F.length("id") % 2).alias("community"))
    return scope_communities(m, n.filter("label IN ('Part', 'Nation')")).groupBy("community").agg(F.max("size").alias("n"))


@query("G6_bfs", f"""WITH {tg.SQL}, s AS (SELECT c_custkey AS query_id, 'CUS:'||c_custkey AS node FROM customer UNION ALL SELECT c_custkey, 'SUP:'||(c_custkey % 10) FROM customer WHERE c_custkey % 10 = 1),
 one AS (SELECT DISTINCT query_id, "to" AS n FROM s JOIN edges ON "from" = s.node), two AS (SELECT DISTINCT query_id, "to" AS n FROM one JOIN edges ON "from" = one.n), r AS (SELECT query_id, n, min(h) AS hop FROM (SELECT *, 1 AS h FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY 1, 2),
 st AS (SELECT query_id, node FROM s UNION SELECT query_id, n FROM one), l AS (SELECT query_id, "to" AS n, array_to_string(list_sort(list(DISTINCT type))[1:3], ';') AS types FROM st JOIN edges ON "from" = st.node GROUP BY 1, 2)
 SELECT query_id, r.n AS node_id, hop, types, 1.0::DOUBLE / (1 + hop) AS score FROM r JOIN l USING (query_id, n) JOIN nodes ON nodes.id = r.n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, name, r.n) <= 50""")
def g6(spark, d):
    c = tg.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    seeds = c.select("query_id", F.concat(F.lit("CUS:"), "query_id").alias("node_id")).union(c.filter("query_id % 10 = 1").select("query_id", F.concat(F.lit("SUP:"), F.col("query_id") % 10)))
    return bfs_expand(seeds, tg.edges(spark, d), tg.nodes(spark, d)).select("query_id", "node_id", "hop", F.array_join("types", ";").alias("types"), "score")


@query("G7_neighbors", f"""WITH {tg.SQL}, u AS (SELECT "from" AS a, "to" AS b FROM edges UNION SELECT "to", "from" FROM edges), one AS (SELECT a AS id, b AS n FROM u WHERE starts_with(a, 'NAT') AND a <> b), two AS (SELECT DISTINCT one.id, u.b AS n FROM one JOIN u ON u.a = one.n),
 r AS (SELECT id, n, min(h) AS hop FROM (SELECT *, 1 AS h FROM one UNION ALL SELECT *, 2 FROM two) WHERE id <> n GROUP BY 1, 2) SELECT id, n AS node_id, hop FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY hop, n) <= 1000""")
def g7(spark, d):
    return neighbors(tg.nodes(spark, d).filter("label = 'Nation'").select("id"), tg.edges(spark, d), 2)


@query("G8_degrees", f"WITH {tg.SQL} SELECT id, count(*) AS degree FROM (SELECT \"from\" AS id FROM edges UNION ALL SELECT \"to\" FROM edges) GROUP BY 1")
def g8(spark, d):
    return node_degrees(tg.edges(spark, d))


@query("G9_context", f"""WITH {tg.SQL}, m AS (SELECT 'CUS:'||c_custkey AS node, c_nationkey AS community FROM customer UNION ALL SELECT 'NAT:'||n_nationkey, n_nationkey FROM nation), e AS (SELECT community, count(*) AS n, string_agg('- '||name||' ['||label||']', chr(10) ORDER BY node) AS t FROM m JOIN nodes ON id = node GROUP BY 1),
 f AS (SELECT a.community, count(*) AS n, string_agg('- '||p.name||' --'||e.type||'--> '||q.name, chr(10) ORDER BY e."from", e."to", e.type) AS t FROM edges e JOIN m a ON a.node = e."from" JOIN m b ON b.node = e."to" AND a.community = b.community JOIN nodes p ON p.id = e."from" JOIN nodes q ON q.id = e."to" GROUP BY 1)
 SELECT e.community, substr('Entities ('||e.n||'):'||chr(10)||e.t||chr(10)||chr(10)||'Relationships ('||coalesce(f.n, 0)||'):'||coalesce(chr(10)||f.t, ''), 1, 8000) AS context FROM e LEFT JOIN f USING (community)""")
def g9(spark, d):
    one = lambda t, p, k, n: tg.table(spark, d, t).select(F.concat(F.lit(p), F.col(k)).alias("node"), F.col(n).alias("community"))
    m = one("customer", "CUS:", "c_custkey", "c_nationkey").union(one("nation", "NAT:", "n_nationkey", "n_nationkey"))
    return community_context(m, tg.nodes(spark, d), tg.edges(spark, d))


_G10 = f"""WITH {tg.SQL}, m AS (SELECT 'CUS:'||c_custkey AS node, c_nationkey AS community FROM customer UNION ALL SELECT 'NAT:'||n_nationkey, n_nationkey FROM nation), g AS (SELECT id, count(*) AS degree FROM (SELECT "from" AS id FROM edges UNION ALL SELECT "to" FROM edges) GROUP BY 1),
 n AS (SELECT m.*, name, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, node) AS r FROM m JOIN nodes ON nodes.id = node LEFT JOIN g ON g.id = node),
 i AS (SELECT a.community, p.name||' '||e.type||' '||q.name AS line, row_number() OVER (PARTITION BY a.community ORDER BY e."from", e."to", e.type) AS r FROM edges e JOIN m a ON a.node = e."from" JOIN m b ON b.node = e."to" AND a.community = b.community JOIN nodes p ON p.id = e."from" JOIN nodes q ON q.id = e."to"),
 f AS (SELECT community, count(*) AS n_in, string_agg(line, '; ' ORDER BY r) FILTER (r <= 3) AS summary FROM i GROUP BY 1)
 SELECT community, string_agg(name, ', ' ORDER BY r) FILTER (r <= 3) AS title, coalesce(any_value(summary), '') AS summary, round(coalesce(20.0::DOUBLE * any_value(n_in) / sum(degree), 0), 4) AS rating, count(*) AS n_members FROM n LEFT JOIN f USING (community) GROUP BY 1"""


@query("G10_reports", _G10)
def g10(spark, d):
    one = lambda t, p, k, n: tg.table(spark, d, t).select(F.concat(F.lit(p), F.col(k)).alias("node"), F.col(n).alias("community"))
    m = one("customer", "CUS:", "c_custkey", "c_nationkey").union(one("nation", "NAT:", "n_nationkey", "n_nationkey"))
    return community_reports(m, tg.nodes(spark, d), tg.edges(spark, d))


def _two_levels(spark, d) -> DataFrame:
    """Regions of nations and customers, and below them the nations."""
    one = lambda t, p, k, n: tg.table(spark, d, t).select(F.concat(F.lit(p), F.col(k)).alias("node"), F.col(n).alias("n"))
    m = one("customer", "CUS:", "c_custkey", "c_nationkey").union(one("nation", "NAT:", "n_nationkey", "n_nationkey"))
    m = m.join(tg.table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.concat(F.lit("R"), "n_regionkey").alias("r")), "n").withColumn("n", F.concat(F.lit("N"), "n"))
    none = F.lit(None).cast("string")
    return m.select(F.lit(0).alias("level"), "node", F.col("r").alias("community"), none.alias("parent")).union(m.select(F.lit(1), "node", "n", "r"))


_TREE = f"""WITH {tg.SQL}, p AS (SELECT 'CUS:'||c_custkey AS node, c_nationkey AS n FROM customer UNION ALL SELECT 'NAT:'||n_nationkey, n_nationkey FROM nation),
 m AS (SELECT 1 AS level, node, 'N'||n AS community, 'R'||n_regionkey AS parent FROM p JOIN nation ON n = n_nationkey UNION ALL SELECT 0, node, 'R'||n_regionkey, NULL FROM p JOIN nation ON n = n_nationkey),
 g AS (SELECT id, count(*) AS degree FROM (SELECT "from" AS id FROM edges UNION ALL SELECT "to" FROM edges) GROUP BY 1),
 n AS (SELECT m.*, name, label, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY level, community ORDER BY coalesce(degree, 0) DESC, node) AS r FROM m JOIN nodes ON nodes.id = node LEFT JOIN g ON g.id = node),
 i AS (SELECT a.level, a.community, a.name AS x, e.type, b.name AS y, row_number() OVER (PARTITION BY a.level, a.community ORDER BY e."from", e."to", e.type) AS r FROM edges e JOIN n a ON a.node = e."from" JOIN n b ON b.node = e."to" AND a.level = b.level AND a.community = b.community),
 f AS (SELECT level, community, count(*) AS n_in, string_agg(x||' '||type||' '||y, '; ' ORDER BY r) FILTER (r <= 3) AS summary, string_agg('- '||x||' --'||type||'--> '||y, chr(10) ORDER BY r) AS facts FROM i GROUP BY 1, 2),
 t AS (SELECT level, community, any_value(parent) AS parent, string_agg(name, ', ' ORDER BY r) FILTER (r <= 3) AS title, count(*) AS n_members, sum(degree) AS ends, string_agg('- '||name||' ['||label||']', chr(10) ORDER BY node) AS ents FROM n GROUP BY 1, 2),
 o AS (SELECT 'N'||n_nationkey AS community, 'About '||n_name AS title, 'model: '||n_name||' and its customers' AS summary FROM nation WHERE n_regionkey >= 2),
 s AS (SELECT level, t.community, parent, coalesce(o.title, t.title) AS title, coalesce(o.summary, f.summary, '') AS summary, round(coalesce(20.0::DOUBLE * n_in / ends, 0), 4) AS rating, n_members, ents, coalesce(n_in, 0) AS n_in, facts FROM t LEFT JOIN f USING (level, community) LEFT JOIN o ON o.community = t.community),
 c AS (SELECT parent, string_agg(l, chr(10) ORDER BY l) AS subs FROM (SELECT parent, '['||community||']: '||substr(summary, 1, 500) AS l FROM s WHERE level = 1 AND parent IN (SELECT parent FROM s WHERE level = 1 GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1)
 SELECT level, community, s.parent, title, summary, rating, n_members, sha256(substr('Entities ('||n_members||'):'||chr(10)||ents||chr(10)||chr(10)||'Relationships ('||n_in||'):'||coalesce(chr(10)||facts, '')||coalesce(chr(10)||chr(10)||'Sub-community summaries:'||chr(10)||subs, ''), 1, 1000000)) AS context FROM s LEFT JOIN c ON c.parent = s.community AND s.level = 0"""


@query("G10_report_tree", _TREE)
def g10_tree(spark, d):
    """Two levels; a model's table gives title and summary of the nations of some regions, which their regions' contexts then hold."""
    nation = tg.table(spark, d, "nation").filter("n_regionkey >= 2")
    given = nation.select(F.lit(1).alias("level"), F.concat(F.lit("N"), "n_nationkey").alias("community"), F.concat(F.lit("About "), "n_name").alias("title"), F.concat(F.lit("model: "), "n_name", F.lit(" and its customers")).alias("summary"), F.lit(None).cast("double").alias("rating"))
    out = report_tree(_two_levels(spark, d), tg.nodes(spark, d), tg.edges(spark, d), given, max_chars=1_000_000)
    return out.withColumn("context", F.sha2("context", 256))


@query("G11_finalize", "SELECT n_nationkey AS community, 1 + count(c_custkey) AS n_members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def g11(spark, d):
    work = Scratch(spark, "final")
    one = lambda t, p, k, n: tg.table(spark, d, t).select(F.concat(F.lit(p), F.col(k)).alias("node"), F.col(n).alias("community"))
    m = one("customer", "CUS:", "c_custkey", "c_nationkey").union(one("nation", "NAT:", "n_nationkey", "n_nationkey"))
    reports = work.write(community_reports(m, tg.nodes(spark, d), tg.edges(spark, d)), "made")
    for _ in range(2):  # the second run replaces the first
        finalize_graph(m, reports, work.path)
    return spark.read.parquet(f"{work.path}/reports").select("community", "n_members")
