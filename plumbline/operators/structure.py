"""Degrees, reciprocity, clustering, assortativity and inequality of directed multi-relation graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import dense_index, quota, running, seeded
from plumbline.store import stash

#: Accounts up to which betweenness is exact; accounts from which it is estimated beyond.
EXACT, SAMPLE = 400, 100


def finalise_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known accounts, without self-loops, once for each (source, target, relation), with is_cross_instance."""
    known = nodes.select("user_id", "instance_domain")
    e = edges.where("source is not null and target is not null and source <> target").dropDuplicates(["source", "target", "relation"])
    e = e.join(known.toDF("source", "ds"), "source").join(known.toDF("target", "dt"), "target")
    return e.withColumn("is_cross_instance", F.col("ds") != F.col("dt")).drop("ds", "dt")


def clustering(edges: DataFrame) -> DataFrame:
    """(user_id, clustering_coefficient) of accounts with two undirected neighbours or more.

    Each triangle is found once, from its edges directed toward the higher
    (degree, id), so that no account has more than about the square root of
    twice the edges to pair, hubs included.
    """
    und = edges.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()
    deg = und.select(F.explode(F.array("u", "v")).alias("user_id")).groupBy("user_id").agg(F.count("*").alias("d"))
    du, dv = deg.toDF("u", "du"), deg.toDF("v", "dv")
    up = F.struct("du", "u") < F.struct("dv", "v")
    low = und.join(du, "u").join(dv, "v").select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = low.join(low.select("a", F.col("b").alias("c")), "a").where("b < c")
    tri = wedge.join(und.toDF("b", "c"), ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("user_id")).groupBy("user_id").agg(F.count("*").alias("t"))
    return deg.where("d >= 2").join(tri, "user_id", "left").select("user_id", (2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).alias("clustering_coefficient"))


def structural_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, in_degree, out_degree, degree_ratio, reciprocity, clustering_coefficient) for every node.

    Degrees count edge rows of all relations; reciprocity is the share of
    distinct out-neighbours that point back.
    """
    out = edges.groupBy(F.col("source").alias("user_id")).agg(F.count("*").alias("o"))
    in_ = edges.groupBy(F.col("target").alias("user_id")).agg(F.count("*").alias("i"))
    one = edges.select("source", "target").distinct()
    both = one.join(one.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("m")), ["source", "target"], "left")
    rec = both.groupBy(F.col("source").alias("user_id")).agg((F.count("m") / F.count("*")).alias("r"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = nodes.select("user_id").join(in_, "user_id", "left").join(out, "user_id", "left").join(rec, "user_id", "left").join(clustering(edges), "user_id", "left")
    return j.select(
        "user_id", z("i").alias("in_degree"), z("o").alias("out_degree"), (z("o") / (z("i") + 1.0)).alias("degree_ratio"),
        F.coalesce("r", F.lit(0.0)).alias("reciprocity"), F.coalesce("clustering_coefficient", F.lit(0.0)).alias("clustering_coefficient"),
    )


def gini(counts: DataFrame, value: str) -> DataFrame:
    """One row (gini) of the inequality of a count.  Ranks come from a count for each value, so equal values share one row."""
    tie = counts.groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    r = running(tie, [], ["x"], ["c"]).withColumnRenamed("before_c", "before")
    # ranks before+1 .. before+c
    a = r.agg(F.sum(F.col("x") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2)).alias("s"), F.sum(F.col("x") * F.col("c")).alias("t"), F.sum("c").alias("n"))
    g = 2 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")
    return a.select(F.when((F.col("t") > 0) & (F.col("n") > 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))).otherwise(0.0).alias("gini"))


def domain_entropy(nodes: DataFrame) -> DataFrame:
    """One row (entropy, n_domains, n_nodes): natural-log entropy of instance domains, 0 for fewer than two."""
    c = nodes.groupBy(F.lower(F.coalesce("instance_domain", F.lit("x.com"))).alias("d")).agg(F.count("*").alias("c"))
    t = c.agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.collect_list("c").alias("cs"))
    e = F.aggregate("cs", F.lit(0.0), lambda a, x: a - x / F.col("n") * F.log(x / F.col("n") + 1e-12))
    return t.select(F.when(F.col("k") > 1, F.greatest(e, F.lit(0.0))).otherwise(0.0).alias("entropy"), F.col("k").alias("n_domains"), F.coalesce("n", F.lit(0)).alias("n_nodes"))


def _through(e: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(net, v, d): sums over roots (net, s) of the shares of shortest paths through v in ties (net, source, target); None without any.

    Paths are counted outward from all roots at once, a join a level, and
    shares added up inward, level by level, so no task holds a graph.
    """
    levels = [stash(roots.select("net", "s", F.col("s").alias("v"), F.lit(1.0).alias("g")), "paths")]
    seen = levels[0].select("net", "s", "v")
    out = e.select("net", F.col("source").alias("v"), "target")
    while not levels[-1].isEmpty():
        step = levels[-1].join(out, ["net", "v"]).groupBy("net", "s", F.col("target").alias("v")).agg(F.sum("g").alias("g"))
        levels.append(stash(step.join(seen, ["net", "s", "v"], "left_anti"), "paths"))
        seen = seen.union(levels[-1].select("net", "s", "v"))
    share = levels[-1].select("net", "s", "v", "g", F.lit(0.0).alias("d"))
    total = None
    for near in reversed(levels[:-1]):
        far = share.select("net", "s", F.col("v").alias("target"), F.col("g").alias("gw"), F.col("d").alias("dw"))
        add = near.join(out, ["net", "v"]).join(far, ["net", "s", "target"]).groupBy("net", "s", "v").agg(F.sum(F.col("g") / F.col("gw") * (1 + F.col("dw"))).alias("d"))
        share = stash(near.join(add, ["net", "s", "v"], "left").select("net", "s", "v", "g", F.coalesce("d", F.lit(0.0)).alias("d")), "shares")
        part = share.where("s <> v").select("net", "v", "d")
        total = part if total is None else total.union(part)
    return None if total is None else total.groupBy("net", "v").agg(F.sum("d").alias("d"))


def betweenness(edges: DataFrame, nodes: DataFrame, exact: int = EXACT, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(user_id, betweenness) of every account in the directed graph of distinct ties.

    With more than `exact` accounts paths are counted from the first `sample`
    in seeded order, and the sums scaled up.
    """
    n = nodes.count()
    ids = nodes.select("user_id")
    e = edges.where("source <> target").select("source", "target").distinct().join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    e = stash(e.select(F.lit(0).alias("net"), "source", "target"), "ties")
    roots = ids if n <= exact else ids.orderBy(seeded("user_id", seed), "user_id").limit(sample)
    sums = _through(e, roots.select(F.lit(0).alias("net"), F.col("user_id").alias("s")))
    if sums is None:
        return ids.select("user_id", F.lit(0.0).alias("betweenness"))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0) * (n / sample if n > exact else 1)
    return ids.join(sums.select(F.col("v").alias("user_id"), "d"), "user_id", "left").select("user_id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def betweenness_by(edges: DataFrame, network: str, exact: int = EXACT, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(network, user_id, betweenness) of each network's accounts, those with ties in it, on their own; all networks in the same joins.

    A network of more than `exact` accounts has paths counted from `sample` of them.
    """
    e = stash(edges.where("source <> target").select(F.col(network).cast("string").alias("net"), "source", "target").distinct(), "ties")
    ends = stash(edges.select(F.col(network).cast("string").alias("net"), F.explode(F.array("source", "target")).alias("user_id")).where("net is not null").distinct(), "ends")
    size = ends.groupBy("net").agg(F.count("*").alias("n"))
    few = ends.join(size.where(F.col("n") <= exact).select("net"), "net", "left_semi")
    many = quota(ends.join(size.where(F.col("n") > exact).select("net"), "net", "left_semi").withColumn("_o", seeded("user_id", seed)), ["net"], ["_o", "user_id"], sample).drop("_o")
    sums = _through(e, few.unionByName(many).select("net", F.col("user_id").alias("s")))
    at = ends.join(size, "net")
    at = at.withColumn("d", F.lit(0.0)) if sums is None else at.join(sums.withColumnRenamed("v", "user_id"), ["net", "user_id"], "left")
    n = F.col("n").cast("double")
    scale = F.when(n > 2, 1 / ((n - 1) * (n - 2))).otherwise(0.0) * F.when(n > exact, n / sample).otherwise(1.0)
    return at.select(F.col("net").alias("network"), "user_id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def bridge_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (federation_bridge_centrality): the share of betweenness that accounts with ties to other instances have, to four places.

    Their share of accounts where no account is between others; 0 without such ties.
    """
    dom = nodes.select("user_id", F.lower(F.coalesce("instance_domain", F.lit("x.com"))).alias("d"))
    cross = edges.join(dom.toDF("source", "ds"), "source").join(dom.toDF("target", "dt"), "target").where("ds <> dt")
    ends = cross.select(F.explode(F.array("source", "target")).alias("user_id")).distinct().withColumn("_b", F.lit(True))
    a = betweenness(edges, nodes).join(ends, "user_id", "left").agg(F.sum("betweenness").alias("t"), F.sum(F.when(F.col("_b"), F.col("betweenness"))).alias("x"), F.count("_b").alias("k"), F.count("*").alias("n"))
    share = F.when(F.col("t") > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x", F.lit(0.0)) / F.col("t")))).otherwise(F.try_divide("k", "n"))
    return a.select(F.round(F.when(F.col("k") > 0, share).otherwise(0.0), 4).alias("federation_bridge_centrality"))


def architecture(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: centralised or federated, with confidence, domain entropy, cross-instance share, in-degree inequality and bridge centrality, to four places."""
    dom = nodes.select("user_id", F.lower(F.coalesce("instance_domain", F.lit("x.com"))).alias("d"))
    e = edges.join(dom.toDF("source", "ds"), "source", "left").join(dom.toDF("target", "dt"), "target", "left")
    cross = F.coalesce("ds", F.lit("x.com")) != F.coalesce("dt", F.lit("x.com"))
    ratio = e.agg(F.coalesce(F.avg(cross.cast("double")), F.lit(0.0)).alias("r"))
    deg = nodes.select("user_id").join(edges.groupBy(F.col("target").alias("user_id")).agg(F.count("*").alias("i")), "user_id", "left").select(F.coalesce("i", F.lit(0)).alias("i"))
    one = domain_entropy(nodes).join(F.broadcast(ratio)).join(F.broadcast(gini(deg, "i"))).join(F.broadcast(bridge_centrality(nodes, edges)))  # single rows
    h, r = F.col("entropy"), F.col("r")
    fed = ((h >= 0.30) & (r >= 0.04)) | ((F.col("n_domains") >= 2) & (r >= 0.10))
    clip = lambda x: F.greatest(F.lit(0.5), F.least(F.lit(0.99), x))
    one_ = F.lit(1.0)
    conf = F.when(fed, clip(0.55 + 0.30 * F.least(one_, h / 1.4) + 0.15 * F.least(one_, r / 0.3))).otherwise(clip(0.60 + 0.40 * (1 - F.least(one_, h / 0.30)) * (1 - F.least(one_, r / 0.04))))
    return one.select(
        F.when(fed, "decentralized_federated").otherwise("centralized").alias("network_architecture"), F.round(conf, 4).alias("architecture_confidence"),
        F.round(h, 4).alias("instance_entropy"), F.round(r, 4).alias("cross_instance_edge_ratio"), F.round("gini", 4).alias("hub_dominance_gini"), "federation_bridge_centrality",
    )


def assortativity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (assortativity): (tr M - |M^2|) / (1 - |M^2|) of the normalised label mixing matrix; null if all edges have one label."""
    lab = nodes.select("user_id", "label")
    m = edges.join(lab.toDF("source", "a"), "source").join(lab.toDF("target", "b"), "target").groupBy("a", "b").agg(F.count("*").alias("c"))
    t = m.agg(F.sum("c").alias("t"))
    m = m.join(F.broadcast(t)).withColumn("p", F.col("c") / F.col("t"))
    same = m.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("p"))), F.lit(0.0)).alias("tr"))
    rows, cols = m.groupBy(F.col("a").alias("k")).agg(F.sum("p").alias("x")), m.groupBy(F.col("b").alias("k")).agg(F.sum("p").alias("y"))
    sq = rows.join(cols, "k").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return same.join(F.broadcast(sq)).select(F.try_divide(F.col("tr") - F.col("s"), 1 - F.col("s")).alias("assortativity"))


def topology(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density of distinct directed edges, overall reciprocity, components, share of the largest, mean and largest degree."""
    from plumbline.operators.components import connected_components

    n = nodes.agg(F.count("*").alias("n_nodes"))
    one = edges.select("source", "target").distinct()
    back = one.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("m"))
    e = one.join(back, ["source", "target"], "left").agg(F.count("*").alias("n_edges"), F.coalesce(F.try_divide(F.count("m"), F.count("*")), F.lit(0.0)).alias("reciprocity"))
    part = nodes.select(F.col("user_id").alias("node")).join(connected_components(edges, "source", "target"), "node", "left")
    c = part.groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("s")).agg(F.count("*").alias("n_components"), F.max("s").alias("largest"))
    ends = one.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    deg = ends.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("sum_degree"), F.coalesce(F.max("d"), F.lit(0)).alias("max_degree"))
    j = n.join(F.broadcast(e)).join(F.broadcast(c)).join(F.broadcast(deg))
    return j.select("n_nodes", "n_edges", F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1.0)).alias("density"), "reciprocity", "n_components", F.try_divide(F.col("largest"), "n_nodes").alias("giant_share"), F.try_divide("sum_degree", "n_nodes").alias("mean_degree"), "max_degree")


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 5, supplied: str | None = None) -> DataFrame:
    """(user_id, community) by synchronous label propagation, then numbered 1.. by size, then smallest member.

    supplied: a column of nodes with community labels; if any account has one
    they stand, numbered 1.. in their own order, and accounts without get 0.

    An account takes the label most of its neighbours and itself have, the smallest of ties.
    """
    if supplied is not None and not nodes.where(F.col(supplied).isNotNull()).isEmpty():
        names = nodes.where(F.col(supplied).isNotNull()).select(F.col(supplied).cast("string").alias("_c")).distinct()
        num = dense_index(names, "_c").select("_c", (F.col("index") + 1).alias("community"))
        return nodes.select("user_id", F.col(supplied).cast("string").alias("_c")).join(num, "_c", "left").select("user_id", F.coalesce("community", F.lit(0)).cast("long").alias("community"))
    e = edges.where("source <> target").select("source", "target").union(edges.where("source <> target").select("target", "source")).distinct()
    e = stash(e.union(nodes.select("user_id", F.col("user_id"))), "neighbours")
    lab = nodes.select(F.col("user_id").alias("target"), F.col("user_id").alias("l"))
    for _ in range(rounds):
        n = e.join(lab, "target").groupBy("source", "l").agg(F.count("*").alias("c"))
        lab = stash(n.groupBy("source").agg(F.min(F.struct(-F.col("c"), F.col("l").alias("l")))["l"].alias("l")).withColumnRenamed("source", "target"), "labels")
    size = lab.groupBy("l").agg(F.count("*").alias("s"), F.min("target").alias("m"))
    num = dense_index(size.withColumn("_o", F.struct(-F.col("s"), "m")), "_o").select("l", (F.col("index") + 1).alias("community"))
    return lab.join(num, "l").select(F.col("target").alias("user_id"), "community")


def dropout(edges: DataFrame, share: float, seed: int = 42, training: bool = True) -> DataFrame:
    """edges without a drawn share of account pairs, both directions of a pair together; all of them when not training."""
    if not training:
        return edges
    pair = F.concat_ws(":", F.lit(str(seed)), F.least("source", "target").cast("string"), F.greatest("source", "target").cast("string"))
    return edges.where(F.conv(F.substring(F.md5(pair), 1, 8), 16, 10).cast("double") / 4294967296.0 >= share)


def permuted_targets(edges: DataFrame, seed: int = 42) -> DataFrame:
    """(source, target): the same sources and targets, the targets in a seeded order: a graph without structure to compare with."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("source").cast("string"), F.col("target").cast("string"))
    e = edges.select("source", "target").distinct()
    plain = dense_index(e.withColumn("_k", F.struct("source", "target")), "_k", "i").select("source", "i")
    mixed = dense_index(e.withColumn("_k", F.struct(F.md5(key).alias("h"), F.col("source").alias("s"), F.col("target").alias("t"))), "_k", "i").select("target", "i")
    return plain.join(mixed, "i").select("source", "target")


def importance(values: DataFrame, name: str, value: str, k: int | None = None) -> DataFrame:
    """Features by the size of a value, largest first, ties by name."""
    out = values.select(name, value).orderBy(F.desc(F.abs(F.col(value))), name)
    return out if k is None else out.limit(k)
