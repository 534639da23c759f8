"""Communities by modularity: local moves, then a graph of communities, level after level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.relational import dense_index
from plumbline.store import discard, settled, stash

#: Gains that count, the part of a level's nodes that must move for another sweep, how much degrees count against ties,
#: slices of a rank of moves, how far from the best a choice may be.
LEAST, GO_ON, RESOLUTION, SLICES, NEAR = 1e-9, 0.05, 1.2, 32, 0.25


def _simple(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, w): distinct ties between known accounts, both directions, weight 1, without loops."""
    ids = nodes.select(F.col("user_id").alias("a"))
    e = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    e = e.join(ids, "a", "left_semi").join(ids.toDF("b"), "b", "left_semi").select("a", "b", F.lit(1.0).alias("w"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of parts (user_id, community): what ties within communities exceed those that degrees alone would make; null without ties."""
    e = _simple(edges, parts)
    c = parts.select(F.col("user_id").alias("a"), F.col("community").alias("x"))
    at = e.join(c, "a").join(c.toDF("b", "y"), "b")
    per = at.groupBy("x").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)).alias("inside"))
    s = per.agg(F.sum("tot").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("tot") * F.col("tot")).alias("q"))
    return s.select((F.col("i") / F.col("m") - resolution * F.col("q") / (F.col("m") * F.col("m"))).alias("modularity"))


def joining_gain(edges: DataFrame, parts: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """One row (gain): the most that joining two communities would add to the modularity; null if no two have ties."""
    c = parts.select(F.col("user_id").alias("a"), F.col("community").alias("x"))
    at = _simple(edges, parts).join(c, "a").join(c.toDF("b", "y"), "b")
    tot, m = at.groupBy("x").agg(F.sum("w").alias("tx")), at.agg(F.sum("w").alias("m"))
    between = at.where("x < y").groupBy("x", "y").agg(F.sum("w").alias("w")).join(tot, "x").join(tot.toDF("y", "ty"), "y").join(F.broadcast(m))  # one row
    return between.agg(F.max(2 * (F.col("w") - resolution * F.col("tx") * F.col("ty") / F.col("m")) / F.col("m")).alias("gain"))


def _wanted(e: DataFrame, at: DataFrame, m: float, resolution: float, turn: int) -> DataFrame:
    """(a, k, home, c, gain): a community that each node gains by joining, nearly the best one.

    Gains count less by up to NEAR, by a hash of node, community and turn, so
    nodes with the same choice do not all go to the same community.
    """
    totals = at.groupBy("c").agg(F.sum("k").alias("tot"))
    near = e.join(at.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
    own = at.select("a", "k", F.col("c").alias("home")).join(totals.toDF("home", "home_tot"), "home")
    x = own.join(near, "a").join(totals, "c").join(near.toDF("a", "home", "w_home"), ["a", "home"], "left")
    stay = F.coalesce("w_home", F.lit(0.0)) - resolution * F.col("k") * (F.col("home_tot") - F.col("k")) / m
    x = x.where("c <> home").select("a", "k", "home", "c", (F.col("w") - resolution * F.col("k") * F.col("tot") / m - stay).alias("gain")).where(F.col("gain") > LEAST)
    less = 1 - NEAR * F.pmod(F.xxhash64("a", "c", F.lit(turn)), F.lit(1024)) / 1024
    best = x.groupBy("a").agg(F.min(F.struct((-F.col("gain") * less).alias("v"), F.col("c").alias("c"), "gain", "k", "home")).alias("x"))
    return best.select("a", "x.k", "x.home", "x.c", "x.gain")


def _made(want: DataFrame, m: float, resolution: float, turn: int) -> DataFrame:
    """(a, to): those of the wanted moves that are made together, each of which raises modularity whatever others are made.

    A community gives or takes, whichever has more gain (of equals as a hash of
    it and the turn has it), so moves out of one are never weighed against moves
    into it; the ends of the move of largest gain do as that needs.  Moves that
    share a community then cost one another at most resolution * k * k / m
    beyond their gains.  They are ranked by halvings of the gain, cut by a hash
    into SLICES, and one is made if its gain is over what it and all of its rank
    or before would cost each other at both ends.  A move that is first at both
    is always made, so a sweep makes one if any is wanted.
    """
    order = F.struct((-F.col("gain")).alias("loss"), "k", "a")
    sides = F.array(F.struct(F.col("home").alias("end"), F.col("gain").alias("g")), F.struct(F.col("c").alias("end"), (-F.col("gain")).alias("g")))
    role = want.select(F.explode(sides).alias("e")).groupBy("e.end").agg(F.sum("e.g").alias("g"))
    top = want.agg(F.min(F.struct(order.alias("x"), "home", "c")).alias("t")).select("t.home", "t.c")
    coin = F.pmod(F.xxhash64("end", F.lit(turn)), F.lit(2)) == 0
    gives = (F.col("end") == F.col("home")) | ((F.col("end") != F.col("c")) & ((F.col("g") > LEAST) | ((F.col("g") > -LEAST) & coin)))
    role = role.join(F.broadcast(top)).select("end", gives.alias("gives"))  # one row
    rank = F.floor(-F.log2("gain")) * SLICES + F.pmod(F.xxhash64("a"), F.lit(SLICES))
    may = want.join(role.where("gives").select(F.col("end").alias("home")), "home", "left_semi").join(role.where("not gives").select(F.col("end").alias("c")), "c", "left_semi")
    may = stash(may.select("a", "k", "home", "c", "gain", rank.alias("rank")), "moves")
    both = may.select(F.explode(F.array("home", "c")).alias("end"), "rank", "k", order.alias("x")).groupBy("end", "rank").agg(F.sum("k").alias("k"), F.min("x").alias("x"))
    there = Window.partitionBy("end")  # a row for each rank, of which there are few
    sums = both.select("end", "rank", F.sum("k").over(there.orderBy("rank")).alias("sum"), F.min("x").over(there)["a"].alias("lead"))
    at = may.join(sums.toDF("home", "rank", "s0", "l0"), ["home", "rank"]).join(sums.toDF("c", "rank", "s1", "l1"), ["c", "rank"])
    cost = resolution * F.col("k") * (F.col("s0") + F.col("s1") - 2 * F.col("k")) / m
    first = (F.col("l0") == F.col("a")) & (F.col("l1") == F.col("a"))
    return at.where(first | (F.col("gain") - cost > LEAST)).select("a", F.col("c").alias("to"))


def _sweep(e: DataFrame, at: DataFrame, m: float, resolution: float, turn: int) -> DataFrame:
    """at (a, k, c), each node's degree and community, with the moves of one sweep made; moved says whose."""
    made = _made(stash(_wanted(e, at, m, resolution, turn), "wanted"), m, resolution, turn)
    return at.join(made, "a", "left").select("a", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved"))


def modularity_communities(edges: DataFrame, nodes: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """(user_id, community): numbered 1.. by size, then smallest member.

    Nodes begin alone.  A level's sweeps go on while enough nodes move; then
    each community becomes a node with the summed ties of its members, and the
    next level begins, until one makes no move: no community can then gain by
    joining another.  Accounts without ties stay alone.
    """
    e = stash(_simple(edges, nodes), "ties")
    m = e.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    degree = e.groupBy("a").agg(F.sum("w").alias("k"))
    at = nodes.select(F.col("user_id").alias("a")).distinct().join(degree, "a", "left").select("a", F.coalesce("k", F.lit(0.0)).alias("k"))
    at = stash(at.withColumn("c", F.col("a")), "level")
    found = at.select(F.col("a").alias("user_id"), F.col("c").alias("community"))
    turn = 0
    while m > 0:
        nodes_here, any_move = at.count(), False
        while True:
            new = settled(e.sparkSession, "sweep", lambda e=e, at=at, turn=turn: _sweep(e, at, m, resolution, turn))
            turn += 1
            moved = new.where("moved").count()
            any_move = any_move or moved > 0
            at, old = new.drop("moved"), at
            if moved <= GO_ON * nodes_here:
                break
        if not any_move:
            break
        found = stash(found.join(at.select(F.col("a").alias("community"), "c"), "community").select("user_id", F.col("c").alias("community")), "found")
        c = at.select("a", "c")
        up = e.join(c, "a").join(c.toDF("b", "d"), "b").where("c <> d").groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.sum("w").alias("w"))
        above = stash(up, "ties")
        at = stash(at.groupBy(F.col("c").alias("a")).agg(F.sum("k").alias("k")).withColumn("c", F.col("a")), "level")
        discard(e)
        e = above
    size = found.groupBy("community").agg(F.count("*").alias("s"), F.min("user_id").alias("m"))
    num = dense_index(size.withColumn("_o", F.struct(-F.col("s"), "m")), "_o").select("community", (F.col("index") + 1).alias("n"))
    return found.join(num, "community").select("user_id", F.col("n").cast("long").alias("community"))
