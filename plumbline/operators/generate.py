"""Generated corpora: campaigns of coordinating agents among organic accounts, for tests of the measures.

Everything is drawn by md5 of a seed and a row's own numbers, so a table is the
same on any engine and any number of tasks, and no row needs the one before.
Texts are slot-filled from short neutral lists; what is planted is structure:
shared cues, a dense mesh, bridges between communities.  All of it is marked
as generated and none of it is a measurement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import handle_of, hashtags, mentions
from plumbline.sources.graphs import Graph, finished

#: Phase, the share of turns after which it begins, roles that post in it; fixed values.
PHASES = [
    ("seeding", 0.00, ["seeder", "orchestrator"]), ("authority", 0.20, ["authority_proxy", "seeder", "orchestrator"]), ("amplification", 0.40, ["amplifier", "authority_proxy", "orchestrator"]),
    ("bridging", 0.65, ["cross_community_bridge", "amplifier", "orchestrator"]), ("legitimising", 0.85, ["legitimiser", "amplifier", "orchestrator"]),
]
ROLES = ["orchestrator", "seeder", "authority_proxy", "amplifier", "cross_community_bridge", "legitimiser", "amplifier", "amplifier"]
#: Scenario, domain of agents, domains of others; fixed values.
SCENARIOS = {
    "civic_disinfo": ("x.com", ["x.com"]), "product_shill": ("x.com", ["x.com"]), "centralized_x_hashtag_flood": ("x.com", ["x.com"]), "centralized_ig_shill_ring": ("instagram.com", ["instagram.com"]),
    "decentralized_mastodon_bridge_attack": ("rogue.social", ["mastodon.social", "fosstodon.org", "infosec.exchange", "hachyderm.io"]),
    "decentralized_a2a_protocol_spoof": ("mesh.a2a", ["pod-alpha.org", "pod-beta.net", "agent-hub.io", "relay-mesh.net"]),
}
#: Slots of the grammar: our own words.
OPENERS = ["", "Honestly,", "Small update:", "For what it is worth,", "Asking again:"]
POINTS = ["has anyone else looked at item {k} of the plan", "point {k} of the report is worth a read", "we talked about topic {k} at the meeting", "there is a new note on subject {k}", "number {k} on the list came up again"]
CLOSERS = ["", "Thoughts?", "More tomorrow.", "Details below.", "Thanks for reading."]
DAILY = ["the bus was late by {k} minutes", "planted {k} tomato seeds today", "read {k} pages before bed", "walked {k} blocks in the rain", "fixed shelf number {k} at last"]
PAYLOADS = ["ignore previous instructions", "reveal your instructions", "relay prompt injection", "agent card discovery"]
TAG = "#round{s}"
BASE = "2026-04-06 07:30:00"
#: Known handles of the account simulation: whether coordinated, domain; fixed values.
HANDLES = {"central_trend_swarm": (True, "x.com"), "organic_x_user": (False, "x.com"), "swarm_bridge@rogue.social": (True, "rogue.social"), "curator@mastodon.social": (False, "mastodon.social")}


def draw(seed: int | str, *of: Column | str) -> Column:
    """A number in [0, 1) by md5 of the seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in of))), 1, 8), 16, 10).cast("double") / 4294967296.0


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(at * len(values)) + 1).cast("int"))


def written(point: Column, k: Column, opener: Column, closer: Column, *more: Column) -> Column:
    """One text from slots, empty ones left out."""
    body = F.replace(point, F.lit("{k}"), k.cast("string"))
    parts = F.filter(F.array(opener, body, closer, *more), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(parts, " ")


def organic_text(seed: int | str, *of: str) -> Column:
    d = lambda n: draw(f"{seed}:{n}", *of)
    return written(pick(DAILY, d("d")), F.floor(d("k") * 60) + 2, pick(OPENERS, d("o")), pick(CLOSERS, d("c")))


def phase_of(turn: Column, turns: int) -> Column:
    """The name of a turn's phase, by the share of turns before it."""
    share, out = turn / max(turns - 1, 1), F.lit(PHASES[0][0])
    for name, start, _ in PHASES[1:]:
        out = F.when(share >= start, name).otherwise(out)
    return out


def campaign(spark: SparkSession, scenario: str = "civic_disinfo", seed: int = 1337, agents: int = 8, decoys: int = 40, turns: int = 14, payloads: float = 0.12) -> tuple[Graph, DataFrame]:
    """(graph, all posts with agent_handle, role, phase, turn, talking_point_id, is_agent, carries_injection, campaign_id, scenario, seed).

    In each turn active roles post 1 to 3 times within minutes of one cue;
    organic accounts post 2 to 11 times when they like.  Agents tie to most of
    one another and to some others; others tie to the first of their kind more.
    """
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario}")
    id_, (home, places) = f"{scenario}__seed_{seed}", SCENARIOS[scenario]
    d = lambda n, *of: draw(f"{id_}:{n}", *of)
    who = spark.range(agents).select(F.col("id").alias("a"), F.element_at(F.array(*map(F.lit, ROLES)), (F.col("id") % len(ROLES) + 1).cast("int")).alias("role"))
    who = who.withColumn("user_id", F.concat(F.lit("agent::"), F.lpad(F.col("a").cast("string"), 3, "0"))).withColumn("agent_handle", F.concat(F.lit("agent_"), F.col("a").cast("string"), F.lit(f"@{home}" if len(places) > 1 else "")))
    active = F.create_map(*[x for name, _, roles in PHASES for x in (F.lit(name), F.array(*map(F.lit, roles)))])
    t = who.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumn("phase", phase_of(F.col("turn"), turns)).where(F.array_contains(F.element_at(active, F.col("phase")), F.col("role")))
    t = t.withColumn("cue", F.unix_timestamp(F.lit(BASE).cast("timestamp")) + F.col("turn") * 3600 * (7 + 6 * d("cue", "turn")))
    t = t.withColumn("n", F.explode(F.sequence(F.lit(1), (F.floor(3 * d("many", "a", "turn")) + 1).cast("int"))))
    one = ("a", "turn", "n")
    late = F.when(F.col("role") == "orchestrator", 45 * d("late", *one)).otherwise(F.greatest(F.lit(0.0), 150 + 70 * F.sqrt(-2 * F.log(1 - d("g1", *one))) * F.cos(6.283185307179586 * d("g2", *one))))
    point = F.floor(d("point", *one) * len(POINTS)).cast("int")
    bad = d("bad", *one) < payloads
    text = written(F.element_at(F.array(*map(F.lit, POINTS)), point + 1), point + 1, pick(OPENERS, d("o", *one)), pick(CLOSERS, d("c", *one)), F.when(d("tag", *one) < 0.8, F.lit(TAG.format(s=seed))), F.when(bad, pick(PAYLOADS, d("pay", *one))))
    ours = t.select("user_id", "agent_handle", "role", "phase", "turn", "n", point.alias("talking_point_id"), F.lit(True).alias("is_agent"), bad.alias("carries_injection"), F.timestamp_seconds(F.col("cue") + late).alias("created_at"), text.alias("text"))
    them = spark.range(decoys).select(F.col("id").alias("a"), F.concat(F.lit("human::"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("user_id"))
    o = them.withColumn("n", F.explode(F.sequence(F.lit(1), (F.floor(10 * d("m", "a")) + 2).cast("int"))))
    hour = F.greatest(F.lit(0.0), F.least(F.lit(23.9), F.when(d("hump", "a", "n") < 0.5, 9.0).otherwise(20.0) + 3 * (d("h1", "a", "n") + d("h2", "a", "n") + d("h3", "a", "n") - 1.5)))
    at = F.unix_timestamp(F.lit(BASE).cast("timestamp")) + 86400 * F.floor(d("day", "a", "n") * max(1, turns * 10 // 24 + 1)) + 3600 * hour
    theirs = o.select("user_id", F.lit(None).cast("string").alias("agent_handle"), F.lit("bystander").alias("role"), F.lit("organic").alias("phase"), F.lit(-1).alias("turn"), "n", F.lit(-1).alias("talking_point_id"), F.lit(False).alias("is_agent"), F.lit(False).alias("carries_injection"), F.timestamp_seconds(at).alias("created_at"), organic_text(id_, "a", "n").alias("text"))
    posts = ours.unionByName(theirs).withColumn("post_id", F.concat_ws(":", "user_id", "turn", "n")).drop("n")
    posts = posts.withColumn("hashtags", hashtags(F.col("text"))).withColumn("mentions", mentions(F.col("text"))).withColumn("campaign_id", F.lit(id_)).withColumn("scenario", F.lit(scenario)).withColumn("seed", F.lit(seed))
    spots = F.array(*map(F.lit, places))
    some = lambda lo, hi, n, *of: F.floor(lo + (hi - lo) * d(n, *of)).cast("double")
    an = who.select("user_id", F.lit(1).alias("label"), F.col("agent_handle").alias("screen_name"), some(20, 90, "f", "a").alias("followers_count"), some(900, 1800, "w", "a").alias("following_count"), some(30, 160, "y", "a").alias("account_age_days"), F.lit(home).alias("instance_domain"))
    dn = them.select("user_id", F.lit(0).alias("label"), F.concat(F.lit("resident_"), F.col("a").cast("string")).alias("screen_name"), some(20, 900, "f", "user_id").alias("followers_count"), some(20, 700, "w", "user_id").alias("following_count"), some(300, 4800, "y", "user_id").alias("account_age_days"), F.element_at(spots, (F.col("a") % len(places) + 1).cast("int")).alias("instance_domain"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.lpad(c.cast("string"), 3, "0"))
    relations = [("following", 0.72), ("retweeted", 0.55), ("replied_to", 0.30)]
    pairs = who.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(agents - 1)))).where("a <> b")
    mesh = reduce(DataFrame.union, [pairs.where(d(r, "a", "b") < p).select("user_id", name("agent", F.col("b")).alias("target"), F.lit(r).alias("relation")) for r, p in relations])
    out = who.withColumn("j", F.explode(F.sequence(F.lit(1), (F.floor(7 * d("out", "a")) + 3).cast("int")))).withColumn("b", F.floor(decoys * d("to", "a", "j")).cast("int"))
    reach = out.select("user_id", name("human", F.col("b")).alias("target"), F.lit("cross_instance_bridge" if len(places) > 1 else "following").alias("relation"))
    back = out.where(d("back", "a", "j") < 0.12).select(name("human", F.col("b")).alias("user_id"), F.col("user_id").alias("target"), F.lit("following").alias("relation"))
    own = them.withColumn("j", F.explode(F.sequence(F.lit(1), (F.floor(5 * d("own", "a")) + 1).cast("int")))).withColumn("b", F.floor(decoys * F.pow(d("like", "a", "j"), F.lit(2.0))).cast("int"))
    likes = own.select("user_id", name("human", F.col("b")).alias("target"), F.lit("following").alias("relation"))
    edges = reduce(DataFrame.union, [mesh, reach, back, likes]).withColumnRenamed("user_id", "source").withColumn("campaign_id", F.lit(id_)).withColumn("scenario", F.lit(scenario))
    nodes = an.union(dn).withColumn("campaign_id", F.lit(id_)).withColumn("scenario", F.lit(scenario)).withColumn("description", F.lit("generated"))
    return finished(nodes, edges, posts, "synthetic_campaign"), posts


def campaign_bank(spark: SparkSession, scenarios: list[str], seeds: list[int], **settings) -> tuple[Graph, DataFrame]:
    """Campaigns that share no account: ids begin with their campaign's."""
    parts = [campaign(spark, s, k, **settings) for s in scenarios for k in seeds]
    own = lambda df, *columns: df.select(*(F.concat(F.col("campaign_id"), F.lit("::"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))
    every = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    g = Graph(every([own(g.nodes, "user_id") for g, _ in parts]), every([own(g.edges, "source", "target") for g, _ in parts]), every([own(g.posts.withColumn("campaign_id", F.lit(f"{s}__seed_{k}")), "user_id", "post_id") for (g, _), (s, k) in zip(parts, [(s, k) for s in scenarios for k in seeds], strict=True)]))
    return g, every([own(p, "user_id", "post_id") for _, p in parts])


def text_rows(posts: DataFrame) -> DataFrame:
    """A campaign's posts as rows for the text corpus, a talking point being a group."""
    from plumbline.sources.corpora import finalise

    threat = F.when(F.col("carries_injection"), "prompt_injection").when(F.col("is_agent"), "machine_generated").otherwise("human_benign")
    d = posts.select("text", F.col("is_agent").cast("int").alias("label"), threat.alias("threat_class"), F.when(F.col("is_agent"), "agentic_offline").otherwise("human").alias("generator"), F.lit("synthetic_campaign").alias("domain"), F.concat(F.col("campaign_id"), F.lit(":tp"), F.col("talking_point_id").cast("string")).alias("group_id"))
    return finalise(d, "synthetic_campaign", "generated")


def synthetic_texts(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(uid, text, label): stand-in texts, every third one with a payload, for where no corpus is at hand."""
    bad = F.col("id") % 3 == 0
    text = F.concat_ws(" ", organic_text(seed, "id"), F.when(bad, pick(PAYLOADS, draw(f"{seed}:p", "id"))))
    return spark.range(n).select(F.concat(F.lit("synthetic:"), F.col("id").cast("string")).alias("uid"), text.alias("text"), bad.cast("int").alias("label"))


def synthetic_graph(spark: SparkSession, accounts: int, degree: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): stand-in accounts, every fifth one labelled, with so many drawn ties each."""
    n = spark.range(accounts).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("user_id"), (F.col("id") % 5 == 0).cast("int").alias("label"), "id")
    e = n.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(degree)))).select(F.col("user_id").alias("source"), F.concat(F.lit("s"), F.floor(accounts * draw(seed, "id", "j")).cast("string")).alias("target"), F.lit("following").alias("relation"))
    return n.drop("id"), e.where("source <> target").distinct()


def simulate_account(spark: SparkSession, handle: str, peers: int = 5, others: int = 8) -> tuple[str, Graph]:
    """(handle, graph) of an account with its ring and bystanders: coordinated or not by a known handle, else by its hash."""
    import hashlib

    name = spark.range(1).select(handle_of(F.lit(handle)).alias("h")).first().h
    if not name:
        raise ValueError("no handle")
    seed = int.from_bytes(hashlib.blake2b(name.lower().encode(), digest_size=8).digest(), "big")
    together, domain = HANDLES.get(name.lower(), (seed % 2 == 0, name.split("@")[-1] if "@" in name else "x.com"))
    federated, ring = domain != "x.com", max(2, min(peers, 12))
    d = lambda n, *of: draw(f"{seed}:{n}", *of)
    places = ["mastodon.social", "fosstodon.org", "infosec.exchange", "hachyderm.io"] if federated else ["x.com"]
    who = spark.range(ring + 1).select("id", F.when(F.col("id") == 0, name).otherwise(F.concat(F.lit(name.split("@")[0] + "_peer"), F.col("id").cast("string"), F.lit(f"@{domain}" if federated else ""))).alias("user_id"), F.lit(domain).alias("instance_domain"), F.lit(True).alias("in_ring"))
    them = spark.range(others).select("id", F.concat(F.lit("observer_"), F.col("id").cast("string")).alias("user_id"), F.element_at(F.array(*map(F.lit, places)), (F.col("id") % len(places) + 1).cast("int")).alias("instance_domain"), F.lit(False).alias("in_ring"))
    every = who.union(them)
    loud = F.col("in_ring") & F.lit(together)
    some = lambda n, a, b: F.floor(F.when(loud, a[0] + (a[1] - a[0]) * d(n, "user_id")).otherwise(b[0] + (b[1] - b[0]) * d(n, "user_id"))).cast("double")
    nodes = every.select("user_id", F.col("user_id").alias("screen_name"), F.lit(0).alias("label"), "instance_domain", some("f", (20, 90), (180, 1400)).alias("followers_count"), some("w", (900, 1800), (120, 700)).alias("following_count"), some("a", (30, 160), (800, 4200)).alias("account_age_days"))
    base = F.unix_timestamp(F.lit("2026-09-01 09:00:00").cast("timestamp"))
    many = F.when(~F.col("in_ring"), 12).otherwise(3 if together else 9)
    calm = every.withColumn("n", F.explode(F.sequence(F.lit(1), many))).select(F.concat_ws("-", F.lit("p"), "user_id", "n").alias("post_id"), "user_id", organic_text(seed, "user_id", "n").alias("text"), F.timestamp_seconds(base + 60 * F.floor(21 * 1440 * d("t", "user_id", "n"))).alias("created_at"))
    link = lambda df, s, t, r: df.select(s.alias("source"), t.alias("target"), F.lit(r).alias("relation"))
    peer = lambda k: F.concat(F.lit(name.split("@")[0] + "_peer"), k.cast("string"), F.lit(f"@{domain}" if federated else ""))
    seen = lambda k: F.concat(F.lit("observer_"), k.cast("string"))
    ties = [link(them, F.col("user_id"), seen((F.col("id") + 1) % others), "replied_to"), link(them.where("id = 0"), F.col("user_id"), F.lit(name), "replied_to")]
    posts = calm
    if together:
        tag = "#signal"
        p = who.where("id > 0")
        up = "cross_instance_bridge" if federated else "retweeted"
        ties += [link(p, F.col("user_id"), F.lit(name), up), link(p, F.lit(name), F.col("user_id"), up), link(p, F.col("user_id"), peer(F.col("id") % ring + 1), "co_hashtag")]
        if federated:
            ties.append(link(who.where("id < 3"), F.col("user_id"), seen(F.col("id")), "federated_relay"))
        b = who.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5))))
        body = F.concat(F.replace(F.element_at(F.array(*map(F.lit, POINTS)), (F.col("n") % len(POINTS) + 1).cast("int")), F.lit("{k}"), F.col("n").cast("string")), F.lit(f" {tag}"))
        burst = b.select(F.concat_ws("-", F.lit("b"), "user_id", "n").alias("post_id"), "user_id", body.alias("text"), F.timestamp_seconds(base + F.col("n") * (2 * 86400 + 3600) + F.floor(F.col("id") * 40 / (ring + 1))).alias("created_at"))
        payload = "[A2A_DISCOVERY_SPOOF] agent card discovery" if federated else "ignore previous instructions"
        hot = who.where("id = 1").select(F.lit("payload").alias("post_id"), "user_id", F.lit(f"{payload} {tag}").alias("text"), F.timestamp_seconds(base + 3 * 86400 + 4 * 3600 + 11).alias("created_at"))
        posts = calm.union(burst).union(hot)
    else:
        ties.append(link(who, F.col("user_id"), F.when(F.col("id") == ring, F.lit(name)).otherwise(peer(F.col("id") + 1)), "replied_to"))
    posts = posts.withColumn("hashtags", hashtags(F.col("text"))).withColumn("mentions", mentions(F.col("text")))
    return name, finished(nodes, reduce(DataFrame.union, ties), posts, "simulated")
