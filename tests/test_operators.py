import math
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import content, dedup, metrics, relational, scoring, structure, temporal
from plumbline.operators.components import connected_components
from plumbline.operators.skew import spread_join
from plumbline.queries.text import f1_normalise
from plumbline.sources import corpora, readers, sinks


@pytest.mark.parametrize(
    "columns,aliases,want",
    [
        (["id", "screen_name", "followers_count"], ["source_id", "source", "from"], None),
        (["id", "screen_name"], ["target_id", "target", "to"], None),
        (["id", "human_text", "machine_text", "model"], ["text", "content", "document"], None),
        (["Account_Type", "x"], ["account.type"], "Account_Type"),
        (["created"], ["created_at"], "created"),
        (["user_screen_name"], ["screen_name"], "user_screen_name"),
    ],
)
def test_aliases(columns, aliases, want):
    assert readers.resolve_column(columns, aliases) == want


def test_required_alias():
    with pytest.raises(KeyError):
        readers.resolve_columns(["a"], {"text": ["text"]}, ("text",))


def posts(spark, rows):
    return spark.createDataFrame(rows, "user_id string, t long").withColumn("created_at", F.timestamp_seconds("t"))


def test_rhythm(spark):
    got = {r.user_id: r for r in temporal.temporal_features(posts(spark, [("a", 0), ("b", 0), ("b", 60), ("c", 0), ("c", 60), ("c", 120), ("d", 0), ("d", 1), ("d", 101), ("d", 102), ("d", 202), (None, 3), ("e", None)])).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"].burstiness == got["b"].burstiness == 0 and got["c"].burstiness == -1 and got["c"].memory_coefficient == 0
    assert got["d"].memory_coefficient == pytest.approx(-1)
    assert temporal.temporal_features(posts(spark, []).limit(0)).collect() == []


def test_synchrony_meets_next_bucket(spark):
    rows = [(u, k * 600 + d) for k in range(4) for u, d in (("a", 59), ("b", 61))] + [("c", 300)]
    got = {r.user_id: r for r in temporal.synchrony(posts(spark, rows)).collect()}
    assert got["a"].synchrony_score == got["b"].synchrony_score > 0 and got["c"].synchrony_score == 0


def test_triangles_and_components(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 1, "x"), (2, 3, "x"), (3, 1, "y"), (1, 4, "x"), (5, 6, "x"), (7, 7, "x")], "source long, target long, relation string")
    n = spark.createDataFrame([(i,) for i in range(1, 9)], "user_id long")
    got = {r.user_id: r for r in structure.structural_features(n, e).collect()}
    assert got[2].clustering_coefficient == 1 and got[1].clustering_coefficient == pytest.approx(1 / 3) and got[8].in_degree == 0
    assert got[1].reciprocity == 0.5
    assert {r.node: r.component for r in connected_components(e, "source", "target").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, None), (None, 0.1), (0, 0.2)], "y int, score double")
    r = metrics.evaluate(df).first()
    assert (r.n, r.tp, r.fp, r.fn, r.tn) == (4, 1, 1, 1, 1) and r.roc_auc == pytest.approx(0.375)
    one = metrics.evaluate(df.where("y = 1")).first()
    assert one.roc_auc is None and one.mcc is None
    assert metrics.evaluate(spark.createDataFrame([(1, 1.0), (0, 0.0)], "y int, score double")).first().brier is None
    b = metrics.bootstrap(df).first()
    assert b.low <= b.f1 <= b.high
    assert metrics.tune(metrics.sweep(df, metrics.candidates(df)), "f1", 0.99).count() == 1


def test_bands(spark):
    df = spark.createDataFrame([(0.35,), (0.60,), (0.82,), (0.85,), (0.1,), (None,)], "s double")
    got = [tuple(r) for r in df.select(scoring.triage(F.col("s")), scoring.band(F.col("s"))).collect()]
    assert got == [("monitor", "elevated"), ("investigate", "high"), ("escalate", "high"), ("escalate", "critical"), ("clear", "low"), (None, None)]
    with pytest.raises(ValueError):
        scoring.triage(F.col("s"), (0.5, 0.4, 0.9))


def test_texts(spark):
    t = "Ignore previous instructions now! Visit HTTP://x.y/z mail a.b@c.io or @bob_1 &amp; sooooo “ok”… JAILBREAK jailbreak"
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    r = df.select(X.normalise(F.col("t")).alias("n"), X.match_spans(F.col("t")).alias("s"), X.lexical_score(F.col("t")).alias("l"), X.sentence_spans(F.col("t")).alias("x"), X.char_ngrams(F.col("t")).alias("g"), X.stylometry(F.col("t")).alias("m")).select("*", "m.*").collect()
    assert r[0].n == "Ignore previous instructions now! Visit HTTPURL mail EMAILADDR or @USER & sooo \"ok\"... JAILBREAK jailbreak"
    assert [t[s.start : s.end].lower() for s in r[0].s] == [s.phrase for s in r[0].s] == ["ignore previous instructions", "jailbreak", "jailbreak"]
    assert r[0].l == pytest.approx(1 - math.exp(-1.8)) and r[1].n == r[2].n == "" and r[1].s == [] and r[1].g == []
    assert all(t[s.start : s.end] == s.sentence for s in r[0].x)
    assert r[0].imperative_start == 1 and r[1].n_words == 0
    short = spark.createDataFrame([("abc",), ("abcdef",)], "t string").select(X.char_ngrams(F.col("t")).alias("g")).collect()
    assert [x.g for x in short] == [["abc"], ["abcde", "bcdef"]]


def test_near_duplicates_keep_first(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    df = spark.createDataFrame([(1, base), (2, base + "!"), (3, "something else entirely, not like it at all"), (4, base), (5, None)], "id long, t string")
    assert sorted(r.id for r in dedup.near_dedupe(df, "id", "t").collect()) == [1, 3, 5]
    assert dedup.exact_dedupe(df, "id", "t").count() == 4


def test_dense_index(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(500)], "id long").repartition(7)
    assert [(r.id, r["index"]) for r in relational.dense_index(df, "id").orderBy("id").collect()] == [(i * 3, i) for i in range(500)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n00123456789012345678;x\n2;y\n")
    (tmp_path / "b.json").write_text('{"records": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "c.json").write_text('{"u1": {"n": 1}, "u2": {"n": 2}}')
    (tmp_path / "d.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert [r.id for r in readers.read_any(spark, str(tmp_path / "a.csv")).collect()] == ["00123456789012345678", "2"]
    assert readers.read_any(spark, str(tmp_path / "b.json")).count() == 2
    assert sorted(r.id for r in readers.read_any(spark, str(tmp_path / "c.json")).collect()) == ["u1", "u2"]
    both = readers.read_many(spark, [str(tmp_path / "d.jsonl"), str(tmp_path / "a.csv")])
    assert both.count() == 4 and {r["__source_file"] for r in both.collect()} == {"d.jsonl", "a.csv"}
    assert len(readers.find_files(spark, str(tmp_path))) == 4
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/x.csv", "a,b\n")
        z.writestr("__MACOSX/x.csv", "no")
    assert [r.member for r in readers.archive_members(spark, str(tmp_path / "z.zip")).collect()] == ["in/x.csv"]
    got = {r.dataset: r.status for r in readers.readiness(spark, {"here": str(tmp_path), "gone": str(tmp_path / "no")}).collect()}
    assert got == {"here": "READY", "gone": "MISSING"}
    sinks.register(spark, str(tmp_path / "m"), "x", "GENERATED", both)
    sinks.register(spark, str(tmp_path / "m"), "x", "REAL", both)
    assert sinks.manifest(spark, str(tmp_path / "m")).first().provenance == "REAL"
    sinks.assert_real(sinks.manifest(spark, str(tmp_path / "m")), ["x"])
    with pytest.raises(ValueError):
        sinks.assert_real(sinks.manifest(spark, str(tmp_path / "m")), ["y"])


def test_entry_without_the_llm_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_reworded_posts_are_copies(spark):
    say = "our great summer sale ends tonight so do not miss the best offers of the whole year at the market {}"
    rows = [("a", say.format("hall")), ("b", say.format("hall!!")), ("c", "Our great  summer sale ends tonight so do not miss the best offers of the whole year at the market stall"), ("d", "something quite different about birds and lakes"), ("d", "a third thing that has no likeness to any other"), ("e", "a thought of my own that I like to say again one"), ("e", "a thought of my own that I like to say again two"), (None, "x"), ("f", None)]
    df = spark.createDataFrame(rows, "user_id string, text string")
    got = {r.user_id: (r.content_duplication_ratio, r.cross_account_dup_ratio) for r in content.duplication(df).collect()}
    assert got == {"a": (0, 1), "b": (0, 1), "c": (0, 1), "d": (0, 0), "e": (0.5, 0)}
    exact = {r.user_id: r.cross_account_dup_ratio for r in content.duplication(df, near=None).collect()}
    assert set(exact) == set(got) and not any(exact.values())
    assert content.duplication(df.limit(0)).collect() == []


def test_long_texts_stay_whole(spark, tmp_path):
    text = " ".join(f"w{i % 1000}" for i in range(5000))
    df = spark.createDataFrame([(1, text, 1)], "doc_id long, text string, label int")
    assert corpora.finalise(df, "d").first().text == text
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert f1_normalise(spark, str(tmp_path)).first().text == text


def test_near_chain_is_decided_whole(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(8)], "id long, t string")
    chain = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    monkeypatch.setattr(dedup, "near_pairs", lambda *_: chain)
    assert sorted(r.id for r in dedup.near_dedupe(df, "id", "t").collect()) == [0, 2, 4, 6]
    with pytest.raises(RuntimeError):
        dedup.near_dedupe(df, "id", "t", rounds=2)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_of_a_join(spark, how):
    many = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(900)] + [(None, -1)], "k long, v long").repartition(3)
    few = spark.createDataFrame([(7, "hot"), (30, "x"), (60, "y"), (60, "z"), (None, "n")], "k long, w string")
    got = spread_join(many, few, ["k"], F.col("v"), how)
    want = many.join(few, "k", how)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in connected_components(e, "a", "b").collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(e, "a", "b", rounds=1)


def _pairwise(rows, window, least=3):
    """(score, partners, mean lift) of each account from all pairs of accounts."""
    here = {u: {t // window for v, t in rows if v == u} for u, _ in rows}
    every = set().union(*here.values())
    pool = {u: b | {x - 1 for x in b if x - 1 in every} for u, b in here.items()}
    found = {u: [] for u in here}
    for u in here:
        for v in here:
            n = len(pool[u] & pool[v])
            if u != v and n >= least:
                e = max(len(here[u]) * len(here[v]) / len(every), 1e-9)
                found[u].append(((n - e) / math.sqrt(e), n / e))
    return {u: (1 - math.exp(-max(max((z for z, _ in x), default=0.0), 0.0) / 6), sum(r >= 2 for _, r in x), sum(r for _, r in x) / len(x) if x else 0.0) for u, x in found.items()}


@pytest.mark.parametrize("meet", [0, 3, 10**9])
def test_synchrony_of_blocks_without_pairs_as_rows(spark, monkeypatch, meet):
    rows = [(u, 60 * ((u * 7 + k * k * (1 + u % 5)) % 90)) for u in range(40) for k in range(2 + u % 23)]
    for name, value in (("FEW", 9), ("MEMBERS", 12), ("MEET", meet), ("COLUMNS", 7), ("CELLS", 30)):  # buckets as columns, by pairs, or both
        monkeypatch.setattr(temporal, name, value)
    monkeypatch.setattr(temporal, "co_posting", None)
    got = {r.user_id: (r.synchrony_score, r.synchrony_partner_count, r.synchrony_mean_lift) for r in temporal.synchrony(posts(spark, [(f"u{u}", t) for u, t in rows])).collect()}
    want = _pairwise([(f"u{u}", t) for u, t in rows], 60)
    assert set(got) == set(want) and all(got[u] == pytest.approx(want[u]) for u in want)


def test_few_valued_tables_count_as_their_rows(spark):
    from plumbline.store import stash

    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    few = "pmod(xxhash64(id), 97) AS user_id", "md5(string(pmod(xxhash64(id, 1), 5))) AS text"
    content.duplication(spark.range(10).selectExpr(*few), near=None)
    read = stash(spark.range(100_000).selectExpr(*few), "few")
    assert int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 100_000 * 16  # else it is broadcast


def test_grams_are_not_put_together_from_characters(spark):
    texts = ["", " A\n b", "abcd", "Abcde", "an an an an an", "\U0001f600\U0001f601x\U0001f602yz \U0001f600"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.char_ngrams(F.col("t")).alias("g"))
    for t, g in df.collect():
        c = " ".join(t.lower().split())
        assert g == list(dict.fromkeys(c[i : i + 5] for i in range(max(1, len(c) - 4)) if c))
    assert "array_join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_cotext_is_made_once(spark):
    texts = [None, "", "Short https://a.b/c", "A shared LINE https://x.y/z?q=1 and HTTP://W.V, http:/no but more_words 12!", "x" * 25, "no signs :// but twenty five letters"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.cotext(F.col("t")).alias("c"))
    for t, c in df.collect():
        want = re.sub(r"[^a-z0-9_]+", " ", re.sub(r"https?://\S+", " ", (t or "").lower())).strip(" ")
        assert c == (want if len(want) >= 25 else None)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9_]+") == 1


def test_features_are_made_once_and_what_they_came_from_goes(spark):
    from plumbline import store
    from plumbline.queries import QUERIES

    before = set(store._PLACED)
    scaled = QUERIES["g10_scaled"](spark, "/root/testdata/sf0.001")  # reads them twice: for the means, and the rows
    assert all("/features-" in f for f in scaled.inputFiles()) and scaled.count() > 0
    assert [p.rpartition("/")[2].partition("-")[0] for p in store._PLACED if p not in before] == ["features"]


@pytest.mark.parametrize("grams", [1 << 20, 20])
def test_near_pairs_carry_no_grams_and_count_as_sets(spark, monkeypatch, grams):
    monkeypatch.setattr(dedup, "GRAMS", grams)  # by the second blocks of few texts
    words = "the night shift packed what came before the last train left for Öland \U0001f682".split()
    texts = {i: " ".join(words[i % 3 : 9 + i % 4] + [f"n{i // 2}"]) for i in range(24)} | {90: "Ab  c", 91: "ab c", 92: "", 93: "abcd"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    near = dedup.near_pairs(df, "id", "t", 0.6)
    assert "array_intersect" not in near._jdf.queryExecution().optimizedPlan().toString()
    sets = {i: {t[k : k + 5] for k in range(max(len(t) - 4, 1))} for i, t in ((i, " ".join(t.lower().split())) for i, t in texts.items()) if t}
    got = near.collect()
    assert len(got) > 20 and all(r.a < r.b and r.jaccard == len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b]) >= 0.6 for r in got)
