import corpus_pipeline as P
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plumbline.llm import decontam as D
from tests.llm.test_decontam import lcs
from tests.llm.test_jaccard import brute as components
from tests.llm.test_pii import brute as spans

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r for r in rows}
            assert len(after) == len(rows) > 0 and set(after) <= set(before)
        if k == 0:
            kept = [labels[i] for i in after if i in labels]
            gone = [labels[i] for i in before if i in labels and i not in after]
            assert sum(kept) >= 0.95 * len(kept) and sum(gone) <= 0.3 * max(1, len(gone))
        elif k == 1:
            assert set(after) == {i for i, _, c in components([(i, r.text) for i, r in before.items()]) if i == c}
        elif k == 2:
            words = lambda t: t.lower().split()
            whole = lambda a, b: f" {' '.join(words(a))} " in f" {' '.join(words(b))} "
            leaks = {i for i, r in before.items() if any(whole(x["text"], r.text) for x in items)}
            assert not leaks & set(after)
            for i in set(before) - set(after) - leaks:  # what else went shares most of an item
                assert any(lcs(words(x["text"]), words(before[i].text)) >= D.WITH_ANSWER * len(words(x["text"])) for x in items)
        elif k == 3:
            for i, r in after.items():
                assert spans(r.text) == "" and r.n_chars == len(r.text)
                assert r.text == before[i].text or spans(before[i].text)
        else:
            assert {r.doc_id for r in rows} == set(before)
            used = {}
            for r in rows:
                used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
            assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 2
        if k < 4:
            before = after


def mixed_up(spark):
    """The documents with their ids, and with ids that are null or repeat; source tells the rows apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.col("doc_id").cast("string"))
    return docs, docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") % 5).when(F.col("doc_id") % 3 == 2, F.col("doc_id")))


def test_masking_goes_by_row(spark):
    docs, mixed = mixed_up(spark)
    want = {r.source: r.text for r in P.personal_data(spark, docs, SF).collect()}
    rows = P.personal_data(spark, mixed, SF).collect()
    assert len(rows) == len(want) and {r.source: r.text for r in rows} == want
    assert any("<email>" in r.text for r in rows if r.doc_id is None)


def test_one_row_of_a_component_stays(spark):
    docs, mixed = mixed_up(spark)
    twice = mixed.union(mixed)
    part = {i: c for i, _, c in components([(r.doc_id, r.text) for r in docs.collect()])}
    text = {str(r.doc_id): r.text for r in docs.collect()}
    kept = [r.source for r in P.near_duplicates(spark, twice, SF).collect()]
    worded = [s for s in kept if text[s] and text[s].split()]
    assert sorted(part[int(s)] for s in worded) == sorted({part[int(s)] for s, t in text.items() if t and t.split()})
    assert len(kept) - len(worded) == 2 * sum(not (t and t.split()) for t in text.values())  # texts without words link with nothing
    few = [(None, "a b c d e f"), (9, "a b c d e f"), (3, "a b c d e f"), (3, "x y z u v w"), (None, "only this one here"), (None, "only this one here")]
    got = P.near_duplicates(spark, spark.createDataFrame(few, "doc_id long, text string"), SF).collect()
    assert sorted((r.text, r.doc_id) for r in got) == [("a b c d e f", 3), ("only this one here", None), ("x y z u v w", 3)]


def test_only_rows_that_leak_go(spark):
    docs, mixed = mixed_up(spark)
    want = sorted(r.source for r in P.decontamination(spark, docs, SF).collect())
    assert len(want) < docs.count()
    assert sorted(r.source for r in P.decontamination(spark, mixed, SF).collect()) == want


def test_empty_tables_nulls_and_clashing_columns(spark):
    rows = [(1, None, "_row"), (2, "", "key"), (3, "mail a.b@c.org now", "x"), (None, "mail a.b@c.org now", None), (4, "word " * 300, "part")]
    docs = spark.createDataFrame([(i, t, s, s, 7, 8, 9) for i, t, s in rows], "doc_id long, text string, source string, _row string, key int, part int, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    dup = P.near_duplicates(spark, docs, SF)
    assert dup.columns == docs.columns and sorted((r.doc_id, r._row) for r in dup.collect()) == [(1, "_row"), (2, "key"), (3, "x"), (4, "part")]
    clean = P.decontamination(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == 5
    hidden = P.personal_data(spark, docs, SF).collect()
    assert sorted((r._row or "", r.text) for r in hidden if r.text and "mail" in r.text) == [("", "mail <email> now"), ("x", "mail <email> now")]
    assert [r.n_chars for r in hidden if r.doc_id == 1] == [None] and {r.key for r in hidden} == {7}
    assert P.quality(spark, docs, SF).columns == docs.columns
    pieces = P.packing(spark, docs, SF).collect()
    assert len({(r.doc_id, r.piece) for r in pieces}) == len(pieces) == 5
