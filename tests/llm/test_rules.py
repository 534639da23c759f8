import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import _text as T
from plumbline.llm.rules import best_threshold, counts, quality_rules, ratio_weights

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        dup += bool(WORD.search(x)) and x in seen
        seen.add(x)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {k for i, t in enumerate(three) if three.count(t) > 1 for k in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té#| ", max_size=40)), max_size=8))
def test_counts(texts):
    raw, off = T.buffers(pa.array(texts, pa.string()))
    assert counts(raw, off).tolist() == [plain(t) for t in texts]


def test_windows_end_with_their_text():
    texts = ["a b c a b", "c x", "a b c"]
    assert counts(*T.buffers(pa.array(texts))).tolist() == [plain(t) for t in texts]


def test_words_and_hashes():
    texts = ["The tHe\tEND\n", None, "", "é É x" * 3, " a"]
    raw, off = T.buffers(pa.array(texts, pa.string()).slice(0))
    h, first, b, e = T.words(raw, off)
    got = [[bytes(raw[b[k] : e[k]]).lower() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [(t or "").encode().lower().split() for t in texts]
    assert h[0] == h[1] == T.word_hash("the") and len(np.unique(h)) == len({w for g in got for w in g})


def test_threshold():
    assert best_threshold({5: 3, 6: 1}, {1: 2, 2: 2}, 0.5) == 2.0
    assert best_threshold({}, {1: 1}, 1.0) == float("-inf")


def test_rejects_what_target_lacks(spark):
    r = random.Random(3)
    good, junk = [f"w{i}" for i in range(300)], [f"x{i}!!" for i in range(300)]
    rows = [(i, " ".join(r.choices(junk if i % 7 == 0 else good, k=80)), "z") for i in range(700)] + [(900, None, "z"), (901, "", "z"), (902, "w1 " * 90, "z"), (None, " ".join(good[:70]), "z")]
    labels = [(i, 0 if i % 7 == 0 else 1, 1) for i in range(300)] + [(5, 1, 0), (None, 1, 1), (6, None, 1)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, key string"), spark.createDataFrame(labels, "doc_id long, quality int, key int"), bits=14).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.kept == (x.doc_id is None or (x.doc_id < 900 and x.doc_id % 7 != 0)), x
        assert x.base_failed == (x.doc_id is not None and x.doc_id >= 900)
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, key string")).where("kept").count()
    assert got == 701
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_both_ways_of_counting(spark):
    docs = spark.createDataFrame([(i, f"a{i % 5} b c", 0) for i in range(50)] + [(None, "x", 0)], "key long, text string, n int")
    trusted = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "key long")
    assert np.array_equal(ratio_weights(docs, trusted, 10), ratio_weights(docs, trusted, 10, keys=3))
