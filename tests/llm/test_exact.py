"""What the methods of op4 and op7 decide, against loops over everything."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm import decontam as D
from plumbline.llm.rules import SHRINK, quality_rules


def test_all_windows_against_all_items(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    items = [" ".join(r.choices(words, k=r.randint(12, 30))) + ". The answer is " + " ".join(r.choices(words, k=3)) + "." for _ in range(12)] + ["too short"]
    docs = []
    for k in range(70):
        body = r.choices(words, k=r.randint(0, 90))
        if k % 3 == 0:
            planted = [w for w in r.choice(items).split() if r.random() > r.choice([0.0, 0.2, 0.4])]
            at = r.randint(0, len(body))
            body = body[:at] + planted + body[at:]
        docs.append((k, " ".join(body)))
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    bd = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    exact = {(x.doc_id, x.item_id): (x.common, x.answered) for x in D.contaminated(dd, bd, cosine=None).collect()}
    near = {(x.doc_id, x.item_id): (x.common, x.answered) for x in D.contaminated(dd, bd).collect()}
    parsed = D.Items.of(list(enumerate(items)), np.ones((D.FEATURES, 4), np.float32))
    want = {}
    for key, text in docs:
        h = D.hashes(text)
        first = np.array([0, len(h)])
        for pos, size in ((p, s) for s, (at, _) in parsed.groups.items() for p in at.tolist()):
            for _, a, b in zip(*D.windows(first, size), strict=True):
                lo, hi = max(0, int(a) - size // 4), min(len(h), int(b) + size // 4)
                if got := D.verdict(parsed.words[pos].tolist(), parsed.answers[pos].tolist(), h[lo:hi].tolist()):
                    want[key, parsed.ids[pos]] = max(want.get((key, parsed.ids[pos]), (0, False)), got)
    assert exact == want and len(want) > 15
    assert set(near) <= set(exact) and len(near) >= 0.8 * len(exact)


@pytest.mark.parametrize("bits", [12, 18])
def test_ratio_and_threshold(spark, bits):
    r = random.Random(5)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    rows = [(k, " ".join(r.choices(good if r.random() < 0.85 else bad, k=1)[0] if k % 4 else r.choice(bad) for _ in range(r.randint(0, 90)))) for k in range(240)] + [(900, None), (901, "A a")]
    labels = {k: int(k % 4 > 0) for k in range(0, 240, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    halves = {x.key: x.h for x in spark.createDataFrame([(k,) for k in labels], "key long").select("key", (F.pmod(F.xxhash64(F.lit("half"), "key"), F.lit(2)) == 0).alias("h")).collect()}
    feats = {}
    for k, text in rows:
        h = [T.word_hash(w) for w in (text or "").split()]
        pairs = [int(T.grams(np.array(h[i : i + 2], np.uint64), 2)[0]) for i in range(len(h) - 1)]
        feats[k] = [x >> (64 - bits) for x in h + pairs]
    raw = Counter(f for k in feats for f in feats[k])
    target = Counter(f for k, y in labels.items() if y == 1 and halves[k] for f in feats[k])
    share = sum(target.values()) / max(1, sum(raw.values()))
    weight = {f: math.log((target[f] + SHRINK) / (c * share + SHRINK)) for f, c in raw.items()}
    ratio = {k: sum(weight[f] for f in fs) / max(1, len(fs)) for k, fs in feats.items()}
    got = {x.doc_id: x for x in quality_rules(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), bits=bits).collect()}
    for k, want in ratio.items():
        assert got[k].ratio == pytest.approx(want, abs=1e-5)
    judged = [(ratio[k], y) for k, y in labels.items() if not (y == 1 and halves[k])]
    wrong = lambda t: sum((x >= t) != (y == 1) for x, y in judged)
    bins = [math.floor(x * 256) for x, _ in judged]
    borders = range(min(bins), max(bins) + 2)
    least = min(wrong(t / 256) for t in borders)
    best = [t for t in borders if wrong(t / 256) == least]
    cut = best[len(best) // 2] / 256
    for k, x in got.items():
        assert x.kept == (not x.base_failed and ratio[k] >= cut), (k, ratio[k], cut)
