import math
import random
import re
import time
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from plumbline.llm.pii import KINDS, OTHER, mask, personal_data, written


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


#: As the contract writes them.
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    out = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PLAIN[kind][0], text or "") if PLAIN[kind][1](m[0])]
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark):
    r = random.Random(5)
    bits = ["a@b.co", "x.y%z@q-r.s.t", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49", "é日", " ", "\n", "0001.2.3.004", "..", "%", "4111111111111111", "+", "-", "7", "a", "a@b", ".c@d.e"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 9)))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "9" * 30_000), (1003, "a" * 30_000 + "@"), (1004, "1 " * 20_000), (1005, "+1" + "(" * 20_000), (1006, "a@b" + ".c" * 9000)]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", written(F.col("base")).alias("s"), "base", "spans").collect()
    want = dict(rows)
    assert len(got) == len(rows)
    for x in got:
        assert x.s == brute(want[x.doc_id]), want[x.doc_id]
        assert set(x.base) <= set(x.spans)


def test_patterns_find_more(spark):
    r = random.Random(7)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    some = lambda: " ".join(r.choices(words, k=8))
    rows = [(i, f"{some()} reach me by phone: +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} {some()}", 0) for i in range(40)]
    rows += [(100, f"é {some()} reach me by phone: 555-123-4567 {some()}", 0), (101, f"{some()} order number 555-765-4321 {some()}", 0), (102, None, 0), (None, "call +1 234 567 8901", 0), (None, "call +1 234 567 8901", 0)]
    got = {x.doc_id: x.s for x in personal_data(spark.createDataFrame(rows, "doc_id long, text string, value int")).select("doc_id", written(F.col("spans")).alias("s")).collect()}
    at = rows[40][1].index("555-")
    assert got[100] == f"phone:{at}:{at + 12}"
    assert got[101] == "" and got[102] == "" and got[None] == "phone:5:20"
    hidden = {x.doc_id: x.text for x in mask(spark.createDataFrame(rows[:43], "doc_id long, text string, value int")).collect()}
    assert hidden[100] == rows[40][1].replace("555-123-4567", "<phone>") and hidden[101] == rows[41][1] and hidden[102] is None
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_unseen_shapes_by_their_context(spark):
    r = random.Random(9)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    some = lambda: " ".join(r.choices(words, k=8))
    name = lambda: "".join(r.choices("abcdefgh", k=6))

    def card():
        d = "".join(r.choices("0123456789", k=15))
        return next(d + c for c in "0123456789" if luhn(d + c))

    rows = [(i, f"{some()} write to: {name()}@{name()}.org {some()} charge the card {card()} {some()} from host {r.randint(1, 255)}.{r.randint(1, 255)}.7.9 {some()}") for i in range(40)]
    new = {
        1000: ("write to: ", "jane_doe (at) mail (dot) org", "email"), 1001: ("write to ", "jane.doe@localhost", "email"), 1002: ("charge the card ", "4111 1111 1111 1112", "card"),
        1003: ("charge the card ", "3782-822463-10006x", None), 1004: ("from host ", "2001:db8:0:1:1:1:1:1", "ip"), 1005: ("see page ", "12345-6789", None), 1006: ("meet @ ", "noon", None),
    }
    rows += [(k, f"é {some()} {before}{value} {some()}") for k, (before, value, _) in new.items()]
    got = {x.doc_id: x.s for x in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", written(F.col("spans")).alias("s")).collect()}
    text = dict(rows)
    for k, (_, value, kind) in new.items():
        at = text[k].index(value)
        if kind:
            assert got[k] == f"{kind}:{at}:{at + len(value)}", (k, got[k])
        elif k > 1003:
            assert got[k] == "", (k, got[k])
    assert all(got[k].count(":") == 6 for k in range(40))


def test_many_identifiers_in_one_text(spark):
    n = 8000
    text = "é " + " ".join(f"to u{i}@m.org or 10.0.{i % 256}.{i // 256} x12345-{i}" for i in range(n))
    df = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    got = personal_data(df).select(F.size("base").alias("n"), written(F.slice("base", 1, 200)).alias("s")).collect()
    assert sorted(x.n for x in got) == [0, 2 * n, 2 * n]
    assert all(x.s == ",".join(brute(text[:9000]).split(",")[:200]) for x in got if x.n)
    out = mask(df).where("doc_id = 1").first().text
    assert out == re.sub(r"u\d+@m.org", "<email>", re.sub(r"10\.0\.\d+\.\d+", "<ip>", text))


def scored(texts, support=5, confident=0.7, certain=0.8, rounds=2):
    """All spans of each text: seeds, patterns and scores in plain Python; the shape of other identifiers is the operator's."""
    base, every = [], []

    def matches(shape, text):
        before = 0
        for m in regex.finditer(shape, text):
            yield m.start(), m.end(), m[0], text[before : m.start()][-48:]
            before = m.start()

    for text in texts:
        known = sorted((s, k, e, v, left) for k, kind in enumerate(KINDS) for s, e, v, left in matches(PLAIN[kind][0], text) if PLAIN[kind][1](v))
        base.append([(s, k, e) for s, k, e, _, _ in known])
        others = [(s, None, e, v, left) for s, e, v, left in matches(OTHER, text) if regex.search(r"(?i)@|[(\[{<]at[)\]}>]", v) or (len(v) >= 6 and len(re.sub("[^0-9]", "", v)) >= 4)]
        every.append(known + [o for o in others if not any(o[0] < e and s < o[2] for s, _, e, _, _ in known)])

    def contexts(left):
        one, two = regex.search(r"([\p{L}\p{N}]+)[^\p{L}\p{N}]{0,8}$", left), regex.search(r"([\p{L}\p{N}]+[^\p{L}\p{N}]{1,8}[\p{L}\p{N}]+)[^\p{L}\p{N}]{0,8}$", left)
        return {m[1] if m is one else regex.sub(r"[^\p{L}\p{N}]+", " ", m[1]) for m in (one, two) if m}

    edges, seeds = set(), {}
    for spans in every:
        for _, k, _, v, left in spans:
            edges |= {(c, v.lower()) for c in contexts(left.lower())}
            if k is not None:
                seeds[v.lower()] = min(k, seeds.get(v.lower(), k))
    new = {}
    for _ in range(rounds):
        known = seeds | new
        seen, patterns = defaultdict(Counter), {}
        for c, v in edges:
            seen[c][known.get(v)] += 1
        for c, n in seen.items():
            top = max(((m, k) for k, m in n.items() if k is not None), default=(0, 0))
            if top[0] >= support and top[0] >= confident * sum(n.values()):
                patterns[c] = (top[1], top[0] / sum(n.values()))
        doubt = defaultdict(float)
        for c, v in edges:
            if v not in known and c in patterns:
                doubt[v, patterns[c][0]] += math.log(max(1 - patterns[c][1], 1e-6))
        best = {}
        for (v, k), d in doubt.items():
            if 1 - math.exp(d) >= certain:
                best[v] = max(best.get(v, (0, 0)), (1 - math.exp(d), k))
        new |= {v: k for v, (_, k) in best.items()}
    out = []
    for b, spans in zip(base, every, strict=True):
        found = sorted({*b, *((s, new[v.lower()], e) for s, k, e, v, _ in spans if k is None and v.lower() in new)})
        out.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found))
    return out, sum(map(len, base))


def test_added_spans_by_brute_force(spark):
    r = random.Random(11)
    leads = ["call me: ", "mail to ", "from host ", "card no. ", "order ", "see ", "page ", "reach us at ", ""]
    kinds = {
        "call me: ": lambda: f"+1 {r.randint(200, 999)} 555 {r.randint(1000, 9999)}", "mail to ": lambda: f"u{r.randint(0, 999)}@m{r.randint(0, 9)}.org", "from host ": lambda: f"10.{r.randint(0, 255)}.0.{r.randint(0, 255)}",
        "reach us at ": lambda: r.choice([f"+44 20 {r.randint(1000000, 9999999)}", f"555-{r.randint(100, 999)}-{r.randint(1000, 9999)}"]),
    }
    odd = [lambda: f"{r.randint(200, 999)}-555-{r.randint(1000, 9999)}", lambda: f"u{r.randint(0, 9)} (at) m (dot) org", lambda: f"x{r.randint(1000, 99999)}-{r.randint(0, 99)}", lambda: "2001:db8:0:1:1:1:1:" + str(r.randint(1, 9)), lambda: f"{r.randint(1, 99)} {r.randint(1, 99)} {r.randint(1000, 9999)}kg"]
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(r.randint(1, 4)):
            lead = r.choice(leads)
            make = kinds[lead] if lead in kinds and r.random() < 0.75 else r.choice(odd)
            parts.append(lead + make() + r.choice([" then", ".", ", and", " é"]))
        texts.append(" ".join(parts))
    want, plain = scored(texts)
    assert sum(w.count(":") // 2 for w in want) > plain + 20  # the patterns add some
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.s for x in personal_data(docs).select("doc_id", written(F.col("spans")).alias("s")).collect()}
    for k, w in enumerate(want):
        assert got[k] == w, texts[k]


def test_runs_of_numbers_before_a_letter(spark):
    run = " ".join(str(10 + i % 90) for i in range(200_000))

    def took(text):
        t = time.time()
        n = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base")).first()[0]
        return time.time() - t, n

    took("warm up 12 34 56 78kg")
    plain, with_letter = took(run), took(run + "kg")
    assert plain[1] == with_letter[1] and with_letter[0] < plain[0] + 10
