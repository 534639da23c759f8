"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are what four plain shapes find: e-mail and IP addresses, payment card
and phone numbers.  The words before a seed are patterns.  A pattern's
confidence for a kind is the share of that kind's identifiers among all
different identifiers seen behind it; an unlabelled identifier's score is one
minus the product of its patterns' doubts.  Identifiers over the threshold
join the seeds and the pattern-instance graph is scored again.  What is found
is added to the seeds' spans, which all stay.

The text is scanned once; after that only identifiers, their contexts and
counts move.  Patterns and instances are grouped with map-side combine and by
different values, so a common word or a copied text weighs one row in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._keys import numbered, unused
from plumbline.llm._spans import cutter, let, running, total
from plumbline.operators.skew import spread_join
from plumbline.store import stash

#: The kinds in the order of the contract, with the shape of each; fixed values.  A match begins where its run of
#: characters does or where the match before it ended, which finds the same matches and never looks at a run twice.
KINDS = ["email", "ip", "card", "phone"]
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Other identifiers, in this order: addresses with the mark spelled out or without a dot; numbers in groups; groups of hexadecimal
#: digits; joined runs of letters and digits.  Runs are possessive, begin where a word does and end before what can't belong to them, so none is looked at twice.
OTHER = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[(\[{<](?i:at)[)\]}>] ?|@)[A-Za-z0-9-]++(?:(?: ?[(\[{<](?i:dot)[)\]}>] ?|\.)[A-Za-z0-9-]++)*+",
    r"(?<![A-Za-z0-9])[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){3,7}+",
    r"(?<![A-Za-z0-9])\(?[0-9]++\)?+(?![A-Za-z0-9])(?:[ ./-]{1,2}\(?[0-9]++\)?+(?![A-Za-z0-9]))++",
    r"(?<![A-Za-z0-9])(?=[A-Za-z._/@-]{0,64}[0-9])[A-Za-z0-9]++(?:[-._/@][A-Za-z0-9]++)*+",
])
#: One that is taken: an address, or six characters and four digits.
ADDRESS = r"(?i)@|[(\[{<]at[)\]}>]"
#: Characters before an identifier in which its context is looked for.
BEFORE = 48
#: Seeds that a pattern needs, the confidence it needs, the score an identifier needs, rounds.
SUPPORT, CONFIDENT, CERTAIN, ROUNDS = 5, 0.7, 0.8, 2
FOUND = "array<struct<start:int,end:int,value:string,left:string>>"


def found(text: Column, shape: str) -> Column:
    """array<struct<start, end, value, left>> of all matches: code points from 0, end exclusive; left: what is before, from the match before on, at most BEFORE."""

    def spans(x: Column) -> Column:
        n = F.size(x["matches"])
        pairs = F.zip_with(F.slice(x["gaps"], F.lit(1), n), x["matches"], lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
        before = F.zip_with(F.slice(F.concat(F.array(F.lit("")), x["matches"]), F.lit(1), n), pairs, lambda b, p: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), F.right(F.concat(b, p["gap"]), F.lit(BEFORE)).alias("left")))
        at = running(F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["value"])), 0, total)

        def span(p: Column, a: Column) -> Column:
            start = a + F.char_length(p["gap"])
            return F.struct(start.alias("start"), (start + F.char_length(p["value"])).alias("end"), p["value"].alias("value"), p["left"].alias("left"))

        return F.zip_with(before, at, span)

    return let(F.struct(F.regexp_extract_all(text, F.lit(shape), F.lit(0)).alias("matches"), F.split(text, shape, -1).alias("gaps")), spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.char_length(digits)

    def add(acc, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (place in KINDS), end, value, left>> of the plain shapes, by start, then kind."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,left:string>>")

    def hits(k: int, kind: str) -> Column:
        good = F.filter(found(text, SHAPES[kind]), lambda x: valid(kind, x["value"]))
        named = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left")))
        gate = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        return F.when(gate, named).otherwise(empty)

    each = [hits(k, kind) for k, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def _contexts(left: Column) -> Column:
    """The word before a place, and the two words before it, in lower case."""

    def words(t: Column) -> Column:
        one, two = F.regexp_extract(t, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]{0,8}$", 1), F.regexp_extract(t, r"([\p{L}\p{N}]+[^\p{L}\p{N}]{1,8}[\p{L}\p{N}]+)[^\p{L}\p{N}]{0,8}$", 1)
        return F.filter(F.array(one, F.regexp_replace(two, r"[^\p{L}\p{N}]+", " ")), lambda x: x != "")

    return let(F.lower(left), words)


def _apart(every: Column) -> Column:
    """Those of the spans (by start) that have a kind, and of the others those that meet none of them."""
    far = 2**31 - 1

    def kept(v: Column) -> Column:
        end = running(F.transform(v, lambda x: F.when(x["kind"].isNull(), 0).otherwise(x["end"])), 0, F.greatest)
        start = F.reverse(running(F.reverse(F.transform(v, lambda x: F.when(x["kind"].isNull(), far).otherwise(x["start"]))), far, F.least))
        near = F.zip_with(end, start, lambda e, s: F.struct(e.alias("end"), s.alias("start")))
        both = F.zip_with(v, near, lambda x, n: F.struct(x.alias("x"), (x["kind"].isNotNull() | ((n["end"] <= x["start"]) & (n["start"] >= x["end"]))).alias("good")))
        return F.transform(F.filter(both, lambda b: b["good"]), lambda b: b["x"])

    return let(every, kept)


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each row: its key, a number of its content, the plain spans, and every identifier with kind (null if none) and contexts."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), t).alias("row"), t.alias("t"))
    d = d.withColumn("base", base_spans(F.col("t")))
    other = F.filter(found(F.col("t"), OTHER), lambda x: x["value"].rlike(ADDRESS) | ((F.char_length(x["value"]) >= 6) & (F.char_length(F.regexp_replace(x["value"], "[^0-9]", "")) >= 4)))
    other = F.transform(other, lambda x: F.struct(x["start"].alias("start"), F.lit(None).cast("int").alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left")))
    other = F.when(F.col("t").rlike("[0-9@]|" + ADDRESS[4:]), other).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string,left:string>>"))
    every = F.when(F.size(other) > 0, _apart(F.array_sort(F.concat("base", other)))).otherwise(F.col("base"))
    ids = F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.xxhash64(F.lower(x["value"])).alias("value"), _contexts(x["left"]).alias("ctx")))
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return d.select("key", "row", bare.alias("base"), ids.alias("ids"))


def _counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("c"))


def _promoted(edges: DataFrame, total: int, seeds: DataFrame, support: int, confident: float, certain: float) -> DataFrame:
    """(value, kind) of unlabelled identifiers whose patterns are sure of them.

    edges (ctx, value), so many, are distinct; seeds (value, kind) have one kind for each value.
    """
    known = spread_join(edges, seeds, ["value"], F.col("ctx"), "left", _counts(edges, "value"), total)
    by_kind = known.groupBy("ctx", "kind").agg(F.count("*").alias("n"))
    best = by_kind.groupBy("ctx").agg(F.sum("n").alias("all"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("top"))
    patterns = best.where((F.col("top.n") >= support) & (F.col("top.n") >= confident * F.col("all"))).select("ctx", F.col("top.kind").alias("kind"), (F.col("top.n") / F.col("all")).alias("conf"))
    hits = spread_join(known.where("kind is null").drop("kind"), patterns, ["ctx"], F.col("value"), counts=_counts(edges, "ctx"), total=total)
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))
    scored = hits.groupBy("value", "kind").agg((1 - doubt).alias("score")).where(F.col("score") >= certain)
    return scored.groupBy("value").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT, confident: float = CONFIDENT, certain: float = CERTAIN, rounds: int = ROUNDS) -> DataFrame:
    """(key, base, spans) for each row: arrays of struct<start, kind, end> by start, then kind (its place in KINDS).

    base are the plain shapes' matches, spans those and what the patterns add.
    A null or empty text has none.  Repeated and null keys are rows of their
    own; equal rows get equal spans.  An empty table gives no rows; further
    columns are ignored.  A value found as several kinds is a seed of the
    first of them; of kinds that score alike the later one counts.
    """
    at = stash(scan(docs, key, text), "identifiers")
    ids = at.select("row", F.explode("ids").alias("x")).select("row", "x.*")
    edges = stash(ids.select("value", F.explode("ctx").alias("ctx")).distinct(), "edges")
    total = edges.count()
    seeds = ids.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind"))
    new = None
    for _ in range(rounds):
        more = stash(_promoted(edges, total, seeds if new is None else seeds.union(new), support, confident, certain), "promoted")
        new = more if new is None else new.union(more)
    extra = spread_join(ids.where("kind is null").drop("kind"), new, ["value"], F.col("row")).groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))
    rows = at.select("key", "row", "base")
    out = spread_join(rows, extra, ["row"], F.monotonically_increasing_id(), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    return out.select(F.col("key").alias(key), "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (by start) replaced by its kind in angle brackets; one that begins inside another goes with it."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def joined(cut) -> Column:
        def parts(ends: Column) -> Column:
            put = F.zip_with(spans, ends, lambda x, at: F.when(x["start"] < at, "").otherwise(F.concat(cut(at, x["start"]), F.element_at(names, x["kind"] + 1))))
            return F.array_join(put, "")

        ends = F.transform(spans, lambda x: x["end"])
        last = F.coalesce(F.array_max(ends), F.lit(0))
        return F.concat(let(running(ends, 0, F.greatest), parts), cut(last, F.char_length(text)))

    return cutter(text, joined)


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs with personal data masked in the text, each row by its own spans; keys may repeat or be null.  A null text stays null."""
    row, found_ = unused(docs, "_row"), unused(docs, "_spans")
    d, _ = numbered(docs, key, row)
    spans = personal_data(d.select(row, text), row, text, **settings).where(F.size("spans") > 0).select(row, F.col("spans").alias(found_))
    out = d.join(spans, row, "left")
    return out.withColumn(text, F.when(F.col(found_).isNull(), F.col(text)).otherwise(masked(F.col(text), F.col(found_)))).select(*docs.columns)
