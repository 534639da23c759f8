"""Text functions as columns: normalising, extraction, stylometry, lexicons, spans, sentences, n-grams."""

from __future__ import annotations

import html
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions.spans import let, running, total

#: The word lists and marks that the measures are defined by.
FUNCTION_WORDS = (
    "the a an and or but if while of to in on at for with as that this these those "
    "is are was were be been being have has had do does did not no nor so than then"
).split()
LLM_TELLS = [
    "as an ai", "as a language model", "i cannot", "i can't provide", "it's important to note", "it is important to note", "in conclusion", "delve into", "tapestry",
    "furthermore", "moreover", "additionally", "let's explore", "navigating the", "in today's fast-paced",
]
INJECTION_TELLS = [
    "ignore previous instructions", "ignore prior instructions", "ignore all previous", "disregard the above", "system prompt", "you are now", "developer mode", "dan mode",
    "jailbreak", "reveal your instructions", "print your system", "bypass", "without any restrictions", "no ethical", "do anything now", "pretend you are", "roleplay as",
    "output the raw", "base64 decode", "act as an unfiltered", "execute payload", "[a2a_discovery_spoof]", "[mcp_token_hijack]", "a2a discovery spoof", "mcp token hijack",
    "cross-instance relay", "relay prompt injection", "agent card discovery", "defederation bypass", "forge agent card", "mcp tool-poisoning", "distributed relay injection",
]
IMPERATIVES = ["ignore", "disregard", "forget", "pretend", "act", "output", "print", "reveal"]
URL, EMAIL, MENTION, NUMBER = " HTTPURL ", " EMAILADDR ", " @USER ", " NUMTOKEN "
ZERO_WIDTH = "[​-‏‪-‮⁠-⁤­﻿]"
FOLD_FROM, FOLD_TO = "‘’‚‛“”„‟′″–—―−   ", "''''\"\"\"\"'\"----   "
URL_RE, EMAIL_RE = r"(?i)(?:https?://|www\.)\S+", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
MENTION_RE, HASHTAG_RE = r"(?<![\p{L}\p{N}_])@[A-Za-z0-9_]{2,30}", r"(?<![\p{L}\p{N}_])#([A-Za-z0-9_]{1,60})"


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", html.unescape(x)), na_action="ignore")


def normalise(text: Column, lower: bool = False, numbers: bool = False, hashes: bool = False, most: int | None = 8000) -> Column:
    """The canonical form of a text; null gives "".  Entities and compatibility forms need Python, which gets those texts that may have any and nulls for the others."""
    t = F.coalesce(text, F.lit(""))
    t = F.coalesce(_unescaped(F.when(t.rlike(r"&|[^\x00-\x7f]"), t)), t)
    t = F.translate(F.regexp_replace(t, ZERO_WIDTH, ""), FOLD_FROM, FOLD_TO)
    t = F.regexp_replace(t, "…", "...")
    # texts without the signs that a match must have are not searched for one
    t = let(t, lambda x: F.when(F.contains(x, F.lit("://")) | F.contains(F.lower(x), F.lit("www.")), F.regexp_replace(x, URL_RE, URL)).otherwise(x))
    t = let(t, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(F.regexp_replace(x, EMAIL_RE, EMAIL), MENTION_RE, MENTION)).otherwise(x))
    if numbers:
        t = F.regexp_replace(t, r"\b\d[\d,._]{3,}\b", NUMBER)
    if hashes:
        t = F.regexp_replace(t, HASHTAG_RE, "$1")
    t = F.regexp_replace(t, r"(.)\1{3,}", "$1$1$1")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.lower(t) if lower else t
    return F.substring(t, 1, most) if most else t


def hashtags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(HASHTAG_RE), F.lit(1)), F.lower)


def mentions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(MENTION_RE), F.lit(0)), lambda x: F.lower(F.substring(x, 2, 40)))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL_RE), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tells(text: Column, lexicon: list[str]) -> Column:
    """Phrases of a lexicon that a text has, in the lexicon's order."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: _present(low, lexicon))


def _present(low: Column, lexicon: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, lexicon)), lambda p: F.contains(low, p))


def lexical_score(text: Column, lexicon: list[str] | None = None) -> Column:
    """1 - exp(-0.9 * different phrases present)."""
    return 1 - F.exp(-0.9 * F.size(tells(text, INJECTION_TELLS if lexicon is None else lexicon)))


def _starts(sizes: Column) -> Column:
    """The sum of the sizes before each, in time linear in them."""
    return running(sizes, 0, total)


def match_spans(text: Column, lexicon: list[str] | None = None) -> Column:
    """array<struct<start, end, phrase>>: all non-overlapping places of each phrase, by start, then end; code points, end exclusive.

    A text is cut at a phrase and the lengths of what is between are added up.
    """

    def one(low: Column, p: Column) -> Column:
        def places(gaps: Column) -> Column:
            size, sizes = F.char_length(p), F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.char_length)
            before = _starts(F.transform(sizes, lambda n: n + size))
            return F.zip_with(before, sizes, lambda at, n: F.struct((at + n).alias("start"), (at + n + size).alias("end"), p.alias("phrase")))

        return let(F.split(low, F.concat(F.lit("\\Q"), p, F.lit("\\E")), -1), places)

    lexicon = INJECTION_TELLS if lexicon is None else lexicon
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_sort(F.flatten(F.transform(_present(low, lexicon), lambda p: one(low, p)))))


def sentence_spans(text: Column) -> Column:
    """array<struct<start, end, sentence>>: runs up to . ! ? or a line's end, trimmed."""

    def spans(pieces: Column) -> Column:
        def span(p: Column, at: Column) -> Column:
            start = at + F.char_length(p) - F.char_length(F.ltrim(p))
            return F.struct(start.alias("start"), (start + F.char_length(F.trim(p))).alias("end"), F.trim(p).alias("sentence"))

        every = F.zip_with(pieces, _starts(F.transform(pieces, F.char_length)), span)
        return F.filter(every, lambda s: (s["sentence"] != "") & (s["sentence"] != "\n"))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]*[.!?]+|[^.!?\n]+|\n"), F.lit(0)), spans)


def payload_alerts(text: Column, lexicon: list[str] | None = None) -> Column:
    """Sentences with a phrase: span, text, the phrases, a severity that grows with them."""
    lexicon = INJECTION_TELLS if lexicon is None else lexicon
    said = F.transform(sentence_spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["sentence"].alias("sentence"), tells(s["sentence"], lexicon).alias("phrases")))
    hit = F.filter(said, lambda s: F.size(s["phrases"]) > 0)
    return F.transform(hit, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["sentence"].alias("sentence"), s["phrases"].alias("phrases"), (1 - F.exp(-0.9 * F.size(s["phrases"]))).alias("severity")))


def posts_of(text: Column) -> Column:
    """A thread's posts: parts between blank lines, or lines if there is one part."""
    clean = lambda a: F.filter(F.transform(a, F.trim), lambda x: x != "")
    parts = clean(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"))
    return F.when(F.size(parts) > 1, parts).otherwise(clean(F.split(F.coalesce(text, F.lit("")), "\n")))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the lower-cased, space-collapsed text; a shorter text is its only one."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    every = F.lit(f"(?s)(?=(.{{{n}}})).")  # a step a character, each looking at the n that begin there
    grams = lambda x: F.when(x == "", F.array().cast("array<string>")).when(F.char_length(x) < n, F.array(x)).otherwise(F.array_distinct(F.regexp_extract_all(x, every, F.lit(1))))
    # as a lambda's argument the text is made once
    return F.transform(F.array(t), grams)[0]


def cotext(text: Column, least: int = 25) -> Column:
    """The key under which accounts share a text: lower case, links and signs to spaces; null if short."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = lambda x: F.trim(F.regexp_replace(F.when(F.contains(x, F.lit("://")), F.regexp_replace(x, r"https?://\S+", " ")).otherwise(x), r"[^a-z0-9_]+", " "))
    # as lambdas' arguments both are made once
    return F.transform(F.transform(F.array(low), plain), lambda t: F.when(F.char_length(t) >= least, t))[0]


def stylometry(text: Column) -> Column:
    """A struct of the 22 measures of a text, all doubles; all 0 for a text without words.

    Words, sentences and the lower case are found once, as arguments of a
    lambda; take the struct as a column first and its fields from that.
    """
    t = F.coalesce(text, F.lit(""))
    sents = F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s", " ")) != "")
    # one pass leaves the characters of the classes that are counted; most texts have few of them
    marked = F.regexp_replace(t, r"[^\p{Lu}\p{Nd}\p{So}]+", "")
    have = F.struct(t.alias("t"), F.lower(t).alias("low"), words(t).alias("w"), F.transform(words(t), F.lower).alias("lw"), F.transform(sents, lambda s: F.size(words(s)).cast("double")).alias("slen"), marked.alias("marked"))
    return let(have, _measures)


def _measures(x: Column) -> Column:
    t, low, w, lw, slen, marked = x["t"], x["low"], x["w"], x["lw"], x["slen"], x["marked"]
    n, k, m = F.size(w), F.char_length(t).cast("double"), F.greatest(F.size(slen), F.lit(1))
    lens = F.transform(w, lambda v: F.char_length(v).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def std(a, c):
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

        def step(s, v):  # running mean and sum of squared deviations
            n, d = s["n"] + 1, v - s["m"]
            m = s["m"] + d / n
            return F.struct(n.alias("n"), m.alias("m"), (s["q"] + d * (v - m)).alias("q"))

        return F.sqrt(F.aggregate(a, zero, step)["q"] / c)

    share = lambda pattern: (F.char_length(marked) - F.char_length(F.regexp_replace(marked, pattern, ""))) / k
    signs = lambda those: F.char_length(t) - F.char_length(F.translate(t, those, ""))
    count = lambda lex: F.size(F.filter(F.array(*map(F.lit, lex)), lambda p: F.contains(low, p)))
    found = lambda p, sign: F.when(sign, F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))).otherwise(0)
    out = {
        "n_chars": k, "n_words": n, "mean_word_len": total(lens) / n, "std_word_len": std(lens, n), "n_sentences": F.size(slen), "mean_sentence_len": n / m,
        "sentence_len_cv": F.when(F.size(slen) > 0, std(slen, m) / F.greatest(total(slen) / m, F.lit(1e-6))).otherwise(0.0),
        "type_token_ratio": F.size(F.array_distinct(lw)) / n, "function_word_ratio": F.size(F.filter(lw, lambda v: v.isin(FUNCTION_WORDS))) / n,
        "punct_ratio": signs(".,;:!?-'\"()") / k, "uppercase_ratio": share(r"\p{Lu}"), "digit_ratio": share(r"\p{Nd}"), "emoji_ratio": share(r"\p{So}"),
        "exclaim_count": signs("!"), "question_count": signs("?"), "n_hashtags": found(HASHTAG_RE, F.contains(t, F.lit("#"))), "n_mentions": found(MENTION_RE, F.contains(t, F.lit("@"))),
        "n_urls": found(URL_RE, F.contains(low, F.lit("://")) | F.contains(low, F.lit("www."))),
        "has_newline": F.contains(t, F.lit("\n")).cast("int"), "llm_tell_count": count(LLM_TELLS), "injection_tell_count": count(INJECTION_TELLS),
        "imperative_start": F.coalesce(F.try_element_at(lw, F.lit(1)).isin(IMPERATIVES), F.lit(False)).cast("int"),
    }
    return F.struct(*(F.when(n > 0, c.cast("double")).otherwise(F.lit(0.0)).alias(name) for name, c in out.items()))


def binary_label(value: Column, extra: list[str] | None = None) -> Column:
    """A label cell as 0, 1 or null: known tokens, then numbers, then parts of words; the order counts."""
    t = F.lower(F.trim(value.cast("string")))
    bots = ["bot", "bots", "spambot", "fake", "machine", "ai", "1", "true", "yes", *(e.lower() for e in extra or [])]
    people = ["human", "genuine", "real", "benign", "0", "false", "no"]
    out = F.when(t.isin(bots), 1).when(t.isin(people), 0).when(t.rlike("^[0-9]+$"), (F.regexp_replace(t, "^0+", "") != "").cast("int"))
    for part, v in (("spambot", 1), ("fake", 1), ("bot", 1), ("harmful", 1), ("machine", 1), ("genuine", 0), ("human", 0), ("benign", 0)):
        out = out.when(F.contains(t, F.lit(part)), v)
    return out


def clean_id(value: Column) -> Column:
    t = F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
    return F.when(t.isin("", "0", "nan", "None", "NULL", "<NA>"), None).otherwise(t)


def domain_of(handle: Column, domain: Column | None = None) -> Column:
    """The given domain, else what follows the last @ of a handle with two parts, else x.com; lower case."""
    parts = F.filter(F.split(handle, "@"), lambda x: x != "")
    own = F.when(F.size(parts) >= 2, F.element_at(parts, -1))
    return F.lower(F.coalesce(domain, own, F.lit("x.com")) if domain is not None else F.coalesce(own, F.lit("x.com")))


def handle_of(value: Column) -> Column:
    """An account handle: without @ and what is before the last slash."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(F.trim(value), "/+$", ""), "/"), -1), "^@+", "")


def canonical_name(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]", "")


def hour_entropy_of(counts: Column) -> Column:
    """Entropy of an array of 24 counts, in units of its largest value."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0)) / math.log2(24)
