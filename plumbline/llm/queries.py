"""The registered queries of this subpackage, and their SQL for DuckDB where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.align import align
from plumbline.llm.chat import CONTROLS, format_chats, loss_text, read_back
from plumbline.llm.counts import count_tokens
from plumbline.llm.decontam import contaminated
from plumbline.llm.html import extract_pages
from plumbline.llm.jaccard import jaccard_join
from plumbline.llm.knn import NeighbourModel, fit, fold, knn_quality
from plumbline.llm.lm import language_model_scores
from plumbline.llm.packing import pack_documents
from plumbline.llm.pii import KINDS, personal_data, written
from plumbline.llm.rules import quality_rules
from plumbline.llm.sessions import sessionise
from plumbline.llm.tokens import read_tokens, write_tokens
from plumbline.store import place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A-Z to a-z, and the words of a text, in DuckDB.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by place, number and checksum, as read back from the bit-packed blocks that were written."""
    path = place(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), 2)
    return read_tokens(spark, path, ids=False)


@query
def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 0, 2048).drop("tokens")


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the component of links that it is in."""
    return jaccard_join(table(spark, sf_dir, "documents")).withColumn("n_shingles", F.col("n_shingles").cast("long"))


SQL["op3_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""


@query
def op7_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts of every document, the n-gram ratio, and the verdict."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def plain_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op7 that SQL can say: the operator's own, without its ratio and verdict."""
    return op7_ngram_ratio_rules(spark, sf_dir).drop("ratio", "kept")


#: The words of a text as they are, in DuckDB.
PLAIN = WORDS.format("coalesce(text, '')")
SQL["plain_rules_base"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {PLAIN} AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) >= 3),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


@query
def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: how many of each kind by the plain shapes, and all spans, those of the patterns too."""
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", (lambda k: lambda x: x["kind"] == k)(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op2 that SQL can say: what the plain shapes find."""
    return op2_bootstrapped_pii(spark, sf_dir).drop("spans")


_OCTET = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INT ELSE (2 * substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INT) % 10 + (2 * substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INT) // 10 END)) % 10 = 0"
#: Kind, shape as the contract writes it, what a match must be.
_BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(v, '{_OCTET}(\.{_OCTET}){{3}}')"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
]
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, s, v FROM (SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s, unnest(m) AS v "
    f"FROM (SELECT doc_id, regexp_extract_all(t, '{shape}') AS m, regexp_split_to_array(t, '{shape}') AS g FROM d)) WHERE {good}"
    for k, (kind, shape, good) in enumerate(_BASE)
)
SQL["personal_data_base"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in _BASE)}, sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + length(v)), ',' ORDER BY s, k), '')) AS base_sha256
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


def quality_model(docs: DataFrame, labels: DataFrame) -> NeighbourModel:
    """Learnt from labels whose key isn't held out."""
    return fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))


@query
def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and label by its labelled neighbours."""
    docs = table(spark, sf_dir, "documents")
    out = knn_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


@query
def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by the model and by add-one counts."""
    out = language_model_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def add_one_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op6 that SQL can say: the counts and the add-one score, to four places."""
    return op6_maxent_scores(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


#: crc32 of a key as text: a byte at a time, eight steps each.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
SQL["add_one_base"] = f"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, {WORDS.format(LOWER)} AS w FROM documents), t AS (SELECT doc_id, held_out, unnest(list_append(list_transform(w, lambda x: 'w' || x), 'end')) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1.0))), 4) AS base_score FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""


def chat_digests(chats: DataFrame) -> DataFrame:
    """What op10 returns of formatted chats (conv_id, formatted, loss), read back from them."""
    out = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, whose table's fingerprint names the layout by turn, and one of control strings alone."""
    own = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(["user", "assistant"])], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)))


@query
def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations as JSON records of three layouts, by conv_id: each record's own fingerprint must find its mapping."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    named = [("messages", "role", "content"), ("messages", "role", "text"), ("conversations", "from", "value")]
    records = [F.to_json(F.struct(F.transform("t", (lambda r, x: lambda m: F.struct(m["role"].alias(r), m["text"].alias(x)))(role, text)).alias(top))) for top, role, text in named]
    which = F.pmod(F.col("conv_id"), F.lit(len(records)))
    body = F.when(which == 0, records[0]).when(which == 1, records[1]).otherwise(records[2])
    return chat_digests(format_chats(c.select("conv_id", body.alias("body")), payload="body"))


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHATS = f"""
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(24 + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
TURNS = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"
SQL["op10_chat_format"] = f"""
WITH c AS ({TURNS}
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
{CHATS}"""
SQL["chat_layouts"] = f"WITH c AS ({TURNS}) {CHATS}"


@query
def op8_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page as a browser would lay it out."""
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op13_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session of every client's clicks, and why it ended."""
    return sessionise(table(spark, sf_dir, "clicks"), (F.col("value") >= 60) & (F.col("kind") == "error"))


# runs are what certain starts leave; within one, each session is found from the one before
SQL["op13_gap_sessions"] = """
WITH RECURSIVE d AS (SELECT click_id, min(client_id) AS client_id, epoch_us(min(ts)) AS t, epoch_us(min(arrived_at)) AS arrived, coalesce(min(kind) = 'error' AND min(value) >= 60, false) AS final, coalesce(floor(100 * min(value) + 0.5), 0)::BIGINT AS cents
  FROM clicks WHERE click_id IS NOT NULL AND ts IS NOT NULL AND client_id IS NOT NULL GROUP BY click_id),
c AS (SELECT *, lag(t) OVER w AS before, lag(final) OVER w AS ended, row_number() OVER w AS n FROM d WHERE coalesce(arrived - t <= 21600000000, true) WINDOW w AS (PARTITION BY client_id ORDER BY t, click_id)),
r AS (SELECT *, CASE WHEN before IS NULL THEN 'first' WHEN ended THEN 'end' WHEN t - before >= 600000000 THEN 'gap' END AS why FROM c),
k AS (SELECT *, count(why) OVER (PARTITION BY client_id ORDER BY n) AS run FROM r),
s AS (SELECT client_id, run, n, t FROM k WHERE why IS NOT NULL
  UNION ALL SELECT s.client_id, s.run, min(k.n), min(k.t) FROM s JOIN k ON k.client_id = s.client_id AND k.run = s.run AND k.t - s.t > 2400000000 GROUP BY s.client_id, s.run, s.n),
b AS (SELECT k.*, s.n IS NOT NULL AS begins FROM k LEFT JOIN s USING (client_id, n)),
g AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY client_id ORDER BY n) AS sid FROM b),
o AS (SELECT client_id, sid, arg_min(click_id, n) AS session_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_clicks, sum(cents)::BIGINT AS value_cents, arg_max(final, n) AS final, arg_min(coalesce(why, 'length'), n) AS why, sha256(string_agg(click_id::VARCHAR, ',' ORDER BY n)) AS path_sha256 FROM g GROUP BY client_id, sid),
p AS (SELECT *, lead(start_us) OVER w AS next, lead(why) OVER w AS closing FROM o WINDOW w AS (PARTITION BY client_id ORDER BY sid)),
l AS (SELECT p.client_id, p.sid, count(*) AS n_late FROM p JOIN d ON d.client_id = p.client_id AND d.arrived - d.t > 21600000000 AND d.t >= p.start_us AND (p.next IS NULL OR d.t < p.next) GROUP BY 1, 2)
SELECT client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents, coalesce(closing, CASE WHEN final THEN 'end' ELSE 'none' END) AS closed_by, path_sha256 FROM p LEFT JOIN l USING (client_id, sid)
"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, the groups that both cut, their links, and how common these are."""
    return align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, huge ones counted by overlapping chunks."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
