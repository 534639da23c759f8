"""Corpus shapes to the fixed text schema; each is a projection over what readers give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import binary_label, normalise
from plumbline.store import stash

KEEP = ["text", "label", "threat_class", "generator", "domain", "group_id", "source_dataset", "era"]


def finalise(df: DataFrame, dataset: str, era: str = "unknown") -> DataFrame:
    """Rows of three words or more with a label, under the text schema; uid is the dataset and a hash of content and group."""
    have = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
    # rows of an array, so that a text is made once, not again for the condition
    whole = F.filter(F.array(normalise(F.col("text"), most=None)), lambda t: F.size(F.split(t, " ")) >= 3)
    out = df.where(F.col("label").isNotNull()).withColumn("text", F.explode(whole))
    out = out.select(
        "text", F.col("label").cast("byte").alias("label"), have("threat_class", None).cast("string").alias("threat_class"), have("generator", "unknown").alias("generator"),
        have("domain", None).cast("string").alias("domain"), F.coalesce(have("group_id", None).cast("string"), F.md5("text")).alias("group_id"), F.lit(dataset).alias("source_dataset"), F.lit(era).alias("era"),
    )
    threat = F.coalesce("threat_class", F.when(F.col("label") == 1, "machine_generated").otherwise("human_benign"))
    return out.withColumn("threat_class", threat).select(F.concat(F.lit(f"{dataset}:"), F.md5(F.concat_ws("\x1f", "group_id", "generator", "text"))).alias("uid"), *KEEP)


def flat(df: DataFrame, text: str, label: str, dataset: str, generator: str | None = None) -> DataFrame:
    """A text and a label cell of any spelling."""
    d = df.select(F.col(text).alias("text"), binary_label(F.col(label)).alias("label"), *([F.col(generator).alias("generator")] if generator else []))
    return finalise(d, dataset)


def paired_answers(df: DataFrame, dataset: str, question: str = "question", human: str = "human_answers", machine: str = "chatgpt_answers") -> DataFrame:
    """Lists of human and machine answers to a question, which stays their group."""
    part = lambda c, y, g: df.select(F.explode(c).alias("text"), F.lit(y).alias("label"), F.lit(g).alias("generator"), F.col(question).alias("group_id"))
    return finalise(part(human, 0, "human").union(part(machine, 1, "chatgpt")), dataset)


def paired_columns(df: DataFrame, dataset: str, human: str, machine: dict[str, str], group: str) -> DataFrame:
    """A human text and machine texts in columns (column: generator), one group a row."""
    cols = {human: "human"} | machine
    rows = F.array(*(F.struct(F.col(c).alias("text"), F.lit(int(c != human)).alias("label"), F.lit(g).alias("generator")) for c, g in cols.items()))
    return finalise(df.select(F.col(group).cast("string").alias("group_id"), F.explode(rows).alias("x")).select("group_id", "x.*").where("text is not null"), dataset)


def prompts(df: DataFrame, dataset: str, kind: Column, columns: tuple[str, ...] = ("vanilla", "adversarial")) -> DataFrame:
    """Prompt columns, one row each, harmful where the row's kind says so."""
    there = [c for c in columns if c in df.columns]
    d = df.withColumn("label", F.contains(F.lower(kind), F.lit("harmful")).cast("int"))
    rows = d.select("label", F.explode(F.array(*(F.struct(F.lit(c).alias("form"), F.col(c).alias("text")) for c in there))).alias("x")).select("label", "x.*").where("trim(text) <> ''")
    threat = F.when(F.col("label") == 0, "human_benign").when(F.col("form") == "adversarial", "jailbreak").otherwise("harmful_completion")
    return finalise(rows.withColumn("threat_class", threat), dataset)


#: Names of text generators as they occur in file names, in the order they are looked for; fixed values.
GENERATORS = "chatgpt gpt4 gpt-4 gpt3 davinci cohere dolly bloomz llama mistral flant5 gpt2 claude gemini qwen".split()


def generator_of(name: Column) -> Column:
    """The generator that a file's name says, the first of the known names; unknown_llm if none."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("unknown_llm")
    for g in reversed(GENERATORS):
        out = F.when(F.contains(low, F.lit(g)), g).otherwise(out)
    return out


def harm_flags(df: DataFrame, dataset: str, prompt: str = "prompt", harm: str = "prompt_harm_label", adversarial: str = "adversarial", domain: str | None = None) -> DataFrame:
    """Prompts flagged harmful or adversarial: either makes label 1; an adversarial one is an injection, whatever it asks for."""
    flag = lambda c, tokens: F.coalesce(binary_label(F.col(c), tokens), F.lit(0)) if c in df.columns else F.lit(0)
    d = df.select(F.col(prompt).alias("text"), flag(harm, ["harmful"]).alias("h"), flag(adversarial, ["true", "yes"]).alias("a"), (F.col(domain) if domain else F.lit("safety")).alias("domain"))
    label = F.greatest("h", "a")
    threat = F.when(F.col("a") > 0, "prompt_injection").when(F.col("h") > 0, "harmful_completion").otherwise("human_benign")
    return finalise(d.select("text", label.alias("label"), threat.alias("threat_class"), F.when(label > 0, "adversarial_human_or_llm").otherwise("human").alias("generator"), "domain"), dataset)


def build_text_corpus(parts: dict[str, DataFrame], threshold: float = 0.9, near: bool = True) -> DataFrame:
    """All corpora under one another, each text once over all of them, near copies too, with new uids: copies across corpora would leak between splits."""
    from functools import reduce

    from plumbline.operators.dedup import exact_dedupe, near_dedupe

    if not parts:
        raise ValueError("no corpora")
    order = F.struct("_o", "uid")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select("uid", *KEEP).withColumn("_o", F.lit(i)) for i, df in enumerate(parts.values())])
    every = exact_dedupe(every.withColumn("_k", F.concat_ws(":", F.lpad(F.col("_o").cast("string"), 6, "0"), "uid")), "_k", "text")
    if near:
        every = stash(every, "texts")  # read several times
        every = near_dedupe(every, "_k", "text", threshold)
    return every.select(F.concat(F.lit("corpus:"), F.md5(F.to_json(order))).alias("uid"), *KEEP)


def drop_heavy(df: DataFrame, columns: list[str] = ("raw", "html", "embedding")) -> DataFrame:
    """df without columns that no later step reads."""
    return df.drop(*columns)


def resolve_first(sources: list[tuple[str, callable]], least: int = 1) -> tuple[str, DataFrame]:
    """(name, rows) of the first source that can be read and has so many rows; the last one's error if none has."""
    problem: Exception | None = None
    for name, read in sources:
        try:
            df = read()
            if df.limit(least).count() >= least:
                return name, df
            problem = ValueError(f"{name}: under {least} rows")
        except Exception as e:  # the next source is tried, and this problem raised if none serves
            problem = e
    raise problem or ValueError("no sources")


def first_writer_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of parts in order of precedence, one row a key."""
    from functools import reduce

    from plumbline.operators.relational import keep_first

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_o", F.lit(i)) for i, p in enumerate(parts)])
    return keep_first(every, [key], ["_o"]).drop("_o")


PARSERS = {"flat": flat, "paired_answers": paired_answers, "paired_columns": paired_columns, "prompts": prompts, "harm_flags": harm_flags}
