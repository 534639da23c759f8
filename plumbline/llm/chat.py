"""Heterogeneous chat layouts to canonical turns and one training format, in DataFrame functions alone.

The nested field paths of a record are hashed to a fingerprint, and that
selects a declarative mapping: where the turns are, what role and text are
called, which roles mean user and assistant.  Typed tables are fingerprinted
by their schema, JSON records one by one.  Turns are written as

    <|im_start|>role\\ntext<|im_end|>\\n

and control strings inside role and text are broken by a backslash behind
their first character; backslashes double and a role's line breaks become
``\\n``, so reading back gives the very same turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from plumbline.llm._spans import cutter, let, running, total

#: Fixed values of the format.
BEGIN, STOP = "<|im_start|>", "<|im_end|>"
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Names that sources use for the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How one kind of record becomes turns: a list of messages, or fields that are a turn each."""

    name: str
    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None  # list, role, text
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, fields joined by a blank line
    rows: tuple[str, str, str] | None = None  # of a table with a row for each turn: order, role, text
    renamed: bool = True  # whether roles get their canonical names


LAYOUTS = [
    Layout("rows by turn", ("role", "text", "turn"), rows=("turn", "role", "text"), renamed=False),
    Layout("messages", ("messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout("messages of text", ("messages[].role", "messages[].text"), ("messages", "role", "text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt and completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt and response", ("prompt", "response", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
]
KNOWN = sorted({p for lay in LAYOUTS for p in lay.paths})


def fingerprint(paths) -> str:
    """The hash of those paths that any layout knows; others don't count."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


def schema_paths(kind: Ty.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type."""
    if isinstance(kind, Ty.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, Ty.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def record_paths(v: Column) -> Column:
    """Nested field paths of a variant, as far as a layout may know them: top fields, and fields of the objects in their lists."""

    def there(top: Column) -> Column:
        has = {p: F.map_contains_key(top, F.lit(p)) for p in KNOWN if "[]." not in p}
        has |= {p: F.exists(F.try_variant_get(F.try_element_at(top, F.lit(p.split("[].")[0])), "$", "array<map<string,variant>>"), (lambda name: lambda m: F.map_contains_key(m, F.lit(name)))(p.split("[].")[1])) for p in KNOWN if "[]." in p}
        return F.array_compact(F.array(*(F.when(has[p], F.lit(p)) for p in KNOWN)))

    return let(F.try_variant_get(v, "$", "map<string,variant>"), there)


def role_name(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(role)), role, F.lit(""))


def _turn(role: Column, text: Column, renamed: bool = True) -> Column:
    return F.struct((role_name(role) if renamed else F.coalesce(role, F.lit(""))).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(lay: Layout, get) -> Column:
    """The turns of a record; get(path, type) reads a field."""
    if lay.messages:
        many, role, text = lay.messages
        return F.transform(F.coalesce(get(many, f"array<struct<`{role}`:string,`{text}`:string>>"), F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")), lambda m: _turn(m[role], m[text], lay.renamed))
    turns = []
    for role, fields in lay.fields:
        parts = [F.when(get(f, "string") != "", get(f, "string")) for f in fields]
        turns.append(_turn(F.lit(role), F.concat_ws("\n\n", *parts) if len(parts) > 1 else get(fields[0], "string")))
    return F.array(*turns)


def json_turns(payload: Column) -> Column:
    """Canonical turns of a JSON record; null if it isn't JSON, is over the size of a variant, or has an unknown layout."""

    def mapped(x: Column) -> Column:
        v, out = x["v"], F.lit(None).cast(TURNS)
        for lay in LAYOUTS:
            if not lay.rows:
                out = F.when(x["print"] == fingerprint(lay.paths), _mapped(lay, lambda f, t: F.try_variant_get(v, f"$.{f}", t))).otherwise(out)
        return out

    prints = lambda v: F.sha2(F.array_join(F.array_sort(record_paths(v)), "\n"), 256)
    return let(F.try_parse_json(payload), lambda v: let(F.struct(v.alias("v"), prints(v).alias("print")), mapped))


def table_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a typed table whose schema's fingerprint is known.

    A table with a row for each turn is grouped by key, null keys together, in
    order of turn, then role, then text; a conversation is one value of the
    result, so all its turns meet in one row.  Other columns are ignored.
    """
    paths = schema_paths(df.schema)
    for lay in LAYOUTS:
        if fingerprint(paths) == fingerprint(lay.paths):
            if lay.rows:
                order, role, text = lay.rows
                row = F.struct(F.col(order).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
                rows = df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("r"))
                return rows.select(key, F.transform("r", lambda x: _turn(x["role"], x["text"], lay.renamed)).alias("turns"))
            return df.select(key, _mapped(lay, lambda f, t: F.col(f).cast(t) if t == "string" else F.transform(F.col(f), lambda m: F.struct(*(m[n].cast("string").alias(n) for n in lay.messages[1:])))).alias("turns"))
    raise ValueError(f"no layout for the fields {paths}")


def escaped(x: Column, role: bool = False) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        x = F.replace(x, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return F.replace(x, F.lit("\n"), F.lit("\\n")) if role else x


def unescaped(x: Column, role: bool = False) -> Column:
    def part(p: Column) -> Column:
        p = F.replace(p, F.lit("\\n"), F.lit("\n")) if role else p
        return F.replace(p, F.lit("\\"), F.lit(""))

    return F.array_join(F.transform(F.split(x, r"\\\\", -1), part), "\\")


def formatted(turns: Column) -> Column:
    """struct<formatted, loss>: the training text, and the array<struct<start, end>> of code points in it that are assistant text."""
    tail = len(STOP) + 1
    every = F.transform(turns, lambda t: F.struct(F.concat(F.lit(BEGIN), escaped(t["role"], True), F.lit("\n")).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))

    def written(parts: Column) -> Column:
        at = running(F.transform(parts, lambda p: F.char_length(p["head"]) + F.char_length(p["text"]) + tail), 0, total)

        def span(p: Column, start: Column) -> Column:
            begin = start + F.char_length(p["head"])
            return F.struct(p["loss"].alias("loss"), begin.alias("start"), (begin + F.char_length(p["text"])).alias("end"))

        spans = F.transform(F.filter(F.zip_with(parts, at, span), lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["text"], F.lit(STOP + "\n"))), "")
        return F.struct(text.alias("formatted"), spans.alias("loss"))

    return let(every, written)


def read_back(text: Column) -> Column:
    """The turns of a training text."""
    blocks = F.split(text, r"<\|im_end\|>\n", -1)
    body = F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.substr(b, F.lit(len(BEGIN) + 1), F.char_length(b)))

    def turn(b: Column) -> Column:
        k = F.instr(b, "\n")
        return F.struct(unescaped(F.substr(b, F.lit(1), k - 1), True).alias("role"), unescaped(F.substr(b, k + 1, F.char_length(b))).alias("text"))

    return F.transform(body, turn)


def loss_text(text: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return cutter(text, lambda cut: F.array_join(F.transform(loss, lambda s: unescaped(cut(s["start"], s["end"]))), ""))


def format_chats(df: DataFrame, key: str = "conv_id", payload: str | None = None) -> DataFrame:
    """(key, formatted, loss) for each conversation of a typed table, or for each row's JSON record in the column payload.

    A null text or role is empty; a null or unknown record has formatted null;
    no turns give the empty text.  An empty table gives no rows.
    """
    turns = table_turns(df, key) if payload is None else df.select(key, json_turns(F.col(payload)).alias("turns"))
    return turns.select(key, F.when(F.col("turns").isNotNull(), formatted(F.col("turns"))).alias("x")).select(key, "x.formatted", "x.loss")
