import json
import random

from pyspark.sql import functions as F

from plumbline.llm import chat as C


def fmt(turns):
    def esc(x, role=False):
        x = x.replace("\\", "\\\\")
        for c in C.CONTROLS:
            x = x.replace(c, c[0] + "\\" + c[1:])
        return x.replace("\n", "\\n") if role else x

    return "".join(f"<|im_start|>{esc(r, True)}\n{esc(t)}<|im_end|>\n" for r, t in turns)


def test_round_trip(spark):
    r = random.Random(1)
    bits = [*C.CONTROLS, "\\", "\\n", "\n", "n", "<", "[", "|", "é日", "im_end|>", " ", "</", "INST]", "s>"]
    some = lambda: "".join(r.choices(bits, k=r.randint(0, 8)))
    rows = [(k // 4, k % 4, r.choice(["user", "assistant", "system", some()]), some(), 0) for k in range(800)]
    rows += [(902, 0, "human", "h", 0), (902, 1, "gpt", "g", 0), (-1, 0, "user", "</s>[INST] ok [/INST]", 0), (-1, 1, "assistant", "</s>[INST] ok [/INST]", 0), (900, 0, None, None, 0), (None, 1, "assistant", "b", 0), (None, 1, "assistant", "a", 0), (901, 0, "assistant", "long " * 40_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = C.format_chats(df).select("conv_id", "formatted", C.read_back(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    want = {}
    for c, t, role, text, _ in rows:
        role = role or ""
        want.setdefault(c, []).append((t, role, text or ""))
    assert len(got) == len(want)
    for x in got:
        turns = [(a, b) for _, a, b in sorted(want[x.conv_id])]
        assert [tuple(t) for t in x.turns] == turns
        assert x.loss == "".join(b for a, b in turns if a == "assistant")
        assert x.formatted == fmt(turns)
        assert sum(x.formatted.count(c) for c in C.CONTROLS) == 2 * len(turns)
    assert C.format_chats(df.limit(0)).collect() == []


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "x"}], "id": 3}, [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "system", "text": None}, {"role": "user", "text": "é\n\"q"}]}, [("system", ""), ("user", "é\n\"q")]),
        ({"conversations": [{"from": "human", "value": "1"}, {"from": "gpt", "value": "2"}]}, [("user", "1"), ("assistant", "2")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o", "extra": {"a": [1]}}, [("user", "i\n\nn"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"question": "p", "answer": 42}, [("user", "p"), ("assistant", "42")]),
        ({"unknown": 1}, None),
    ]
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(records)] + [(100, None), (101, "no json {"), (102, "[1]"), (103, '{"messages": []}')]
    got = {x.conv_id: x for x in C.format_chats(spark.createDataFrame(rows, "conv_id long, body string"), payload="body").collect()}
    assert len(got) == len(rows)
    for k, (_, turns) in enumerate(records):
        assert got[k].formatted == (None if turns is None else fmt(turns)), k
    assert [got[k].formatted for k in (100, 101, 102)] == [None] * 3


def test_typed_tables(spark):
    df = spark.createDataFrame([(1, [("human", "q", 1.0), ("gpt", None, 2.0)], "z")], "conv_id long, conversations array<struct<from:string,value:string,w:double>>, formatted string")
    assert C.format_chats(df).first().formatted == fmt([("user", "q"), ("assistant", "")])
    df = spark.createDataFrame([(1, "p", "r"), (2, None, "r")], "conv_id long, prompt string, response string")
    assert [x.formatted for x in C.format_chats(df).orderBy("conv_id").collect()] == [fmt([("user", "p"), ("assistant", "r")]), fmt([("user", ""), ("assistant", "r")])]


def test_very_many_turns(spark):
    n = 6000
    rows = [(1, k, ["user", "assistant"][k % 2], f"é {k} \\ </s>") for k in range(n)]
    x = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("formatted", C.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).first()
    assert x.formatted == fmt([(r, t) for _, _, r, t in rows]) and x.loss == "".join(t for _, _, r, t in rows if r == "assistant")


def test_the_query_over_mixed_layouts(spark, tmp_path):
    from plumbline.llm import queries as Q

    rows = [(c, k, ["user", "assistant", "system"][k % 3], f"t{c} {k}" if k else None) for c in range(40) for k in range(c % 5 + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    mixed = sorted(map(tuple, Q.chat_layouts(spark, str(tmp_path)).collect()))
    assert mixed == sorted(tuple(r) for r in Q.op10_chat_format(spark, str(tmp_path)).collect() if r.conv_id >= 0) and len(mixed) == 40
