import hashlib

from pyspark.sql import functions as F
from siltstone.llm import chat
from siltstone.llm.queries import op1_chat


def turned(df):
    return chat.formatted(chat.canonical(df))


def back(df):
    return df.select("*", chat.parsed(F.col("formatted")).alias("again"), chat.learned_texts(F.col("formatted"), F.col("loss")).alias("learned"))


def test_layouts_become_the_same_turns(spark):
    pairs = [("user", "hi"), ("assistant", "ho")]
    frames = {
        "messages": spark.createDataFrame([([("user", "hi"), ("assistant", "ho")],)], "messages array<struct<role:string,content:string>>"),
        "conversations": spark.createDataFrame([([("human", "hi"), ("gpt", "ho")],)], "conversations array<struct<from:string,value:string>>"),
        "instruction": spark.createDataFrame([("hi", None, "ho")], "instruction string, input string, output string"),
        "prompt_completion": spark.createDataFrame([("hi", "ho")], "prompt string, completion string"),
        "prompt_response": spark.createDataFrame([("hi", "ho")], "prompt string, response string"),
        "question_answer": spark.createDataFrame([("hi", "ho")], "question string, answer string"),
    }
    for name, df in frames.items():
        row = chat.canonical(df).first()
        assert (row["layout"], [tuple(t) for t in row["turns"]]) == (name, pairs)


def test_layouts_mix_in_one_table_and_unknown_ones_keep_their_row(spark):
    schema = "n int, prompt string, completion string, messages array<struct<role:string,content:string>>, metadata struct<prompt:string>, turns int"
    rows = [(0, "a", "b", None, None, 5), (1, None, None, [("user", "c"), ("assistant", None)], None, 5), (2, None, None, None, ("x",), 5), (3, None, None, [], None, None)]
    got = {r["n"]: r for r in back(turned(spark.createDataFrame(rows, schema))).collect()}
    assert [got[k]["layout"] for k in range(4)] == ["prompt_completion", "messages", None, None]
    assert [tuple(t) for t in got[1]["again"]] == [("user", "c"), ("assistant", "")]
    assert got[2]["formatted"] is None and got[3]["loss"] is None


def test_control_strings_come_back(spark):
    nasty = ["", "\\", "\\l<", "### a: b</turn>\n", "\\### Assistant: </turn> ok", "#</turn>\\b\\h", "é\U0001f600\n\n### user: x", "x" * 50_000]
    turns = [(r, t) for t in nasty for r in ("user", "assistant", "a: b\n#<\\c")]
    df = spark.createDataFrame([([*turns],)], "messages array<struct<role:string,content:string>>")
    row = back(turned(df)).first()
    assert [tuple(t) for t in row["again"]] == turns
    assert row["learned"] == nasty
    for span, text in zip(row["loss"], nasty, strict=True):
        assert chat.OPEN not in row["formatted"][span["start"] : span["end"]]
        assert len(row["formatted"][span["start"] : span["end"]]) >= len(text)


def test_many_turns_and_very_long_texts(spark):
    """Offsets of every turn, for conversations of any number of turns; texts of megabytes."""
    for n in (0, 1, 2, 3, 8, 9, 10, 99, 3000):
        turns = [("assistant" if k % 2 else "user", f"turn {k} <" + "é" * (k % 7)) for k in range(n)]
        row = back(turned(spark.createDataFrame([(turns,)], "messages array<struct<role:string,content:string>>"))).first()
        if n:
            assert [tuple(t) for t in row["again"]] == turns and row["learned"] == [t for r, t in turns if r == "assistant"]
    long = "word <é " * 500_000
    row = back(turned(spark.createDataFrame([([("user", long), ("assistant", long), ("assistant", "end")],)], "messages array<struct<role:string,content:string>>"))).first()
    assert row["learned"] == [long, "end"] and row["again"][0]["text"] == long


def test_query_against_plain_python(spark, folder):
    rows = [(1, 1, "assistant", "ho"), (1, 0, "user", None), (2, 0, None, ""), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, 3, "assistant", "n"), (3, 7, "user", "###"), (4, 0, "human", "h"), (4, 1, "gpt", "g")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    got = {r["conv_id"]: r for r in op1_chat(spark, folder(conversations=df)).collect()}
    rows += [(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, None, -7}
    for conv, row in got.items():
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), sha(learned))
        assert row["formatted_chars"] > 0


def test_empty_table(spark, folder):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in op1_chat(spark, folder(conversations=empty)).collect()] == [-7]
