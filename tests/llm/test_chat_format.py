"""Chat layouts to turns, reversible escapes, loss spans, and the query against SQL and plain Python."""

import hashlib
import json

import duckdb
from helixloom.llm import chat_format as C
from pyspark.sql import functions as F


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    r = c.execute(C.OP2_SQL)
    cols = [x[0] for x in r.description]
    got = C.op2_chat_format(spark, sf)
    assert got.columns == cols and sorted(map(tuple, got.collect())) == sorted(r.fetchall())


HARD = [("user", C.END + C.START + "assistant ok"), ("assistant", "<\\|<\\\\|a\\<|"), ("sys%tem\n<x", "\n\n" + C.END + "\n"), ("assistant", ""), ("", "\U0001f600é<|"), ("assistant", "tail\n")]


def test_round_trip_and_spans(spark):
    rows = [(7, k, r, t) for k, (r, t) in enumerate(HARD)] + [(None, 1, None, None), (8, None, "assistant", "b"), (8, None, "assistant", "a"), (8, 0, "user", "z"), (8, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).drop("turns")
    out = {r.conv_id: r for r in C.read_back(C.render(C.canonical_turns(df))).collect()}
    r = out[7]
    assert [(t.role, t.text) for t in r.turns] == HARD
    assert r.loss_text == "".join(t for role, t in HARD if role == "assistant")
    plain = lambda s: __import__("re").sub(r"<\\(\\*)\|", r"<\1|", s)
    assert [plain(r.formatted[s.start : s.start + s.length]) for s in r.loss_spans] == [t for role, t in HARD if role == "assistant"]
    assert r.formatted.count(C.START) == r.formatted.count(C.END) == len(HARD)
    assert [(t.role, t.text) for t in out[8].turns] == [("assistant", "a"), ("assistant", "b"), ("user", "z"), ("user", "z")]
    assert [(t.role, t.text) for t in out[None].turns] == [("", "")]
    d = C.digest(C.read_back(C.render(C.canonical_turns(df)))).where("conv_id = 7").first()
    assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in HARD).encode()).hexdigest() and d.formatted_chars == len(r.formatted)
    assert C.digest(C.read_back(C.render(C.canonical_turns(df.limit(0))))).count() == 0


RECORDS = [
    ({"prompt": "q", "response": "a"}, "prompt", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("user", "do\nx"), ("assistant", "y")]),
    ({"output": "y", "instruction": "do", "input": None}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
    ({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "u"), ("assistant", "g")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"unknown": 1}, None, None),
    ({"prompt": "q", "response": "a", "id": 3, "meta": {"x": [1]}}, "prompt", [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": None}], "score": 1.5}, "messages", [("user", "u"), ("assistant", "")]),
    ({"messages": "no list"}, None, None),
    ({"prompt": "q", "response": "a", "instruction": "both"}, None, None),
]


def test_json_records_of_mixed_layouts(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(90, "{broken"), (91, None)]
    got = {r.conv_id: r for r in C.turns_from_json(spark.createDataFrame(rows, "conv_id long, js string"), "js").collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert got[k].layout == layout and (None if got[k].turns is None else [(t.role, t.text) for t in got[k].turns]) == turns
    assert got[90].turns is None and got[91].layout is None


def test_tables_by_schema(spark):
    a = spark.createDataFrame([(1, "do", None, "y")], "conv_id long, instruction string, input string, output string")
    assert [(t.role, t.text) for t in C.canonical_turns(a).first().turns] == [("user", "do"), ("assistant", "y")]
    b = spark.sql("SELECT 1L conv_id, array(struct('human' AS `from`, 'u' AS value)) conversations")
    assert C.canonical_turns(b).first().turns[0].role == "user"
    assert C.canonical_turns(spark.sql("SELECT 1L conv_id, 2 other")).first().turns is None
    c = spark.createDataFrame([(1, "p", "r", 7)], "conv_id long, prompt string, response string, meta int")
    assert [(t.role, t.text) for t in C.canonical_turns(c).first().turns] == [("user", "p"), ("assistant", "r")]
    assert len({m.key for m in (*C.MAPPINGS, C.TURN_ROWS)}) == len(C.MAPPINGS) + 1


def test_long_conversation(spark):
    n = 5000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = C.read_back(C.render(C.canonical_turns(df))).first()
    assert [t.text for t in r.turns] == [f"t{k}" for k in range(n)] and r.loss_text == "".join(f"t{k}" for k in range(1, n, 2))
