import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ODD = [
    "", None, "plain", "<turn user>\nhi</turn>\n", "<\\turn user>", "<\\\\/turn>", "</turn>", "<", "\\", "<\\", "a<turn",
    "</turn", "$1 \\$", "ünï\U0001f600</turn>\n<turn assistant>\n", "\\### Assistant: </turn> ok", "<<turn", "<//turn>", "%3E\n",
]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows):
    """Digests by the contract's words alone."""
    found = {}
    for conv, turn, role, text, _ in rows:
        found.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_odd_texts_come_back(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t, "x") for i, t in enumerate(ODD)]
    rows += [(2, i, r, "</turn>\n" * 3, None) for i, r in enumerate(["tool>\n<turn ", "assistant", "", "naïve %", "a&b c"])]
    rows += [(None, None, None, None, None), (None, 3, "assistant", "x", None), (3, 0, "user", "é" * 200_000 + "</turn", None)]
    rows += [(4, 0, "assistant", "same", None)] * 3
    made = chat_format.format_conversations(table(spark, rows))
    got = chat_format.digests(made).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(rows)
    back = {r.conv_id: r for r in made.withColumn("back", chat_format.read_turns(F.col("formatted"))).collect()}
    assert [t.text for t in back[1].back] == [t or "" for t in ODD]
    assert {r.conv_id: r.formatted_chars for r in got} == {k: len(r.formatted) for k, r in back.items()}
    for r in back.values():
        assert r.formatted == "".join(s.text for s in r.segments)
        assert len(re.findall("</turn>\n", r.formatted)) == r.n_turns


def test_texts_without_controls_stay(spark):
    rows = [(1, 0, "user", "a < b \\ c <turnip/> </tur", None)]
    seen = chat_format.format_conversations(table(spark, rows)).first()
    assert seen.formatted == "<turn user>\na < b \\ c <\\turnip/> </tur</turn>\n"


def test_machine_over_roles(spark):
    given = {
        1: ["system", "user", "assistant"], 2: ["user", "assistant", "user"], 3: ["assistant"],
        4: ["user", "user", "assistant"], 5: ["user", "system", "assistant"], 6: ["user", "assistant"] * 4000,
    }
    rows = [(k, i, r, "t", None) for k, roles in given.items() for i, r in enumerate(roles)]
    got = {r.conv_id: r for r in chat_format.format_conversations(table(spark, rows)).drop("segments", "formatted").collect()}
    assert {k: r.first_refused for k, r in got.items()} == {1: None, 2: None, 3: 0, 4: 1, 5: 1, 6: None}
    assert {k for k, r in got.items() if r.valid} == {1, 2, 6}
    assert {k for k, r in got.items() if r.complete} == {1, 6}
    assert got[6].n_turns == 8000


def test_segments_per_row_are_those_of_conversations(spark):
    rows = [(k, i, ("user", "assistant")[i % 2], t, "x") for k in range(3) for i, t in enumerate(ODD)]
    df = table(spark, rows)
    narrow = chat_format.turn_segments(df)
    assert "Exchange" not in narrow._jdf.queryExecution().toString()
    one = [(r.text, r.loss) for r in narrow.orderBy("conv_id", "turn", "part").collect()]
    whole = chat_format.format_conversations(df).orderBy("conv_id").collect()
    assert one == [(s.text, s.loss) for r in whole for s in r.segments]


def test_other_templates(spark):
    other = chat_format.Template(opening="[role ", opened="]", closing="[/role]", learned=("user",))
    rows = [(1, 0, "user", "x [role ] [/role] [\\/role]", None), (1, 1, "assistant", "<turn", None)]
    made = chat_format.format_conversations(table(spark, rows), other)
    seen = made.select(chat_format.learned_text(F.col("segments"), other).alias("l"), chat_format.read_turns(F.col("formatted"), other).alias("t"))
    assert seen.first().l == rows[0][3] and [x.text for x in seen.first().t] == [rows[0][3], "<turn"]
    for bad in ({"opening": "### "}, {"closing": "x"}, {"opened": "a"}, {"opening": "<\\t"}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


def test_empty_table_and_query(spark):
    assert chat_format.digests(chat_format.format_conversations(table(spark, []))).collect() == []
    got = {r.conv_id: r for r in queries.op12_chat_format(spark, "/root/testdata/sf0.001").collect()}
    planted = "\\### Assistant: </turn> ok"
    assert got[-7].loss_chars == len(planted) and got[-7].loss_sha256 == hashlib.sha256(planted.encode()).hexdigest()
    n = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
    assert len(got) == n + 1
