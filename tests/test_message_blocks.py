"""Blocks of stored messages and tokens of listings, in shapes that the tables do not hold."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from marginalia.operators.message_blocks import fence, inline_code, message_markdown
from marginalia.sources.site_payloads import continuation_tokens


def rendered(spark, *messages):
    rows = [(i, m if isinstance(m, str) or m is None else json.dumps(m)) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "i int, m string")
    return [r.x for r in df.select("i", message_markdown(F.col("m")).alias("x")).orderBy("i").collect()]


def test_what_is_no_message_gives_nothing(spark):
    assert rendered(spark, None, "", "{", "[]", "5", {"content": 7}, {"content": []}, {"content": [None, 3, "x", {}, {"type": "new"}], "text": "unused"}) == [""] * 8


def test_blocks_with_fields_of_other_kinds(spark):
    got = rendered(
        spark,
        {"content": [{"type": "text", "text": 12}, {"type": "text", "text": {"a": 1}}]},
        {"content": [{"type": "tool_use", "input": {"query": 5, "command": "ls ```` x"}}]},
        {"content": [{"type": "tool_result", "content": [{"type": "text", "text": '{"stdout": "", "stderr": "bad\n"}'.replace("\n", "\\n")}, {"type": "text", "text": '{"stdout": 5}'}]}]},
        {"content": [{"type": "tool_result", "content": "plain"}, {"type": "thinking", "thinking": "  "}, {"type": "thinking", "thinking": "so"}], "files": [{"file_uuid": "u1"}, {}], "attachments": [{}]},
        {"content": [{"type": "text", "text": "x" * 300_000}]},
    )
    assert got[0] == '12\n\n{"a":1}' and got[1] == "**Tool**\n\n`````\nls ```` x\n`````"
    assert got[2] == '**Result**\n\n_stderr_\n\n```\nbad\n```\n\n```\n{"stdout": 5}\n```'
    assert got[3] == "<details>\n<summary>Thinking</summary>\n\nso\n\n</details>\n\n- attached: u1\n- attached: file\n- attached: attachment"
    assert got[4] == "x" * 300_000


def test_marks_outgrow_what_they_hold(spark):
    df = spark.createDataFrame([("a",), ("`a``b",), ("```\n`````",), ("",)], "t string")
    got = df.select(fence(F.col("t"), "x").alias("f"), inline_code(F.col("t")).alias("i")).collect()
    assert [r.f.split("x")[0] for r in got] == ["```", "```", "``````", "```"]
    assert [r.i for r in got][:2] == ["`a`", "``` `a``b ```"]


def test_tokens_stand_in_depth_first_order(spark):
    item = lambda t: {"continuationItemRenderer": {"continuationEndpoint": {"continuationCommand": {"token": t}}}}
    section = lambda items: {"itemSectionRenderer": {"sectionIdentifier": "comment-item-section", "contents": items}}
    deep = item("deep")
    for _ in range(200):
        deep = {"k": [deep]}
    rows = [
        {"z": [deep], "a": item("shallow")}, {"a": section([{"x": item("inner")}, None, 4]), "b": section([item("s")])}, {"a": section(5), "b": section({"c": 1})},
        [item(""), item(7)], "[" * 100_000, None, {"itemSectionRenderer": [1], "continuationItemRenderer": "x"},
    ]
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows)], "i int, p string")
    got = df.select("i", continuation_tokens(F.col("p")).alias("t")).orderBy("i").collect()
    assert [(r.t.section, r.t.following) for r in got] == [(None, "deep"), ("s", "inner"), (None, None), (None, "7"), (None, None), (None, None), (None, None)]
