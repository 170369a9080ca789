import random

from lakewarden.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns string, plain int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (
            r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None,
            r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role, text or ""))
    return out


def test_conversations_come_back(spark):
    chosen = random.Random(3)
    bits = ["###", "### ", "#", " ", "\\", "\\b", "\\l", "\\h\\h\\h ", "</turn>", "</turn>\n",
            "### Assistant: ", ": ", "\n", "<", "é🙂", "User", "@", "a" * 50]
    roles = ["user", "assistant", "system", "Assistant", "@x", "a: b", "", None, "### u", "null"]
    rows = [(conv, turn, roles[0] if conv % 2 else chosen.choice(roles),
             chosen.choice([None, "", *["".join(chosen.choice(bits) for _ in range(
                 chosen.randrange(9)))] * 4]))
            for conv in range(60) for turn in range(chosen.randrange(1, 7))]
    rows += [(None, 1, "user", "no id"), (70, None, "user", "x"), (70, 1, "user", "y"),
             (71, 1, "user", "same"), (71, 1, "user", "same"), (72, 1, "assistant", "w " * 20_000)]
    formatted = chat.formatted(make(spark, rows))
    want = expected(rows)
    for r in formatted.collect():
        assert r["round_trip"]
        spans = [r["formatted"][s["begin"] - 1:s["begin"] - 1 + s["length"]]
                 for s in r["loss_spans"]]
        texts = [t for role, t in want[r["conv_id"]] if role == "assistant"]
        assert len(spans) == len(texts)
        if not r["escaped"]:
            assert spans == texts
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in back.items()} == want
    for conv, turns in want.items():
        assert back[conv]["loss_text"] == "".join(t for role, t in turns if role == "assistant")


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 1, "user", "plain \\ text # <b>"), (2, 1, "user", "a </turn> b")]
    found = {r["conv_id"]: r for r in chat.formatted(make(spark, rows)).collect()}
    assert found[1]["formatted"] == "### User: plain \\ text # <b></turn>\n"
    assert not found[1]["escaped"] and found[2]["escaped"]
    assert found[2]["formatted"].count("</turn>") == 1


def test_broken_text_is_not_taken_for_a_turn(spark):
    texts = ["### User: a</turn>", "### User a</turn>\n", "### User: a</turn> b</turn>\n", ""]
    df = spark.createDataFrame([(t,) for t in texts], "formatted string")
    found = [r[0] for r in df.select(chat.parsed(df["formatted"])).collect()]
    assert found == [[None], [None], [None], []]


def test_runs_without_python_and_on_no_rows(spark, plan_text):
    plan = plan_text(chat.read_back(chat.formatted(make(spark, []))))
    assert "EvalPython" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert chat.formatted(make(spark, [])).collect() == []
