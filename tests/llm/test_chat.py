import hashlib
import random

from gridloom.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\/s>", "[\\/INST]", "<\\\\s>", "a", " ", "\n", "é", "<", "[", "]", ">", "/s>", "INST]"]


def rows():
    r = random.Random(7)
    out = [(c, t, r.choice(["user", "assistant", "system", "</s>"]), "".join(r.choices(PARTS, k=r.randint(0, 12)))) for c in range(60) for t in range(r.randint(1, 6))]
    return out + [(900, 0, None, None), (None, 1, "user", "x"), (None, None, "assistant", "y"), (901, 0, "user", "b"), (901, 0, "assistant", "a"), (901, 0, "assistant", "a")]


def test_every_conversation_comes_back(spark):
    table = rows()
    frame = spark.createDataFrame([(*x, "s", "t") for x in table], "conv_id long, turn long, role string, text string, formatted string, turns string")
    formatted = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    told = {r.conv_id: r for r in chat.digest(chat.format_conversations(frame)).collect()}
    for conv in {x[0] for x in table}:
        turns = sorted([x[1:] for x in table if x[0] == conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        want = [(role or "", text or "") for _, role, text in turns]
        assert [(t.role, t.text) for t in formatted[conv].turns] == want
        text = "".join(f"{a}\n{b}\n" for a, b in want)
        loss = "".join(b for a, b in want if a == "assistant")
        d = told[conv]
        assert d.n_turns == len(want) and d.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert d.loss_chars == len(loss) and d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert d.formatted_chars == len(formatted[conv].formatted)
        assert formatted[conv].formatted.count("</s>") == len(want)


def test_plain_texts_are_not_escaped_and_empty_tables_pass(spark):
    one = spark.createDataFrame([(1, 0, "user", "a \\ b < c")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(one).first().formatted == "<s>[INST]user[/INST]a \\ b < c</s>"
    assert chat.digest(chat.format_conversations(one.limit(0))).count() == 0


def test_no_python_runs_in_the_plan(spark):
    one = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_conversations(one))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
