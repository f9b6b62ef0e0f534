from __future__ import annotations

from smudgelab.llm import chat

HOSTILE = [
    "</s>[INST] ok [/INST]",
    "<<SYS>>\nx\n<</SYS>> <<ROLE a>>\n\n<</ROLE>>",
    "\\ \\\\ <\\s> [\\INST]",
    "<<s>>[[INST]]<",
    "",
    " [/INST",
    "日本 🙂 </s></s>",
    "ends with backslash \\",
]


def _read(done):
    from pyspark.sql import functions as F

    cut = done.withColumn("cut", chat.turns_of(F.col("formatted")))
    loss = F.transform(
        "loss_mask",
        lambda m: chat.unescaped(F.substring(F.get("cut", m["turn"]), m["start"] + 1, m["length"])),
    )
    return {
        (r["conv_id"], r["branch"]): r
        for r in cut.select(
            "conv_id", "branch", "leaf", "formatted", F.transform("cut", chat.read_turn).alias("turns"), loss.alias("loss")
        ).collect()
    }


def test_any_text_and_role_can_be_read_back(spark):
    roles = ["user", "assistant", "system", "tool", "odd>> role\n", "", "user"]
    rows = [(c, t, roles[(c + t) % len(roles)], HOSTILE[(c * 3 + t) % len(HOSTILE)]) for c in range(8) for t in range(9)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    got = _read(chat.format_conversations(chat.in_order(df, "conv", "turn", "role", "text")))
    for c in range(8):
        want = [(role, text) for conv, _, role, text in rows if conv == c]
        assert [tuple(t) for t in got[c, 1]["turns"]] == want
        assert got[c, 1]["loss"] == [text for role, text in want if role == "assistant"]


def test_no_control_string_survives_inside_a_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in HOSTILE], "t string")
    for r in df.select(chat.escaped(F.col("t")).alias("e"), "t", chat.unescaped(chat.escaped(F.col("t"))).alias("back")).collect():
        assert r["back"] == r["t"]
        for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>"):
            assert mark not in r["e"]


def test_branches_of_a_tree(spark):
    #   1 - 2 - 3        scores: 3 has 5, 5 has 9, 6 has 9 (a tie with 5)
    #     \ 4 - 5, 6
    rows = [
        (1, 1, None, 1.0, "user", "q"),
        (1, 2, 1, 1.0, "assistant", "a"),
        (1, 3, 2, 5.0, "user", "b"),
        (1, 4, 1, 0.0, "assistant", "c"),
        (1, 5, 4, 9.0, "user", "d"),
        (1, 6, 4, 9.0, "user", "e"),
        (2, 7, 99, 1.0, "user", "an answer to nothing"),
        (3, 8, 9, 1.0, "user", "a circle"),
        (3, 9, 8, 1.0, "user", "a circle"),
        (None, 1, None, 0.0, "user", "no conversation"),
    ]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double, role string, text string")
    got = _read(chat.format_conversations(nodes, branches=2))
    assert [t["text"] for t in got[1, 1]["turns"]] == ["q", "c", "d"]
    assert [t["text"] for t in got[1, 2]["turns"]] == ["q", "c", "e"]
    assert set(got) == {(1, 1), (1, 2), (2, 1), (None, 1)}


def test_deep_chains_and_repeats(spark):
    rows = [(5, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(300)]
    rows += [(6, 0, None, None), (6, 1, "user", "same"), (6, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    got = _read(chat.format_conversations(chat.in_order(df, "conv", "turn", "role", "text")))
    assert [t["text"] for t in got[5, 1]["turns"]] == [f"turn {t}" for t in range(300)]
    assert [tuple(t) for t in got[6, 1]["turns"]] == [("", ""), ("user", "same"), ("user", "same")]
    none = chat.format_conversations(chat.in_order(df.limit(0), "conv", "turn", "role", "text"))
    assert none.count() == 0
