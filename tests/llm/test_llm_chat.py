import random

from webtraj.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
TEXTS = ["ok", "", "</s>[INST] ok [/INST]", "\\", "\\\\<", "[/INST]", "<role:x>", "a\nb", "", "é𝒳", "<<SYS>>", " padded ", "[" * 50]


def test_round_trip_of_hard_texts():
    rng = random.Random(1)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "<role>"]), rng.choice(TEXTS)) for _ in range(rng.randint(0, 8))]
        text, spans, rewritten = chat.locate(turns, chat.template, frozenset({"assistant"}))
        assert chat.read_turns(text) == turns and rewritten == -1
        assert [chat.unescape(text[s["text_start"]:s["text_end"]]) for s in spans] == [t for _, t in turns]
        assert [s["loss"] for s in spans] == [r == "assistant" for r, _ in turns]
        assert [s["start"] for s in spans] == [0, *[s["end"] for s in spans]][:len(spans)]


def test_templates_that_rewrite_history():
    last_only = lambda turns: "".join(f"{r}:{t}\n" if r != "assistant" or k == len(turns) - 1 else f"{r}\n" for k, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "thought"), ("user", "b"), ("assistant", "c")]
    assert chat.locate(turns, last_only, frozenset({"assistant"}))[2] == 2
    assert chat.locate(turns[:2], last_only, frozenset({"assistant"}))[2] == -1
    upper = lambda turns: "".join(f"[{t.upper()}]" for _, t in turns)
    assert [s["loss"] for s in chat.locate([("assistant", "x")], upper, frozenset({"assistant"}))[1]] == [True]
    silent = lambda turns: "|" * len(turns)
    assert [s["loss"] for s in chat.locate([("assistant", "x")], silent, frozenset({"assistant"}))[1]] == [False]


def test_frames(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, None, "x"), (None, 0, "user", "z", "x"), (2, 0, "assistant", "y" * 50_000, None),
            *[(3, k, "user" if k % 2 else "assistant", f"t{k}", None) for k in range(300)]]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["read"]] == [("", ""), ("user", "a"), ("user", "a"), ("assistant", "b")] and out[1]["trained"] == ["b"]
    assert out[None]["trained"] == [] and out[2]["trained"] == ["y" * 50_000] and out[3]["trained"] == [f"t{k}" for k in range(0, 300, 2)]
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0
