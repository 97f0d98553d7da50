"""Chat windows: exact round trip, budgets, masks."""

import collections
import hashlib
import random

import pytest

from quietwave.llm import chat
from quietwave.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, extra string"


@pytest.mark.parametrize("seed", range(4))
def test_escape_round_trip(seed):
    rng = random.Random(seed)
    parts = [*chat.CONTROLS, "\\", "<", "|", ">", "[", "/", "s>", "INST]", "a", "\n", chat.OPEN, chat.CLOSE]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROLS)
        assert chat.TURN.findall(chat.render(text, text) * 2) == [(shown, shown)] * 2


def digests(rows):
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in rows:
        turns.update(f"{role}\n{text}\n".encode())
        loss.update(text.encode() if role == "assistant" else b"")
    return len(rows), turns.hexdigest(), sum(len(t) for r, t in rows if r == "assistant"), loss.hexdigest()


def test_query_reads_back_every_turn(spark):
    want = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want[r["conv_id"]].append((r["role"], r["text"] or ""))
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in QUERIES["op5_chat_formatting"](spark, SF).collect()}
    assert got == {k: digests(v) for k, v in want.items()}


def test_windows_keep_budget_system_and_targets(spark):
    rng = random.Random(9)
    turns = [(1, 0, "system", "be <|kind|>", "x")]
    turns += [(1, i, "user" if i % 2 else "assistant", " ".join("word" for _ in range(rng.randint(1, 60))) + f" {i}", "x") for i in range(1, 60)]
    turns += [(2, 0, "assistant", "long " * 900, "x"), (2, 1, "user", None, None), (2, 1, "user", None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(turns, TURNS)
    windows = chat.format_windows(frame, tokenizer_path("byte_bpe_50k.json"), budget=200, history=60)
    rows = sorted(windows.where("conv_id = 1").collect(), key=lambda r: r["window"])
    assert len(rows) > 5 and [r["window"] for r in rows] == list(range(len(rows)))
    for r in rows:
        shown = chat.TURN.findall(r["formatted"])
        assert not r["over_budget"] and r["n_tokens"] <= 200 and shown[0][0] == "system" and len(shown) == r["n_turns"]
    assert any(r["n_repeated"] > 1 for r in rows)
    learned = [chat.unescape(r["formatted"][s["start"]:s["end"]]) for r in rows for s in r["loss"]]
    assert learned == [t[3] for t in turns if t[0] == 1 and t[2] == "assistant"]
    assert windows.where("conv_id = 2 AND over_budget").count() == 1
    back = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert back[2] == digests([("assistant", "long " * 900), ("user", ""), ("user", "")]) and back[None] == digests([("", "")])
    assert chat.read_back(chat.format_windows(frame.where("false"), tokenizer_path("byte_bpe_50k.json"))).count() == 0
