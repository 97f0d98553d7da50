"""Chat formatting in budgeted windows.

A conversation's turns are rendered with a template and cut, by prefix sums of their token counts, into
windows of whole turns within a token budget. Every window starts with the conversation's system turn
and repeats a limited history of the turns before it; the loss mask marks assistant texts, each in the
one window that holds it as a new turn, so repeated targets are masked. Conversations stream through a
task in sorted order with running sums; only the current window and the history are held, so a
conversation of any length fits.

Defined results: null text or role is the empty text; turns with equal numbers stand in order of role,
then text, and repeated rows count as turns; a null conversation or turn number is a value of its own,
first in order; a turn longer than the budget stands whole in a window of its own, marked; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed control strings: the template's own and those of common chat templates.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
# a backslash, or the first sign of a control string; overlapping ones are found by looking ahead
SPECIAL = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def escape(text: str) -> str:
    """Puts a backslash behind the first sign of each control string and before each backslash."""
    return SPECIAL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{BODY}{escape(text)}{CLOSE}"


WINDOWS = "conv_id {id}, window long, n_turns long, n_repeated long, n_tokens long, over_budget boolean, formatted string, loss array<struct<start:int,end:int>>"


def format_windows(turns: DataFrame, tokenizer: str, budget: int = 2048, history: int = 512, conv: str = "conv_id",
                   turn: str = "turn", role: str = "role", text: str = "text", system: str = "system", target: str = "assistant") -> DataFrame:
    """Windows of formatted turns: (conv_id, window, n_turns, n_repeated, n_tokens, over_budget, formatted, loss).

    `n_repeated` turns at the start are the system turn and history; `loss` has code point spans.
    """
    clean = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer)
        own.encode_special_tokens = True
        for batch in batches:
            shown = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            sizes = [len(own.encode(s, add_special_tokens=False).ids) for s in shown]
            yield batch.append_column("tokens", pa.array(sizes, pa.int64()))

    kind = clean.schema["conv_id"].dataType.simpleString()
    sized = clean.mapInArrow(count, f"conv_id {kind}, turn {clean.schema['turn'].dataType.simpleString()}, role string, text string, tokens long")
    ordered = sized.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "window", "n_turns", "n_repeated", "n_tokens", "over_budget", "formatted", "loss"]
        out: list[tuple] = []
        current, state = object(), None
        id_type = pa.int64()

        def close() -> None:
            """Emit the open window and turn its end into the next one's history."""
            if state is None or not state["new"]:
                return
            lead = ([state["system"]] if state["system"] else []) + state["past"]
            shown, spans, at = [], [], 0
            for i, (r, t, _) in enumerate(lead + state["new"]):
                body = escape(t)
                start = at + len(OPEN) + len(escape(r)) + len(BODY)
                if i >= len(lead) and r == target:
                    spans.append({"start": start, "end": start + len(body)})
                at = start + len(body) + len(CLOSE)
                shown.append(render(r, t))
            total = sum(x[2] for x in lead) + sum(x[2] for x in state["new"])
            out.append((current, state["window"], len(shown), len(lead), total, total > budget, "".join(shown), spans))
            # the first turn of all is the system turn and is not repeated twice
            tail = state["past"] + state["new"]
            if state["fresh_system"]:
                state["system"], state["fresh_system"] = tail[0], False
                tail = tail[1:]
            room, keep = history, []
            for x in reversed(tail):
                if x[2] > room:
                    break
                room -= x[2]
                keep.append(x)
            state.update(window=state["window"] + 1, past=keep[::-1], new=[], used=0)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            id_type = batch.column("conv_id").type
            for c, r, t, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "tokens")), strict=True):
                if state is None or c != current:
                    close()
                    current = c
                    state = {"window": 0, "system": None, "fresh_system": r == system, "past": [], "new": [], "used": 0}
                lead = (state["system"][2] if state["system"] else 0) + sum(x[2] for x in state["past"])
                if state["new"] and lead + state["used"] + n > budget:
                    close()
                if not state["new"]:
                    # history gives way, oldest turn first, when the new turn needs its room
                    own = state["system"][2] if state["system"] else 0
                    while state["past"] and own + sum(x[2] for x in state["past"]) + n > budget:
                        state["past"].pop(0)
                state["new"].append((r, t, n))
                state["used"] += n
                if len(out) >= 256:
                    yield flush()
        close()
        yield flush()

    return ordered.mapInArrow(windows, WINDOWS.format(id=kind))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from windows in order within each partition.

    The windows of `format_windows` are in that order; others are put in it by
    `repartition("conv_id").sortWithinPartitions("conv_id", "window")`.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, state, out, id_type = object(), None, [], pa.int64()

        def done() -> None:
            if state is not None:
                out.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            id_type = batch.column("conv_id").type
            for c, repeated, shown, spans in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "n_repeated", "formatted", "loss")), strict=True):
                if state is None or c != current:
                    done()
                    current, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for r, t in TURN.findall(shown)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{unescape(r)}\n{unescape(t)}\n".encode())
                for span in spans:
                    learned = unescape(shown[span["start"]:span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(shown)
        done()
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return windows.select("conv_id", "n_repeated", "formatted", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
