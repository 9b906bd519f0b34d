"""Chat formatting in budgeted windows, with loss masks.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose the spans:
a span reaches to the last turn whose prefix sum is within the budget from the span's start, so
only a single turn that is longer than the budget exceeds it, and every turn is a target once.
A window starts with the system turn and repeats a few turns before its span as history; neither
counts for the loss again. Texts are escaped so that no control string of the template can appear
in them, and a formatted window can be read back exactly.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.token_counts import token_counter

# The template's control strings. A turn is BEGIN role BODY text END.
BEGIN, BODY, CLOSE, END = "<s>[INST]", "[/INST]", "</s>", "\n"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPE = "\\"


@dataclass(frozen=True)
class ChatRules:
    """Tokens a window's span may have, history turns repeated, and tokens history may have.

    Turns are dealt out in blocks of `block` turn numbers, so a conversation of any length is
    worked on by many tasks. A window never crosses a block.
    """

    budget: int = 1024
    history_turns: int = 2
    history_tokens: int = 256
    block: int = 256


def escape(text: str) -> str:
    """A text in which no control string occurs: a backslash after its first character, and backslashes doubled."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROL:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    parts = text.split(ESCAPE * 2)
    return ESCAPE.join(p.replace(ESCAPE, "") for p in parts)


def format_turns(turns: list[tuple[str, str]], targets: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask): the bodies of assistant turns that are targets."""
    out, spans, at = [], [], 0
    for (role, text), target in zip(turns, targets, strict=True):
        head, body = f"{BEGIN}{escape(role)}{BODY}", escape(text)
        out.append(f"{head}{body}{CLOSE}{END}")
        if target and role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(out[-1])
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted window, unescaped."""
    turns = []
    for part in formatted.split(f"{CLOSE}{END}{BEGIN}") if formatted else []:
        role, _, body = part.removeprefix(BEGIN).removesuffix(f"{CLOSE}{END}").partition(BODY)
        turns.append((unescape(role), unescape(body)))
    return turns


WINDOW = "block bigint, window int, formatted string, repeated int, loss array<struct<start:int,end:int>>"


def _name_kind(kind: str) -> str:
    """The type that conversations are named by."""
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"


def _windows_of(turns: list[dict], system: tuple[str, str, int] | None, rules: ChatRules) -> Iterator[dict]:
    """The windows of a block's turns, in order; the first ones may be carried from the block before.

    A turn has role, text, tokens, own (whether it is this block's) and lead (the conversation's
    system turn, which later windows repeat).
    """
    first = next((i for i, t in enumerate(turns) if t["own"]), len(turns))
    room = max(1, rules.budget - (system[2] if system else 0))
    upto = list(accumulate((t["tokens"] for t in turns), initial=0))
    spans, at = [], first
    while at < len(turns):
        end = max(at + 1, bisect_right(upto, upto[at] + room) - 1)
        spans.append(range(at, end))
        at = end
    for number, span in enumerate(spans):
        history, tokens, at = [], 0, span[0]
        while at > 0 and len(history) < rules.history_turns and not turns[at - 1]["lead"]:
            tokens += turns[at - 1]["tokens"]
            if tokens > rules.history_tokens:
                break
            at -= 1
            history.insert(0, (turns[at]["role"], turns[at]["text"]))
        lead = [system[:2]] if system and not any(turns[i]["lead"] for i in span) else []
        own = [(turns[i]["role"], turns[i]["text"]) for i in span]
        formatted, loss = format_turns([*lead, *history, *own], [False] * (len(lead) + len(history)) + [True] * len(own))
        yield {"window": number, "formatted": formatted, "repeated": len(lead) + len(history), "loss": loss}


def chat_windows(
    conversations: DataFrame, path: str, rules: ChatRules = ChatRules(), conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv, block, window, formatted, repeated, loss): the windows of every conversation.

    Turns come in the order of their numbers; rows that share a number, repeated rows too, are
    turns of their own, in the order of role and text. NULL text or role is empty, a NULL number
    comes first, a NULL conversation is one conversation. The system turn is the first turn if its
    role is `system`. `repeated` counts the turns at a window's start that are no targets of it:
    the system turn, except in the window where it stands itself, and up to `history_turns` turns
    that precede the span. `loss` has the spans of assistant texts, in code points.

    A span holds as many turns as the budget (less the system turn) has room for, or one that is
    longer; history comes on top. No turn is cut or left out. Conversations are named by whole
    numbers or anything else, which becomes text. Other columns are ignored, whatever their names.
    """

    def counted(batches):
        counter = token_counter(path)
        for batch in batches:
            n = counter.count(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], names=[*batch.schema.names, "tokens"])

    kind = _name_kind(conversations.schema[conv].dataType.simpleString())
    rows = conversations.select(
        F.col(conv).cast(kind).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.mapInArrow(counted, f"conv {kind}, turn bigint, role string, text string, tokens int")
    block = F.floor(F.col("turn") / F.lit(rules.block))
    rows = rows.withColumn("block", F.coalesce(block, F.lit(-(2**40))))
    # The first turn of each conversation, found before the shuffle; only system turns are kept.
    first = rows.groupBy("conv").agg(F.min(F.struct(F.coalesce("turn", F.lit(-(2**60))).alias("turn"), "role", "text", "tokens")).alias("first"))
    system = first.filter(F.col("first.role") == "system").select("conv", F.col("first").alias("system"))
    own = rows.withColumn("own", F.lit(True))
    # The last turns of a block go along to the next one as history.
    carried = own.filter(F.pmod("turn", F.lit(rules.block)) >= rules.block - rules.history_turns)
    carried = carried.withColumns({"block": F.col("block") + 1, "own": F.lit(False)})
    turns = own.union(carried)

    def built(key: tuple, group: list[dict]) -> list[tuple]:
        if not any(t["own"] for t in group):
            return []
        head, taken = group[0]["system"], False
        for t in group:
            t["lead"] = bool(head) and not taken and t["role"] == "system" and t["text"] == head["text"] and t["turn"] in (None, head["turn"])
            taken |= t["lead"]
        system = (head["role"], head["text"], head["tokens"]) if head else None
        return [(*key, w["window"], w["formatted"], w["repeated"], w["loss"]) for w in _windows_of(group, system, rules)]

    def build(batches):
        key, group = None, []
        for batch in batches:
            made = []
            for t in batch.to_pylist():
                if (t["conv"], t["block"]) != key:
                    made += built(key, group) if group else []
                    key, group = (t["conv"], t["block"]), []
                group.append(t)
            yield _window_batch(made, kind)
        if group:
            yield _window_batch(built(key, group), kind)

    # A block has at most `block` turn numbers, so a group is small; a conversation's blocks meet its
    # system turn by a join that Spark splits where one conversation is large.
    joined = turns.join(system.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of")), "left").drop("of")
    ordered = joined.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "role", "text")
    return ordered.mapInArrow(build, f"conv {kind}, {WINDOW}")


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind == "bigint" else pa.string()


def _window_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [_arrow(kind), pa.int64(), pa.int32(), pa.string(), pa.int32(), span]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    columns[5] = [[{"start": a, "end": b} for a, b in loss] for loss in columns[5]]
    names = ["conv", "block", "window", "formatted", "repeated", "loss"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted windows.

    Each window is read, its repeated turns are left out and the text under its mask is unescaped.
    A digest runs over a conversation from first to last, so its windows (not its turns) meet in
    order in one partition and pass through the running digests one at a time.
    """

    kind = windows.schema["conv"].dataType.simpleString()

    def run(batches):
        state, done = None, []

        def closed(s):
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"])

        for batch in batches:
            for conv, formatted, repeated, loss in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or state["conv"] != conv:
                    if state:
                        done.append(closed(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                state["formatted"] += len(formatted)
                for r, t in read_turns(formatted)[repeated:]:
                    state["n"] += 1
                    state["turns"].update(f"{r}\n{t}\n".encode())
                for span in loss:
                    shown = unescape(formatted[span["start"] : span["end"]])
                    state["chars"] += len(shown)
                    state["loss"].update(shown.encode())
            if done:
                yield _digest_batch(done, kind)
                done = []
        if state:
            yield _digest_batch([closed(state)], kind)

    ordered = windows.repartition("conv").sortWithinPartitions("conv", "block", "window")
    return ordered.select("conv", "formatted", "repeated", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def _digest_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    kinds = [_arrow(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
