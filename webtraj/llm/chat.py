"""Chat formatting with a template that is only called, never read.

Growing prefixes of a conversation are rendered. If an output begins with the one before, the rest is the span of the
new turn; if not, the template rewrites history, and the first turn that did so is reported. A second call with a
probe in place of the new text shows what the template puts around it, so the text's own span is known, too. The spans
of the wanted roles are the loss mask.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, ship

PROBE = "\ue000"
TURN = "struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>"
TURN_ARROW = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())])
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_BODY = r"((?:[^\\<\[]|\\.)*)"
_READ = re.compile("|".join([*(re.escape(a) + _BODY + re.escape(b) for a, b in MARKS.values()), f"<role>{_BODY}<text>{_BODY}</role>"]), re.S)


def escape(text: str) -> str:
    """Control strings begin with ``<`` or ``[``; a backslash goes before each of them and before backslashes."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def template(turns: list[tuple[str, str]]) -> str:
    """The default template: turns of known roles between marks, others with their role's name."""
    out = []
    for role, text in turns:
        a, b = MARKS.get(role) or (f"<role>{escape(role)}<text>", "</role>")
        out.append(f"{a}{escape(text)}{b}")
    return "".join(out)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a conversation that the default template wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = list(MARKS)[m.lastindex - 1] if m.lastindex <= len(MARKS) else unescape(m.group(len(MARKS) + 1))
        out.append((role, unescape(m.group(m.lastindex))))
        at = m.end()
    return out


def locate(turns: list[tuple[str, str]], render: Callable, wanted: frozenset[str]) -> tuple[str, list[dict], int]:
    """Formatted text, spans of the turns, and the first turn at which history was rewritten (-1: never)."""
    before, spans, rewritten = render([]), [], -1
    for k, (role, _) in enumerate(turns):
        after = render(turns[:k + 1])
        start = len(before)
        if not after.startswith(before):
            rewritten = k if rewritten < 0 else rewritten
            start = next((i for i, (a, b) in enumerate(zip(before, after)) if a != b), min(len(before), len(after)))
        probe = render([*turns[:k], (role, PROBE)])
        at = probe.rfind(PROBE)
        head, tail = probe[:at], probe[at + 1:]
        known = at >= 0 and after.startswith(head) and after.endswith(tail) and len(after) >= len(head) + len(tail)
        low, high = (len(head), len(after) - len(tail)) if known else (start, len(after))
        spans.append({"role": role, "start": start, "end": len(after), "text_start": low, "text_end": high, "loss": known and role in wanted})
        before = after
    return before, spans, rewritten


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 render: Callable = template, wanted: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, formatted, turns, rewritten), one per conversation.

    ``turns`` holds the spans of each turn and of its text, in code points, and whether it is under the loss mask. Turns
    follow ``turn`` (nulls first; ties: role, then text); a null role or text is empty; repeated rows are turns of their
    own; rows of a null conversation are one conversation. An empty table gives no row; other columns are not read. A
    conversation is one value, so its rows meet in one task, and n turns cost n renderings of growing length.
    """
    bound_batches(rows.sparkSession)
    chosen = frozenset(wanted)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chats in batches:
            done = [locate([(t["role"], t["text"]) for t in c.as_py()], render, chosen) for c in chats]
            texts, spans, rewritten = zip(*done) if done else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(TURN_ARROW)), pa.array(rewritten, pa.int32())],
                                             names=["formatted", "turns", "rewritten"])

    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    shaped = F.arrow_udf(run, f"struct<formatted:string,turns:array<{TURN}>,rewritten:int>")
    # The explode keeps the optimizer from calling the function once for every field that is read later.
    return chats.select("conv_id", F.explode(F.array(shaped("rows"))).alias("f")).select("conv_id", "f.*")


def read_chats(formatted: DataFrame, column: str = "formatted", turns: str = "turns") -> DataFrame:
    """Add ``read`` (roles and texts parsed from the formatted text) and ``trained`` (texts under the loss mask)."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            read, trained = [], []
            for t, s in zip(texts, spans):
                t = t.as_py()
                read.append([{"role": r, "text": x} for r, x in read_turns(t)])
                trained.append([unescape(t[x["text_start"]:x["text_end"]]) for x in s.as_py() if x["loss"]])
            yield pa.StructArray.from_arrays([pa.array(read, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(trained, pa.list_(pa.string()))],
                                             names=["read", "trained"])

    udf = F.arrow_udf(run, "struct<read:array<struct<role:string,text:string>>,trained:array<string>>")
    return formatted.withColumn("__r", udf(F.col(f"`{column}`"), F.col(f"`{turns}`"))).withColumn("read", F.col("__r.read")).withColumn("trained", F.col("__r.trained")).drop("__r")


ship(__name__)
