"""Chat formatting: a template is a black box that renders a list of turns to one string.

Rendering successive turn prefixes and comparing consecutive outputs locates each turn's span without any
knowledge of the template. If a longer prefix changes what was rendered before, the template rewrites history
and the conversation is reported as such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
OPEN, BETWEEN, CLOSE = "<turn ", ">\n", "\n</turn>\n"
_PROBE = "\ue000probe\ue001"


def escape(text: str) -> str:
    """Control strings all hold < or >, which no escaped text does."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def template(turns: list[Turn]) -> str:
    return "".join(f"{OPEN}{escape(role)}{BETWEEN}{escape(text)}{CLOSE}" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a string that `template` made."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        mid = formatted.index(BETWEEN, at)
        end = formatted.index(CLOSE, mid + len(BETWEEN))
        out.append((unescape(formatted[at + len(OPEN) : mid]), unescape(formatted[mid + len(BETWEEN) : end])))
        at = end + len(CLOSE)
    return out


def locate(turns: list[Turn], render: Callable[[list[Turn]], str] = template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The rendering of all turns; for each turn its begin, its text's begin and end, and its end; whether each
    longer prefix only adds to the shorter one. The text's place in a turn is found with a probe text that its role doesn't hold."""
    before, spans = render([]), []
    for k in range(len(turns)):
        mark = _PROBE
        while mark in turns[k][0]:
            mark = _PROBE[0] + mark
        now = render(turns[: k + 1])
        if not now.startswith(before):
            return render(turns), [], False
        probe = render([*turns[:k], (turns[k][0], mark)])
        bare = render([*turns[:k], (turns[k][0], "")])
        at = probe.find(mark, len(before))
        if at < 0 or not probe.startswith(before):
            return render(turns), [], False
        spans.append((len(before), at, at + len(now) - len(bare), len(now)))
        before = now
    return before, spans, True


def _format(render, learn: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column("_turns").to_pylist():
                turns = [(t["role"] or "", t["text"] or "") for t in turns]
                text, spans, stable = locate(turns, render)
                mask = [{"start": a, "end": z} for (role, _), (_, a, z, _) in zip(turns, spans) if role == learn]
                out.append((text, [{"start": a, "end": z} for a, _, _, z in spans], mask, stable))
            cols = list(zip(*out)) or [(), (), (), ()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_k0"), pa.array(cols[0], pa.string()), pa.array(cols[1], span), pa.array(cols[2], span), pa.array(cols[3], pa.bool_())], names=["_k0", "formatted", "turn_spans", "loss_spans", "stable"])

    return run


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", render: Callable[[list[Turn]], str] = template, learn: str = "assistant") -> DataFrame:
    """One row for each conversation: its id, formatted, turn_spans, loss_spans (texts of `learn` turns) and stable.

    Rows are ordered by turn, then role and text, nulls first; repeated rows are turns of their own. A null
    role or text is empty. A null id is one conversation. stable is false where the template rewrites history;
    then there are no spans, so nothing is learnt from. A conversation is one output row and so must fit in a
    worker; successive rendering costs the square of its turns.
    """
    row = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    d = turns.select(F.col(f"`{conv_col}`").alias("_k0"), row.alias("_r")).groupBy("_k0").agg(F.sort_array(F.collect_list("_r")).alias("_turns"))
    d = d.select("_k0", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("_turns"))
    span = "array<struct<start:bigint,end:bigint>>"
    out = d.mapInArrow(_format(render, learn), f"_k0 {d.schema['_k0'].dataType.simpleString()}, formatted string, turn_spans {span}, loss_spans {span}, stable boolean")
    return out.withColumnRenamed("_k0", conv_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
            said = "".join(f"{role}\n{t}\n" for role, t in turns)
            out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_k0"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["_k0", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest_chats(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests read back from the formatted strings and their loss masks."""
    d = formatted.select(F.col(f"`{conv_col}`").alias("_k0"), "formatted", "loss_spans")
    return d.mapInArrow(_digest, f"_k0 {d.schema['_k0'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("_k0", conv_col)
