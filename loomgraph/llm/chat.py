"""Chat formatting by incremental rendering of a black-box template.

The template is any function from a list of (role, text) to a string. Successive turn prefixes are rendered and consecutive outputs
compared: what a turn adds is its span; an output that does not begin with the one before shows a template that rewrites history.
Two probe texts in place of a turn's own tell its marks from its text, so the loss mask covers the texts alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|### |</turn>|: ")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TEXT = re.compile(r"((?:\\.|[^\\])*?) </turn>\n", re.S)
_ROLE = re.compile(r"### ((?:\\.|[^\\])*?): ", re.S)
PROBES = "\ue000", "\ue001"


def escape(text: str) -> str:
    """A backslash before every backslash and every control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(1 << 14)
def _rendered(turn: tuple[str, str]) -> str:
    return f"{HEAD}{escape(turn[0])}{SEP}{escape(turn[1])}{END}"


def template(turns: list[tuple[str, str]]) -> str:
    return "".join(map(_rendered, turns))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text that ``template`` has made."""
    out, at = [], 0
    while at < len(formatted):
        role = _ROLE.match(formatted, at)
        text = _TEXT.match(formatted, role.end())
        out.append((unescape(role[1]), unescape(text[1])))
        at = text.end()
    return out


def _common(a: str, b: str, low: int = 0) -> int:
    """Length of the common prefix of two strings whose first ``low`` characters are known to agree."""
    high = min(len(a), len(b))
    while low < high:  # halves are compared as slices
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _common_end(a: str, b: str, most: int) -> int:
    """Length of the common suffix, at most ``most``."""
    return _common(a[len(a) - most :][::-1], b[len(b) - most :][::-1]) if most > 0 else 0


def locate(render: Callable[[list[tuple[str, str]]], str], turns: list[tuple[str, str]]) -> tuple[str, list[dict], bool]:
    """(whole output, a span per turn, whether history was rewritten); a span holds start, end, text_start, text_end.

    After a rewrite a turn's span starts where its output first differs from the one before. A turn whose text the template changes
    beyond what two probes show (so that its marks do not frame it) has text_start = text_end = end.
    """
    before, spans, rewrites = render([]), [], False
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        start = len(before) if now.startswith(before) else _common(before, now)
        rewrites |= start < len(before)
        one, two = (render([*turns[:k], (role, p)]) for p in PROBES)
        head = _common(one, two, start if one.startswith(before) and two.startswith(before) and start == len(before) else 0)
        tail = _common_end(one, two, min(len(one), len(two)) - head)
        framed = head + tail <= len(now) and now.startswith(one[:head]) and now.endswith(one[len(one) - tail :])
        spans.append({"role": role, "start": start, "end": len(now), "text_start": head if framed else len(now), "text_end": len(now) - tail if framed else len(now)})
        before = now
    return before, spans, rewrites


SCHEMA = "conv_id long, formatted string, rewrites boolean, spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"


def format_chats(conversations: DataFrame, render: Callable = template) -> DataFrame:
    """One row per conversation: formatted text, spans of its turns in it, rewrites flag. Loss covers the text of assistant turns.

    Rows go by turn, then role and text (null turns first; repeated rows are turns of their own). Null text or role is empty. Rows with
    null conv_id form one conversation. An empty table gives an empty result; other columns are ignored. Very long texts are formatted whole. A
    conversation is one output row and so is rendered in one task; every prefix of its turns is rendered, which the method asks for.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(frames):
        for f in frames:
            rows = []
            for c, turns in zip(f.conv_id, f.turns, strict=True):
                rows.append((c, *locate(render, [(t["role"], t["text"]) for t in turns])))
                _rendered.cache_clear()  # holds the turns of one conversation at most
            made = pd.DataFrame(rows, columns=["conv_id", "formatted", "spans", "rewrites"])
            yield made[["conv_id", "formatted", "rewrites", "spans"]].astype({"conv_id": "Int64"})

    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns")).mapInPandas(run, SCHEMA)
