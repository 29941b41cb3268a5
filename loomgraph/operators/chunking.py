"""Documents cut into chunks: protected blocks, greedy packing of lines; one document is the unit of work."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

_HEADING, _ROW, _RULE = re.compile(r"#{1,6}\s+(.+?)\s*$"), re.compile(r"\s*\|.*\|\s*$"), re.compile(r"\s*\|(\s*:?-+:?\s*\|)+\s*$")
_CJK = re.compile("[\u3000-\u9fff\uf900-\ufaff]")


class Size:
    """Tokens of texts joined by line breaks: CJK characters count one, all others together a quarter, rounded up."""

    def __init__(self):
        self.cjk = self.other = self.parts = 0

    def with_(self, text: str) -> Size:
        more, cjk = Size(), len(_CJK.findall(text))
        more.cjk, more.other, more.parts = self.cjk + cjk, self.other + len(text) - cjk + (self.parts > 0), self.parts + 1
        return more

    @property
    def tokens(self) -> int:
        return self.cjk + -(-self.other // 4)


def tokens(text: str) -> int:
    return Size().with_(text).tokens


def blocks(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, heading in force, text) of ``placed_blocks``."""
    return ((kind, heading, body) for kind, heading, body, _ in placed_blocks(text))


def split_blocks_table(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs(doc_id, text)``: number, kind, heading, offsets from start up to end; null text has none. A document is one row of a task."""

    def cut(batches):
        import pandas as pd

        for rows in batches:
            yield pd.DataFrame(
                [(d, n, kind, heading, at, at + len(body)) for d, text in zip(rows["doc_id"], rows["text"]) for n, (kind, heading, body, at) in enumerate(placed_blocks(text))],
                columns=["doc_id", "n", "kind", "heading", "start", "end"],
            )

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(cut, "doc_id long, n int, kind string, heading string, start long, end long")


def placed_blocks(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, heading in force, text, offset) of the blocks of a document: fenced code, tables, and the text between; blank ones drop out."""
    lines, heading, held, i = text.split("\n"), "", [], 0
    at = [0, *accumulate(len(line) + 1 for line in lines)]
    while i < len(lines):
        fence, end, kind = lines[i].lstrip()[:3], i + 1, ""
        if fence in ("```", "~~~"):
            kind = "CODE"
            while end < len(lines) and not lines[end].lstrip().startswith(fence):
                end += 1
            end += 1
        elif _ROW.match(lines[i]) and i + 1 < len(lines) and _RULE.match(lines[i + 1]):
            kind = "TABLE"
            while end < len(lines) and _ROW.match(lines[end]):
                end += 1
        found = None if kind else _HEADING.match(lines[i])
        if (kind or found) and "".join(held).strip():
            yield "TEXT", heading, "\n".join(held), at[i - len(held)]
        if kind:
            yield kind, heading, "\n".join(lines[i:end]), at[i]
        if kind or found:
            held = []
        if found:
            heading = found[1]
        if not kind:
            held.append(lines[i])
        i = end
    if "".join(held).strip():
        yield "TEXT", heading, "\n".join(held), at[len(lines) - len(held)]


def pack_lines(text: str, cap: int) -> Iterator[str]:
    """Lines packed in order up to ``cap`` tokens; a line is never cut, and one beyond the cap stands alone."""
    held, size = [], Size()
    for line in text.split("\n"):
        if held and size.with_(line).tokens > cap:
            yield "\n".join(held)
            held, size = [], Size()
        held.append(line)
        size = size.with_(line)
    yield "\n".join(held)


def split_blocks(text: str, pattern: str) -> Iterator[tuple[str, str, str]]:
    """Blocks with the text ones split where ``pattern`` matches; code and tables stay whole, blank parts drop out."""
    for kind, heading, body in blocks(text):
        for part in re.split(pattern, body) if kind == "TEXT" else [body]:
            if part and part.strip():
                yield kind, heading, part


def assemble(text: str, max_tokens: int, standalone_max: int, heading_strict: bool, pattern: str | None = None) -> Iterator[tuple[str, str, str]]:
    """(kind, heading, content) of the chunks: code and tables stand alone, text joins the open chunk while the joined text fits."""
    held, size, head = [], Size(), ""
    for kind, heading, body in blocks(text) if pattern is None else split_blocks(text, pattern):
        n = tokens(body)
        alone = kind != "TEXT"
        if held and (alone or size.with_(body).tokens > max_tokens or (heading_strict and heading != head)):
            yield "TEXT", head, "\n".join(held)
            held, size = [], Size()
        if n > (standalone_max if alone else max_tokens):
            for part in pack_lines(body, standalone_max if alone else max_tokens):
                if part.strip():
                    yield kind, heading, part
        elif alone:
            yield kind, heading, body
        else:
            head = head if held else heading
            held.append(body)
            size = size.with_(body)
    if held:
        yield "TEXT", head, "\n".join(held)


def assemble_chunks(docs: DataFrame, max_tokens: int = 512, standalone_max: int = 1024, heading_strict: bool = True) -> DataFrame:
    """Chunks of ``docs(doc_id, text)`` with their rank from 0; null and blank texts have none."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for rank, (kind, heading, content) in enumerate(assemble(text, max_tokens, standalone_max, heading_strict) if isinstance(text, str) else ()):
                    rows.append((doc_id, rank, kind, heading, content, tokens(content)))
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "kind", "heading", "content", "tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, rank int, kind string, heading string, content string, tokens int")


def parent_child(text: str, parent_max: int, child_max: int, pattern: str | None = None) -> Iterator[tuple[str, int, str, str, str]]:
    """(chunk_type, parent_group, kind, heading, content): each parent followed by its children, which are its own text cut smaller."""
    for group, (kind, heading, content) in enumerate(assemble(text, parent_max, parent_max, True, pattern)):
        yield "parent", group, kind, heading, content
        for part in pack_lines(content, child_max):
            if part.strip():
                yield "child", group, kind, heading, part


def parent_child_chunks(docs: DataFrame, parent_max: int = 1024, child_max: int = 256, pattern: str | None = None) -> DataFrame:
    """Parents and children of ``docs(doc_id, text)`` with their rank from 0; null and blank texts have none. ``relevance.link_parents`` names parents."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for rank, row in enumerate(parent_child(text, parent_max, child_max, pattern) if isinstance(text, str) else ()):
                    rows.append((doc_id, rank, *row))
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "chunk_type", "parent_group", "kind", "heading", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, rank int, chunk_type string, parent_group int, kind string, heading string, content string")
