"""Markdown documents to chunks.

A document is read line by line into blocks (paragraph, table, figure, bibliography entry) under
its heading path; blocks are then packed into chunks.  Both steps carry state from line to line, so
they run as one function of a document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions.mapped import of_texts

CHUNKS = "array<struct<text: string, section: string, segment_type: string, chunk_index: int, char_count: int, approx_tokens: int>>"

HEADING = re.compile(fixed.HEADING)
PIPE_ROW, PIPE_RULE = re.compile(fixed.PIPE_ROW), re.compile(fixed.PIPE_RULE)
FIGURE = re.compile(fixed.FIGURE)
TABLE_CAPTION = re.compile(fixed.TABLE_CAPTION, re.I)
DEEP = re.S | re.I


@dataclass
class Block:
    kind: str
    text: str


@dataclass
class Part:
    """A heading and the blocks under it."""

    heading: str
    level: int
    blocks: list[Block] = field(default_factory=list)


class Lines:
    """The lines of a document, taken one after another."""

    def __init__(self, text: str) -> None:
        self.all, self.at = text.split("\n"), 0

    def __bool__(self) -> bool:
        return self.at < len(self.all)

    @property
    def head(self) -> str:
        return self.all[self.at]

    def take(self) -> str:
        self.at += 1
        return self.all[self.at - 1]

    def take_while(self, wanted: Callable[[str], bool]) -> list[str]:
        out = []
        while self and wanted(self.head):
            out.append(self.take())
        return out

    def next_is(self, pattern: re.Pattern[str]) -> bool:
        return self.at + 1 < len(self.all) and pattern.fullmatch(self.all[self.at + 1]) is not None


def opens_table(line: str) -> bool:
    return "<table" in line.lower()


def closes_table(line: str) -> bool:
    return "</table>" in line.lower()


def real_tables(text: str) -> str:
    """Without HTML tables that have no numbered caption in the eight lines with text before them."""
    lines, out, told = Lines(text), [], []
    while lines:
        if not opens_table(lines.head):
            line = lines.take()
            out.append(line)
            told = [*told, line][-8:] if line.strip() else told
            continue
        table = lines.take_while(lambda x: not closes_table(x))
        if lines:
            table.append(lines.take())
        if any(TABLE_CAPTION.search(x) for x in told):
            out += table
        told = [*told, *(x for x in table if x.strip())][-8:]
    return "\n".join(out)


def is_entry(text: str, heading: str) -> bool:
    """Whether a paragraph under a heading is a bibliography entry."""
    under = heading.lower()
    if "reference" not in under and "bibliography" not in under:
        return False
    marked = re.match(fixed.NUMBERED_ENTRY, text) or "doi" in text.lower() or "https://" in text
    return bool(marked or (re.match(fixed.AUTHOR_ENTRY, text) and re.search(r"\b\d{4}\b", text)))


def entries(text: str) -> list[str]:
    """Entries that stand in one paragraph, by their numbers, else by the year at their end."""
    for pattern in fixed.ENTRY_BREAKS:
        found = [p.strip() for p in re.split(pattern, text) if p.strip()]
        if len(found) > 1:
            return found
    return [text]


def next_block(lines: Lines, heading: str) -> list[Block]:
    """The blocks that begin at the next line; none for a blank one."""
    line = lines.head
    if opens_table(line):
        body = [lines.take(), *lines.take_while(lambda x: not closes_table(x))]
        if lines:
            body.append(lines.take())
        return [Block("table", "\n".join(body))]
    if PIPE_ROW.fullmatch(line) and lines.next_is(PIPE_RULE):
        return [Block("table", "\n".join(lines.take_while(lambda x: PIPE_ROW.fullmatch(x) is not None)))]
    goes_on = lambda x: bool(x.strip()) and not x.startswith("#")
    if line.strip().startswith("[Figure:") or FIGURE.match(line.strip()):
        return [Block("figure", "\n".join([lines.take(), *lines.take_while(goes_on)]))]
    first = lines.take()
    if not first.strip():
        return []
    more = lines.take_while(lambda x: goes_on(x) and not opens_table(x) and not x.strip().startswith("[Figure:"))
    text = " ".join(x.strip() for x in [first, *more])
    if is_entry(text, heading):
        return [Block("reference", e.strip()) for e in entries(text)]
    return [Block("text", text)]


def parts(text: str) -> list[Part]:
    """Headings with their blocks; headings without any are left out."""
    lines, out = Lines(text), [Part("", 0)]
    while lines:
        if m := HEADING.fullmatch(lines.head.strip()):
            lines.take()
            out.append(Part(re.sub(fixed.TITLE_MARKS, "", m[2].strip()).strip(), len(m[1])))
        else:
            out[-1].blocks += next_block(lines, out[-1].heading)
    return [p for p in out if p.blocks]


def packed(items: list[str], most: int, start: int = 0, carry: bool = False) -> list[list[str]]:
    """Groups of items in order, each begun anew when the next would take it over the size.
    start: size that each group has without items.  carry: a group begins with the last item before."""
    groups: list[list[str]] = []
    size = start
    for x in items:
        if groups and groups[-1] and size + len(x) > most:
            groups.append([groups[-1][-1]] if carry else [])
            size = start + sum(map(len, groups[-1]))
        elif not groups:
            groups.append([])
        groups[-1].append(x)
        size += len(x)
    return groups


def sentence_parts(text: str) -> list[str]:
    out: list[str] = []
    for piece in re.split(fixed.SENTENCE_END, text):
        tail = out[-1].rstrip(".!? ").split() if out else []
        if tail and tail[-1] in fixed.ABBREVIATIONS:
            out[-1] = f"{out[-1]} {piece}"
        else:
            out.append(piece)
    return out


@dataclass(frozen=True)
class Sizes:
    target: int = fixed.TARGET_TOKENS * fixed.CHARS_PER_TOKEN
    most: int = fixed.MAX_TOKENS * fixed.CHARS_PER_TOKEN


def text_chunks(paragraphs: list[str], sizes: Sizes) -> list[str]:
    """One chunk, or, beyond the largest size, groups of sentences that overlap by one."""
    whole = "\n\n".join(paragraphs)
    if len(whole) <= sizes.most:
        return [whole]
    pieces = sentence_parts(whole)
    return [whole] if len(pieces) < 2 else [" ".join(g) for g in packed(pieces, sizes.target, carry=True)]


def _found(pattern: str, text: str, group: int) -> str | None:
    m = re.search(pattern, text, DEEP)
    return m[group] if m else None


def table_chunks(table: str, sizes: Sizes) -> list[str]:
    """A table up to the general size as it is; a larger one by groups of rows, each under the
    head (and caption) again."""
    if len(table) // fixed.CHARS_PER_TOKEN <= fixed.MAX_TOKENS:
        return [table]
    if not table.strip().startswith("<"):
        rows = table.strip().split("\n")
        if len(rows) < 3:
            return [table]
        head = "\n".join(rows[:2])
        return ["\n".join([head, *g]) for g in packed(rows[2:], sizes.target, len(head))]
    marked = _found(fixed.TABLE_HEAD, table, 0)
    head = marked or _found(fixed.TABLE_FIRST_ROW, table, 0) or "<table>"
    caption = _found(fixed.TABLE_TITLE, table, 0) or ""
    body = _found(fixed.TABLE_BODY, table, 1)
    if body is None:
        body = table[len(head) :] if marked else table
    rows = re.findall(fixed.TABLE_ROW, body, DEEP)
    if not rows:
        return [table]
    top = head + (f"\n  {caption}" if caption else "") + "\n  <tbody>\n"
    return [top + "\n".join(g) + "\n  </tbody>\n</table>" for g in packed(rows, sizes.target, len(head) + len(caption))]


def prefix(path: list[str]) -> str:
    """A heading path of at most 80 characters: the deepest headings, else a cut one."""
    whole = " > ".join(path)
    if len(whole) <= fixed.PREFIX:
        return whole
    for k in range(1, len(path)):
        if len(" > ".join(path[k:])) <= fixed.PREFIX:
            return " > ".join(path[k:])
    return path[-1] if len(path[-1]) <= fixed.PREFIX else path[-1][: fixed.PREFIX - 3] + "..."


def chunks_of(text: str | None, sizes: Sizes = Sizes()) -> list[dict]:
    """Chunks in order.  Text under three tokens is left out, tables never."""
    out: list[dict] = []
    path: list[str] = []

    def emit(kind: str, body: str) -> None:
        if kind == "text" and path:
            body = f"[{prefix(' > '.join(path).split(' > '))}]\n{body}"
        tokens = len(body) // fixed.CHARS_PER_TOKEN
        if tokens >= 3 or kind == "table":
            out.append({"text": body, "section": " > ".join(path), "segment_type": kind, "chunk_index": len(out), "char_count": len(body), "approx_tokens": tokens})

    for part in parts(text or ""):
        # deeper and equal levels end; a level that was skipped counts as not there
        path = path[: max(0, part.level - 1)]
        if part.heading:
            path.append(part.heading)
        held: list[str] = []

        def flush() -> None:
            if held:  # noqa: B023
                for body in text_chunks(held, sizes):  # noqa: B023
                    emit("text", body)
                held.clear()  # noqa: B023

        for block in part.blocks:
            if block.kind == "text":
                if held and sum(map(len, held)) + len(block.text) > sizes.target:
                    flush()
                held.append(block.text)
                continue
            flush()
            for body in table_chunks(block.text, sizes) if block.kind == "table" else [block.text]:
                emit(block.kind, body)
        flush()
    return out


def markdown_chunks(c: Column) -> Column:
    return of_texts(chunks_of, CHUNKS)(c)


def without_fake_tables(c: Column) -> Column:
    return of_texts(lambda t: None if t is None else real_tables(t), "string")(c)
