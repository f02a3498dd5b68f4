"""Recursive text splitting, the one text operator that is not expressible in Catalyst.

Splitters are plain functions of one text; `chunk_column` runs one over Arrow
batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of chunks that a task holds before it passes them on.
HELD_CHARS = 1 << 20

# --- fixed values: separators from coarse to fine; whether the mark stays with the text before it ---
SEPARATORS = [
    ("\n\n\n", False), ("\n\n", False), ("\n", False), (". ", True), (".\n", True), ("! ", True), ("!\n", True), ("? ", True), ("?\n", True),
    ("؟ ", True), ("؟\n", True), ("؛ ", True), ("، ", True), (", ", True), ("; ", True), (" ", False),
]
# --- fixed values: blocks that are kept in one piece, and how a kept block is written while splitting ---
KEPT_BLOCKS = [("code", r"```[\s\S]*?```"), ("math", r"\$\$[\s\S]*?\$\$"), ("table_html", r"<table[\s\S]*?</table>"), ("table_md", r"\|[^\n]+\|(?:\n\|[^\n]+\|)+")]
PLACEHOLDER = "\x00BLOCK_{kind}_{rule}_{nth}\x00"
# --- fixed values: the same for the paragraph splitter ---
PARAGRAPH_BLOCKS = [("code", r"```[\s\S]*?```"), ("math", r"\$\$[\s\S]*?\$\$"), ("table", r"<table[\s\S]*?</table>")]
PARAGRAPH_PLACEHOLDER = "__BLOCK_{kind}_{rule}_{nth}__"


def _hide_blocks(text: str, blocks: list[tuple[str, str]] = KEPT_BLOCKS, form: str = PLACEHOLDER) -> tuple[str, dict[str, str]]:
    """Kept blocks become placeholders, counted from the last of each kind."""
    hidden: dict[str, str] = {}
    for rule, (kind, pattern) in enumerate(blocks):
        total = len(re.findall(pattern, text))
        if not total:
            continue
        seen = iter(range(total - 1, -1, -1))

        def hide(m: re.Match) -> str:
            mark = form.format(kind=kind, rule=rule, nth=next(seen))  # noqa: B023
            hidden[mark] = m[0]
            return mark

        text = re.sub(pattern, hide, text)
    return text, hidden


def _show_blocks(text: str, hidden: dict[str, str]) -> str:
    """Placeholders become their blocks; a later kind's block may hold an earlier one's placeholder."""
    if not hidden:
        return text
    marks = re.compile("|".join(map(re.escape, hidden)))
    while marks.search(text):
        text = marks.sub(lambda m: hidden[m[0]], text)
    return text


def _atoms(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most `limit` characters, each split no finer than it must be."""
    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= limit:
            if part:
                yield part
        elif level == len(SEPARATORS):
            yield from (part[i : i + limit] for i in range(0, len(part), limit))
        else:
            mark, stays = SEPARATORS[level]
            *heads, last = part.split(mark)
            pieces = [p for p in (*(h + (mark if stays else " ") for h in heads), last) if p]
            todo += [(p, level + 1) for p in reversed(pieces)] if len(pieces) > 1 else [(part, level + 1)]


def _runs(sizes: list[int], limit: int, glue: int | list[int] = 0, counted: bool = True, below: float = inf) -> list[tuple[int, int]]:
    """Ranges [i, j) of neighbours that one chunk takes, as long as they fit in `limit`; empty units begin no range.

    Unit k has glue[k] before it unless it begins its range (counted=False: the
    glue right before a unit isn't held against it).  A unit over the limit
    stands alone, and so does one of `below` or more that begins a range.
    """
    glues = glue if isinstance(glue, list) else [glue] * len(sizes)
    ends = list(accumulate(g + n for g, n in zip(glues, sizes)))  # as if all units were laid out in a row
    reach = ends if counted else [e - g for e, g in zip(ends, glues)]
    out, i = [], 0
    while i < len(sizes):
        j = i + 1
        if sizes[i]:
            if sizes[i] < below:
                j = max(j, bisect_right(reach, ends[i] - sizes[i] + limit, j))
            out.append((i, j))
        i = j
    return out


def _lead(text: str, size: int, word: str) -> str:
    """The last `size` characters; "whole": from the word that they begin in, "next": from the first word that begins in them."""
    cut = len(text) - size
    if cut <= 0:
        return text
    if word == "whole":
        return text[text.rfind(" ", 0, cut + 1) + 1 or cut :]
    start = text.find(" ", cut) + 1 if word == "next" else 0
    return text[start if 0 < start < len(text) else cut :]


def _with_leads(chunks: list[str], overlap: int, word: str, limit: float = inf, tail: float | None = 0) -> list[str]:
    """Each chunk after the first begins with the end of the one before.

    What is over the limit then goes from the chunk's end, at its last blank if
    more than the share `tail` of the room is left by that; with tail=None the
    lead is shortened instead and nothing is lost.
    """
    if overlap <= 0:
        return chunks
    out = chunks[:1]
    for lead, chunk in zip((_lead(c, overlap, word) for c in chunks), chunks[1:]):
        room = limit - len(lead)
        if room <= 0:
            lead = ""
        elif len(chunk) > room and tail is None:
            lead = lead[len(lead) - max(0, limit - len(chunk)) :]
        elif len(chunk) > room:
            blank = chunk.rfind(" ", 0, room)
            chunk = chunk[: blank if blank > tail * room else room]
        out.append(lead + chunk)
    return out


def _grown(chunks: list[str], limit: int, least: int, joiner: str) -> list[str]:
    """Chunks under `least` grow by those after them as long as they fit; one at the end joins the chunk before it, where that fits."""
    ranges = _runs([len(c) for c in chunks], limit, len(joiner), below=least)
    out = [joiner.join(chunks[i:j]) for i, j in ranges]
    if len(out) > 1 and len(chunks[ranges[-1][0]]) < least and len(out[-2]) + len(joiner) + len(out[-1]) <= limit:
        out[-2:] = [joiner.join(out[-2:])]
    return out


def _checked(text: str | None, size: int, overlap: int) -> bool:
    """There is something to split."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    return bool(text and text.strip())


def _stripped(chunks: list[str]) -> list[str]:
    return [c for c in map(str.strip, chunks) if c]


def split_text(text: str | None, size: int = 2000, overlap: int = 200, least: int = 100, lossy: bool = True) -> list[str]:
    """Chunks of about `size` characters along paragraphs, lines, sentences, clauses and words.

    Each chunk after the first repeats the end of the one before.  As in the
    behaviour this must match, a chunk that would grow too long by that loses
    its end; lossy=False shortens what is repeated instead, so that every
    character but the separators is in some chunk.
    """
    if not _checked(text, size, overlap):
        return []
    plain, hidden = _hide_blocks(text)
    atoms = list(_atoms(plain, size))
    own = [_show_blocks("".join(atoms[i:j]), hidden) for i, j in _runs([len(a) for a in atoms], size)]
    return _stripped(_grown(_with_leads(own, overlap, "whole", size, 0 if lossy else None), size, least, ""))


def _slices(text: str, limit: int) -> Iterator[str]:
    """Slices of at most `limit` characters between separators, coarse ones first; the separator between two slices goes."""
    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= limit or level == len(SEPARATORS):
            yield from (part[i : i + limit] for i in range(0, len(part), limit))
            continue
        mark = SEPARATORS[level][0]
        if mark.strip():  # only blank marks may follow one another
            part = mark.join(filter(None, part.split(mark)))
        sizes = [len(u) for u in part.split(mark)]
        ends = list(accumulate(n + len(mark) for n in sizes))  # each one mark past its unit
        todo += [(part[ends[i] - len(mark) - sizes[i] : ends[j - 1] - len(mark)], level + 1) for i, j in reversed(_runs(sizes, limit, len(mark)))]


def split_budgeted(text: str | None, size: int = 500, overlap: int = 50, least: int = 50) -> list[str]:
    """Chunks whose own text fits in size - overlap, so that the repeated end of the one before always has room.

    Parts are joined again by the mark that split them; what is repeated begins
    at a word; neighbours under `least` are joined by a space.
    """
    if not _checked(text, size, overlap):
        return []
    plain, hidden = _hide_blocks(text)
    own = [_show_blocks(s, hidden) for s in _slices(plain, size - overlap)]
    return _stripped(_grown(_with_leads(own, overlap, "next", size, 0.7), size, least, " "))


def split_paragraphs(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """Paragraphs packed up to `size` (not counting what joins them), long ones by sentence; each chunk begins with the last `overlap` characters of the one before."""
    if not text:
        return []
    plain, hidden = _hide_blocks(text, PARAGRAPH_BLOCKS, PARAGRAPH_PLACEHOLDER)
    groups: list[list[tuple[str, str]]] = [[]]  # (joiner, unit); a long paragraph begins a group of its own
    for para in re.split(r"\n\n+", plain):
        if len(para) <= size:
            groups[-1].append(("\n\n", para))
        else:
            groups.append([(" ", s) for s in re.split(r"(?<=[.!?؟])\s+", para)])
    own = []
    for units in groups:
        for i, j in _runs([len(u) for _, u in units], size, [len(m) for m, _ in units], counted=False):
            own.append(_show_blocks(units[i][1] + "".join(m + u for m, u in units[i + 1 : j]), hidden))
    return _stripped(_with_leads(own, overlap, "cut"))


SPLITTERS = {"recursive": split_text, "budgeted": split_budgeted, "paragraphs": split_paragraphs}


def chunk_column(text: Column, splitter: str = "recursive", **options) -> Column:
    """Array of chunks of a text column."""
    split = SPLITTERS[splitter]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t, **options))

    return run(text)


def _chunk_rows(split, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], [batch.schema.names[0], "pos", "chunk"])

        for batch in batches:
            rows, places, chunks, held = [], [], [], 0
            for row, text in enumerate(batch.column(1)):
                for place, chunk in enumerate(split(text.as_py(), **options)):
                    rows.append(row)
                    places.append(place)
                    chunks.append(chunk)
                    held += len(chunk)
                if held >= HELD_CHARS:
                    yield out()
                    rows, places, chunks, held = [], [], [], 0
            yield out()

    return run


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", splitter: str = "recursive", **options) -> DataFrame:
    """One row per chunk: id, pos, chunk. A task holds one batch of texts and the chunks of a part of it."""
    read = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([read.schema[0], T.StructField("pos", T.IntegerType(), False), T.StructField("chunk", T.StringType())])
    return read.mapInArrow(_chunk_rows(SPLITTERS[splitter], options), schema)
