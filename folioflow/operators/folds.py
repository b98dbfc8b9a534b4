"""Folds over one work's ordered parts whose steps depend on the steps before: each is linear in the parts.

They see numbers (lengths, times, levels), come as arrays in Arrow batches and give back group numbers, runs or flags; texts
stay in Spark, which slices and joins them, but for chunks, whose texts are joined on the way. Of a batch only a few MB at a
time are Python's objects, so a task's memory does not grow with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

NEVER = 1 << 60
#: Bytes of an Arrow batch that are Python's objects at a time; a larger row is by itself.
PIECE_BYTES = 1 << 20
#: Kinds of a Markdown file's lines; 1 to 3 are headings that open a section, DEEP ones do not.
BLANK, DEEP, TEXT, FENCE = 0, 4, 5, 6


def pieces(batch: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """A batch's rows in order, in slices of at most ``most`` bytes or one row."""
    if len(batch) < 2 or batch.nbytes <= most:
        yield batch
        return
    half = len(batch) // 2
    yield from pieces(batch[:half], most)
    yield from pieces(batch[half:], most)


def lists(column: pa.Array) -> Iterator[list | None]:
    """The rows of a column of arrays."""
    values = column.flatten().to_numpy(zero_copy_only=False).tolist()
    at = 0
    for n in column.value_lengths().to_pylist():
        yield None if n is None else values[at : at + n]
        at += n or 0


def fold(step: Callable[..., Any], kind: str, *columns: Column) -> Column:
    """``step`` over each row's arrays; a row with a null array gives null."""
    made = to_arrow_type(T.DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch):
                rows = zip(*map(lists, piece.flatten()), strict=True)
                yield pa.array([None if any(x is None for x in row) else step(*row) for row in rows], made)

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))


def group_numbers(most: int, glue: int) -> Callable[[list[int]], list[int]]:
    """Numbers of groups in order, of at most ``most`` in sum, ``glue`` for each item but a group's first."""

    def step(sizes: list[int]) -> list[int]:
        out, group, held = [], -1, 0
        for n in sizes:
            full = group < 0 or held + n + glue > most
            group, held = group + full, n if full else held + n + glue
            out.append(group)
        return out

    return step


def paragraph_numbers(most: int) -> Callable[[list[int], list[bool]], list[int]]:
    """Numbers of paragraphs: one ends where a sentence does, or at ``most`` characters."""

    def step(sizes: list[int], ends: list[bool]) -> list[int]:
        out, number, held = [], 0, 0
        for n, end in zip(sizes, ends, strict=True):
            out.append(number)
            held += n + 1
            if end or held >= most:
                number, held = number + 1, 0
        return out

    return step


def blocks(least: float, most: float, pause: float) -> Callable[[list[float], list[float]], list[dict]]:
    """Runs (first, last) of segments: one closes at ``most`` seconds, or at ``least`` before a pause."""

    def step(starts: list[float], ends: list[float]) -> list[dict]:
        out: list[dict] = []
        for i, start in enumerate(starts):
            if out:
                length, gap = ends[i - 1] - starts[out[-1]["first"]], start - ends[i - 1]
                if not (length >= most or length >= least and gap >= pause):
                    out[-1]["last"] = i
                    continue
            out.append({"first": i, "last": i})
        return out

    return step


def running_ends(gap: int) -> Callable[[list[int]], list[int]]:
    """Where each of the parts of these sizes ends, ``gap`` between them."""
    return lambda sizes: [end + i * gap for i, end in enumerate(accumulate(sizes))]


def overlapping(target: int, overlap: int) -> Callable[[list[int], list[int]], list[dict]]:
    """Chunks (first, last, overlap_before, overlap_after, chars) of sentences of these sizes with glue ahead of each."""

    def step(sizes: list[int], glue: list[int]) -> list[dict]:
        begin, end, at = [], [], 0
        for n, g in zip(sizes, glue, strict=True):
            begin.append(at + g)
            at += g + n
            end.append(at)
        out: list[dict] = []
        first = new = 0

        def close(i: int) -> None:
            nonlocal first, new
            carried = i
            while overlap > 0 and carried - 1 > new and begin[carried - 1] >= end[i - 1] - overlap:
                carried -= 1
            before = end[new - 1] - begin[first] if first < new else 0
            after = end[i - 1] - begin[carried] if carried < i else 0
            out.append({"first": first, "last": i - 1, "overlap_before": before, "overlap_after": after, "chars": end[i - 1] - begin[first]})
            first, new = carried, i

        for i in range(len(sizes)):
            if new < i and end[i] - begin[first] > target:
                close(i)
        if sizes:
            close(len(sizes))
            out[-1]["overlap_after"] = 0
        return out

    return step


def overlapping_texts(target: int, overlap: int) -> Callable[[list[str], list[int]], list[dict]]:
    """``overlapping`` of sentences and the numbers of their paragraphs, each chunk with its text.

    Sentences of a paragraph are joined by a blank, paragraphs by a blank line.
    """
    runs_of = overlapping(target, overlap)

    def step(texts: list[str], paragraphs: list[int]) -> list[dict]:
        glue = [" " if a == b else "\n\n" for a, b in zip(paragraphs, paragraphs[1:], strict=False)]
        glue = ["", *glue][: len(texts)]
        runs = runs_of([len(t) for t in texts], [len(g) for g in glue])
        glued = [g + t for g, t in zip(glue, texts, strict=True)]
        for r in runs:
            r["text"] = texts[r["first"]] + "".join(glued[r["first"] + 1 : r["last"] + 1])
        return runs

    return step


def kept_sections(levels: list[int], titled: list[bool], long: list[bool]) -> list[bool]:
    """Which sections are left once rounds that drop short ones change nothing.

    In each round every short section goes that has no title or whose neighbour behind is no deeper. Read from the
    end, the round in which a section goes follows from those of its neighbours to come: ahead of it they are the section behind, then
    the next one that goes later, and so on.
    """
    out, near = [], []  # (level, round), nearest last; rounds grow away from here
    for level, title, stays in zip(reversed(levels), reversed(titled), reversed(long), strict=True):
        goes = NEVER if stays else 1
        if title and not stays:
            goes = 0
            for at in range(len(near) - 1, -1, -1):
                if near[at][0] <= level or goes == NEVER:
                    break
                goes = near[at][1]
            goes = NEVER if goes == NEVER else goes + 1
        while near and near[-1][1] <= goes:
            near.pop()
        near.append((level, goes))
        out.append(goes == NEVER)
    return out[::-1]


def outline(kinds: list[int]) -> list[dict]:
    """Sections of a Markdown file's lines of these kinds: the line they begin ``at`` and the line numbers of each paragraph.

    Paragraphs ahead of the first line of text or heading belong to the section that text opens; a heading drops them. A deep
    heading is a paragraph by itself, and its number n is given as -n - 1. Lines of fences are text of any kind.
    """
    opened: list[dict] = [{"at": -1, "parts": []}]
    inside, going = False, False  # a fence; a paragraph that the next line goes on with
    for i, kind in enumerate(kinds):
        last = opened[-1]
        if kind == FENCE:
            inside = not inside
        elif inside or kind == TEXT:
            if not inside and last["at"] < 0:
                last["at"] = i
            if not going:
                last["parts"].append([])
            last["parts"][-1].append(i)
            going = True
        else:
            going = False
            if kind == DEEP:
                last["parts"].append([-i - 1])
            elif kind != BLANK:
                opened.append({"at": i, "parts": []})
    return [s for s in opened if s["at"] >= 0]
