"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text falls into atomic segments that keep every character: lines, of long lines sentences, of long sentences words, of long words
runs of characters. Adjacent segments wait in a heap by the strength of the boundary between them; the weakest is merged
first while the merged piece and its overlap fit the limit. What is left are the pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import let_workers_import

# strengths of the boundary before a segment, weakest first
CHARACTER, WORD, SENTENCE, LINE, ITEM, PARAGRAPH, FENCE, HEADING = range(8)
_HEADING, _ITEM, _FENCE = re.compile(r"#{1,6}\s"), re.compile(r"\s*(?:[-*+•–]|\d+[.)])\s"), re.compile(r"\s*(?:```|~~~)")
_SENTENCE, _WORD = re.compile(r"(?<=[.!?…])\s+(?=\S)"), re.compile(r"(?<=\s)(?=\S)")


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def _cuts(text: str, pattern: re.Pattern) -> list[str]:
    ends = [m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


def _break(text: str, most: int, strength: int) -> Iterator[tuple[str, int]]:
    """Segments of at most `most` bytes; the first keeps the strength of the boundary before the text."""
    if _size(text) <= most:
        yield text, strength
        return
    for pattern, inner in ((_SENTENCE, SENTENCE), (_WORD, WORD)):
        parts = _cuts(text, pattern)
        if len(parts) > 1:
            for k, p in enumerate(parts):
                yield from _break(p, most, inner if k else strength)
            return
    start, size = 0, 0
    for k, c in enumerate(text):
        n = _size(c)
        if size + n > most and k > start:
            yield text[start:k], CHARACTER if start else strength
            start, size = k, 0
        size += n
    yield text[start:], CHARACTER if start else strength


def _lines(text: str) -> Iterator[tuple[str, int]]:
    blank = fenced = False
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text):
        fence = bool(_FENCE.match(line))
        if fence:
            strength = LINE if fenced else FENCE
            fenced = not fenced
        elif fenced:
            strength = WORD  # code stays together rather than prose
        elif _HEADING.match(line):
            strength = HEADING
        elif blank:
            strength = PARAGRAPH
        else:
            strength = ITEM if _ITEM.match(line) else LINE
        blank = not line.strip()
        yield line, strength


def _lap(text: str, s: int, lines: int, limit: int, room: int) -> int:
    """Where the overlap of a piece at s begins: `lines` lines before it if they leave `room` bytes of the limit.

    Where they do not, they are cut from the front at a word to a third of the limit, and left out if that is too much too.
    """
    at, n, low = s, 0, max(0, s - limit - 1)
    while at > low and n < lines:
        at = max(low, text.rfind("\n", low, at - 1) + 1)
        n += 1
    if s - at <= limit and _size(text[at:s]) + room <= limit:
        return at
    cut = max(at, s - limit // 3)
    while _size(text[cut:s]) > limit // 3:
        cut += max(1, (_size(text[cut:s]) - limit // 3) // 4)
    if cut > at and (m := re.search(r"\s(?=\S)", text[cut:s])):
        cut += m.end()
    return cut if _size(text[cut:s]) + room <= limit else s


def _segments(text: str, limit: int, lines: int) -> Iterator[tuple[str, int, int]]:
    """(segment, strength, begin of its overlap): lines, broken further only where one does not fit beside its overlap."""
    s = 0
    for line, strength in _lines(text):
        todo = [(line, strength)]
        while todo:
            part, k = todo.pop()
            size, at = _size(part), _lap(text, s, lines, limit, 1)
            if _size(text[at:s]) + size > limit:
                finer = next((p for p in ((_cuts(part, _SENTENCE), SENTENCE), (_cuts(part, _WORD), WORD)) if len(p[0]) > 1), None)
                if finer:
                    parts, inner = finer
                    todo += [(p, inner if i else k) for i, p in reversed(list(enumerate(parts)))]
                    continue
                most = max(1, limit - (limit // 3 if lines > 0 else 0))
                if size > most:  # a run of characters
                    first, *rest = [x for x, _ in _break(part, most, k)]
                    if rest:
                        todo += [(x, CHARACTER) for x in reversed(rest)]
                    part, size = first, _size(first)
                at = _lap(text, s, lines, limit, size)
            yield part, k, at
            s += len(part)


def split_text(text: str, limit: int, overlap_lines: int) -> list[tuple[int, str, str]]:
    """(start, overlap, own text) of the pieces in order; the own texts put together are the text.

    overlap + own text never exceed `limit` UTF-8 bytes, except that a piece is at least one character. The overlap is the
    last `overlap_lines` lines before the piece; where no word fits beside them, at most a third of the limit of them.
    """
    limit = max(1, limit)
    if _size(text) <= limit:
        return [(0, "", text)]
    segments = list(_segments(text, limit, overlap_lines))
    own, strength, laps = [x for x, _, _ in segments], [k for _, k, _ in segments], [at for _, _, at in segments]
    sizes, starts = [_size(x) for x in own], [0]
    for x in own[:-1]:
        starts.append(starts[-1] + len(x))
    before = [_size(text[at:x]) for at, x in zip(laps, starts)]
    n = len(own)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    entry = lambda i: (strength[nxt[i]], sizes[i] + sizes[nxt[i]], i, nxt[i])
    heap = [entry(i) for i in range(n - 1)]
    heapq.heapify(heap)
    last = list(range(n))  # of a piece: its last segment
    while heap:
        _, total, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or nxt[i] != j or total != sizes[i] + sizes[j] or before[i] + total > limit:
            continue
        sizes[i], last[i], alive[j] = total, last[j], False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            heapq.heappush(heap, entry(i))
        if prv[i] >= 0:
            heapq.heappush(heap, entry(prv[i]))
    heads = [i for i in range(n) if alive[i]]
    bounds = [starts[i] for i in heads] + [len(text)]
    return [(a, text[laps[i] : a], text[a:b]) for i, a, b in zip(heads, bounds, bounds[1:])]


def split_oversized(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, piece_no, n_pieces, start, overlap_chars, n_bytes, text, *keep) for (id, text, max_bytes, overlap_lines, *keep).

    Only items above their limit come out, each as its pieces numbered from 1; text is the overlap followed by the piece's own
    text. The sizes are checked before any text goes to Python. Null text or limit: not oversized. A limit below 1 counts as 1,
    a null overlap as 0. Repeated rows give repeated pieces, so pass distinct items.
    """
    let_workers_import(items.sparkSession)
    large = items.where(F.col("max_bytes").isNotNull() & (F.octet_length("text") > F.greatest(F.col("max_bytes"), F.lit(1)))).select(F.col("id").cast("long"), "text", F.col("max_bytes").cast("int"), F.coalesce("overlap_lines", F.lit(0)).cast("int").alias("overlap_lines"), *keep)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in large.schema.fields[4:])
    names = ["id", "piece_no", "n_pieces", "start", "overlap_chars", "n_bytes", "text"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, (i, text, limit, lines) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                pieces = split_text(text, limit, lines)
                rows += [(i, k, len(pieces), start, len(lap), _size(lap + own), lap + own) for k, (start, lap, own) in enumerate(pieces, 1)]
                of += [k] * len(pieces)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] + [c.take(pa.array(of)) for c in batch.columns[4:]], names + list(keep))

    return large.mapInArrow(run, "id long, piece_no int, n_pieces int, start int, overlap_chars int, n_bytes int, text string" + more)
