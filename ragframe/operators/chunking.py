"""Splitting documents into chunks.

A document is one row, so splitting needs no shuffle. Fixed windows are plain
column expressions; the hierarchical splitter and the header-aware splitter run
in Arrow batches and emit chunk rows directly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.functions import ids
from ragframe.functions.text import strip
from ragframe.settings import (
    PAGED_OVERLAP,
    PAGED_SEPARATORS,
    PAGED_SIZE,
    PLAIN_OVERLAP,
    PLAIN_SEPARATORS,
    PLAIN_SIZE,
)

Span = tuple[int, int]

_BLANKS = " \t\n\r\x0b\x0c"
_HEADER = re.compile(r"(#{1,3})(?:[ \t]+(.*))?$")
_FENCE = re.compile(r"[ \t]*(```|~~~)")
# Chunk rows put into one Arrow batch on the way back to Spark.
_OUT_ROWS = 8192


def chunk_fixed(df: DataFrame, size: int = PLAIN_SIZE, overlap: int = PLAIN_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters, each ``overlap`` characters into the last.

    Adds ``pos`` (0-based) and replaces ``text`` by the stripped window; blank
    windows are dropped and not numbered.
    """
    _check(size, overlap)
    last = F.greatest(F.length("text") - F.lit(overlap + 1), F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last, F.lit(size - overlap)),
        lambda start: strip(F.col("text").substr(start + 1, F.lit(size))),
    )
    kept = F.filter(windows, lambda w: w != "")
    return df.select(
        *[c for c in df.columns if c != "text"], F.posexplode(kept).alias("pos", "text")
    )


def chunk_recursive(
    df: DataFrame,
    size: int = PLAIN_SIZE,
    overlap: int = PLAIN_OVERLAP,
    separators: Iterable[str] = PLAIN_SEPARATORS,
) -> DataFrame:
    """Hierarchical splitter; adds ``pos`` and ``start`` (character offset)."""
    _check(size, overlap)
    rule = (size, overlap, tuple(separators))
    return _explode(df, lambda _: (rule, False), None)


def chunk_paged(df: DataFrame) -> DataFrame:
    """Splitter for page text: smaller chunks that prefer section marks."""
    return chunk_recursive(df, PAGED_SIZE, PAGED_OVERLAP, PAGED_SEPARATORS)


def split_markdown(df: DataFrame) -> DataFrame:
    """Cut at ``#``, ``##``, ``###`` lines; the header stays in its section.

    Adds h1, h2, h3 (the headers in force), ``pos`` and ``start``.
    """
    return _explode(df, lambda _: (None, True), None)


def split_documents(df: DataFrame) -> DataFrame:
    """Split every document by its format in one pass over the table.

    Markdown is cut at headers first and then by size, page text by the paged
    splitter, everything else by the plain one. ``chunk_index`` numbers a
    document's chunks in order; source ids are unique per document here (tables
    in which they are not use :func:`ragframe.functions.ids.with_chunk_index`).
    """
    plain = (PLAIN_SIZE, PLAIN_OVERLAP, PLAIN_SEPARATORS)
    paged = (PAGED_SIZE, PAGED_OVERLAP, PAGED_SEPARATORS)
    rules = {"md": (plain, True), "pdf": (paged, False), "other": (plain, False)}
    named = df.withColumn("_format", ids.doc_format(F.coalesce("source_id", F.lit(""))))
    return (
        _explode(named, rules.__getitem__, "_format")
        .drop("_format")
        .withColumnRenamed("pos", "chunk_index")
    )


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")


def _explode(df: DataFrame, rule_of, format_column: str | None) -> DataFrame:
    """Run the splitter over Arrow batches: one row per chunk, other columns kept."""
    kept = [f for f in df.schema.fields if f.name not in ("text", "h1", "h2", "h3")]
    names = [f.name for f in kept]
    schema = T.StructType(
        [
            *kept,
            T.StructField("h1", T.StringType()),
            T.StructField("h2", T.StringType()),
            T.StructField("h3", T.StringType()),
            T.StructField("pos", T.IntegerType(), False),
            T.StructField("start", T.IntegerType(), False),
            T.StructField("text", T.StringType(), False),
        ]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formats = batch.column(format_column).to_pylist() if format_column else None
            rows: list[int] = []
            out: list[tuple] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                rule, by_header = rule_of(formats[row] if formats else None)
                for pos, piece in enumerate(document_chunks(text or "", rule, by_header)):
                    rows.append(row)
                    out.append((pos, *piece))
                if len(out) >= _OUT_ROWS:
                    yield _batch(batch, names, rows, out)
                    rows, out = [], []
            if out:
                yield _batch(batch, names, rows, out)

    return df.mapInArrow(split, schema)


def _batch(batch: pa.RecordBatch, names: list[str], rows: list[int], out: list[tuple]):
    pos, start, text, h1, h2, h3 = zip(*out, strict=True)
    arrays = batch.select(names).take(pa.array(rows, pa.int64())).columns
    arrays += [pa.array(h, pa.string()) for h in (h1, h2, h3)]
    arrays += [pa.array(pos, pa.int32()), pa.array(start, pa.int32()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(
        arrays, names=[*names, "h1", "h2", "h3", "pos", "start", "text"]
    )


def document_chunks(text: str, rule, by_header: bool) -> Iterator[tuple]:
    """Chunks of one text as (start, stripped text, h1, h2, h3)."""
    sections = header_sections(text) if by_header else [((0, len(text)), (None, None, None))]
    for (lo, hi), headers in sections:
        spans = [(lo, hi)] if rule is None else sized_spans(text, lo, hi, *rule)
        for a, b in spans:
            piece = text[a:b]
            body = piece.lstrip(_BLANKS)
            start = b - len(body)
            body = body.rstrip(_BLANKS)
            if body:
                yield (start, body, *headers)


def header_sections(text: str) -> Iterator[tuple[Span, tuple]]:
    """Spans between header lines with the headers in force.

    A higher header ends the lower ones. Lines within code fences are no headers;
    a fence ends with the mark that opened it.
    """
    headers: list[str | None] = [None, None, None]
    begin = at = 0
    fence: str | None = None
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence is None:
            # a line that closes its own mark opens nothing
            if mark and line.count(mark.group(1)) == 1:
                fence = mark.group(1)
        elif mark and mark.group(1) == fence:
            fence = None
        found = None if fence else _HEADER.match(line)
        if found:
            if at > begin:
                yield (begin, at), tuple(headers)
            level = len(found.group(1))
            headers[level - 1] = (found.group(2) or "").strip(_BLANKS)
            headers[level:] = [None] * (3 - level)
            begin = at
        at += len(line) + 1
    yield (begin, len(text)), tuple(headers)


def sized_spans(
    text: str, lo: int, hi: int, size: int, overlap: int, separators: tuple[str, ...]
) -> Iterator[Span]:
    """Spans of at most ``size`` characters that cover ``text[lo:hi]``.

    The first separator that occurs is cut before each occurrence. Short pieces
    are packed together; a piece that is still too long is split on its own by
    the separators that follow.
    """
    for i, sep in enumerate(separators):
        if sep == "":
            yield from _windows(lo, hi, size, overlap)
            return
        if text.find(sep, lo, hi) >= 0:
            break
    else:
        yield (lo, hi)
        return
    run: list[Span] = []
    for a, b in _pieces(text, lo, hi, sep):
        if b - a <= size:
            run.append((a, b))
            continue
        yield from _pack(run, size, overlap)
        run = []
        yield from sized_spans(text, a, b, size, overlap, separators[i + 1 :])
    yield from _pack(run, size, overlap)


def _pieces(text: str, lo: int, hi: int, sep: str) -> Iterator[Span]:
    begin = lo
    at = text.find(sep, lo, hi)
    while at >= 0:
        if at > begin:
            yield (begin, at)
            begin = at
        at = text.find(sep, at + len(sep), hi)
    yield (begin, hi)


def _pack(pieces: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Join neighbours up to ``size``; reopen with trailing pieces within ``overlap``."""
    first = 0
    for i, (_, end) in enumerate(pieces):
        if end - pieces[first][0] <= size:
            continue
        stop = pieces[i][0]
        yield (pieces[first][0], stop)
        while first < i and (
            stop - pieces[first][0] > overlap or end - pieces[first][0] > size
        ):
            first += 1
    if pieces:
        yield (pieces[first][0], pieces[-1][1])


def _windows(lo: int, hi: int, size: int, overlap: int) -> Iterator[Span]:
    start = lo
    while True:
        end = min(start + size, hi)
        yield (start, end)
        if end == hi:
            return
        start = end - overlap

