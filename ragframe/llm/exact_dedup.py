"""Exact deduplication by an extendible-hash index on shared files.

The index maps a normalised text to the smallest id that has it. Its directory is addressed by the leading bits of the
text's SHA-256; it is doubled as long as a bucket holds more than ``BUCKET_BYTES``, so an overfull bucket splits and the
others keep their depth. An owner task gets a contiguous range of buckets, reads its entries in key order and chains
those with an equal key, comparing bytes. Entries of one scan task with equal texts are merged before they move, so a
text that a third of all rows share arrives once per scan task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.llm.common import Batches, may_hold, membership, raw_text, saved, text_batches, with_text_column

# A bucket with more bytes of text splits.
BUCKET_BYTES = 8 << 20

# Deepest directory: 2**18 entries, so directory and histogram are bounded. Buckets at this depth grow beyond
# BUCKET_BYTES and are still read as a sorted stream.
MAX_DEPTH = 18

# A scan task hands on its merged entries when it holds this much text, so many at once.
COMBINE_BYTES, COMBINE_ROWS = 16 << 20, 1_000

KEY_BITS = 63

# Hexadecimal digits of a digest that its place in a membership filter follows from.
HEAD_DIGITS = 15


def normalised(raw: bytes) -> bytes:
    """Every run of ASCII white space becomes one space."""
    words = b" ".join(raw.split())
    if not words:
        return b" " if raw else b""
    head = b" " if raw[:1].isspace() else b""
    return head + words + (b" " if raw[-1:].isspace() else b"")


def exact_groups(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text): one row per distinct text.

    Columns: text_sha256, keep_id (smallest id, nulls last), keep_rows (rows that have this id), group_size.
    """
    entries = saved(_combined(docs), "exact-entries")
    owner_of, owners = _directory(entries)
    placed = entries.withColumn("owner", _owner(owner_of)(F.col("hash_key")))
    index = placed.repartitionById(owners, F.col("owner")).sortWithinPartitions("hash_key", "text_sha256")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    index = index.mapInArrow(_chain, f"text_sha256 string, keep_id {id_type}, keep_rows bigint, group_size bigint")
    return saved(index, "exact-index")


def mark_exact(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the smallest doc_id is kept, a null id only where all are
    null; of rows that share this id as well (repeated rows) exactly one is kept. Other columns are ignored.
    """
    digest = F.col("text_sha256")
    digests = saved(_with_digest(docs.select("doc_id", "text")).select("doc_id", "digest.text_sha256"), "exact-digests")
    joined = digests.join(exact_groups(docs), "text_sha256")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    tied = first & (F.col("keep_rows") > 1)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    single = joined.where(~tied).withColumn("kept", first).select(columns)
    # repeated rows are counted, then told apart by a number
    repeats = joined.where(tied).groupBy("doc_id", "keep_id", "group_size", digest).agg(F.count(F.lit(1)).alias("rows"))
    repeats = repeats.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("number"))
    return single.unionByName(repeats.withColumn("kept", F.col("number") == 1).select(columns))


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`mark_exact` does not keep; all columns stay."""
    index = exact_groups(docs)
    repeated = index.where("group_size > 1")
    head = F.conv(F.substring("text_sha256", 1, HEAD_DIGITS), 16, 10).cast("bigint")
    suspects = membership(repeated.select(head.alias("head")), hashed=True)
    rows = _with_digest(docs.select(F.struct("*").alias("row"), "doc_id", "text"), suspects)
    rows = rows.select("row", "doc_id", "digest.*")
    # texts outside the filter occur once; only the others move
    keep = repeated.select("text_sha256", "keep_rows", "keep_id")
    known = rows.where("suspect").join(keep, "text_sha256", "left")
    known = known.where(F.col("keep_rows").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    tied = known.where("keep_rows > 1").dropDuplicates(["text_sha256"])
    known = known.where("coalesce(keep_rows, 1) = 1")
    parts = [part.select("row.*") for part in (rows.where("not suspect"), known, tied)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _with_digest(rows: DataFrame, suspects: np.ndarray | None = None) -> DataFrame:
    """``rows`` with ``digest``: text_sha256 of the normalised ``text``, and whether ``suspects`` may hold its head."""

    def start():
        def digests(texts: pa.Array) -> pa.Array:
            found = [hashlib.sha256(normalised(t)).hexdigest() for t in texts.to_pylist()]
            if suspects is None:
                held = np.zeros(len(found), bool)
            else:
                held = may_hold(suspects, np.array([int(d[:HEAD_DIGITS], 16) for d in found], np.int64))
            return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(held)], ["text_sha256", "suspect"])

        return digests

    return with_text_column(rows, "digest", "struct<text_sha256:string,suspect:boolean>", start, raw_text())


def _combined(docs: DataFrame) -> DataFrame:
    """Entries of the index, equal texts of a scan task merged: (hash_key, digest, body, ids)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def combine(batches: Batches) -> Batches:
        held: dict[bytes, list] = {}
        size, kind = 0, None

        def merged() -> Batches:
            bodies = list(held)
            for start in range(0, len(bodies), COMBINE_ROWS):
                part = bodies[start : start + COMBINE_ROWS]
                keys = [hashlib.sha256(body) for body in part]
                values = [held.pop(body) for body in part]
                columns = [
                    pa.array([int.from_bytes(k.digest()[:8], "big") >> (64 - KEY_BITS) for k in keys], pa.int64()),
                    pa.array([k.hexdigest() for k in keys], pa.string()),
                    pa.array(part, pa.binary()),
                    *(pa.array([v[i] for v in values], t) for i, t in enumerate((kind, pa.int64(), pa.int64()))),
                ]
                names = ["hash_key", "text_sha256", "body", "keep_id", "keep_rows", "group_size"]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = normalised(raw)
                if (entry := held.get(body)) is None:
                    held[body] = [doc_id, 1, 1]
                    size += len(body) + 200
                else:
                    _merge(entry, doc_id, 1, 1)
            if size >= COMBINE_BYTES:
                yield from merged()
                size = 0
        yield from merged()

    schema = f"hash_key bigint, text_sha256 string, body binary, keep_id {id_type}, keep_rows bigint, group_size bigint"
    return text_batches(docs.select("doc_id", raw_text().alias("raw")), combine, schema)


def _merge(entry: list, keep_id, keep_rows: int, group_size: int) -> None:
    """Add rows of the same text to an entry [keep_id, keep_rows, group_size]; null ids are the largest."""
    entry[2] += group_size
    if keep_id == entry[0]:
        entry[1] += keep_rows
    elif entry[0] is None or (keep_id is not None and keep_id < entry[0]):
        entry[0], entry[1] = keep_id, keep_rows


def split_directory(loads: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Double the directory until no bucket above ``capacity`` can still split.

    ``loads`` has the bytes of each of the 2**k deepest prefixes. Returns the bucket of each directory entry and the
    global depth; buckets are numbered in key order.
    """
    deepest = int(loads.size).bit_length() - 1
    starts, depth, level = np.zeros(1, np.int64), 0, 0
    local = np.zeros(1, np.int64)
    while True:
        cells = loads.reshape(1 << level, -1).sum(axis=1)
        full = (local == level) & (cells[starts >> (deepest - level)] > capacity)
        if level == deepest or not full.any():
            break
        half = 1 << (deepest - level - 1)
        local = local + full
        starts = np.concatenate([starts, starts[full] + half])
        local = np.concatenate([local, local[full]])
        order = np.argsort(starts)
        starts, local, level = starts[order], local[order], level + 1
        depth = level
    entries = np.arange(1 << depth, dtype=np.int64) << (deepest - depth)
    return np.searchsorted(starts, entries, side="right") - 1, depth


def _directory(entries: DataFrame) -> tuple[np.ndarray, int]:
    """The owner task of each directory entry, from a histogram of at most 2**MAX_DEPTH prefixes."""
    prefix = F.shiftright("hash_key", KEY_BITS - MAX_DEPTH).cast("int").alias("prefix")
    sizes = entries.groupBy(prefix).agg(F.sum(F.length("body") + F.lit(100)).alias("size")).toArrow()
    loads = np.zeros(1 << MAX_DEPTH, np.int64)
    loads[sizes.column("prefix").to_numpy()] = sizes.column("size").to_numpy()
    buckets, depth = split_directory(loads, BUCKET_BYTES)
    held = np.bincount(buckets, loads.reshape(1 << depth, -1).sum(axis=1))
    # neighbouring small buckets share an owner
    owner = (np.cumsum(held) - held) // BUCKET_BYTES
    owner = np.unique(owner, return_inverse=True)[1]
    return owner[buckets].astype(np.int32), int(owner.max()) + 1


def _owner(owner_of: np.ndarray):
    shift = KEY_BITS - (int(owner_of.size).bit_length() - 1)

    @F.arrow_udf(T.IntegerType())
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(owner_of[keys.to_numpy() >> shift])

    return place


def _chain(batches: Batches) -> Batches:
    """Entries in key order -> one row per distinct text; equal keys are chained and told apart by their bytes."""
    key, chain = None, []

    def closed(out: list) -> None:
        out.extend((digest, *entry) for _, digest, entry in chain)

    kind = pa.int64()
    for batch in batches:
        out: list[tuple] = []
        kind = batch.column("keep_id").type
        names = ("hash_key", "text_sha256", "body", "keep_id", "keep_rows", "group_size")
        for k, digest, body, *ids in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if k != key:
                closed(out)
                key, chain = k, []
            for known, _, entry in chain:
                if known == body:
                    _merge(entry, *ids)
                    break
            else:
                chain.append((body, digest, ids))
        yield _index_batch(out, kind)
    out = []
    closed(out)
    yield _index_batch(out, kind)


def _index_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.string(), kind, pa.int64(), pa.int64())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["text_sha256", "keep_id", "keep_rows", "group_size"])


ORACLE = """
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
    row_number() over (partition by body order by doc_id) = 1 as kept, sha256(body) as text_sha256
from texts window w as (partition by body)
"""
