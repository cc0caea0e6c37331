"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its shuffled documents. A document's virtual finish time is the number of words its queue
has sent up to its end, divided by the source's target, and a queue that is sent again starts over behind itself. All
copies are range-sorted by finish time and taken from the front until the budget, the words of the whole table, is
used. Cumulative sums over a source are sums over blocks of a hash of the document plus a sum within the block, so a
source with a third of all rows is spread over as many tasks as any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import WORD, saved
from ragframe.settings import BROADCAST_ROWS

# Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)

# A document is taken this often at most.
MOST_COPIES = 3

# Rows of a source and block that one window sorts, on average over the blocks of the whole table.
BLOCK_ROWS = 2_000

HASH_DIGITS = 15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """A whole number below 2**60 that puts documents in a random but repeatable order."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, HASH_DIGITS), 16, 10).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, rank, source_size, target): shares by weight, at most MOST_COPIES times the size.

    What a source cannot take is reshared by weight. In the order of size per weight, a source is at its limit if its
    fair share of what the sources before it leave is at least the limit; the others share what is left.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.get(weights, (F.col("rank") - 1) % len(WEIGHTS)).cast("double"))
    limit = F.col("source_size") * MOST_COPIES
    by_room = Window.orderBy((limit / F.col("weight")).asc(), F.col("rank"))
    before = F.coalesce(F.sum(limit).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (total - before) / left)
    free = F.when(limit > F.col("level") * F.col("weight"), F.struct(F.col("source_size") * MOST_COPIES / F.col("weight"), "rank", "level"))
    ranked = ranked.withColumn("fair", F.min(free).over(Window.partitionBy())["level"])
    target = F.coalesce(F.least(limit.cast("double"), F.col("fair") * F.col("weight")), limit.cast("double"))
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def _queued(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document with its place in its source's queue and how often the mix takes it, and the sources' targets."""
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("h")
    )
    sized = saved(sized, "mix-sizes")
    targets = saved(source_targets(sized), "mix-targets")
    same = sized["source"].eqNullSafe(targets["source"])
    sized = sized.join(targets, same).select("doc_id", "size", "h", "rank", "source_size", "target")

    # hash blocks of about BLOCK_ROWS rows
    digits = max(1, (sized.count() // BLOCK_ROWS).bit_length() // 4 + 1)
    sized = sized.withColumn("block", F.shiftright("h", 4 * (HASH_DIGITS - digits)))
    blocks = sized.groupBy("rank", "block").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("rank", "block", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("rank", "block").orderBy("h", "doc_id", "size")
    sent = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    queued = sized.join(blocks, ["rank", "block"]).withColumn("sent", sent)
    queued = saved(queued.drop("block", "before"), "mix-queue")
    return queued.withColumn("times", _times(_cutoff(queued))), targets


def _finish(copy: Column) -> Column:
    return (F.col("sent") + copy * F.col("source_size")) / F.col("target")


def _cutoff(queued: DataFrame):
    """The last (finish time, rank) that still fits the budget; None if nothing does."""
    copies = queued.where("size > 0 and target > 0").withColumn(
        "copy", F.explode(F.array(*[F.lit(i) for i in range(MOST_COPIES)]))
    )
    copies = copies.select(_finish(F.col("copy")).alias("finish"), "rank", "size")
    ordered = copies.repartitionByRange("finish", "rank").withColumn("part", F.spark_partition_id())
    ordered = saved(ordered, "mix-order")
    parts = ordered.groupBy("part").agg(F.sum("size").alias("words"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"), "words")
    budget = queued.agg(F.sum("size")).first()[0] or 0
    # whole parts below the budget need no sorting; the part in which it ends does
    crossing = parts.where((F.col("before") <= budget) & (F.col("before") + F.col("words") > budget))
    within = Window.partitionBy("part").orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0)
    edge = ordered.join(crossing, "part").withColumn("total", F.sum("size").over(within) + F.col("before"))
    full = ordered.join(parts.where(F.col("before") + F.col("words") <= budget), "part")
    taken = edge.where(F.col("total") <= budget).select("finish", "rank").unionByName(full.select("finish", "rank"))
    last = taken.agg(F.max(F.struct("finish", "rank")).alias("last")).first()["last"]
    return (last["finish"], last["rank"]) if last else None


def _times(cutoff) -> Column:
    if cutoff is None:
        return F.lit(0).cast("long")
    finish, rank = (F.lit(x) for x in cutoff)
    taken = F.lit(0).cast("long")
    for i in range(MOST_COPIES):
        end = _finish(F.lit(i))
        fits = (F.col("size") > 0) & ((end < finish) | ((end == finish) & (F.col("rank") <= rank)))
        taken = taken + F.coalesce(fits, F.lit(False)).cast("long")
    return taken


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken.

    Null texts have no words; null sources are one source, the last. Documents without words are never taken. Rows
    that are equal in all three columns queue one behind the other. Other columns are ignored.
    """
    queued, _ = _queued(docs)
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def take_mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row as often as it is taken, with all its columns.

    Rows that are equal in doc_id, source and text are taken as often as the one of them taken most.
    """
    queued, targets = _queued(docs)
    # later in a queue means taken less often, so the last key that is taken so often says it for the whole source
    most = [F.max(F.when(F.col("times") > i, F.col("h"))).alias(f"upto_{i}") for i in range(MOST_COPIES)]
    limits = queued.where("times > 0").groupBy("rank").agg(*most)
    limits = saved(limits.join(targets.select("rank", F.col("source").alias("of")), "rank").drop("rank"), "mix-limits")
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    key = shuffle_key(F.col("doc_id"), F.col("text"))
    rows = docs.where(word_count(F.col("text")) > 0).select(F.struct("*").alias("row"), key.alias("h"))
    rows = rows.join(limits, F.col("row.source").eqNullSafe(F.col("of")))
    times = sum((F.coalesce(F.col("h") <= F.col(f"upto_{i}"), F.lit(False)).cast("int") for i in range(MOST_COPIES)), F.lit(0))
    rows = rows.select("row", F.filter(F.sequence(F.lit(1), F.lit(MOST_COPIES)), lambda i: i <= times).alias("copies"))
    return rows.select("row", F.explode("copies")).select("row.*")


ORACLE = """
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
        substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15) as h from documents),
sizes as (select source, sum(size)::bigint as s from sized group by 1),
ranked as (select source, s, row_number() over (order by source nulls last) as rank,
    (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from sizes),
levels as (select *, ((select sum(s) from sizes)
      - coalesce(sum(3 * s) over (order by 3 * s / w::double, rank rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by 3 * s / w::double, rank rows between current row and unbounded following)::double as level
    from ranked),
fair as (select arg_min(level, (3 * s / w::double, rank)) as f from levels where 3 * s > level * w),
targets as (select source, rank, s, coalesce(least(3 * s::double, f * w), 3 * s::double) as target from levels, fair),
queued as (select doc_id, size::bigint as size, s, target, rank,
    sum(size) over (partition by rank order by h, doc_id, size rows unbounded preceding) as sent
    from sized join targets on sized.source is not distinct from targets.source),
copies as (select doc_id, size, rank, sent, (sent + c * s)::double / target as finish
    from queued, (values (0), (1), (2)) v(c) where size > 0 and target > 0),
ordered as (select *, sum(size) over (order by finish, rank rows unbounded preceding) as total from copies),
taken as (select rank, sent, sum(size)::bigint as words from ordered
    where total <= (select sum(size) from sized) group by 1, 2)
select doc_id, size, s as source_size, target, coalesce(words, 0)::bigint as taken
from queued left join taken using (rank, sent)
"""
