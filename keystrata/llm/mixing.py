"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash and queued again and again,
three times at most, each in pieces of at most ``PIECE`` words, as packets are.
A piece's virtual finish time is the words that its source has queued up to its
end, divided by the source's target.  The pieces of all sources are range-sorted
by finish time, words are added up in that order, and the mix ends where they
reach the total budget: the piece that crosses it is cut.  So each source is
served in proportion to its target, and is a piece or so away from it at the end.

Both running sums, of a source's words in shuffled order and of all words in
order of finish, are made in range partitions; what one row for each partition
says about its end is added up on the driver.  So no task sees a whole source.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; sources without words have target 0; pieces
that finish together go by source, then by place in it.  Rows alike in id,
source and text are shuffled apart and share evenly what the mix takes of them;
rows that share an id or have none are documents of their own.  Very long texts
are counted in one scan.  An empty table gives an empty mix.  Only ``doc_id``,
``source`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize, unused

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Words of a piece.
PIECE = 64
#: Rows that are alike are numbered in stretches of so many.
STRETCH = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words between ASCII white space: the number of places where one starts."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, mark, n``: rows alike in id, source and text, counted; ``mark`` tells texts apart."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _mark(F.col("text")).alias("mark"))
    return materialize(rows.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n")), "sizes")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, nr, source_size, target`` by source: shares of all words by weight, stopped at ``most`` times the size.

    ``sizes``: ``source, size`` and, if rows are counted, ``n``.  Filling in order of size by weight settles the
    resharing: the first sources reach their stop, and the level at which the others share the rest is the one below
    the next source's stop.
    """
    words = F.col("size") * F.col("n") if "n" in sizes.columns else F.col("size")
    totals = sizes.groupBy("source").agg(F.sum(words).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    named = totals.withColumn("nr", F.row_number().over(by_name).cast("long"))
    named = named.withColumn("weight", F.element_at(cycle, ((F.col("nr") - 1) % len(weights) + 1).cast("int")))
    stop = most * F.col("source_size")
    by_stop = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("nr").asc())
    before, after, every = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(stop).over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = named.withColumn("level", level).withColumn("stops", stop <= F.col("level") * F.col("weight"))
    # Once a source stays below its stop, so do all after it, at the level of the first of them, which is the highest.
    rest = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    held = filled.withColumn("target", F.when(F.col("stops"), stop.cast("double")).otherwise(rest * F.col("weight")))
    return held.select("source", "nr", "source_size", F.least(F.coalesce("target", F.lit(0.0)), stop.cast("double")).alias("target"))


def _counted_out(rows: DataFrame, name: str) -> DataFrame:
    """Each row ``n`` times, numbered by ``name``; the stretches of a large ``n`` are dealt over tasks."""
    last = F.col("n") - 1
    if (rows.agg(F.max("n")).first()[0] or 0) <= STRETCH:
        return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(STRETCH).cast("long")))).repartition("mark", "doc_id", "from")
    return parts.withColumn(name, F.explode(F.sequence("from", F.least(F.col("from") + (STRETCH - 1), last)))).drop("from")


def _summed(rows: DataFrame, by: list[str], of: str, group: str | None, label: str) -> DataFrame:
    """``rows``, written in the order of ``by``, with ``part``, the number of the range that holds them, and ``ahead``,
    the sum of ``of`` over the rows before them in it (of the same ``group``, the first of ``by``)."""
    names = [*rows.columns, "part", "ahead"]
    at, held = rows.columns.index(of), rows.columns.index(group) if group else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(at).to_numpy()
            ahead = np.cumsum(size) - size
            if held is None:
                out, total = ahead + total, total + int(size.sum())
            else:
                of_group = batch.column(held).to_numpy()
                starts = np.flatnonzero(np.r_[of_group[0] != last, of_group[1:] != of_group[:-1]])
                run_of = np.cumsum(np.r_[0, of_group[1:] != of_group[:-1]])
                firsts = np.r_[0, starts[starts > 0]]
                out = ahead - ahead[firsts][run_of] + np.where(run_of == 0, total if of_group[0] == last else 0, 0)
                total, last = int(out[-1] + size[-1]), of_group[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(out.astype(np.int64))], names)

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, f"{kinds}, part int, ahead bigint"), label)


def _queued(members: DataFrame, seed: int) -> DataFrame:
    """Documents with words, each by itself, with ``before``: the words queued ahead of it in one round of its source."""
    single = _counted_out(members.where("size > 0 and target > 0"), "k").withColumn("spread", F.xxhash64(F.lit(seed), "doc_id", "mark", "k"))
    rows = _summed(single.drop("n"), ["nr", "spread", "doc_id", "mark", "size", "k"], "size", "nr", "order")
    # One row for each range: the words of its first source that lie in earlier ranges.
    ends = rows.groupBy("part").agg(F.min("nr").alias("first"), F.max(F.struct("nr", (F.col("ahead") + F.col("size")).alias("words"))).alias("last")).orderBy("part").collect()
    held, words, more = None, 0, []
    for r in ends:
        more.append((r.part, r.first, words if r.first == held else 0))
        words = r["last"].words + (words if r["last"].nr == held == r.first else 0)
        held = r["last"].nr
    spark = members.sparkSession
    carried = spark.createDataFrame(more, "part int, nr bigint, carried bigint")
    return rows.join(F.broadcast(carried), ["part", "nr"], "left").withColumn("before", F.col("ahead") + F.coalesce("carried", F.lit(0))).drop("part", "ahead", "carried", "k", "spread")


def schedule(members: DataFrame, seed: int = 0, most: int = MOST_COPIES) -> DataFrame:
    """The mix, piece by piece in order of finish: ``doc_id, nr, size, mark, finish, words, taken``.

    ``members``: ``sized`` rows with ``nr, source_size, target`` of their source.
    """
    spark = members.sparkSession
    queued = materialize(_queued(members, seed), "queue")
    plan = members.groupBy("nr").agg(F.max("source_size").alias("z"), F.max("target").alias("t")).where("z > 0")
    budget, free, room = plan.agg(F.sum("z"), F.sum((F.col("t") < most * F.col("z")).cast("int")), F.sum(F.when(F.col("t") < most * F.col("z"), F.col("t")))).first()
    budget, until = budget or 0, 1 + ((free or 0) * (PIECE + 1)) / max(room or 0, 1)
    while True:
        # Pieces that finish by ``until``; if their words reach the budget, no other piece is in the mix.
        end = F.col("target") * until
        copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("start", F.col("copy") * F.col("source_size") + F.col("before")).where(F.col("start") < end)
        pieces = copies.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PIECE).cast("long"))))
        pieces = pieces.withColumn("start", F.col("start") + F.col("at")).withColumn("words", F.least(F.lit(PIECE).cast("long"), F.col("size") - F.col("at")))
        pieces = pieces.withColumn("finish", (F.col("start") + F.col("words")) / F.col("target")).where(F.col("finish") <= until)
        mix = _summed(pieces.select("doc_id", "nr", "size", "mark", "finish", "start", "words"), ["finish", "nr", "start"], "words", None, "mix")
        ends = mix.groupBy("part").agg(F.sum("words").alias("words")).orderBy("part").collect()
        if sum(r.words for r in ends) >= budget:
            break
        until *= 2
    offsets = np.cumsum([0, *(r.words for r in ends)]).tolist()
    carried = spark.createDataFrame([(r.part, n) for r, n in zip(ends, offsets, strict=False)], "part int, carried bigint")
    left = F.lit(budget) - F.col("ahead") - F.col("carried")
    rows = mix.join(F.broadcast(carried), "part").withColumn("taken", F.least(left, F.col("words")).cast("long")).where("taken > 0")
    return rows.select("doc_id", "nr", "size", "mark", "finish", "words", "taken")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, mark, n, source_size, target, taken``: rows alike in id, source and text, and what the mix takes of them."""
    sizes = sized(docs)
    plan = materialize(targets(sizes), "targets").withColumnRenamed("source", "of")
    members = materialize(sizes.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "members")
    none = members.select("doc_id", "nr", "size", "mark", "source", "n", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    some = schedule(members, seed).select("doc_id", "nr", "size", "mark", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "taken")
    put = none.unionByName(some).groupBy("doc_id", "nr", "size", "mark")
    return put.agg(F.max("source").alias("source"), F.sum("n").alias("n"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken")).drop("nr")


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The query's rows: what the mix takes of each document.  Rows that are alike share it, as evenly as whole words go."""
    rows = _counted_out(materialize(mixed(docs, seed), "mixed"), "k")
    share = F.floor(F.col("taken") / F.col("n")) + F.when(F.col("k") < F.col("taken") % F.col("n"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))


def mix_texts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` that the mix takes words of, with ``taken``, their number, repeats counted, and ``taken_rows``, the number of rows
    alike in id, source and text that share it: one of them stays.  A name that ``docs`` has gets an underscore."""
    own: dict[str, str] = {}
    for c in ("taken", "taken_rows", "doc_id", "source", "mark"):
        own[c] = unused([*docs.columns, *own.values()], c if c.startswith("taken") else f"mix_{c}")
    rows = mixed(docs, seed).where("taken > 0").withColumnRenamed("n", "taken_rows")
    rows = materialize(rows.select(*(F.col(c).alias(name) for c, name in own.items())), "taken")
    mark = unused([*docs.columns, *own.values()], "mark")
    left = docs.withColumn(mark, _mark(F.col("text")))
    met = left.join(rows, left.doc_id.eqNullSafe(rows[own["doc_id"]]) & left.source.eqNullSafe(rows[own["source"]]) & (left[mark] == rows[own["mark"]]))
    if not rows.where(F.col(own["taken_rows"]) > 1).isEmpty():
        met = met.dropDuplicates(["doc_id", "source", mark])
    return met.select(*docs.columns, own["taken"], own["taken_rows"])
