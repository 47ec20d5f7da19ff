"""Mixing sources to target weights along a training curriculum that changes over time."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import fresh, partitions, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Weight at the start and at the end of training, linear in between: level, rising, falling, repeating as WEIGHTS do.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
CAP = 3


def _cycle(values: Sequence, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank, len(values)) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also start and end of the schedule, target, words (the target as a whole number).

    Sources by code point, null last, weigh `weights` in turn and share all words; a target stops at `cap` times its
    source's size and the rest is shared by weight. That is one level for all that are not capped: with sources sorted
    by cap / weight, the first level that its own source can take. One row per source; windows run on these rows.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumns({"weight": _cycle(weights, F.col("rank")), "most": F.col("source_size") * cap, "total": F.sum("source_size").over(Window.partitionBy())})
    s = s.withColumn("room", F.col("most") / F.col("weight"))
    s = s.withColumns({"before": F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                       "left": F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    s = s.withColumn("level", F.first(F.when(F.col("level") <= F.col("room"), F.col("level")), ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
    pair = _cycle([list(p) for p in schedules], F.col("rank"))
    return s.select("source", "source_size", pair[0].alias("w0"), pair[1].alias("w1"), "target", F.floor(F.col("target") + 0.5).alias("words"))


def position_at(offset: Column, words: Column, w0: Column, w1: Column) -> Column:
    """When in training, from 0 to 1, a source whose weight runs from w0 to w1 has used `offset` of its `words`.

    The integral of the schedule is u = p t + (q - p) t^2 / 2 with p, q the weights over their mean; solved for t.
    """
    u, p, q = offset / words, 2 * w0 / (w0 + w1), 2 * w1 / (w0 + w1)
    return 2 * u / (p + F.sqrt(p * p + 2 * (q - p) * u))


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """All columns of `docs` and the struct `mix`: size, source_size, target, taken, position (null where nothing is taken).

    A source's documents queue by the md5 of their id (size breaks ties; a null id counts as empty). Its target is
    served by going through the queue again and again, the last time as far as the words last, so the taken words of a
    source are its target to the word and a document is taken `cap` times at most. `position` is where the document
    first stands in training: its source's demand, integrated over time, reaches the words queued before it there.
    The queue is cut by the first three hex digits: totals per (source, cut) are small, and a hot source is spread over
    4096 groups. `size` is the words of a row; null sources are a source of their own; an empty table gives an empty one.
    """
    name = fresh(docs, "mix")
    key = F.md5(F.coalesce(docs[doc_id].cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source].alias("source"), key.alias("key"), F.substring(key, 1, 3).alias("cut"), size.alias("size"))
    light = docs.select(docs[source].alias("source"), F.substring(key, 1, 3).alias("cut"), size.alias("size"))
    cuts = light.groupBy("source", "cut").agg(F.sum("size").alias("held"))
    targets = source_targets(cuts.groupBy("source").agg(F.sum("held").alias("source_size")), **options)
    w = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("skip", F.coalesce(F.sum("held").over(w), F.lit(0))).drop("held")
    plan = cuts.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "cut", "skip", "source_size", "w0", "w1", "target", "words")
    inside = Window.partitionBy("source", "cut").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    got = queued.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.cut") == F.col("p.cut")))
    offset = F.col("ahead") + F.col("skip")
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    rest = F.col("words") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - offset))
    got = got.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"), offset.alias("offset"), "words", "w0", "w1")
    at = F.when(F.col("taken") > 0, position_at(F.col("offset"), F.col("words"), F.col("w0"), F.col("w1")))
    return got.select("row.*", F.struct("size", "source_size", "target", "taken", at.alias("position"), "offset", "words", "w0", "w1").alias(name))


def in_order(df: DataFrame, position: Column) -> DataFrame:
    """Range-sort by training position: part files in turn are the order; rows without a position come last, spread by a hash."""
    name = fresh(df, "at")
    df = df.withColumn(name, F.coalesce(position, 2 + unit_hash(F.col(df.columns[0]).cast("string"), 1)))
    return df.repartitionByRange(partitions(df.sparkSession), name).sortWithinPartitions(name).drop(name)


def curriculum(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The training stream: the columns of `docs`, each document once per time it is taken, sorted by position.

    A copy that the mix takes in part, one a source at most, has that many words, joined by single spaces.
    """
    name = fresh(docs, "mix")
    mixed = mix(docs, word_count(text), doc_id, source, **options).where(F.col(name)["taken"] > 0)
    times = fresh(mixed, "times")
    copies = mixed.withColumn(times, F.explode(F.sequence(F.lit(0), F.expr(f"cast(({name}.taken - 1) div {name}.size as int)"))))
    m, part = F.col(name), F.least(F.col(name)["size"], F.col(name)["taken"] - F.col(times) * F.col(name)["size"])
    words = F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), 0), 1, part.cast("int"))
    cut = F.when(part == m["size"], F.col(text)).otherwise(F.array_join(words, " "))
    at = position_at(m["offset"] + F.col(times) * m["source_size"], m["words"], m["w0"], m["w1"])
    return in_order(copies.withColumn(text, cut), at).select(*docs.columns)
