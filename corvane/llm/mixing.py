"""Mixing sources to target weights: a curriculum whose weights change over the training run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import durable
from corvane.llm.common import SPACES

#: Each weight's demand at the run's begin and end against its mean: light sources fade, heavy ones grow.
SCHEDULE = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}
#: Sources that are broadcast at most: a row of them takes less than 100 bytes.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for a null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """A row per source: no (from 0), source, source_size, n_docs, weight, total and target, the words the mix takes of it.

    Sources by code point, null last, get the weights in turn and share the sum of all sizes. No target lies
    above max_repeat times its source's size; what is above goes to the others by weight. In order of
    max_repeat * size / weight, a source is at its bound exactly if that is at most what would be left for
    each unit of weight from it on, so running sums give the result without a loop. These windows are over
    sources, not documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    number = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("long")
    weighted = sources.withColumn("no", number).withColumn("weight", turn).withColumn("_cap", max_repeat * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("_full", "no").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda x: F.sum(x).over(everything) - F.coalesce(F.sum(x).over(before), F.lit(0))
    words = F.sum("source_size").over(everything)
    leveled = weighted.withColumns({"total": words, "_level": (words - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / left("weight")})
    capped = F.col("_full") <= F.col("_level")
    shared = leveled.withColumn("_open", F.min(F.when(~capped, F.struct("_full", "no", "_level"))).over(everything))
    target = F.when(capped, F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("_open._level"))
    return shared.select("no", "source", "source_size", "n_docs", "weight", "total", target.alias("target"))


def inverse_demand(share: Column, begin: Column, end: Column) -> Column:
    """The time in 0..1 by which this share of a source's target is demanded.

    A weight that moves linearly from begin to end (mean 1) has demanded begin*t + (end - begin)*t*t/2 by t.
    """
    bend = (end - begin) / 2
    root = F.sqrt(F.greatest(begin * begin + 4 * bend * share, F.lit(0.0)))
    return F.when(F.abs(bend) < 1e-12, share / begin).otherwise((root - begin) / (2 * bend))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """A row per document: doc_id, source, size, a hash of the id (52 bits), one of the text, and more."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hashed.alias("_hash"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_version"), *more)


def _placed(docs: DataFrame, weights: Sequence[int], max_repeat: int, *more: Column) -> DataFrame:
    """A row per document with its source's figures and at, the words before it in its source's stream; and with more, as it is."""
    sized = durable(_sized(docs))
    targets = durable(source_targets(sized, weights, max_repeat).withColumnRenamed("source", "_source"))
    if targets.count() <= BROADCAST_SOURCES:  # else Spark shuffles, and splits a source with very many rows
        targets = F.broadcast(targets)
    ranges = F.ceil(2 * F.sqrt(F.col("n_docs")))
    known = lambda rows: rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_range", F.floor(F.col("_hash") / F.lit(float(1 << 52)) * ranges).cast("long"))
    earlier = Window.partitionBy("no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = known(sized).groupBy("no", "_range").agg(F.sum("size").alias("_sum"))
    starts = sums.select("no", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("no", "_range").orderBy("_hash", "doc_id", "_version").rowsBetween(Window.unboundedPreceding, -1)
    summed = known(_sized(docs, *more) if more else sized).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return summed.join(starts, ["no", "_range"]).withColumn("at", F.col("_start") + F.col("_inside"))


def _planned(docs: DataFrame, weights: Sequence[int], max_repeat: int, schedule: dict[int, tuple[float, float]], *more: Column) -> DataFrame:
    size, at, whole, need = F.col("size"), F.col("at"), F.col("source_size"), F.floor("target").cast("long")
    rounds = F.when(whole > 0, F.least(F.floor(need / whole), F.lit(max_repeat))).otherwise(F.lit(0)).cast("long")
    rest = need - F.col("_rounds") * whole - at
    side = lambda k: F.element_at(F.create_map(*(F.lit(x) for w, ends in schedule.items() for x in (w, float(ends[k])))), F.col("weight").cast("int"))
    planned = _placed(docs, weights, max_repeat, *more).withColumn("_rounds", rounds).withColumn("_part", F.greatest(F.lit(0), F.least(size, rest)).cast("long"))
    empty = ((F.col("_rounds") > 0) | (rest > 0) | (whole == 0)).cast("int")  # a document without words, once if the stream comes by it
    return planned.withColumns(
        {
            "taken": F.col("_rounds") * size + F.col("_part"),
            "copies": F.when(size > 0, F.col("_rounds") + (2 * F.col("_part") >= size).cast("int")).otherwise(empty).cast("int"),
            "_begin": side(0),
            "_end": side(1),
        }
    )


def _position(passes: Column) -> Column:
    """The training position of a document's pass (0 for the first), in words of the whole mix."""
    share = F.when(F.col("target") > 0, (passes * F.col("source_size") + F.col("at")) / F.col("target")).otherwise(F.lit(0.0))
    return inverse_demand(share, F.col("_begin"), F.col("_end")) * F.col("total") + 0.0  # no negative zero


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, schedule: dict[int, tuple[float, float]] = SCHEDULE) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, copies, first_at, range-sorted by first_at.

    A source's documents, in the order of a hash of their ids, form its stream of words, which starts again at
    its end; the mix takes the stream's first floor(target) words. taken: the document's words in them, at
    most max_repeat times its size. copies: its passes, counting one that is cut if at least half of it is
    taken; a document without words counts once where the stream comes by it. first_at: the training position, in words of the whole mix, at which it first comes up under its
    source's weight schedule; null if never, and those documents come last. Reruns agree: nothing is drawn at
    random.

    Nulls and ties: a null text has size 0; a null source is one source, the last; a null id hashes as an
    empty one. Repeated rows are documents of their own, side by side in the stream. An empty table gives no
    row. Other columns of docs are not read.

    Sizes are written once to the shared folder, so that texts are read once. A source of n documents is cut
    into about 2*sqrt(n) ranges of the hash: running sums are made over ranges, then inside each, so that no
    task holds a source.
    """
    planned = _planned(docs, weights, max_repeat, schedule).withColumn("first_at", F.when(F.col("taken") > 0, _position(F.lit(0))))
    order = F.coalesce("first_at", (F.col("total") + F.col("at")).cast("double"))
    ordered = planned.withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order")
    return ordered.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "first_at")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, schedule: dict[int, tuple[float, float]] = SCHEDULE) -> DataFrame:
    """The mix itself: each row of docs as often as mix() says (copies), all its columns, range-sorted by training position.

    Rows with no copy are not in it: those that the mix takes less than half of. Null and empty texts are in it
    once if the mix takes any word of their source at or behind their place, or if no text of the source has a
    word. Nulls and ties as for mix(); columns of any name stay.

    Rows are shuffled to be placed in their source's stream and again to be sorted by position; sizes are
    counted once more on the way.
    """
    plan = _planned(docs, weights, max_repeat, schedule, F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    met = plan.where(F.col("copies") > 0).select("_row", F.explode(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), _position)).alias("_spot"))
    return met.repartitionByRange("_spot").sortWithinPartitions("_spot").select("_row.*")
