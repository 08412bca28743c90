"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a fixed pseudo-random order, are cut into blocks of equal text
size. Block k of a source with weight w may be released at slot floor(k / w) and is due by
slot ceil((k + 1) / w); in each slot the released block with the earliest deadline goes
first. Weights are whole parts of one period, so the schedule of one period is a table of
fixed size that repeats: the slot of any block is a look-up and a multiplication, and the
stream is never simulated over the data. In every prefix before a source runs out, each
source is within one block of its share.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadtrace.session import materialise

#: Slots of a period: what weights are rounded to, and most sources.
PERIOD = 1024
#: Characters of a block.
BLOCK_CHARS = 1 << 16
#: Characters of a bucket of a source's order: a running sum is taken over buckets, then inside each.
BUCKET_CHARS = 1 << 20


def whole_weights(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Parts of the period, at least one each: largest remainders, ties by name. No weights have no parts."""
    if not weights:
        return {}
    if len(weights) > period or any(not w > 0 for w in weights.values()):
        raise ValueError(f"needs at most {period} sources, with weights above 0")
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    parts = {s: 1 + int(x) for s, x in exact.items()}
    rest = period - sum(parts.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:rest]:
        parts[s] += 1
    return parts


def schedule(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """One period as (source, k, slot): its blocks by earliest deadline among the released ones, ties by name."""
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]  # release slot, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), s, k))
        due, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, k, slot))
        if k + 1 < parts[s]:
            heapq.heappush(waiting, ((k + 1) * period // parts[s], s, k + 1))
    return out


def _source(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def tempered_weights(docs: DataFrame, power: float) -> dict[str, float]:
    """Target weights as a power of each source's characters. One row a source reaches the driver; more than PERIOD are refused."""
    rows = docs.groupBy(_source(F.col("source")).alias("source")).agg(F.sum(F.length("text") + 1).alias("n")).orderBy("source").limit(PERIOD + 1).collect()
    if len(rows) > PERIOD:
        raise ValueError(f"more than {PERIOD} sources")
    return {r.source: max(1, r.n or 1) ** power for r in rows}


def _plan(spark, weights: dict[str, float], period: int) -> DataFrame:
    """One period as rows (source, part, k, at): `period` rows at most, none without weights."""
    parts = whole_weights(weights, period)
    rows = [(s, parts[s], k, slot) for s, k, slot in schedule(parts)] or [("", 1, 0, 0)]
    values = ",".join(f"({_literal(s)}, {part}L, {k}L, {slot}L)" for s, part, k, slot in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(source, part, k, at)").filter(F.lit(bool(parts)))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs' key, source, size, and h, a hash of id and text: equal ids or texts alone never share it."""
    size = (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long")
    key = F.col("doc_id").cast("long")
    return docs.select(*more, key.alias("key"), _source(F.col("source")).alias("source"), size.alias("size"), F.xxhash64(key, F.col("text").cast("string")).alias("h"))


def _before(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with base, the sizes of those of the same keys that stand before them in the order of a number from 0 on.

    Sums are taken over stretches of the order first, then inside each, and a stretch has
    about as many rows as there are stretches: no task sees all rows of a key.
    """
    wide = rows.groupBy(*keys).agg(F.ceil(F.sqrt(F.max(order) + 1)).cast("long").alias("step"))
    rows = rows.join(F.broadcast(wide), keys).withColumn("stretch", F.floor(F.col(order) / F.col("step"))).drop("step")
    sums = rows.groupBy(*keys, "stretch").agg(F.sum("size").alias("sum"))
    sums = sums.select(*keys, "stretch", (F.sum("sum").over(Window.partitionBy(*keys).orderBy("stretch")) - F.col("sum")).alias("first"))
    inside = F.sum("size").over(Window.partitionBy(*keys, "stretch").orderBy(order)) - F.col("size")
    return rows.withColumn("inside", inside).join(sums, [*keys, "stretch"]).withColumn("base", F.col("first") + F.col("inside")).drop("first", "inside", "stretch")


def _groups(g: DataFrame, weights: dict[str, float]) -> DataFrame:
    """g: a row for equal (source, h, key), n rows of `size` characters together; with start, how many characters stand before them.

    A source's order is by h; its buckets grow in number with its size, a running sum over
    them gives each its base, and the windows inside a bucket hold BUCKET_CHARS on average.
    """
    if weights:
        known = g.sparkSession.sql("SELECT * FROM VALUES " + ",".join(f"({_literal(s)})" for s in weights) + " AS t(source)")
        lost = g.join(F.broadcast(known), "source", "left_anti").select("source").first()
        if lost is not None:
            raise ValueError(f"no weight for source {lost.source!r}")
    wide = g.groupBy("source").agg(F.ceil(F.sum("size") / BUCKET_CHARS).alias("buckets"))  # a row a source
    g = g.join(F.broadcast(wide), "source").withColumn("bucket", F.pmod("h", F.col("buckets"))).drop("buckets")
    base = g.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    base = _before(base, ["source"], "bucket").drop("size")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return g.join(base, ["source", "bucket"]).select("source", "h", "key", "n", "size", (F.col("base") + F.col("inside")).alias("start"))


def _slotted(rows: DataFrame, plan: DataFrame, block_chars: int, period: int) -> DataFrame:
    """rows (source, place) with block and slot."""
    rows = rows.withColumn("block", F.floor(F.col("place") / F.lit(block_chars)))
    rows = rows.join(F.broadcast(plan.select("source", "part").distinct()), "source").withColumn("k", F.pmod("block", "part"))
    return rows.join(F.broadcast(plan.select("source", "k", "at")), ["source", "k"]).withColumn("slot", F.floor(F.col("block") / F.col("part")) * period + F.col("at"))


def _copies(rows: DataFrame, n: Column) -> DataFrame:
    """Each row n times, with i from 0 on: in two steps, so that no array holds more than the root of n."""
    many = rows.withColumn("step", F.ceil(F.sqrt(n)).cast("long")).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, "step")))
    return many.withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + F.col("step"), n) - 1))).drop("step", "lo")


def mix(docs: DataFrame, weights: dict[str, float], block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """A place in the mixed stream for every document.

    docs: doc_id long, text string, source string; other columns are ignored. weights: a
    target for every source of docs (null counts as ''); a source without one is refused.
    Returns doc_id, source, block (of its source), slot (of the stream) and place
    (characters of the source before it): ordered by slot, then place, the documents are the
    mix. Every document appears once, also when its source runs dry later than others: from
    there on the remaining sources share what is left. A null text counts as an empty one, of
    size 1; a text longer than a block fills several, and the next document stands behind
    it; repeated rows get places of their own, one after the other; a null doc_id is placed
    like any key, by its text. Equal hashes are told apart by doc_id. No rows, or no weights
    for no rows, give no places.
    """
    spark = docs.sparkSession
    counted = _keyed(docs).groupBy("source", "h", "key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    g = _groups(materialise(counted, "mix-groups"), weights)
    rows = _copies(g, F.col("n")).select("source", F.col("key").alias("doc_id"), (F.col("start") + F.col("i") * F.floor(F.col("size") / F.col("n"))).alias("place"))
    return _slotted(rows, _plan(spark, weights, period), block_chars, period).select("doc_id", "source", "block", "slot", "place")


def with_places(docs: DataFrame, weights: dict[str, float], block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """row (all columns of docs as a struct), slot and place: the places of mix.

    Rows that are equal in doc_id and text take all the places of their group, one each: by a
    hash of their other columns, equal rows one after the other. So places follow from the
    rows alone, however they are partitioned, and a task that runs again gives the same.
    """
    other = F.unhex(F.md5(F.coalesce(F.to_json(F.struct(*(c for c in docs.columns if c != "text"))), F.lit(""))))  # 16 bytes
    rows = _keyed(docs, F.struct(*docs.columns).alias("row"), other.alias("other"))
    alike = ["source", "h", "key", "other"]
    kinds = materialise(rows.groupBy(*alike).agg(F.count("*").alias("copies"), F.sum("size").alias("size")), "mix-kinds")
    counted = kinds.groupBy("source", "h", "key").agg(F.sum("copies").alias("n"), F.sum("size").alias("size"))
    g = _groups(materialise(counted, "mix-groups"), weights)
    first = F.sum("copies").over(Window.partitionBy("source", "h", "key").orderBy("other")) - F.col("copies")
    same = F.col("k.key").eqNullSafe(F.col("g.key"))
    ranked = kinds.withColumn("first", first).drop("size").alias("k").join(g.alias("g"), (F.col("k.source") == F.col("g.source")) & (F.col("k.h") == F.col("g.h")) & same)
    ranked = ranked.select("k.*", "start", F.floor(F.col("size") / F.col("n")).alias("each"))
    ranked = materialise(ranked, "mix-ranks")
    met = lambda part: rows.drop("size").alias("r").join(part.alias("p"), [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("key", "other")] + [F.col(f"r.{c}") == F.col(f"p.{c}") for c in ("source", "h")])
    shown = ["row", "r.source", "first", "start", "each"]
    placed = met(ranked.filter("copies = 1")).select(*shown)
    several = ranked.filter("copies > 1")
    if not several.isEmpty():  # equal rows: one of each kind, written out again
        one = met(several).groupBy("r.source", "r.h", "r.key", "r.other").agg(F.first("row").alias("row"), *(F.first(c).alias(c) for c in ("first", "start", "each", "copies")))
        each = _copies(one, F.col("copies"))
        placed = placed.unionByName(each.select("row", "source", (F.col("first") + F.col("i")).alias("first"), "start", "each"))
    placed = placed.select("row", "source", (F.col("start") + F.col("first") * F.col("each")).alias("place"))
    return _slotted(placed, _plan(docs.sparkSession, weights, period), block_chars, period).select("row", "slot", "place")


def mixed_rows(docs: DataFrame, weights: dict[str, float], block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """docs, all rows and columns, in the order of the mix: partitions are ranges of slots, sorted by slot and place.

    Null texts, repeated rows and empty tables as in mix; columns of docs named like the
    mix's own (slot, place, h) stay as they are. A reader that needs the order takes it
    from with_places, since files of a table are read in any order.
    """
    return with_places(docs, weights, block_chars, period).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
