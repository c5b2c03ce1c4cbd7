"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow that sends its documents in a seeded shuffle, pass after pass. A document's virtual finish time is
the words its flow has sent up to and with it, divided by the flow's target. All flows together, in order of finish
time, are the mix; it ends where the total budget is spent.

Sums over a source are taken in two levels: within buckets of about ``BUCKET_ROWS`` documents of a source, then over the
buckets, so a source that holds a third of all rows is many tasks. The end of the mix is found in a
histogram over ranges of finish times: ranges before the one in which the budget ends are taken whole, and only
that range is sorted row by row. A range that holds many turns, as when every host is a source and most sources finish at the same
times, is cut again by finish time and then by source, until few turns are left to sort.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, sorted last. A
null doc_id is shuffled like an empty text. Rows that repeat are documents of their own. A source of size 0 gets target 0. An empty
table gives an empty mix. ``mix`` keeps all columns; names that start with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.store import BROADCAST_ROWS, Scratch

BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the budget as a fraction of all words
PASSES = 2  # no document is taken more often
BUCKET_ROWS = 4_096
HEAVY_BUCKETS, CELLS = 4, 1_024  # a range of more than so many buckets is cut into cells
SEED = 17
PLACE = ("__finish", "__sid", "__pass", "__key", "__id", "__size")  # the order of the mix


def size_of(text) -> F.Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), "")).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more) -> DataFrame:
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
                       size_of(F.col(text_col)).alias("__size"), key.alias("__key"), *more)


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source: number, weight, size, rows, target and buckets.

    A target is the source's weighted part of the budget, at most ``passes`` times its size. In order of size over weight the
    capped sources come first, so running sums say for each whether the level reached without it is above its cap.
    """
    num, den = share
    sources = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"), F.count(F.lit(1)).alias("__rows"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())  # one row per source, not per document
    cycle = F.array(*[F.lit(w) for w in weights])
    numbered = sources.withColumn("__sid", F.row_number().over(by_name).cast("long"))
    numbered = numbered.withColumn("__weight", F.get(cycle, ((F.col("__sid") - 1) % len(weights)).cast("int")).cast("long"))
    cap = (F.col("__source_size") * passes).cast("double")
    order = Window.orderBy(cap / F.col("__weight"), "__sid")
    whole = Window.partitionBy()
    level = numbered.select(
        "*",
        F.sum(F.col("__source_size") * passes).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__caps"),
        F.sum("__weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("__weights_on"),
        F.sum("__source_size").over(whole).alias("__total"),
    )
    before = F.col("__caps") - F.col("__source_size") * passes
    room = F.col("__total") * num - before * den
    capped = cap * den * F.col("__weights_on") <= room.cast("double") * F.col("__weight")
    level = level.withColumn("__capped", capped)
    used = F.sum(F.when(F.col("__capped"), F.col("__source_size") * passes).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("__capped"), 0).otherwise(F.col("__weight"))).over(whole)
    level = level.withColumn("__left", F.col("__total") * num - used * den).withColumn("__free", free)
    target = F.when(F.col("__capped"), cap).otherwise(
        (F.col("__left") * F.col("__weight")).cast("double") / (F.col("__free") * den)
    )
    buckets = F.ceil(F.col("__rows") / F.lit(BUCKET_ROWS)).cast("long")
    return level.select("__sid", "__source", "__source_size", "__rows", "__total", target.alias("__target"),
                        buckets.alias("__buckets"))


class Mix:
    """What one mix needs to know: the targets, the words before each bucket, and the last document taken."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights=WEIGHTS, share=SHARE, passes: int = PASSES, seed: int = SEED):
        self.docs, self.columns, self.seed, self.passes = docs, (id_col, text_col, source_col), seed, passes
        self.scratch = Scratch(docs.sparkSession, "mixing")
        self.sizes = self.scratch.write(_sized(docs, *self.columns, seed), "sizes")
        self.sources = self.scratch.write(targets(self.sizes, weights, share, passes), "sources")
        known = self.sources.agg(F.count(F.lit(1)), F.max("__total"), F.sum("__rows"), F.sum("__buckets")).first()
        self.few_sources = known[0] <= BROADCAST_ROWS
        self.few_buckets = (known[3] or 0) <= BROADCAST_ROWS
        self.budget = (known[1] or 0) * share[0] // share[1]
        self.rows = known[2] or 0
        placed = self._placed(self.sizes).groupBy("__sid", "__bucket").agg(F.sum("__size").alias("__words"))
        up_to = Window.partitionBy("__sid").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
        before = placed.withColumn("__before", F.sum("__words").over(up_to) - F.col("__words"))
        self.before = self.scratch.write(before.drop("__words"), "before")
        self.last = self._last()

    def _placed(self, rows: DataFrame) -> DataFrame:
        sources = F.broadcast(self.sources) if self.few_sources else self.sources
        sources = sources.withColumnRenamed("__source", "__name").drop("__rows", "__total")
        part = F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        placed = rows.join(sources, F.col("__source").eqNullSafe(F.col("__name"))).drop("__name")
        return placed.withColumn("__bucket", F.floor(part * F.col("__buckets")).cast("long"))

    def timed(self, rows: DataFrame) -> DataFrame:
        """The rows with ``__sent``: the words of their source up to and with them, in one pass."""
        before = F.broadcast(self.before) if self.few_buckets else self.before
        here = Window.partitionBy("__sid", "__bucket").orderBy("__key", "__id", "__size")
        local = self._placed(rows).withColumn(
            "__local", F.sum("__size").over(here.rowsBetween(Window.unboundedPreceding, 0))
        )
        sent = local.join(before, ["__sid", "__bucket"])
        return sent.withColumn("__sent", F.col("__before") + F.col("__local")).drop("__before", "__local", "__bucket", "__buckets")

    def _turns(self, rows: DataFrame) -> DataFrame:
        """Every pass of every document that can be taken, with its finish time."""
        turns = rows.filter("__size > 0 AND __target > 0").withColumn(
            "__pass", F.explode(F.sequence(F.lit(0), F.lit(self.passes - 1)))
        )
        return turns.withColumn("__finish", self._finish(F.col("__pass")))

    @staticmethod
    def _finish(turn) -> F.Column:
        return (turn * F.col("__source_size") + F.col("__sent")).cast("double") / F.col("__target")

    def _last(self):
        """The last turn that the budget covers, as a row of its place in the order; None if there is none."""
        turns = self._turns(self.timed(self.sizes))
        ranges = max(1, self.rows // BUCKET_ROWS)
        turns = turns.withColumn("__range", F.floor(F.col("__finish") * ranges).cast("long"))
        per_range = turns.groupBy("__range").agg(F.sum("__size").alias("__words"), F.count(F.lit(1)).alias("__turns"))
        up_to = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)  # one row per range
        ends = per_range.withColumn("__to", F.sum("__words").over(up_to))
        over = ends.filter(F.col("__to") > self.budget).orderBy("__range").limit(1).collect()
        if not over:
            return turns.agg(F.max(F.struct(*PLACE))).first()[0]
        start = over[0]["__to"] - over[0]["__words"]
        inside = turns.filter(F.col("__range") == over[0]["__range"])
        if over[0]["__turns"] > HEAVY_BUCKETS * BUCKET_ROWS:
            inside, start = self._narrowed(self.scratch.write(inside.select(*PLACE), "heavy-range"), start)
        order = Window.orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)  # rows of one range
        summed = inside.withColumn("__to", F.sum("__size").over(order) + start)
        place = F.struct(*PLACE)
        found, first = summed.agg(F.max(F.when(F.col("__to") <= self.budget, place)), F.min(place)).first()
        if found is None:
            found = turns.filter(place < self._literal(first)).agg(F.max(place)).first()[0]
        return found

    def _narrowed(self, turns: DataFrame, start: int):
        """The turns of one cell in which the budget ends, and the words before it: cells of finish times within cells, then
        of source numbers, as long as there are many turns of different values."""
        for step in (F.col("__finish"), F.col("__sid").cast("double")):
            while True:
                n, low, high = turns.agg(F.count(F.lit(1)), F.min(step), F.max(step)).first()
                if n <= BUCKET_ROWS:
                    return turns, start
                if low == high:
                    break
                cell = F.least(F.floor((step - low) / (high - low) * CELLS), F.lit(CELLS - 1)).cast("long")
                words = turns.groupBy(cell.alias("__cell")).agg(F.sum("__size").alias("__words"))
                up_to = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)  # one row per cell
                ends = words.withColumn("__to", F.sum("__words").over(up_to) + start)
                over = ends.filter(F.col("__to") > self.budget).orderBy("__cell").first()
                turns, start = turns.filter(cell == over["__cell"]), over["__to"] - over["__words"]
        return turns, start

    def _literal(self, row) -> F.Column:
        """A place in the order, read by the driver, as a column."""
        kinds = {"__sid": "long", "__pass": "int", "__size": "long", "__id": self.sizes.schema["__id"].dataType}
        return F.struct(*[F.lit(row[c]).cast(kinds[c]) if c in kinds else F.lit(row[c]) for c in PLACE])

    def _taken(self, turn) -> F.Column:
        if self.last is None:
            return F.lit(False)
        here = {"__finish": self._finish(turn), "__pass": turn.cast("int")}
        place = F.struct(*[here.get(c, F.col(c)).alias(c) for c in PLACE])
        end = self._literal(self.last)
        return F.coalesce((F.col("__size") > 0) & (F.col("__target") > 0) & (place <= end), F.lit(False))

    def times_taken(self) -> F.Column:
        return sum((self._taken(F.lit(p)).cast("long") for p in range(self.passes)), F.lit(0).cast("long"))

    def allotments(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
        rows = self.timed(self.sizes)
        return rows.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"),
                           F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                           (F.col("__size") * self.times_taken()).alias("taken"))

    def rows_in_order(self) -> DataFrame:
        """The mixed documents with all their columns, once per time taken, range-sorted by finish time."""
        whole = F.struct(*[self.docs[f"`{c}`"] for c in self.docs.columns]).alias("__row")
        turns = self._turns(self.timed(_sized(self.docs, *self.columns, self.seed, whole)))
        taken = turns.filter(self._taken(F.col("__pass"))).select("__finish", "__sid", "__pass", "__key", "__row")
        return taken.orderBy("__finish", "__sid", "__pass", "__key").select("__row.*")
