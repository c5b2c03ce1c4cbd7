"""Benchmark decontamination with a broadcast hash set of test n-grams.

A window is ``width`` consecutive words of a benchmark item; an item of fewer words is one window. Scanning every window
of every text would emit a row per word. Instead texts are cut into blocks of ``seed = (width + 1) // 2`` words:
every occurrence of a window covers at least one whole block, whatever its place. A block's hash is looked up in the
broadcast set of all seeds of the windows. Only texts with hits are read again, and every window around a hit is verified
by comparing its words themselves. Windows of shorter items have seeds of their own in the same scan.

Defined cases: a null or empty text, or one without words, has no hits and is not contaminated; benchmark items without words
are left out; equal items are hit together. Rows that repeat both doc_id and text give equal rows. Empty tables give
empty results or no hits. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.store import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 64 << 20
ROW_BYTES = 64  # of a broadcast row beside its arrays and texts


def words_of(text) -> F.Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def _windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(item, size, window): every different window of every item, as words joined by blanks, with its length."""
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")
    ).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    window = F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))
    return items.select("item", size.alias("size"), F.explode(F.array_distinct(window)).alias("window")).distinct()


def _seed_size(size: int) -> int:
    return (size + 1) // 2


def _seeds_at(words, places, size: int) -> F.Column:
    """(seed, at) of the run of ``_seed_size(size)`` words at each place; runs of another size never look alike."""
    n = F.lit(_seed_size(size))
    return F.transform(places, lambda p: F.struct(F.xxhash64(F.lit(size), F.slice(words, p + 1, n)).alias("seed"), p.alias("at")))


def _seeds(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(seed, size): the hashes of all runs of ``_seed_size(size)`` words inside the windows."""
    w = F.split("window", " ")
    parts = []
    for size in sizes:
        runs = _seeds_at(w, F.sequence(F.lit(0), F.lit(size - _seed_size(size))), size)
        own = windows.filter(F.col("size") == size).select(F.explode(runs).alias("s"))
        parts.append(own.select(F.col("s.seed").alias("seed"), F.lit(size).alias("seed_of")).distinct())
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _fits(df: DataFrame, payload) -> bool:
    """Whether a table may be broadcast: its rows, and the bytes of their arrays and texts (``payload``), are added up."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(payload), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size + rows * ROW_BYTES <= BROADCAST_BYTES


def _bounded(df: DataFrame, payload) -> DataFrame:
    """Broadcast when the size, which was added up, allows it; otherwise Spark joins it as a table."""
    return F.broadcast(df) if _fits(df, payload) else df


def _bytes(*columns) -> F.Column:
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0)).cast("long")


def _scan(texts: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per different (doc_id, text): n_words, its copies, and the blocks found among the seeds (``seed_of``, ``at``)."""
    n = F.size("w")
    none = F.array().cast("array<struct<seed:bigint,at:int>>")
    blocks = F.array(F.struct(F.lit(None).cast("long").alias("seed"), F.lit(-1).alias("at")))  # keeps texts without hits
    for size in sizes:
        k = _seed_size(size)
        block = _seeds_at(F.col("w"), F.sequence(F.lit(0), n - k, F.lit(k)), size)
        blocks = F.concat(blocks, F.when(n >= k, block).otherwise(none))
    rows = texts.select("doc_id", "text_hash", n.cast("long").alias("n_words"), F.explode(blocks).alias("b"))
    rows = rows.select("doc_id", "text_hash", "n_words", "b.seed", "b.at")
    if sizes:
        seeds = _seeds(windows, sizes)
        rows = rows.join(_bounded(seeds, F.lit(16)), "seed", "left").filter("seed_of IS NOT NULL OR at < 0")
    else:
        rows = rows.withColumn("seed_of", F.lit(None).cast("int"))
    return rows.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(F.col("at") < 0).alias("copies"), F.collect_set(F.when(F.col("at") >= 0, F.struct("seed_of", "at"))).alias("found")
    )


def _occurrences(texts: DataFrame, scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, size, window): the real occurrences of windows that cover a found block. Only texts with
    found blocks are cut into words again."""
    found = scanned.filter(F.size("found") > 0).select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "found"
    )
    found = _bounded(found, _bytes("__doc") + 32 * F.size("found"))
    rows = texts.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash")))
    rows = rows.withColumn("w", words_of(F.col("text")))
    n = F.size("w")

    def around(f):
        """Every window place that covers the block at ``f``."""
        size = f["seed_of"]
        first = F.greatest(f["at"] - (size - F.floor((size + 1) / 2).cast("int")), F.lit(0))
        last = F.least(f["at"], n - size)
        places = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(size.alias("size"), i.alias("start")))

    places = F.array_distinct(F.flatten(F.transform("found", around)))
    windows_at = F.transform(places, lambda x: F.struct(
        x["size"].alias("size"), x["start"].alias("start"), F.array_join(F.slice("w", x["start"] + 1, x["size"]), " ").alias("window")))
    rows = rows.select("doc_id", "text_hash", F.explode(windows_at).alias("o")).select("doc_id", "text_hash", "o.*")
    listed = windows.select("size", "window").distinct()
    return rows.join(_bounded(listed, _bytes("window")), ["size", "window"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence), n_items, items (sorted as strings),
    hits (starts and sizes of occurrences), contaminated (at least one hit word in twenty), text_hash."""
    scratch = Scratch(docs.sparkSession, "decontam")
    windows = scratch.write(_windows(benchmark, item_col, item_text, width), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``width`` values
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    scanned = scratch.write(_scan(texts.withColumn("w", words_of(F.col("text"))), windows, sizes), "scanned")
    real = _occurrences(texts, scanned, windows)
    of_window = windows.groupBy("window").agg(F.collect_set("item").alias("items_of"))
    if _fits(windows, _bytes("window", "item") + 16):  # at least as large as its groups
        of_window = F.broadcast(of_window)
    real = real.join(of_window, "window").groupBy(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")
    ).agg(
        F.array_sort(F.collect_set(F.struct("start", "size"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items_of")))).alias("items"),
    )
    real = scratch.write(real, "hits")
    key = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))
    items_bytes = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    rows = scanned.join(_bounded(real, _bytes("__doc") + 24 * F.size("hits") + items_bytes), key, "left")
    hits = F.coalesce("hits", F.array().cast("array<struct<start:int,size:int>>"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    covered = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    n_hit = F.size(covered).cast("long")
    return rows.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        hits.alias("hits"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, id_col, text_col, **options).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad_id")) & (own == F.col("__bad_hash")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 **options) -> DataFrame:
    """(doc_id, text): documents as their normalised words without the words inside an occurrence of a window."""
    found = contamination(docs, benchmark, id_col, text_col, **options).filter("n_hit > 0")
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "hits").distinct()
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), own.alias("__own"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    inside = lambda i: F.exists("hits", lambda h: (i >= h["start"]) & (i < h["start"] + h["size"]))
    left = F.array_join(F.filter(words_of(F.col("text")), lambda w, i: ~inside(i)), " ")
    return rows.select("doc_id", F.when(F.col("hits").isNull(), F.col("text")).otherwise(left).alias("text"))
