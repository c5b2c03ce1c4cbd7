"""Text to chunks and chunks to typed records, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import ident, require_columns
from tablewright.session import LOCAL_ROWS, local_or_written

# Paragraph separator and lengths, window size and span, chunk and batch caps.
PARAGRAPH_SEPARATOR, PARAGRAPH_LENGTH = "\n\n", 20
WINDOW_SIZE, WINDOW_SPAN, WINDOW_LENGTH = 350, 3500, 15
CHUNK_CAP, BATCH_CAP = 30, 100

# The characters that count as white space in Unicode text.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD_BREAK = r"[^\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """Text without white space at either end, Unicode spaces included."""
    return F.btrim(c, F.lit(_SPACES))


def paragraphs(text: Column, separator: str = PARAGRAPH_SEPARATOR, longer_than: int = PARAGRAPH_LENGTH) -> Column:
    """Array of stripped parts longer than the limit."""
    parts = F.split(text, "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in separator), -1)
    # Stripping only shortens, so the many short parts are dropped before it.
    long = F.filter(parts, lambda s: F.length(s) > longer_than)
    return F.filter(F.transform(long, strip), lambda s: F.length(s) > longer_than)


def windows(text: Column, size: int = WINDOW_SIZE, span: int | None = None, longer_than: int = WINDOW_LENGTH) -> Column:
    """Array of fixed windows, not stripped, kept by their stripped length.

    The whole text is cut; ``span=WINDOW_SPAN`` keeps to the leading characters.
    """
    # One pattern walks the text once; substrings by position would walk it once per window.
    body = text if span is None else F.substring(text, 1, span)
    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.filter(cut, lambda w: F.length(strip(w)) > longer_than)


def chunk_documents(
    df: DataFrame,
    key: str,
    text: str,
    separator: str = PARAGRAPH_SEPARATOR,
    span: int | None = None,
    max_chunks: int | None = None,
) -> DataFrame:
    """(key, pos, kind, chunk): paragraphs, or windows where a text has no paragraph long enough.

    Everything happens inside the row, so no shuffle ranks the chunks; ``max_chunks`` keeps the first ones.
    """
    require_columns(df, key, text)
    t = F.coalesce(ident(text), F.lit(""))
    rows = df.select(ident(key).alias("key"), t.alias("t")).withColumn("paras", paragraphs(F.col("t"), separator))
    has = F.size("paras") > 0
    chunks = F.when(has, F.col("paras")).otherwise(windows(F.col("t"), span=span))
    if max_chunks is not None:
        chunks = F.slice(chunks, 1, max_chunks)
    return rows.select(
        "key", F.when(has, F.lit("paragraph")).otherwise(F.lit("window")).alias("kind"), F.posexplode(chunks).alias("pos", "chunk")
    ).select("key", "pos", "kind", "chunk")


def batch(df: DataFrame, order: str | Sequence[str], text: str, cap: int | None = None) -> DataFrame:
    """Records for extraction: the optional cap first, then blank texts out."""
    require_columns(df, text)
    keys = [order] if isinstance(order, str) else list(order)
    capped = df if cap is None else df.orderBy(*[ident(k) for k in keys]).limit(cap)
    return capped.where(F.length(strip(ident(text))) > 0)


# ---- record extraction -----------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """Lower-case words per category and per signal."""

    categories: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "Billing": ("invoice", "bill", "billing", "charge", "charged", "refund", "payment", "price"),
            "Technical": ("error", "bug", "crash", "broken", "fail", "failed", "failure", "slow", "login", "password"),
            "Delivery": ("delivery", "shipping", "shipped", "late", "package", "order", "arrived"),
            "Account": ("account", "profile", "subscription", "cancel", "upgrade", "plan"),
        }
    )
    positive: Sequence[str] = ("good", "great", "excellent", "happy", "love", "thanks", "thank", "perfect", "fast")
    negative: Sequence[str] = ("bad", "terrible", "awful", "angry", "hate", "worst", "poor", "broken", "slow", "late")
    urgent: Sequence[str] = ("urgent", "immediately", "asap", "now", "critical", "emergency", "today")
    action: Sequence[str] = ("please", "need", "must", "fix", "help", "refund", "cancel", "call", "send")
    default_category: str = "General"


STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "you", "was", "are", "not", "but", "have", "from", "they", "his", "her",
)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD_BREAK), lambda t: F.length(t) > 0)


def _hits(words: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda t: t.isin(list(lexicon))))


def extract_records(df: DataFrame, text: str, lexicon: Lexicon = Lexicon(), keep: Sequence[str] = ()) -> DataFrame:
    """category, sentiment_score in [-1, 1], urgency 1-5 and action_required 0/1 per record."""
    require_columns(df, text, *keep)
    names = list(lexicon.categories)
    known = sorted({w for words in (*lexicon.categories.values(), lexicon.positive, lexicon.negative, lexicon.urgent, lexicon.action) for w in words})
    # One pass over all words leaves the few that some list holds.
    listed = F.filter(tokens(F.coalesce(ident(text), F.lit(""))), lambda t: t.isin(known))
    rows = df.select(*[ident(k) for k in keep], listed.alias("__w"))
    rows = rows.select(
        *[ident(k) for k in keep],
        F.array(*[_hits(F.col("__w"), lexicon.categories[n]) for n in names]).alias("__c"),
        _hits(F.col("__w"), lexicon.positive).alias("__pos"),
        _hits(F.col("__w"), lexicon.negative).alias("__neg"),
        _hits(F.col("__w"), lexicon.urgent).alias("__urg"),
        _hits(F.col("__w"), lexicon.action).alias("__act"),
    )
    best = F.array_max("__c")
    labels = F.array(*[F.lit(n) for n in names])
    score = F.try_divide((F.col("__pos") - F.col("__neg")).cast("double"), (F.col("__pos") + F.col("__neg")).cast("double"))
    return rows.select(
        *[ident(k) for k in keep],
        F.when(best > 0, F.element_at(labels, F.array_position("__c", best).cast("int"))).otherwise(F.lit(lexicon.default_category)).alias("category"),
        F.coalesce(score, F.lit(0.0)).alias("sentiment_score"),
        F.least(F.lit(5), F.col("__urg") + 1).alias("urgency"),
        (F.col("__act") > 0).cast("int").alias("action_required"),
    )


def most_frequent(words: Column) -> Column:
    """The word an array holds most often, the smallest on ties; null without any. Equal words are runs of the sorted array."""
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("w"), F.lit(0).alias("n"), none.alias("best"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        n = F.when(s["w"] == w, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), n.alias("n"), F.when(n > s["most"], w).otherwise(s["best"]).alias("best"), F.greatest(n, s["most"]).alias("most"))

    return F.aggregate(F.array_sort(words), start, step, lambda s: s["best"])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hashes ``__h`` of the keys that several rows have, null being a key as any other. A key that only shares the hash of one counts as
    repeated too, which costs time but changes no result."""
    ks = [ident(k) for k in keys]
    counts = df.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    found = local_or_written(counts.select(F.xxhash64(*ks).alias("__h")).distinct(), LOCAL_ROWS)
    return found if found.take(1) else found.limit(0)  # no rows by its plan, so that the joins with it go


def _by_repetition(df: DataFrame, keys: Sequence[str], repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys no other row has, and those with repeated keys."""
    hashed = df.withColumn("__hash", F.xxhash64(*[ident(k) for k in keys]))
    same = F.col("__hash") == F.col("__h")
    return hashed.join(repeated, same, "left_anti").drop("__hash"), hashed.join(repeated, same, "left_semi").drop("__hash")


def _usable(text: Column, stop_words: Sequence[str], min_length: int) -> Column:
    return F.filter(tokens(text), lambda w: (F.length(w) >= min_length) & ~w.isin(list(stop_words)))


def _shared_topic(df: DataFrame, keys: Sequence[str], words: Column) -> DataFrame:
    """The topics of records of several rows. Words are counted before the shuffle, so a record that holds a third of all words costs one
    row per distinct word."""
    ks = [ident(k) for k in keys]
    counts = df.select(*ks, F.explode_outer(words).alias("w")).groupBy(*ks, "w").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("w").isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col("w").alias("w"))))
    return counts.groupBy(*ks).agg(best.alias("b")).select(*ks, F.col("b.w").alias("main_topic"))


def main_topic(
    df: DataFrame, keys: Sequence[str], text: str, stop_words: Sequence[str] = STOP_WORDS, min_length: int = 3
) -> DataFrame:
    """Most frequent word per record that is no stop word, the smallest on ties; null without any.

    Rows that share their keys are one record. A record of one row, as nearly all are, is settled inside the row, so its words
    never move.
    """
    require_columns(df, text, *keys)
    words = _usable(ident(text), stop_words, min_length)
    alone, shared = _by_repetition(df, keys, repeated_keys(df, keys))
    own = alone.select(*[ident(k) for k in keys], most_frequent(words).alias("main_topic"))
    return own.unionByName(_shared_topic(shared, keys, words))


def with_main_topic(
    df: DataFrame, keys: Sequence[str], text: str, repeated: DataFrame, by: Sequence[str],
    stop_words: Sequence[str] = STOP_WORDS, min_length: int = 3,
) -> DataFrame:
    """The table with the main topic of every row's record. ``repeated`` are the ``repeated_keys`` of the columns ``by``, some of the
    keys, without which no two rows share all keys: only rows that have them are joined with their record's topic."""
    require_columns(df, text, *keys, *by)
    words = _usable(ident(text), stop_words, min_length)
    alone, shared = _by_repetition(df, by, repeated)
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    topics = _shared_topic(shared, keys, words).withColumnsRenamed(names)
    same = reduce(and_, [ident(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    joined = shared.join(topics, same, "left").drop(*names.values())
    return alone.withColumn("main_topic", most_frequent(words)).unionByName(joined)


def extract_fields(
    df: DataFrame, text: str, directive: Mapping[str, tuple[str, str]], keep: Sequence[str] = ()
) -> DataFrame:
    """User fields: name to (pattern with one group, Spark type). No match or a failed cast is null."""
    require_columns(df, text, *keep)
    out = []
    for name, (pattern, dtype) in directive.items():
        if re.compile(pattern).groups < 1:
            raise ValueError(f"the pattern of {name!r} needs a group")
        found = F.regexp_extract(F.coalesce(ident(text), F.lit("")), pattern, 1)
        out.append(F.when(found != "", found).try_cast(dtype).alias(name))
    return df.select(*[ident(k) for k in keep], *out)


def split_rejects(df: DataFrame, text: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Records with at least one field, and the rest with the reason."""
    require_columns(df, text, *fields)
    blank = F.length(strip(F.coalesce(ident(text), F.lit("")))) == 0
    empty = F.coalesce(*[ident(f).cast("string") for f in fields]).isNull()
    return df.where(~blank & ~empty), df.where(blank | empty).select(
        *[ident(c) for c in df.columns if c not in fields],
        F.when(blank, F.lit("blank text")).otherwise(F.lit("no field found")).alias("reason"),
    )


def union_records(*tables: DataFrame) -> DataFrame:
    """Ragged tables under one schema: missing fields null, mixed numbers double, other mixtures text."""
    kinds: dict[str, list[T.DataType]] = {}
    for t in tables:
        for f in t.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)

    def common(types: list[T.DataType]) -> T.DataType:
        if all(x == types[0] for x in types):
            return types[0]
        return T.DoubleType() if all(isinstance(x, T.NumericType) for x in types) else T.StringType()

    target = {n: common(ts) for n, ts in kinds.items()}
    cast = [t.select(*[ident(c).cast(target[c]).alias(c) for c in t.columns]) for t in tables]
    out = cast[0]
    for t in cast[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
