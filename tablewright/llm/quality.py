"""Quality by hierarchical empirical Bayes: a document's own evidence with the record of its host and path.

1. A logistic model over hashed words, word beginnings and style (capitals, marks, repeated words) is trained on a bounded
   sample of labelled documents (``SAMPLE_DOCS``). Its log-odds less the prior log-odds are a document's evidence.
2. Grouped sums of the model's probabilities over all documents give the share of bad documents by path and host. A path is
   shrunk towards its host and a host towards the whole, by strengths that the spread between sites gives (method of moments), so a site
   with few documents says little.
3. The evidence plus the log-odds of the path's share decide: a document is rejected if it is bad with ``REJECT`` or more.

Defined cases: a null text counts as empty; a null host or path is a site of its own. Labels of documents that are not there, and null labels,
are left out; repeated labels count each time. Without labels of both kinds the evidence is 0 and nothing is rejected. Repeated rows
are scored alike; an empty table gives an empty result. ``keep_good`` keeps all columns; ``__evidence``, ``__host`` and ``__path`` are reserved names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm import wordspans
from tablewright.llm.store import BROADCAST_ROWS, Scratch

SAMPLE_DOCS = 12_000
WORD_BITS = 18
BEGINNING = 5  # bytes
LEAST_DOCS, LEAST_Z = 4, 2.5
REJECT = 0.5
LIMITS = np.array([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
NOT_LETTERS = wordspans.byte_set([c for c in range(128) if not chr(c).isalpha()])
CAPITALS = wordspans.byte_set(range(65, 91))
LETTERS = ~NOT_LETTERS
MARKS = wordspans.byte_set(map(ord, "#$%&*+/<=>@[\\]^_`{|}~"))
STRESS = wordspans.byte_set(map(ord, "!?"))
DIGITS = wordspans.byte_set(range(48, 58))
STYLES = 6
STYLE_AT = 2 << WORD_BITS


class Features:
    """The distinct feature numbers of each text."""

    def __init__(self):
        self.hasher = wordspans.SpanHasher(seed=3)
        self.lower = wordspans.lower_ascii()

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        for first, end, raw, offsets in wordspans.slices(column):
            n = end - first
            data = self.lower[raw]
            starts, ends, row = wordspans.word_bounds(data, offsets, NOT_LETTERS)
            words = self.hasher(data, starts, ends)
            cut = np.minimum(ends, starts + BEGINNING)
            shift = np.uint64(64 - WORD_BITS)
            found = np.concatenate([
                (words >> shift).astype(np.int64),
                (self.hasher(data, starts, cut) >> shift).astype(np.int64) + (1 << WORD_BITS),
            ])
            both = np.unique((np.concatenate([row, row]) << 24) | found)
            bounds = np.searchsorted(both, np.arange(n + 1) << 24)
            size = np.maximum(np.diff(offsets), 1)
            count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[offsets])  # noqa: E731, B023
            letters = np.maximum(count(LETTERS), 1)
            again = np.zeros(len(words), dtype=bool)
            again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
            n_words = np.maximum(np.bincount(row, minlength=n), 1)
            repeats = np.bincount(row[again], minlength=n)
            ratios = np.stack([count(CAPITALS) / letters, count(MARKS) / size, count(STRESS) / size, count(DIGITS) / size,
                               repeats / n_words, letters / size])
            style = STYLE_AT + np.arange(STYLES)[:, None] * 16 + np.searchsorted(LIMITS, ratios)
            for k in range(n):
                yield np.concatenate([both[bounds[k] : bounds[k + 1]] & ((1 << 24) - 1), style[:, k]])


class Model:
    """Weights per feature number, and the log-odds of a bad document in the sample."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood ratio of bad against good for each text."""
        weights = self.weights
        return np.array([weights[f].sum() + self.bias - self.prior for f in Features().of(column)], dtype=np.float64)


NO_MODEL = Model(np.zeros(STYLE_AT + STYLES * 16), 0.0, 0.0)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """(doc_id, bad, text) of about ``sample_docs`` labelled documents, chosen by a hash of the id."""
    named = labels.select(F.col("doc_id").alias("__id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    named = named.filter("bad IS NOT NULL AND __id IS NOT NULL")
    n = named.count()
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = named.filter(place < sample_docs / max(n, 1)).limit(2 * sample_docs)
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select(F.col("__id").alias("doc_id"), "bad", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
          rounds: int = 120) -> Model:
    """Features are found where the texts are; the driver gets their numbers for the sample alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Features()
        for batch in batches:
            found = [x.astype(np.int32) for x in tool.of(batch.column(2))]
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)],
                                             names=["doc_id", "bad", "found"])

    id_type = labels.schema["doc_id"].dataType.simpleString()
    rows = sample(docs, labels, id_col, text_col, sample_docs).mapInArrow(run, f"doc_id {id_type}, bad int, found array<int>")
    table = rows.toArrow().sort_by([("doc_id", "ascending"), ("bad", "ascending")])
    bad = table.column("bad").to_numpy().astype(np.float64)
    if len(bad) == 0 or bad.min() == bad.max():
        return NO_MODEL
    found = table.column("found").combine_chunks()
    flat, sizes = found.flatten().to_numpy(), np.diff(found.offsets.to_numpy())
    return _fit(flat.astype(np.int64), sizes, bad, rounds)


def _fit(flat: np.ndarray, sizes: np.ndarray, bad: np.ndarray, rounds: int) -> Model:
    """Penalised logistic regression (Adam) on the features that differ between the classes beyond chance."""
    width, n = STYLE_AT + STYLES * 16, len(bad)
    row = np.repeat(np.arange(n), sizes)
    in_all = np.bincount(flat, minlength=width)
    in_bad = np.bincount(flat, weights=bad[row], minlength=width)
    rate = bad.mean()
    z = (in_bad - in_all * rate) / np.sqrt(np.maximum(in_all * rate * (1 - rate), 1e-9))
    used = (in_all >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
    number = np.cumsum(used) - 1
    keep = used[flat]
    flat, row = number[flat[keep]], row[keep]
    weights, bias = np.zeros(int(used.sum())), float(np.log(rate / (1 - rate)))
    first, second, b1, b2 = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    prior = bias
    for k in range(1, rounds + 1):
        score = np.bincount(row, weights=weights[flat], minlength=n) + bias
        error = bad - 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        grad = np.bincount(flat, weights=error[row], minlength=len(weights)) - 0.5 * weights
        slope = error.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        b1, b2 = 0.9 * b1 + 0.1 * slope, 0.99 * b2 + 0.01 * slope * slope
        fix1, fix2 = 1 - 0.9**k, 1 - 0.99**k
        weights += 0.1 * (first / fix1) / (np.sqrt(second / fix2) + 1e-8)
        bias += 0.1 * (b1 / fix1) / (b2 / fix2 + 1e-12) ** 0.5
    out = np.zeros(width)
    out[np.flatnonzero(used)] = weights
    return Model(out, bias, prior)


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``__evidence``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = pa.array(model.evidence(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, evidence], names=[*batch.schema.names, "__evidence"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__evidence", T.DoubleType())]))


def _odds(p) -> F.Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean) -> float:
    """Pseudo-documents of the level above, from the spread of ``bad / n`` around ``mean`` beyond what chance explains."""
    inner = mean * (1 - mean)
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)) - F.sum(inner)
    room = F.greatest(F.sum(F.col("n") * inner), F.lit(1e-9))
    share = sites.agg(F.least(F.greatest(spread / room, F.lit(1e-4)), F.lit(0.5))).first()[0]
    return 1 / share - 1


def site_shares(scored: DataFrame, prior: float, scratch: Scratch) -> DataFrame:
    """(__host, __path, share): the shrunken share of bad documents of each path, from (``__host``, ``__path``, ``__evidence``)."""
    p = 1 / (1 + F.exp(-(F.col("__evidence") + prior)))
    paths = scored.groupBy("__host", "__path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("bad"))
    paths = scratch.write(paths, "paths")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean = paths.agg(F.sum("bad") / F.sum("n")).first()[0]
    if mean is None:
        return paths.select("__host", "__path", F.lit(0.5).alias("share"))
    mean = F.lit(min(max(mean, 1e-6), 1 - 1e-6))
    k = _strength(hosts, mean)
    above = hosts.select(F.col("__host").alias("__h"), ((F.col("bad") + k * mean) / (F.col("n") + k)).alias("mean"))
    within = paths.join(above, F.col("__host").eqNullSafe(F.col("__h"))).drop("__h")
    k = _strength(within, F.col("mean"))
    share = (F.col("bad") + k * F.col("mean")) / (F.col("n") + k)
    return within.select("__host", "__path", F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("share"))


def _judged(scored: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """``scored`` with ``__share`` of its site and ``__p``, the probability that the document is bad."""
    sites = scratch.write(site_shares(scored.select("__host", "__path", "__evidence"), model.prior, scratch), "sites")
    sites = sites.select(F.col("__host").alias("__h"), F.col("__path").alias("__q"), F.col("share").alias("__share"))
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_ROWS else sites
    same = F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__q"))
    judged = scored.join(sites, same).drop("__h", "__q")
    return judged.withColumn("__p", 1 / (1 + F.exp(-(F.col("__evidence") + _odds(F.col("__share"))))))


def classify(docs: DataFrame, labels: DataFrame, host, path, id_col: str = "doc_id", text_col: str = "text",
             sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, evidence, site_share, p_bad, kept. ``host`` and ``path`` are columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = train(docs, labels, id_col, text_col, sample_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), host.alias("__host"), path.alias("__path"), F.col(text_col).alias("text"))
    scored = scratch.write(with_evidence(rows, model).drop("text"), "scored")
    return _judged(scored, model, scratch).select(
        "doc_id", F.col("__evidence").alias("evidence"), F.col("__share").alias("site_share"), F.col("__p").alias("p_bad"),
        (F.col("__p") < REJECT).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, host, path, id_col: str = "doc_id", text_col: str = "text",
              sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that are not rejected, with all their columns. Scored twice, so no text is shuffled or stored."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = train(docs, labels, id_col, text_col, sample_docs)
    scored = with_evidence(docs.select("*", host.alias("__host"), path.alias("__path")), model, text_col)
    judged = _judged(scored, model, scratch)
    return judged.filter(F.col("__p") < REJECT).select(*[F.col(f"`{c}`") for c in docs.columns])
