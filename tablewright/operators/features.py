"""Feature preparation: calendar parts, category indicators, median fill, standardisation.

``fit_features`` reads the table a fixed number of times whatever its size and returns a
``FeatureModel`` whose ``transform`` is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import distinct_sketch, ident, is_calendar, is_number, is_text, require_columns
from tablewright.functions.counts import is_present, key_counts, value_columns, value_counts
from tablewright.functions.ranks import exact_medians
from tablewright.operators.split import dense_row_index
from tablewright.session import LOCAL_ROWS

# Name parts that mark a text column as a date, the parse share it needs, the parts
# given to unparsed rows, and the two limits past which a text column counts as an identifier.
DATE_NAME_PARTS = ("date", "time", "timestamp", "year", "day")
PARSE_SHARE = 0.6
MISSING_PARTS = (2026, 1, 1, 0)
IDENTIFIER_SHARE, IDENTIFIER_DISTINCT = 0.8, 50

DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd",
    "dd MMM yyyy", "MMM dd, yyyy", "yyyy-MM", "yyyy",
)
CALENDAR_PARTS = ("year", "month", "day", "dayofweek")
BIAS = "constant_bias"
# A column with more categories is encoded as one sparse vector instead of one column per category.
MAX_INDICATORS = 1000
# ML's encoder and assembler keep a named attribute for every place of a vector in the driver; larger vectors are made without.
NAMED_PLACES = 100_000
# Size of the distinct sketch (about 0.8 % error), and the band around a limit that is recounted exactly.
SKETCH_LG_K, RECOUNT_BAND = 14, 0.08


def _parts(c: Column) -> list[Column]:
    # weekday counts Monday as 0; dayofweek would count Sunday as 1
    return [F.year(c), F.month(c), F.dayofmonth(c), F.weekday(c)]


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that fits, else null; never an error."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A vector column whose metadata hold its size alone. It is read from JSON, which needs neither a Python worker nor names for its places."""
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))["v"]


def size_only(size: int) -> dict:
    return {"ml_attr": {"num_attrs": size}}


@dataclass(frozen=True)
class FeatureModel:
    """Fitted encoding. ``columns`` are the scalar features in order, ``vectors`` the wide ones."""

    sources: tuple[str, ...]
    date_texts: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    booleans: tuple[str, ...] = ()
    categories: tuple[tuple[str, tuple[str, ...]], ...] = ()
    wide: tuple[tuple[str, DataFrame, int], ...] = ()  # column, its written codes (value, code), their number
    medians: dict[str, float] = field(default_factory=dict)
    dropped: tuple[str, ...] = ()
    formats: tuple[str, ...] = DATE_FORMATS
    missing_parts: tuple[int, int, int, int] = MISSING_PARTS

    @property
    def columns(self) -> list[str]:
        indicators = [f"{c}_{v}" for c, values in self.categories for v in values[1:]]
        return [*self.numeric, *self.booleans, *indicators] or ([] if self.wide else [BIAS])

    @property
    def vectors(self) -> list[str]:
        return [f"{c}_onehot" for c, _, _ in self.wide]

    @property
    def slots(self) -> list[tuple[str, int]]:
        """Each feature with its number of places in the assembled vector; a wide column is one feature."""
        return [(c, 1) for c in self.columns] + [(c, size) for c, _, size in self.wide]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns unchanged, then the features as doubles without nulls."""
        require_columns(df, *keep, *self.sources)
        for name, codes, size in self.wide:
            # Null, the smallest category and values not seen before all set no indicator, as with few categories.
            named = codes.select(F.col("value").alias(f"{name}__value"), F.col("code").alias(f"{name}__code"))
            df = df.join(F.broadcast(named) if size <= LOCAL_ROWS else named, ident(name) == ident(f"{name}__value"), "left")
            if size > NAMED_PLACES:
                at = ident(f"{name}__code").cast("int")
                places, ones = (F.when(at.isNotNull(), F.array(c)).otherwise(F.array().cast(f"array<{kind}>")) for c, kind in ((at, "int"), (F.lit(1.0), "double")))
                df = df.withColumn(f"{name}_onehot", sparse_vector(size, places, ones).alias(f"{name}_onehot", metadata=size_only(size)))
                continue
            df = df.withColumn(f"{name}__index", F.coalesce(ident(f"{name}__code"), F.lit(size)).cast("double"))
            encoder = OneHotEncoder(inputCols=[f"{name}__index"], outputCols=[f"{name}_onehot"], dropLast=True)
            last = df.sparkSession.createDataFrame([(float(size),)], f"`{name}__index` double")
            df = encoder.fit(last).transform(df)
        scalars = _scalar_columns(df, self.sources, self.date_texts, self.formats, self.missing_parts)
        out: list[Column] = []
        for name in self.numeric:
            c = scalars[name].cast("double")
            if name in self.medians:
                c = F.coalesce(c, F.lit(self.medians[name]))
            out.append(c.alias(name))
        for name in self.booleans:
            out.append(F.coalesce(ident(name).cast("double"), F.lit(0.0)).alias(name))
        for name, values in self.categories:
            for v in values[1:]:
                out.append(F.when(ident(name) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{name}_{v}"))
        out += [ident(v) for v in self.vectors]
        if not out:
            out = [F.lit(1.0).alias(BIAS)]
        return df.select(*[ident(k) for k in keep], *out)


def assembled(df: DataFrame, model: FeatureModel, name: str) -> DataFrame:
    """The features of a transformed table as one vector column; beyond NAMED_PLACES it is sparse and without names."""
    sizes = [size for *_, size in model.wide]
    if sum(sizes) <= NAMED_PLACES:
        return VectorAssembler(inputCols=[*model.columns, *model.vectors], outputCol=name).transform(df)
    scalars = F.array(*[ident(c) for c in model.columns]) if model.columns else F.array().cast("array<double>")
    entries = [F.filter(F.transform(scalars, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)]
    width = len(model.columns)
    for column, size in zip(model.vectors, sizes, strict=True):
        places, values = (F.unwrap_udt(ident(column))[part] for part in ("indices", "values"))
        shifted = F.transform(places, lambda i: i + width)  # noqa: B023 - evaluated at once
        entries.append(F.zip_with(shifted, values, lambda i, v: F.struct(i.alias("i"), v.alias("v"))))
        width += size
    missing = F.exists(scalars, lambda v: v.isNull() | F.isnan(v))
    df = df.withColumn("__entries", F.when(missing, F.raise_error(F.lit("a feature is null or NaN"))).otherwise(F.concat(*entries)))
    vector = sparse_vector(width, F.col("__entries")["i"], F.col("__entries")["v"])
    return df.withColumn(name, vector.alias(name, metadata=size_only(width))).drop("__entries")


def _gapless(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = ident(name)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c


def _scalar_columns(
    df: DataFrame, sources: Sequence[str], date_texts: Sequence[str], formats: Sequence[str], missing: Sequence[int]
) -> dict[str, Column]:
    """Numeric source columns and calendar parts by name, in table order."""
    out: dict[str, Column] = {}
    parts: dict[str, Column] = {}
    for name in sources:
        dtype = df.schema[name].dataType
        c = ident(name)
        if name in date_texts:
            for label, p, default in zip(CALENDAR_PARTS, _parts(parse_date(c, formats)), missing):
                parts[f"{name}_{label}"] = F.coalesce(p, F.lit(default))
        elif is_calendar(dtype):
            for label, p in zip(CALENDAR_PARTS, _parts(c)):
                parts[f"{name}_{label}"] = p
        elif is_number(dtype):
            out[name] = _gapless(df, name)
    return out | parts


def fit_features(
    df: DataFrame,
    exclude: Sequence[str] = (),
    formats: Sequence[str] = DATE_FORMATS,
    missing_parts: Sequence[int] = MISSING_PARTS,
    max_indicators: int = MAX_INDICATORS,
) -> FeatureModel:
    """Learns which columns become features and their categories and medians; ``exclude`` holds keys and labels."""
    sources = [c for c in df.columns if c not in exclude]
    texts = [c for c in sources if is_text(df.schema[c].dataType)]
    named = [c for c in texts if any(p in c.lower() for p in DATE_NAME_PARTS)]
    first = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(parse_date(ident(c), formats)).alias(f"p{i}") for i, c in enumerate(named)],
        *[F.coalesce(distinct_sketch(ident(c), SKETCH_LG_K), F.lit(0)).alias(f"u{i}") for i, c in enumerate(texts)],
        *[F.count(_gapless(df, c)).alias(f"k{i}") for i, c in enumerate(sources)],
    ).first()
    n = first["rows"]
    base = {"sources": tuple(sources), "formats": tuple(formats), "missing_parts": tuple(missing_parts)}
    if n == 0 or not sources:
        return FeatureModel(**base)
    date_texts = [c for i, c in enumerate(named) if first[f"p{i}"] / n > PARSE_SHARE]
    open_texts = [c for c in texts if c not in date_texts]
    distinct = {c: first[f"u{texts.index(c)}"] for c in open_texts}
    distinct |= _recount(df, distinct, n, max_indicators)
    dropped = [c for c in open_texts if distinct[c] / n > IDENTIFIER_SHARE and distinct[c] > IDENTIFIER_DISTINCT]
    scalars = _scalar_columns(df, sources, date_texts, formats, missing_parts)
    booleans = [c for c in sources if isinstance(df.schema[c].dataType, T.BooleanType)]
    categoricals = [c for c in open_texts if c not in dropped]
    narrow = [c for c in categoricals if distinct[c] <= max_indicators]
    wide = [c for c in categoricals if distinct[c] > max_indicators]

    # Calendar parts are missing where their source is; parts of parsed texts are always filled.
    origin = {f"{c}_{label}": c for c in sources if c not in date_texts for label in CALENDAR_PARTS}
    filled = {c: first[f"k{i}"] for i, c in enumerate(sources)}
    present = {c: filled.get(origin.get(c, c), n) for c in scalars}
    gaps = [c for c in scalars if 0 < present[c] < n]
    medians = exact_medians(df.select(*[scalars[c].alias(c) for c in gaps]), gaps)
    return FeatureModel(
        **base,
        date_texts=tuple(date_texts),
        numeric=tuple(c for c in scalars if present[c] > 0),
        booleans=tuple(c for c in booleans if filled[c] > 0),
        categories=tuple((c, v) for c, v in _categories(df, narrow) if v),
        wide=tuple(_index(df, c) for c in wide),
        medians={c: float(m) for c, m in medians.items()},
        dropped=tuple(dropped),
    )


def _recount(df: DataFrame, distinct: dict[str, int], n: int, max_indicators: int) -> dict[str, int]:
    """Exact counts for the columns whose sketch lies near one of the limits."""
    limits = (IDENTIFIER_SHARE * n, float(IDENTIFIER_DISTINCT), float(max_indicators))
    near = [c for c, u in distinct.items() if any(abs(u - x) <= RECOUNT_BAND * x + 1 for x in limits)]
    if not near:
        return {}
    counts = key_counts(df, near)
    rows = counts.where(is_present(counts)).groupBy("pos").agg(F.count(F.lit(1)).alias("u")).collect()
    exact = {near[r["pos"]]: r["u"] for r in rows}
    return {c: exact.get(c, 0) for c in near}


def _categories(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, tuple[str, ...]]]:
    """Sorted categories of columns already known to have few."""
    if not columns:
        return []
    counts = value_counts(df, columns)
    v = value_columns(counts)[0]
    found: dict[int, list[str]] = {}
    for row in counts.where(is_present(counts)).select("pos", v).collect():
        found.setdefault(row["pos"], []).append(row[v])
    return [(c, tuple(sorted(found.get(i, [])))) for i, c in enumerate(columns)]


def _index(df: DataFrame, column: str) -> tuple[str, DataFrame, int]:
    """A code for every distinct value but the smallest, as a written table: the values stay on the executors."""
    values = df.where(ident(column).isNotNull()).select(ident(column).alias("value")).distinct()
    smallest = values.agg(F.min("value")).first()[0]
    codes = dense_row_index(values.where(F.col("value") != F.lit(smallest)), "code")
    return column, codes, codes.count()


@dataclass(frozen=True)
class Standardiser:
    """Zero mean and unit population deviation per column; a constant column keeps its scale."""

    means: dict[str, float]
    deviations: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[
                ((ident(c) - F.lit(self.means[c])) / F.lit(self.deviations[c])).alias(c) if c in self.means else ident(c)
                for c in df.columns
            ]
        )


def fit_standardiser(df: DataFrame, columns: Sequence[str]) -> Standardiser:
    if not columns:
        return Standardiser({}, {})
    row = df.agg(
        *[F.avg(ident(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(ident(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    means = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    # A constant column's deviation can come out as rounding dust instead of zero.
    deviations = {
        c: (s if s is not None and s > 1e-12 * max(1.0, abs(means[c])) else 1.0)
        for i, c in enumerate(columns)
        for s in [row[f"s{i}"]]
    }
    return Standardiser(means, deviations)


def label_codes(df: DataFrame, label: str) -> list[str]:
    """Distinct labels in ascending order; a label column is a class, so their number is checked."""
    require_columns(df, label)
    values = [r[0] for r in df.where(ident(label).isNotNull()).select(ident(label).cast("string")).distinct().limit(MAX_INDICATORS + 1).collect()]
    if len(values) > MAX_INDICATORS:
        raise ValueError(f"{label!r} has more than {MAX_INDICATORS} distinct values, which is not a class label")
    return sorted(values)


def label_encode(df: DataFrame, label: str, name: str = "label_code") -> DataFrame:
    """Text labels to 0..k-1 in ascending order, null to -1; numeric labels stay as they are."""
    if not is_text(df.schema[label].dataType):
        return df.withColumn(name, ident(label))
    codes = F.array(*[F.lit(v) for v in label_codes(df, label)])
    return df.withColumn(
        name, F.when(ident(label).isNull(), F.lit(-1)).otherwise(F.array_position(codes, ident(label)).cast("int") - 1)
    )
