"""CSV and parquet sources, schema preparation and result sinks."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window



# ------------------------------------------------------------------ CSV reading
def csv_has_header(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """A first line with any non-numeric cell is a header."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    cells = next(csv.reader([first["value"]], delimiter=sep, skipinitialspace=True), [])  # quotes are not part of a cell

    def numeric(cell: str) -> bool:
        try:
            float(cell)
        except ValueError:
            return False
        return True

    return not all(numeric(c) for c in cells)


def read_numeric_csv(spark: SparkSession, path: str, target: str = "Outcome") -> DataFrame:
    """Numeric CSV with or without header; target is the named or the last column."""
    raw = spark.read.csv(path, header=csv_has_header(spark, path))
    name = target if target in raw.columns else raw.columns[-1]
    features = [c for c in raw.columns if c != name]
    return raw.select(
        *[F.col(f"`{c}`").cast("double").alias(f"x_{c.lstrip('_')}") for c in features],
        F.col(f"`{name}`").cast("double").cast("int").alias("label"),
    )


def read_named_csv(
    spark: SparkSession, path: str, names: Sequence[str], null_token: str = "?", types: Mapping[str, str] | None = None
) -> DataFrame:
    """Headerless CSV with given names; leading blanks trimmed, one token read as NULL.
    `types` gives the SQL types of columns that are not text, so that the table can go on to
    `to_features` with its numbers as numbers."""
    schema = ", ".join(f"`{n}` {(types or {}).get(n, 'string')}" for n in names)
    return spark.read.schema(schema).csv(
        path, header=False, ignoreLeadingWhiteSpace=True, nullValue=null_token
    )


# --------------------------------------------------------------- column rules
def binarise(value: Column | str, positive: str) -> Column:
    """1 where the trimmed text equals `positive`, else 0."""
    column = F.col(value) if isinstance(value, str) else value
    return (F.trim(column) == positive).cast("int")


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes 0..k-1 in lexicographic order of the distinct values."""
    distinct = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    # ordered over the distinct set only: one row per category, not per record
    return distinct.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("int").alias("code"))


def encode_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace text columns by their integer codes. The lookup join is broadcast by
    Spark when the dictionary is under its size threshold and shuffled otherwise."""
    out = df
    for c in columns:
        codes = category_codes(df, c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_k_{c}"))
        out = out.join(codes, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
    return out.select(*[F.col(f"_k_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def pick_target(columns: Sequence[str], pattern: str) -> str:
    """First column whose name contains the pattern, else the last column."""
    return next((c for c in columns if pattern in c.lower()), columns[-1])


@dataclass(frozen=True)
class TableSpec:
    """Rules turning a raw table into a feature table."""

    row_id: str
    target: str | None = None
    target_pattern: str = "default"
    drop: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()
    text_target: bool = False


def nominal_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The table's own spelling of nominal names, which are given without regard to case."""
    wanted = {n.casefold() for n in names}
    found = {c.casefold(): c for c in df.columns if c.casefold() in wanted}
    if unknown := wanted - found.keys():
        raise KeyError(f"the table has no column for the nominal names {sorted(unknown)}")
    return [found[n.casefold()] for n in names]


def to_features(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Apply a spec: drop ids, choose the target, encode text, mark nominal columns."""
    target = spec.target or pick_target([c for c in df.columns if c not in spec.drop], spec.target_pattern)
    nominal = set(nominal_columns(df, spec.nominal))
    kinds = dict(df.dtypes)
    features = [c for c in df.columns if c not in {spec.row_id, target, *spec.drop}]
    text = [c for c in features if kinds[c] == "string" and c not in nominal]
    encode = text + ([target] if spec.text_target else [])
    coded = encode_categories(df, encode) if encode else df
    return coded.select(
        F.col(spec.row_id).cast("bigint").alias("row_id"),
        F.col(target).cast("int").alias("label"),
        *[
            F.col(c).cast("int").alias(f"c_{c}") if c in text or c in nominal else F.col(c).cast("double").alias(f"x_{c}")
            for c in features
        ],
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells become NULL so that aggregates and ordering skip them."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if kinds[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )


def require_binary(df: DataFrame, label: str = "label") -> DataFrame:
    """Fail unless the label takes exactly two values."""
    classes = df.agg(F.count_distinct(label)).first()[0]
    if classes != 2:
        raise ValueError(f"expected a binary target, found {classes} classes")
    return df


# -------------------------------------------------------------------- registry
@dataclass
class Registry:
    """Named feature-table builders."""

    builders: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, builder: Callable[[SparkSession, str], DataFrame]) -> None:
        self.builders[name] = builder

    def load(self, name: str, spark: SparkSession, folder: str) -> DataFrame:
        if name not in self.builders:
            raise ValueError(f"unknown dataset {name!r}; available: {sorted(self.builders)}")
        return self.builders[name](spark, folder)


# --------------------------------------------------------------------- profile
def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by prefix."""
    return [c for c in df.columns if c.startswith("x_")], [c for c in df.columns if c.startswith("c_")]


def profile(df: DataFrame) -> DataFrame:
    """Rows, features, imbalance ratio, minority % and missing-cell % in one scan."""
    num, cat = feature_columns(df)
    cells = num + cat
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cells), F.lit(0))
    ones, zeros = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    smaller, larger = F.least(ones, zeros), F.greatest(ones, zeros)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(cells)).alias("n_features"),
        F.round(larger / smaller, 6).alias("imbalance_ratio"),
        F.round(100 * smaller / (ones + zeros), 6).alias("minority_pct"),
        F.round(100 * nulls / (F.count("*") * len(cells)), 6).alias("missing_pct"),
    )


# ---------------------------------------------------------- result files, resume
def read_stage(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """Results of one stage; only its partition folders are listed and read."""
    return spark.read.parquet(folder).where(F.col("stage") == stage)


def drop_failed(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("failed"), F.lit(True)))


def failed_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if("failed").alias("n_failed"))


def write_results(df: DataFrame, path: str, by: Sequence[str] = ("stage", "dataset", "seed")) -> None:
    """Partitioned result write; only partitions present in `df` are replaced, and the
    output committer publishes a partition as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def open_tasks(tasks: DataFrame, finished: DataFrame, code_id: str, keys: Sequence[str]) -> DataFrame:
    """Tasks with no finished run under the same code id (resume)."""
    done = finished.where(F.col("code_id") == code_id).select(*keys).distinct()
    return tasks.join(done, list(keys), "left_anti")


def mixed_code_parts(finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts written by more than one code id; a resume must refuse these."""
    return (
        finished.groupBy(*keys)
        .agg(F.countDistinct("code_id").alias("n_codes"))
        .where("n_codes > 1")
    )


def incomplete_parts(finished: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Parts whose row count differs from the grid's expectation."""
    return finished.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") != expected)


def significant(column: Column, digits: int = 6) -> Column:
    """Round to significant digits (0 stays 0)."""
    magnitude = F.floor(F.log10(F.abs(column)))
    factor = F.pow(F.lit(10.0), F.lit(digits - 1) - magnitude)
    return F.when(column == 0, F.lit(0.0)).otherwise(F.rint(column * factor) / factor)


def write_rounded_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV export with doubles at `digits` significant digits."""
    rounded = df.select(
        *[significant(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
    rounded.write.mode("overwrite").csv(path, header=True)


