"""Loading of raw tables by a contract, and the files that a forecast is handed over in."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class Table:
    """files: candidates, of which the first that exists is read. required: groups of names of which each table has one, in any case;
    the group's first name is the one that the loaded table carries. Files whose name ends in .csv are read with a header."""

    name: str
    files: tuple[str, ...]
    required: tuple[tuple[str, ...], ...] = ()
    schema: str | None = None


class ContractError(ValueError):
    """All that is missing, in one message."""


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A CSV file with header and given or inferred types, or Parquet; None where there is no file."""
    try:
        if path.endswith(".csv"):
            reader = spark.read.option("header", True)
            return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def agreed(df: DataFrame, table: Table) -> tuple[DataFrame, list[str]]:
    """The table under the contract's names, and the groups that it lacks; of several names of a group the first listed counts."""
    own: dict[str, str] = {}
    for c in df.columns:
        own.setdefault(c.lower(), c)
    renamed, missing = {}, []
    for group in table.required:
        found = next((own[n.lower()] for n in group if n.lower() in own), None)
        if found is None:
            missing.append(" or ".join(group))
        elif found != group[0]:
            renamed[found] = group[0]
    taken = {new.lower() for new in renamed.values()}
    kept = [c for c in df.columns if c in renamed or c.lower() not in taken]
    return df.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in kept]), missing


@dataclass(frozen=True)
class Loaded:
    frames: dict[str, DataFrame]
    files: dict[str, str]
    skipped: tuple[str, ...]

    def report(self) -> DataFrame:
        """Table, rows and file of each loaded table, counted in one job."""
        parts = [df.groupBy().count().select(F.lit(name).alias("table_name"), F.col("count").alias("n_rows"), F.lit(self.files[name]).alias("file")) for name, df in self.frames.items()]
        if not parts:
            raise ContractError("no table was loaded")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def save(self, prefix: str = "") -> None:
        """Each table over the managed one of its name."""
        for name, df in self.frames.items():
            df.write.mode("overwrite").saveAsTable(f"{prefix}{name}")


def load(spark: SparkSession, root: str, tables: Sequence[Table], strict: bool = False) -> Loaded:
    """Read all tables. A table without a file is an error if strict, else a warning; missing columns are always one error for all tables."""
    frames, files, absent, lacking = {}, {}, [], []
    for t in tables:
        found = next(((f, df) for f in t.files if (df := read(spark, f"{root.rstrip('/')}/{f}", t.schema)) is not None), None)
        if found is None:
            absent.append(t.name)
            continue
        files[t.name] = found[0]
        frames[t.name], missing = agreed(found[1], t)
        if missing:
            lacking.append(f"{t.name} ({found[0]}): {', '.join(missing)}")
    problems = [f"no file for {', '.join(absent)}"] * bool(absent and strict) + [f"missing columns in {x}" for x in lacking]
    if problems:
        raise ContractError("; ".join(problems))
    if absent:
        warnings.warn(f"no file for {', '.join(absent)}", stacklevel=2)
    return Loaded(frames, files, tuple(absent))


def modelling_frame(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in order, whole and decimal numbers as doubles; an empty table is an error."""
    if df.isEmpty():
        raise ContractError("the modelling table holds no rows")
    number = (T.IntegralType, T.DecimalType, T.FloatType)
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, number) and f.name not in order else F.col(f.name) for f in df.schema]).orderBy(*order)


def training_slice(df: DataFrame, start: dt.date | None, day: str = "sales_date", least: int = 1000) -> DataFrame:
    """Rows from a start on, which lies within the days of the table and leaves enough rows."""
    if start is None:
        return df
    ends = df.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count_if(F.col(day) >= F.lit(start)).alias("left")).head()
    if ends["first"] is None or not ends["first"] <= start <= ends["last"]:
        raise ContractError(f"{start} is not within {ends['first']} and {ends['last']}")
    if ends["left"] < least:
        raise ContractError(f"{start} leaves {ends['left']} rows of {least}")
    return df.filter(F.col(day) >= F.lit(start))


#: The columns of a forecast file, in order.
FORECAST = {"Date": "sales_date", "Revenue": "revenue", "COGS": "cogs"}


def write_forecast(forecast: DataFrame, path: str) -> None:
    """The forecast by day as CSV files with a header; days go to files by range, so that a name sort reads them in order."""
    forecast.select(*[F.col(c).alias(name) for name, c in FORECAST.items()]).repartitionByRange("Date").sortWithinPartitions("Date").write.mode("overwrite").option("header", True).csv(path)


def check_forecast(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether the file has the columns in order, its rows, its nulls by column, and whether it can be handed in."""
    df = spark.read.option("header", True).csv(path)
    ordered = df.columns == list(FORECAST)
    typed = {"Date": F.to_date, "Revenue": lambda c: c.try_cast("double"), "COGS": lambda c: c.try_cast("double")}
    empty: Callable[[str], object] = lambda c: F.count_if(typed[c](F.col(c)).isNull()) if c in df.columns else F.count("*")
    out = df.agg(F.count("*").alias("n_rows"), *[empty(c).alias(f"null_{c.lower()}") for c in FORECAST])
    return out.withColumn("columns_match", F.lit(ordered)).withColumn("valid", F.col("columns_match") & (F.col("n_rows") > 0) & (F.col("null_date") + F.col("null_revenue") + F.col("null_cogs") == 0))
