"""Tables opened under a contract: what they must have is checked before anything reads them, and all that differs is told at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BrokenContract(ValueError):
    """A table is not what its readers expect; args[1] has the differences."""


@dataclass(frozen=True)
class Contract:
    """Columns and their types; those that hold no nulls, that tell rows apart together, and rules that no row may break.

    version is a column that says by which schema a row was written: rows of a later one than supported are refused, as
    nothing here knows what they mean.
    """

    columns: dict[str, str]
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    rules: dict[str, Column] = field(default_factory=dict)
    version: tuple[str, int] | None = None


def schema_faults(df: DataFrame, contract: Contract) -> list[tuple[str, str]]:
    """(column, fault) of columns that are missing or of another type; further columns are no fault."""
    found = {name.lower(): kind for name, kind in df.dtypes}
    out = [(c, "missing" if c.lower() not in found else f"is {found[c.lower()]}, not {kind}") for c, kind in contract.columns.items() if found.get(c.lower()) != kind]
    return sorted(out)


def row_faults(df: DataFrame, contract: Contract) -> DataFrame:
    """(name, fault, n) of what rows break, with how many do: one scan for nulls, rules and versions, one group for keys."""
    tests: dict[tuple[str, str], Column] = {(c, "null"): F.col(c).isNull() for c in contract.required}
    tests |= {(name, "rule"): ~F.coalesce(rule, F.lit(True)) for name, rule in contract.rules.items()}
    if contract.version:
        name, supported = contract.version
        tests[name, f"version over {supported}"] = F.coalesce(F.col(name) > supported, F.lit(False))
    names = list(tests)
    out = df.sparkSession.createDataFrame([], "name string, fault string, n long")
    if names:
        counts = df.agg(*[F.sum(tests[k].cast("long")).alias(f"_{i}") for i, k in enumerate(names)])
        out = counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("fault"), F.coalesce(f"_{i}", F.lit(0)).alias("n")) for i, (a, b) in enumerate(names)])).alias("x")).select("x.*")
    if contract.unique:
        twice = df.groupBy(*contract.unique).agg(F.count("*").alias("m")).where("m > 1").agg(F.count("*").alias("n"))
        out = out.unionByName(twice.select(F.lit(", ".join(contract.unique)).alias("name"), F.lit("repeated").alias("fault"), "n"))
    return out.where("n > 0")


def checked_open(spark: SparkSession, path: str, contract: Contract, rows: bool = True, fmt: str = "parquet") -> DataFrame:
    """The contract's columns of a table, or BrokenContract with all that differs; rows=False checks the schema alone, without a scan.

    Nothing is written, whatever the table's version. Other columns are left out.
    """
    df = spark.read.format(fmt).load(path)
    faults: list[tuple] = schema_faults(df, contract)
    if not faults and rows:
        faults = sorted(tuple(r) for r in row_faults(df, contract).collect())  # a line a rule
    if faults:
        raise BrokenContract(f"{path}: " + "; ".join(" ".join(map(str, f)) for f in faults), faults)
    return df.select(*contract.columns)
