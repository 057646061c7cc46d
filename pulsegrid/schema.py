"""Table contracts: schemas, header aliases, validation, and NaN to NULL at the door."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _TEXT, _TIME = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


READINGS = _table(subject_id=_LONG, seq=_LONG, ts=_DOUBLE, ir=_DOUBLE, red=_DOUBLE)
WINDOWS = _table(subject_id=_LONG, win=_INT, n=_INT, ir=T.ArrayType(_DOUBLE), red=T.ArrayType(_DOUBLE))
SUBJECTS = _table(id=_LONG, name=_TEXT, age=_INT, gender=_TEXT, glucose_level=_DOUBLE, created_at=_TIME)
RUNS = _table(id=_LONG, subject_id=_LONG, status=_TEXT, started_at=_TIME, completed_at=_TIME, log=_TEXT)
PREDICTIONS = _table(id=_LONG, subject_id=_LONG, pipeline_run_id=_LONG, predicted=_DOUBLE, actual=_DOUBLE, features=T.MapType(_TEXT, _DOUBLE), created_at=_TIME)
NODES = _table(tree=_INT, node=_INT, feature=_TEXT, threshold=_DOUBLE, yes=_INT, no=_INT, leaf=_DOUBLE, gain=_DOUBLE, cover=_DOUBLE)

#: Fixed header spellings, lower case and trimmed, by canonical column; the first one that a header has counts.
ALIASES = {
    "ir": ("ir_value", "ir", "infrared", "ir value", "ir_raw"),
    "red": ("red_value", "red", "red value", "red_raw"),
    "ts": ("ts", "timestamp", "time"),
}


def number(column: Column | str) -> Column:
    """A double from anything; what is no finite number becomes NULL."""
    c = F.col(column) if isinstance(column, str) else column
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in floats else F.col(c) for c in df.columns])


def resolve(columns: list[str], aliases: dict[str, tuple[str, ...]] | None = None, required: tuple[str, ...] = ("ir", "red")) -> dict[str, str]:
    """Canonical name to the input's own; the first match wins. Raises if a required one is missing."""
    found: dict[str, str] = {}
    for name, spellings in (aliases or ALIASES).items():
        own = {c.strip().lower(): c for c in columns}
        if hit := next((s for s in spellings if s in own), None):
            found[name] = own[hit]
    if missing := [r for r in required if r not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}; found {', '.join(columns)}")
    return found


def normalize_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None, required: tuple[str, ...] = ("ir", "red")) -> DataFrame:
    """Projects to canonical names; other columns stay as they are."""
    found = resolve(df.columns, aliases, required)
    return df.withColumnsRenamed({old: new for new, old in found.items()})


def column_sets(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Names that are there, missing and extra, in order."""
    return {"present": [c for c in expected if c in df.columns], "missing": [c for c in expected if c not in df.columns], "extra": [c for c in df.columns if c not in expected]}


def validate(df: DataFrame, contract: T.StructType) -> DataFrame:
    """The contract's columns in its order, cast; raises if one is missing."""
    if lost := column_sets(df, contract.names)["missing"]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.fields])
