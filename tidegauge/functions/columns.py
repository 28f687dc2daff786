"""Column roles and scalar expressions (projection, casting, labels, null rules)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names that carry an id rather than a measurement.
TECHNICAL_NAMES = ("unnamed:0", "unnamed:0.1", "index", "row_id", "rowid", "record_id")
TECHNICAL_PREFIX = "unnamed:"

# Labels shown for blanks, folded tails and missing segments.
BLANK_LABEL = "(en blanco)"
OTHER_LABEL = "Other"
MISSING_LABEL = "<MISSING>"
MODE_FALLBACK = "<FALTANTE>"

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ZERO_TOLERANCE = 1e-8


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. The defaults are the flow-table names."""

    key: str = "Unnamed: 0"
    target: str = "DaysInDeposit"
    period: str = "week"
    class_code: str = "Size"
    categorical: tuple[str, ...] = ("Owner", "Condition", "Type", "Quality")
    overlap: tuple[str, ...] = ("Owner", "Size", "Type", "Quality", "week")
    expected: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "in": ("Unnamed: 0", "Condition", "Owner", "Size", "Type", "Quality", "week"),
            "out": ("Unnamed: 0", "Owner", "Size", "Type", "Quality", "DaysInDeposit", "week"),
        }
    )


def c(name: str) -> Column:
    """Reference a column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_technical(name: str) -> bool:
    """Names in the fixed set, and names with its prefix, in any case and with any white space."""
    plain = "".join(name.split()).lower()
    return plain in {n.lower() for n in TECHNICAL_NAMES} or plain.startswith(TECHNICAL_PREFIX.lower())


def analytical_columns(df: DataFrame, keep: Iterable[str] = ()) -> list[str]:
    hidden = {name for name in df.columns if is_technical(name)}.difference(keep)
    return [name for name in df.columns if name not in hidden]


def analytical(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Project away the technical id columns."""
    return df.select(*[c(name) for name in analytical_columns(df, keep)])


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name in analytical_columns(df) if is_numeric(df, name)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [name for name in analytical_columns(df) if not is_numeric(df, name)]


def reject_nested(df: DataFrame, names: Iterable[str]) -> None:
    nested = [n for n in names if isinstance(df.schema[n].dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise ValueError(f"Nested columns cannot be profiled: {', '.join(nested)}")


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    as_double = value.cast("double")
    return F.when(F.isnan(as_double) | (F.abs(as_double) == float("inf")), None).otherwise(as_double)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL; other types pass unchanged."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c(name)), None).otherwise(c(name))
    return c(name)


def to_number(text: Column) -> Column:
    """Parse plain decimal text; anything else is NULL (never an error under ANSI mode)."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: numbers stay, text is parsed."""
    return finite(c(name)) if is_numeric(df, name) else to_number(c(name))


def as_text(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("string")


def label(df: DataFrame, name: str) -> Column:
    """Display label: blanks named, text trimmed, whole numbers without decimals."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        text = number_label(finite(c(name)).cast("double"))
    else:
        text = F.trim(c(name).cast("string"))
    return F.when(text.isNull() | (text == ""), F.lit(BLANK_LABEL)).otherwise(text)


def number_label(value: Column) -> Column:
    """A double in short: whole numbers as integers, fractions plainly, an exponent only below 0.0001."""
    text, size = value.cast("string"), F.abs(value)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E-", -1)
    tiny = F.concat(mantissa, F.lit("e-"), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"\.?0+$", "")
    return F.when(size >= 9e15, F.format_string("%.0f", value)).when(
        value == F.floor(value), F.floor(value).cast("string")).when(size < 1e-4, tiny).when(text.contains("E"), plain).otherwise(text)


def segment_label(columns: Iterable[str]) -> Column:
    """Joined segment key; a missing part reads ``<MISSING>``."""
    parts = [F.coalesce(c(name).cast("string"), F.lit(MISSING_LABEL)) for name in columns]
    return F.concat_ws(" | ", *parts)


def near_zero(value: Column) -> Column:
    return F.abs(value) <= ZERO_TOLERANCE


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Percentage with the denominator floored at one row."""
    return F.round(part / F.greatest(whole, F.lit(1)) * 100.0, digits)
