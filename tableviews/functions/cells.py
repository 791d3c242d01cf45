"""Cell values: text, type, emptiness, and values taken from VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text that reads as a number.  A plain cast would also take Java suffixes such as "1d".
INTEGER_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"
REAL_TEXT = r"(?i)^\s*[+-]?(\d+(_\d+)*\.?|\d*\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?(nan|inf|infinity)\s*$"
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

INT_TYPES = ["BIGINT", "BOOLEAN"]

# How the number that is none reads as text.
NAN_TEXT = "NaN"


def variant_type(v: Column) -> Column:
    """JSON type of a VARIANT: VOID, BOOLEAN, BIGINT, DOUBLE, STRING, ARRAY or OBJECT.

    Decimals are what the JSON reader makes of number literals with a fraction,
    so they count as DOUBLE.
    """
    name = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    return F.when(name.isin("DECIMAL", "FLOAT"), "DOUBLE").otherwise(F.coalesce(name, F.lit("VOID")))


def variant_text(v: Column, vtype: Column | None = None) -> Column:
    """Text of a VARIANT scalar; NULL for JSON null.  A float keeps its point (5.0, not 5)."""
    vtype = variant_type(v) if vtype is None else vtype
    text = v.cast("string")
    return (
        F.when(vtype == "BOOLEAN", F.initcap(text))
        .when((vtype == "DOUBLE") & ~F.contains(text, F.lit(".")) & ~F.contains(text, F.lit("E")), F.concat(text, F.lit(".0")))
        .when(vtype.isin("ARRAY", "OBJECT"), F.to_json(v))
        .otherwise(text)
    )


def shown(value: Column) -> Column:
    """Cell text as shown inside rendered tables, where a missing value is written out."""
    return F.coalesce(value, F.lit("None"))


def number_of(text: Column) -> Column:
    """Text as DOUBLE, NULL when it does not read as a number."""
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def finite_or_null(x: Column) -> Column:
    """NaN and the infinities become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def finite_elements(xs: Column) -> Column:
    """``finite_or_null`` on every element of an array."""
    return F.transform(xs, finite_or_null)


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def is_meaningful(flat: Column) -> Column:
    """Whether the values of an answer say anything.

    ``flat`` is the answer as one array of text.  Empty answers, answers with
    only missing, empty or NaN values, and the single value zero do not count.  A NaN
    is what Spark writes for the number; a name such as Nan is a value.
    """
    says_something = F.exists(flat, lambda x: x.isNotNull() & (x != "") & (x != NAN_TEXT))
    only_zero = (F.size(flat) == 1) & F.coalesce(number_of(F.get(flat, F.lit(0))) == 0, F.lit(False))
    return F.coalesce((F.size(flat) > 0) & says_something & ~only_zero, F.lit(False))


def has_value(v: Column) -> Column:
    """Neither missing nor JSON null."""
    return v.isNotNull() & (variant_type(v) != "VOID")


def is_falsy(v: Column) -> Column:
    """Missing, null, empty text, zero, false, or an empty list or object."""
    text = v.cast("string")
    kind = variant_type(v)
    return v.isNull() | F.coalesce(
        (kind == "VOID")
        | ((kind == "STRING") & (text == ""))
        | ((kind == "BOOLEAN") & (text == "false"))
        | (kind.isin("BIGINT", "DOUBLE") & (text.try_cast("double") == 0))
        | (kind.isin("ARRAY", "OBJECT") & F.to_json(v).isin("[]", "{}")),
        F.lit(True),
    )


def first_filled(*cols: Column) -> Column:
    """First value that is neither missing nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def flat_values(v: Column, depth: int = 12) -> Column:
    """All scalars of a nested VARIANT list as one ARRAY<VARIANT>, in order.

    Each step opens one level of nesting, and a scalar becomes a list of one.  A list
    that is nested deeper than ``depth`` ends the job with an error.
    """
    def open_list(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))

    flat = open_list(v)
    for _ in range(depth - 1):
        flat = F.flatten(F.transform(flat, open_list))
    too_deep = F.exists(flat, lambda x: F.coalesce(variant_type(x) == "ARRAY", F.lit(False)))
    message = F.lit(f"an answer is nested deeper than {depth} lists")
    return F.when(too_deep, F.raise_error(message).cast("array<variant>")).otherwise(flat)


def collapse_single(rows: Column) -> Column:
    """The cell of a one-by-one result, NULL for every other shape."""
    first = F.get(rows, F.lit(0))
    return F.when((F.size(rows) == 1) & (F.size(first) == 1), F.get(first, F.lit(0)))


def voted_sql_type(vtype: Column, text: Column) -> Column:
    """Aggregate: INTEGER, REAL or TEXT for a column, from the JSON types and texts of its values.

    Typed numbers decide first; only a column without any is judged by how its text reads.
    """
    filled = text.isNotNull() & (vtype != "VOID")
    some = lambda test: F.coalesce(F.bool_or(F.coalesce(filled & test, F.lit(False))), F.lit(False))
    integer_text = text.rlike(INTEGER_TEXT)
    return (
        F.when(some(vtype == "DOUBLE"), "REAL")
        .when(some(vtype.isin(INT_TYPES)), "INTEGER")
        .when(some(text.rlike(REAL_TEXT) & ~integer_text), "REAL")
        .when(some(integer_text), "INTEGER")
        .otherwise("TEXT")
    )
