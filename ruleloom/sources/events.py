"""Where a rule's field names find their values: typed columns or one VARIANT column.

Both kinds of schema answer the same three questions about a dotted field name: is there a value
(``present``), its text, and its number. A name that can't have a value gives ``None``, which the compiler turns
into a constant null, so that Catalyst folds it away.

Text of a value: strings as they are, integers in decimal, other numbers cut towards zero and clamped to
64 bits, ``true``/``false``, ``null`` for an explicit null (VARIANT only), JSON for arrays and objects.
Number of a value: integers, other numbers cut towards zero where they fit 64 bits, strings of an optional
sign and digits; nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
_TOP = float(2**63)


def valid_path(path: str) -> bool:
    return bool(path) and ".." not in path and not path.startswith(".") and not path.endswith(".")


def strict_integer(text: Column) -> Column:
    """The 64-bit integer that a text of an optional sign and digits stands for."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def truncated(value: Column) -> Column:
    """A double cut towards zero; null where it doesn't fit 64 bits or isn't finite."""
    return F.when((value >= -_TOP) & (value < _TOP), value).try_cast("bigint")


def clamped_text(value: Column) -> Column:
    """A double cut towards zero as text, clamped to 64 bits; ``null`` if it isn't finite."""
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    inside = F.when(value >= _TOP, F.lit(2**63 - 1)).when(value < -_TOP, F.lit(-(2**63))).otherwise(value.try_cast("bigint"))
    return F.when(odd, "null").otherwise(inside.cast("string"))


def parsed_double(text: Column) -> Column:
    """The double that a text stands for as a whole; null for other texts."""
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z") | F.lower(text).rlike(r"^[+-]?(inf|infinity|nan)\z"), text.try_cast("double"))


@dataclass(frozen=True)
class Value:
    """A field's value as columns. ``plain`` means that the text is a string column of the source.

    ``double`` is a number as it is, or what a text stands for; null for anything else.
    """

    present: Column
    text: Column
    number: Column
    double: Column
    plain: bool = False
    exact_number: bool = False

    @property
    def is_number(self) -> Column:
        """Whether the value is a number or a text that stands for one."""
        return self.double.isNotNull()


class StructEvents:
    """Typed columns; dots reach into structs and string-keyed maps. A null is a missing value."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self._found: dict[str, Value | None] = {}

    def _resolve(self, path: str) -> tuple[Column, T.DataType] | None:
        if not valid_path(path):
            return None
        column, kind = None, self.schema
        for part in path.split("."):
            if isinstance(kind, T.StructType):
                if part not in kind.names:
                    return None
                kind = kind[part].dataType
                column = F.col(f"`{part}`") if column is None else column.getField(part)
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
            else:
                return None
        return column, kind

    def field(self, path: str) -> Value | None:
        if path not in self._found:
            got = self._resolve(path)
            self._found[path] = None if got is None else self._value(*got)
        return self._found[path]

    @staticmethod
    def _value(c: Column, kind: T.DataType) -> Value:
        none, no_double = F.lit(None).cast("bigint"), F.lit(None).cast("double")
        if isinstance(kind, T.StringType):
            return Value(c.isNotNull(), c, strict_integer(c), parsed_double(c), plain=True)
        if isinstance(kind, _INTEGERS):
            return Value(c.isNotNull(), c.cast("string"), c.cast("bigint"), c.cast("double"), exact_number=True)
        if isinstance(kind, _FRACTIONS):
            d = c.cast("double")
            return Value(c.isNotNull(), clamped_text(d), truncated(d), d)
        if isinstance(kind, T.VariantType):
            return VariantEvents.value_of(c)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return Value(c.isNotNull(), F.to_json(c), none, no_double)
        return Value(c.isNotNull(), c.cast("string"), none, no_double)

    def bind(self, df: DataFrame) -> DataFrame:
        return df

    def strings(self) -> Column:
        """All top-level string values."""
        names = [f.name for f in self.schema.fields if isinstance(f.dataType, T.StringType)]
        return F.array_compact(F.array(*[F.col(f"`{n}`") for n in names])) if names else F.array().cast("array<string>")

    def keywords(self) -> Column:
        return _keywords(self._resolve, lambda got: got[0] if isinstance(got[1], T.StringType) else F.lit(None).cast("string"))


@dataclass
class VariantEvents:
    """One VARIANT column. Each used field is extracted once, in a projection below the rules."""

    column: str = "event"
    _taken: dict[str, int] = field(default_factory=dict)

    def field(self, path: str) -> Value | None:
        if not valid_path(path):
            return None
        n = self._taken.setdefault(path, len(self._taken))
        return Value(F.col(f"__t{n}").isNotNull(), F.col(f"__t{n}"), F.col(f"__n{n}"), F.col(f"__d{n}"))

    def bind(self, df: DataFrame) -> DataFrame:
        """Add the columns of all fields asked for so far."""
        if not self._taken:
            return df
        values = {f"__v{n}": F.try_variant_get(self.column, self._json_path(p), "variant") for p, n in self._taken.items()}
        numbers = self._taken.values()
        kinds = {f"__k{n}": F.schema_of_variant(f"__v{n}") for n in numbers}
        typed = {f"__{k}{n}": c for n in numbers for k, c in self.typed(F.col(f"__v{n}"), F.col(f"__k{n}")).items()}
        # In projections of their own: each is computed once, however many branches look at it.
        df = df.withColumns(values).withColumns(kinds).withColumns(typed)
        out = {}
        for n in numbers:
            value = self.value_of(F.col(f"__v{n}"), F.col(f"__k{n}"), {k: F.col(f"__{k}{n}") for k in "sifb"})
            out[f"__t{n}"], out[f"__n{n}"], out[f"__d{n}"] = value.text, value.number, value.double
        return df.withColumns(out).drop(*values, *kinds, *typed)

    @staticmethod
    def _json_path(path: str) -> str:
        return "$" + "".join('["{}"]'.format(part.replace('"', '\\"')) for part in path.split("."))

    @staticmethod
    def typed(v: Column, kind: Column) -> dict[str, Column]:
        """The value as a string, integer, fraction or boolean; all but the one that it is are null."""
        as_ = lambda t: F.try_variant_get(v, "$", t)
        fraction = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        return {"s": F.when(kind == "STRING", as_("string")), "i": F.when(kind == "BIGINT", as_("bigint")), "f": F.when(fraction, as_("double")), "b": F.when(kind == "BOOLEAN", as_("boolean"))}

    @classmethod
    def value_of(cls, v: Column, kind: Column | None = None, typed: dict[str, Column] | None = None) -> Value:
        kind = F.schema_of_variant(v) if kind is None else kind
        s, i, f, b = (typed or cls.typed(v, kind)).values()
        text = (
            F.when(v.isNull(), None)
            .when(F.is_variant_null(v), "null")
            .when(s.isNotNull(), s)
            .when(i.isNotNull(), i.cast("string"))
            .when(f.isNotNull(), clamped_text(f))
            .when(b.isNotNull(), b.cast("string"))
            .otherwise(F.to_json(v))
        )
        number = F.when(i.isNotNull(), i).when(f.isNotNull(), truncated(f)).when(s.isNotNull(), strict_integer(s))
        double = F.when(i.isNotNull(), i.cast("double")).when(f.isNotNull(), f).when(s.isNotNull(), parsed_double(s))
        return Value(v.isNotNull(), text, number, double)

    def strings(self) -> Column:
        """All top-level string values."""
        top = F.try_variant_get(self.column, "$", "map<string, variant>")
        text = lambda k, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        return F.array_compact(F.map_values(F.transform_values(top, text)))

    def keywords(self) -> Column:
        def resolve(path):
            v = F.try_variant_get(self.column, self._json_path(path), "variant")
            return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

        return _keywords(resolve, lambda got: got)


def _keywords(resolve, text) -> Column:
    """The event's keyword as an array: ``message``, else ``alert.signature``, if a string; else null."""
    found = [text(got) for got in (resolve("message"), resolve("alert.signature")) if got is not None]
    word = F.coalesce(*found) if found else F.lit(None).cast("string")
    return F.when(word.isNotNull(), F.array(word))


def event_schema(df: DataFrame, column: str = "event") -> StructEvents | VariantEvents:
    """The schema of a frame: its VARIANT column of that name, else its typed columns."""
    if column in df.columns and isinstance(df.schema[column].dataType, T.VariantType):
        return VariantEvents(column)
    return StructEvents(df.schema)


def parse_events(lines: DataFrame, column: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """JSON text to a VARIANT column ``event``; blank lines go.

    ``PERMISSIVE`` leaves a null event where the text isn't JSON, ``DROPMALFORMED`` drops those rows and
    ``FAILFAST`` fails. Set ``spark.sql.variant.allowDuplicateKeys`` to keep the last of equal keys.
    """
    text = F.col(column).cast("string")
    filled = lines.where(text.rlike(r"\S"))
    if mode == "FAILFAST":
        return filled.withColumn("event", F.parse_json(text))
    parsed = filled.withColumn("event", F.try_parse_json(text))
    return parsed.where(F.col("event").isNotNull()) if mode == "DROPMALFORMED" else parsed


def read_ndjson(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Events of newline-delimited JSON files, with the text in ``value``."""
    return parse_events(spark.read.text(path), mode=mode)


def with_identity(events: DataFrame, id_column: str | None = None, ts_column: str | None = None) -> DataFrame:
    """Give events an id and a time where the caller names no columns for them."""
    id_ = F.col(id_column).cast("string") if id_column else F.uuid()
    ts = F.col(ts_column).cast("timestamp") if ts_column else F.current_timestamp()
    return events.withColumn("event_id", id_).withColumn("event_ts", ts)
