"""The data model: kinds of columns, comparisons, aggregates, and relations by ordinal."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ColumnNotFoundError


class Kind(Enum):
    INT = "Int"
    FLOAT = "Float"
    STRING = "String"
    OTHER = "Other"

    @property
    def spark(self) -> T.DataType:
        return {Kind.INT: T.LongType(), Kind.FLOAT: T.DoubleType()}.get(self, T.StringType())


class Comparator(Enum):
    EQ = "="
    LT = "<"
    GT = ">"
    LTE = "<="
    GTE = ">="
    NEQ = "!="


class AggregateKind(Enum):
    COUNT = "COUNT"
    SUM = "SUM"
    MIN = "MIN"
    MAX = "MAX"
    AVG = "AVG"


@dataclass(frozen=True)
class Comparison:
    """Column (by ordinal) against a literal: int, float or str."""

    ordinal: int
    comparator: Comparator
    value: int | float | str


@dataclass(frozen=True)
class Aggregate:
    """One aggregate; ordinal -1 means ``*``. Without an alias it is called FUNC_i, i its place."""

    kind: AggregateKind
    ordinal: int = -1
    alias: str | None = None


def kind_of(data_type: T.DataType) -> Kind:
    if isinstance(data_type, T.IntegralType):
        return Kind.INT
    if isinstance(data_type, T.FractionalType):
        return Kind.FLOAT
    return Kind.STRING if isinstance(data_type, T.StringType) else Kind.OTHER


@dataclass(frozen=True)
class Relation:
    """A lazy table. Inside, columns are called ``_0``, ``_1`` ...; the names are put on at the edge.

    So duplicate, case-sensitive and dotted names need no session setting.
    """

    df: DataFrame
    names: tuple[str, ...]
    kinds: tuple[Kind, ...]

    @classmethod
    def of(cls, df: DataFrame) -> Relation:
        """Any DataFrame, with its own types."""
        fields = df.schema.fields
        return cls(df.toDF(*[f"_{i}" for i in range(len(fields))]), tuple(df.columns), tuple(kind_of(f.dataType) for f in fields))

    def frame(self) -> DataFrame:
        return self.df.toDF(*self.names)

    def ordinal(self, name: str) -> int:
        """The first column so named, case-sensitively; -1 if there is none."""
        return self.names.index(name) if name in self.names else -1

    def resolve(self, name: str) -> int:
        if (at := self.ordinal(name)) < 0:
            raise ColumnNotFoundError(name, self.names)
        return at

    def has(self, ordinal: int) -> bool:
        return 0 <= ordinal < len(self.names)

    def col(self, ordinal: int) -> Column:
        return F.col(f"_{ordinal}")

    def replaced(self, df: DataFrame) -> Relation:
        return Relation(df, self.names, self.kinds)

    def selected(self, parts: list[tuple[Column, str, Kind]]) -> Relation:
        """A relation of the given (expression, name, kind)."""
        df = self.df.select(*[c.alias(f"_{i}") for i, (c, _, _) in enumerate(parts)])
        return Relation(df, tuple(p[1] for p in parts), tuple(p[2] for p in parts))
