"""Rules of sessions as table functions of SQL, for the library's rules and for a caller's own.

``register(spark, name, make)`` makes ``SELECT * FROM name(rows => TABLE(...) PARTITION BY ... ORDER BY ..., session => 'column', ...)`` available; make turns the
further named arguments into a ``Rule`` of ``clocked`` and is called where the schema is worked out, so that the columns of the result may depend
on them. A partition's rows stream through one instance, in their order; deadlines ring between rows, and all that are left at the end. Rows
have a column ``at``, the time in whole numbers, that doesn't fall.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from textloom.streaming import clocked as C


def session_function(make: Callable[..., C.Rule]) -> type:
    """The class of a table function that runs make's rule over each partition."""

    class SessionFunction:
        @staticmethod
        def analyze(rows: AnalyzeArgument, session: AnalyzeArgument, **limits: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("rows must be a table: rows => TABLE(...)")
            for name, found in (("session", session), *limits.items()):
                if not found.isConstantExpression:
                    raise ValueError(f"{name} must be a constant")
            columns = rows.dataType
            for name in (session.value, "at"):
                if name not in columns.names:
                    raise ValueError(f"rows have no column {name}")
            emits = make(**{k: a.value for k, a in limits.items()}).emits
            out = T.StructType([columns[session.value]])
            for part in emits.split(", "):
                name, kind = part.split(" ", 1)
                out.add(name, {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[kind])
            return AnalyzeResult(out)

        def __init__(self) -> None:
            self.state, self.key, self.rule = None, None, None

        def eval(self, rows: Row, session: str, **limits) -> Iterator[tuple]:
            if self.rule is None:
                self.rule, self.key = make(**limits), rows[session]
            given = namedtuple("Given", rows.asDict())(*rows)
            self.state, out = C.stepped(self.rule, self.state, [given], -C.FOREVER)
            for found in out:
                yield (self.key, *found)

        def terminate(self) -> Iterator[tuple]:
            out: list[tuple] = []
            if self.rule is not None:
                C.rung(self.rule, self.state, C.FOREVER, out)
            for found in out:
                yield (self.key, *found)

    return SessionFunction


def register(spark: SparkSession, name: str, make: Callable[..., C.Rule]) -> None:
    spark.udtf.register(name, udtf(session_function(make)))


def register_all(spark: SparkSession) -> None:
    """The library's rules: sessions_ended (gap), blocks_closed (span, most, cost), saves_due (wait), requests_ended (timeout, most, one_ends_all)."""
    for name, make in (("sessions_ended", C.silence_rule), ("blocks_closed", C.block_rule), ("saves_due", C.autosave_rule), ("requests_ended", C.request_rule)):
        register(spark, name, make)
