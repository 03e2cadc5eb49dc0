"""Table functions for SQL, over tables of any columns.

    select * from running_decay(TABLE(accesses), key => 'folder', at => 'ts', value => 'reward', half_life => 24.0)
    select * from gap_sessions(TABLE(accesses), key => 'folder', at => 'ts', gap => 1800)

Each asks Spark to partition the table by its key and to order it by time, and returns
all columns of the table and its own. Of a key's rows it holds a few numbers only. Rows
with a null key are one key. Rows without a time come first and leave its own columns
null. Times are TIMESTAMP_NTZ, or TIMESTAMP where the session's zone has no summer time.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _constant(name: str, given: AnalyzeArgument, least: float | None = None):
    """What a constant argument says: a column's name, or a number over ``least``."""
    if given.isTable or not given.isConstantExpression or given.value is None:
        raise ValueError(f"{name} must be a constant")
    if least is not None and not float(given.value) > least:
        raise ValueError(f"{name} must be over {least}")
    return given.value


def _appended(table: AnalyzeArgument, columns: dict[str, AnalyzeArgument], added: list[T.StructField]) -> AnalyzeResult:
    """The table's schema and ``added``, named apart from it in whatever case; partitioned by
    the first of ``columns``, ordered by the others."""
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE")
    names = [_constant(name, given) for name, given in columns.items()]
    for name in names:
        if name not in table.dataType.names:
            raise ValueError(f"{name}: one of {', '.join(table.dataType.names)}")
    out, taken = T.StructType(list(table.dataType.fields)), {n.lower() for n in table.dataType.names}
    for field in added:
        name = field.name
        while name.lower() in taken:
            name += "_"
        out = out.add(name, field.dataType)
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    return AnalyzeResult(out, partitionBy=[PartitioningColumn(quoted[0])], orderBy=[OrderingColumn(q, ascending=True, overrideNullsFirst=True) for q in quoted[1:]])


class RunningDecay:
    """decayed: the sum of a key's values so far, each halved for every ``half_life`` hours
    since. A null value adds nothing. Rows of one time are taken by their values, ascending."""

    def __init__(self):
        self.total, self.last = 0.0, None

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, value: AnalyzeArgument, half_life: AnalyzeArgument) -> AnalyzeResult:
        _constant("half_life", half_life, 0)
        return _appended(table, {"key": key, "at": at, "value": value}, [T.StructField("decayed", T.DoubleType())])

    def eval(self, table: Row, key: str, at: str, value: str, half_life: float):
        now = table[at]
        if now is None:
            yield (*table, None)
            return
        if self.last is not None:
            self.total *= 2.0 ** (-(now - self.last).total_seconds() / 3600 / float(half_life))
        self.last = now
        self.total += float(table[value] or 0)
        yield (*table, self.total)


class GapSessions:
    """session and place, from 1: a key's sessions end where its next row comes more than
    ``gap`` seconds later, and each row has its place in its session."""

    def __init__(self):
        self.session, self.place, self.last = 0, 0, None

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        _constant("gap", gap, 0)
        return _appended(table, {"key": key, "at": at}, [T.StructField("session", T.LongType()), T.StructField("place", T.LongType())])

    def eval(self, table: Row, key: str, at: str, gap: float):
        now = table[at]
        if now is None:
            yield (*table, None, None)
            return
        if self.last is None or (now - self.last).total_seconds() > float(gap):
            self.session, self.place = self.session + 1, 0
        self.last, self.place = now, self.place + 1
        yield (*table, self.session, self.place)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("running_decay", udtf(RunningDecay))
    spark.udtf.register("gap_sessions", udtf(GapSessions))
