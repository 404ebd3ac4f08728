"""Tables of a database, read by ranges of an integer key on the executors: in batches, or as a stream behind the last key.

`spark.dataSource.register(KeyRanges)` once a session (`registered` does), then
`spark.read.format("key_ranges").schema("id long, model string").options(driver="sqlite3", dsn=..., table=...)`.

Options: `driver` (a DB-API module), `dsn`, `connect` (JSON, more arguments of connect), `table`, `key`
(default `id`; SQLite's `rowid` serves too), `after` (the cursor: only larger keys), `batch` (rows fetched at a
time, 5,000), `range` (keys a partition spans, 100,000) and `expr.<column>` (what is selected for a
column that isn't one of the table's, such as a length). Only the schema's columns are asked for;
comparisons of plain columns with constants go to the database where
spark.sql.python.filterPushdown.enabled is set.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

#: Rows of one fetch.
BATCH = 5000
SPAN = 100_000
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class KeyRange(InputPartition):
    """Keys above `low` up to `high`."""

    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class Origin:
    """A table of a database. Holds no connection, so it can be sent to executors."""

    def __init__(self, options: dict, schema: StructType | None):
        get = {k.lower(): v for k, v in options.items()}
        self.driver, self.dsn, self.more = get["driver"], get["dsn"], json.loads(get.get("connect", "{}"))
        self.table, self.key = get["table"], get.get("key", "id")
        self.after, self.batch, self.span = int(get.get("after", 0)), int(get.get("batch", BATCH)), int(get.get("range", SPAN))
        self.made = {k[5:]: v for k, v in get.items() if k.startswith("expr.")}
        self.columns = schema.fieldNames() if schema else []
        for name in (self.table, self.key, *self.columns):
            if not re.fullmatch(r"\w+(\.\w+)*", name):
                raise ValueError(f"not a name: {name}")
        self.conditions: list[tuple[str, list]] = []

    def rows(self, sql: str, values: list) -> Iterator[tuple]:
        module = importlib.import_module(self.driver)
        mark = {"qmark": "?", "format": "%s", "pyformat": "%s"}[module.paramstyle]
        connection = module.connect(self.dsn, **self.more)
        try:
            cursor = connection.cursor()
            cursor.execute(sql.replace("?", mark), values)
            while found := cursor.fetchmany(self.batch):
                yield from found
        finally:
            connection.close()

    def pushed(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the conditions that the database can judge; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name is None or name.lower() in self.made:
                yield f
            elif type(f) in SIGNS and type(value) in (int, str):
                self.conditions.append((f"{name} {SIGNS[type(f)]} ?", [value]))
            elif isinstance(f, In) and all(type(v) in (int, str) for v in value):
                self.conditions.append((f"{name} IN ({', '.join('?' * len(value))})", list(value)))
            elif isinstance(f, IsNotNull):
                self.conditions.append((f"{name} IS NOT NULL", []))
            else:
                yield f

    def bounds(self) -> tuple[int, int]:
        """Least and largest key behind the cursor; (0, 0) if there is none."""
        low, high = next(self.rows(f"SELECT min({self.key}), max({self.key}) FROM {self.table} WHERE {self.key} > ?", [self.after]))
        return (0, 0) if low is None else (int(low), int(high))

    def ranges(self, low: int, high: int) -> list[KeyRange]:
        """(low, high] in spans."""
        return [KeyRange(at, min(at + self.span, high)) for at in range(low, high, self.span)]

    def read(self, part: KeyRange) -> Iterator[tuple]:
        """The rows of a range, page by page in order of the key, so no read of the database is long."""
        names = [self.made.get(c.lower(), c) for c in self.columns]
        more = "".join(f" AND {c}" for c, _ in self.conditions)
        values = [v for _, vs in self.conditions for v in vs]
        sql = f"SELECT {', '.join([*names, self.key])} FROM {self.table} WHERE {self.key} > ? AND {self.key} <= ?{more} ORDER BY {self.key} LIMIT {self.batch}"
        low = part.low
        while True:
            page = list(self.rows(sql, [low, part.high, *values]))
            yield from (tuple(r[:-1]) for r in page)
            if len(page) < self.batch:
                return
            low = page[-1][-1]


class RangeReader(DataSourceReader):
    def __init__(self, origin: Origin):
        self.origin = origin

    def pushFilters(self, filters):  # noqa: N802
        return self.origin.pushed(filters)

    def partitions(self):
        low, high = self.origin.bounds()
        return self.origin.ranges(low - 1, high) or [KeyRange(0, 0)]

    def read(self, partition):
        return self.origin.read(partition)


class RangeStreamReader(DataSourceStreamReader):
    """Offsets are keys: a micro-batch has the rows between the last key read and the largest there is."""

    def __init__(self, origin: Origin):
        self.origin = origin

    def initialOffset(self):  # noqa: N802
        return {"key": self.origin.after}

    def latestOffset(self):  # noqa: N802
        return {"key": max(self.origin.after, self.origin.bounds()[1])}

    def partitions(self, start, end):
        return self.origin.ranges(start["key"], end["key"])

    def read(self, partition):
        return self.origin.read(partition)


class KeyRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "key_ranges"

    def schema(self):
        raise ValueError("a schema is needed: only its columns are read")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(Origin(self.options, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return RangeStreamReader(Origin(self.options, schema))


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source known to it and comparisons handed on."""
    spark.dataSource.register(KeyRanges)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def table(spark: SparkSession, schema: str, stream: bool = False, **options: str | int) -> DataFrame:
    """A table of a database with the columns of `schema`; options as above (`expr_x` for `expr.x`)."""
    named = {re.sub("^expr_", "expr.", k): str(v) for k, v in options.items()}
    read = registered(spark).readStream if stream else registered(spark).read
    return read.format("key_ranges").schema(schema).options(**named).load()


def payloads(keys: DataFrame, schema: str, driver: str, dsn: str, table: str, key: str, connect: str = "{}", at_a_time: int = 500) -> DataFrame:
    """Columns of `schema` of the rows whose `key` is in `keys`: looked up on the executors, nothing else is read.

    The keys are sorted by range first, so that a task's lookups lie near each other.
    """
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)
    options = {"driver": driver, "dsn": dsn, "table": table, "key": key, "connect": connect}
    Origin(options, fields)  # names are checked

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        origin, kind = Origin(options, fields), to_arrow_schema(fields)
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for at in range(0, len(wanted), at_a_time):
                some = wanted[at : at + at_a_time]
                found = list(origin.rows(f"SELECT {', '.join(origin.columns)} FROM {table} WHERE {key} IN ({', '.join('?' * len(some))})", some))
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in found], schema=kind)

    return keys.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, fields)
