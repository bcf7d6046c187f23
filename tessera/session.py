"""A database of Parquet tables behind the engine's SQL: DDL, row changes, queries, parameters, staged transactions.

A table is a list of immutable folders. INSERT adds one; UPDATE and DELETE write the rows anew and swap the list, so a reader
of an older list is never disturbed, and BEGIN, savepoints and ROLLBACK copy and put back lists. One writer; the last one wins.
Indexes are names only: scans prune by Parquet statistics. VACUUM and CHECKPOINT do nothing.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera import dialect
from tessera.rows import RowApi

# Type names and Spark's types.
TYPES = {
    "INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "FLOAT": "double", "REAL": "double", "DOUBLE": "double", "TEXT": "string", "VARCHAR": "string", "STRING": "string",
    "BOOLEAN": "boolean", "BOOL": "boolean", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz", "VECTOR": "array<float>",
    "GEOMETRY": "struct<x:double,y:double,z:double>", "GEOM": "struct<x:double,y:double,z:double>", "POINT3D": "struct<x:double,y:double,z:double>",
}
NAME = r"[^\W\d]\w*"


@dataclass(frozen=True)
class Defined:
    schema: StructType
    key: str
    time: str | None = None
    counter: str | None = None  # the auto-increment column
    next: int = 1
    defaults: dict[str, str] = field(default_factory=dict)
    required: frozenset[str] = frozenset()
    sizes: dict[str, int] = field(default_factory=dict)  # of vectors
    declared: bool = False  # whether the key was declared, so is unique
    paths: tuple[str, ...] = ()


def parts(text: str) -> list[str]:
    """Comma-separated parts outside brackets and strings."""
    out, depth, now = [], 0, ""
    for t in dialect.TOKEN.findall(text):
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if t == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += t
    return [*out, now.strip()] if now.strip() else out


def numbered(text: str) -> str:
    """Plain parameters by their place, so that a part of the text may be used twice."""
    n = iter(range(1, len(text) + 1))
    return "".join(f"?{next(n)}" if t == "?" else t for t in dialect.TOKEN.findall(text))


class Database(RowApi):
    def __init__(self, spark: SparkSession, path: str, max_result_rows: int | None = None, timeout: float | None = None):
        """max_result_rows and timeout (seconds) bound what `query` and `for_each` of RowApi bring to the driver."""
        self.spark, self.path = spark.newSession(), path.rstrip("/")
        self.max_result_rows, self.timeout = max_result_rows, timeout
        for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.timestampType": "TIMESTAMP_NTZ", "spark.sql.ansi.enabled": "true"}.items():
            self.spark.conf.set(k, v)
        self.tables: dict[str, Defined] = {}
        self.indexes: dict[str, str] = {}
        self.saved: list[tuple[str, dict[str, Defined]]] = []
        self.last_id: int | None = None

    def register(self, name: str, path: str, key: str | None = None, time: str | None = None) -> None:
        """A Parquet file or folder as a table."""
        schema = self.spark.read.parquet(path).schema
        self._put(name, Defined(schema, key or schema[0].name, time, paths=(path,)))

    def table(self, name: str) -> DataFrame:
        t = self._get(name)
        return self.spark.read.schema(t.schema).parquet(*t.paths) if t.paths else self.spark.createDataFrame([], t.schema)

    def _get(self, name: str) -> Defined:
        if name.lower() not in self.tables:
            raise ValueError(f"no table {name!r}")
        return self.tables[name.lower()]

    def _put(self, name: str, t: Defined) -> None:
        self.tables[name.lower()] = t
        self.table(name).createOrReplaceTempView(name)

    def _known(self, name: str) -> dialect.Table | None:
        t = self.tables.get(name.lower())
        whole = lambda s: frozenset(f.name.lower() for f in s if f.dataType.typeName() in ("long", "integer", "short"))
        return t and dialect.Table(t.key, t.time, whole(t.schema), frozenset(f.name.lower() for f in t.schema))

    def _sql(self, text: str, params=()) -> DataFrame:
        return self.spark.sql(dialect.rewrite(text, self._known, self.last_id), args={f"p{i}": v for i, v in enumerate(params, 1)} or None)

    def _written(self, name: str, rows: DataFrame) -> str:
        path = f"{self.path}/{name.lower()}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def execute(self, sql: str, params=()) -> DataFrame | int | None:
        """Rows of a query (lazily), the number of changed rows, or None."""
        sql = numbered(sql.strip().rstrip(";").strip())
        for pattern, action in ACTIONS:
            if m := re.fullmatch(pattern, sql, re.I | re.S):
                return action(self, *m.groups(), params=params)
        return self._sql(sql, params)

    def create(self, quiet, name, columns_and_more, params=()):
        if name.lower() in self.tables:
            if quiet:
                return None
            raise ValueError(f"table {name!r} exists")
        inside = dialect.nested(columns_and_more)
        if not inside or not isinstance(inside[0], dialect.Group):
            raise ValueError("CREATE TABLE needs columns")
        depth, end = 0, 0
        for end, ch in enumerate(columns_and_more):  # noqa: B007
            depth += (ch == "(") - (ch == ")")
            if not depth:
                break
        t = Defined(StructType(), "", time=(m := re.search(rf"(?i)timeseries\s*\(\s*({NAME})", columns_and_more[end:])) and m[1])
        for column in parts(columns_and_more[1:end]):
            t = self._with_column(t, column)
        self._put(name, t if t.key else replace(t, key=t.schema[0].name))
        return None

    def _with_column(self, t: Defined, text: str) -> Defined:
        m = re.fullmatch(rf"({NAME})\s+({NAME})\s*(?:\(\s*(\d+)\s*\))?(.*)", text, re.S)
        if not m or m[2].upper() not in TYPES:
            raise ValueError(f"bad column {text!r}")
        name, kind, size, rest = m.groups()
        schema = StructType([*t.schema.fields]).add(name, _parse_datatype_string(TYPES[kind.upper()]))
        t = replace(t, schema=schema, sizes=t.sizes | ({name: int(size)} if size and kind.upper() == "VECTOR" else {}))
        if re.search(r"(?i)primary\s+key", rest):
            t = replace(t, key=name, declared=True, required=t.required | {name})
        if re.search(r"(?i)not\s+null", rest):
            t = replace(t, required=t.required | {name})
        if m := re.search(r"(?i)auto_increment(?:\s*=\s*(\d+))?", rest):
            t = replace(t, counter=name, next=int(m[1] or 1))
        if m := re.search(r"(?is)default\s+('(?:[^']|'')*'|\S+)", rest):
            t = replace(t, defaults=t.defaults | {name: m[1]})
        return t

    def drop(self, quiet, name, params=()):
        if name.lower() in self.tables or not quiet:
            self._get(name)
            del self.tables[name.lower()]
            self.spark.catalog.dropTempView(name)

    def add_column(self, name, column, params=()):
        t = self._get(name)
        if column.split()[0].lower() in (f.name.lower() for f in t.schema):
            raise ValueError(f"column of {column!r} exists")
        self._put(name, self._with_column(t, column))

    def set_counter(self, name, n, params=()):
        self._put(name, replace(self._get(name), next=int(n)))

    def create_index(self, name, table, params=()):
        self._get(table)
        self.indexes[name.lower()] = table

    def drop_index(self, name, params=()):
        if self.indexes.pop(name.lower(), None) is None:
            raise ValueError(f"no index {name!r}")

    def insert(self, name, columns, values, params=()):
        t = self._get(name)
        names = [x.strip() for x in columns.split(",")] if columns else [f.name for f in t.schema]
        rows = self._sql(f"SELECT * FROM VALUES {values} AS v({', '.join(names)})", params)
        return self.append(name, rows)

    def append(self, name: str, rows: DataFrame) -> int:
        """Rows with some or all of the table's columns: defaults, counters and checks as in INSERT."""
        t = self._get(name)
        have = {c.lower(): c for c in rows.columns}
        if unknown := set(have) - {f.name.lower() for f in t.schema}:
            raise ValueError(f"no columns {sorted(unknown)}")
        given = lambda f: F.col(have[f.name.lower()]) if f.name.lower() in have else F.expr(dialect.rewrite(t.defaults.get(f.name, "NULL")))
        columns = [given(f).cast(f.dataType).alias(f.name) for f in t.schema]
        rows = rows.select(*columns)
        staged = None
        if t.counter and t.counter.lower() not in have:
            staged = self._written(name, rows.withColumn("_place", F.monotonically_increasing_id()))
            rows = self._counted(self.spark.read.parquet(staged), t)
        path = self._written(name, rows)
        if staged:
            self._delete(staged)
        new = self.spark.read.schema(t.schema).parquet(path)
        seen = self._checked(name, t, new, path, self.table(name) if t.paths else None)
        if t.counter and seen["_last"] is not None:
            self.last_id = seen["_last"]
            t = replace(t, next=max(t.next, seen["_last"] + 1))
        self._put(name, replace(t, paths=(*t.paths, path)))
        return seen["_n"]

    def _counted(self, rows: DataFrame, t: Defined) -> DataFrame:
        """Ids without gaps: a row's place in its task, plus the rows of the tasks before (one number a task), plus the counter."""
        task, place = F.shiftright("_place", 33).alias("_task"), F.col("_place").bitwiseAND((1 << 33) - 1)
        sizes = sorted(tuple(r) for r in rows.groupBy(task).count().collect())
        starts, at = [], t.next
        for k, n in sizes:
            starts.append((k, at))
            at += n
        starts = self.spark.createDataFrame(starts, "_task long, _start long")
        numbered = rows.withColumn("_task", task).join(F.broadcast(starts), "_task")
        return numbered.withColumn(t.counter, F.col("_start") + place).select(*[f.name for f in t.schema])

    def _checked(self, name: str, t: Defined, new: DataFrame, path: str, others: DataFrame | None, keys: bool = True) -> dict:
        """Number of new rows and the largest counter; if a rule is broken, new's folder is deleted and an error raised."""
        checks = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{c}") for c in t.required]
        checks += [F.count(F.when(F.size(c) != n, 1)).alias(f"_size_{c}") for c, n in t.sizes.items()]
        checks += [F.max(t.counter).alias("_last")] if t.counter else []
        seen = new.agg(F.count("*").alias("_n"), F.min(t.key).alias("_low"), F.max(t.key).alias("_high"), *checks).first().asDict()
        broken = [k for k, v in seen.items() if k.startswith(("_null_", "_size_")) and v]
        error = f"not null or vector size violated: {broken}" if broken else None
        if not error and t.declared and keys:
            again = new.groupBy(t.key).count().filter("count > 1").select(t.key)
            if others is not None and seen["_low"] is not None:  # only row groups that can hold a new key are read
                old = others.select(t.key).filter(F.col(t.key).between(F.lit(seen["_low"]), F.lit(seen["_high"])))
                again = again.unionByName(new.join(old, t.key, "left_semi").select(t.key))
            error = None if again.isEmpty() else f"duplicate key in {name!r}"
        if error:
            self._delete(path)
            raise ValueError(error)
        return seen

    def update(self, rest, params=()):
        head, *more = dialect.clauses(rest, "SET", "WHERE")
        name, changes, where = head, *(more + [""])[:2]
        if not re.fullmatch(NAME, name) or not more:
            raise ValueError(f"bad UPDATE of {head!r}")
        t, sets = self._get(name), {}
        for change in parts(changes):
            column, _, value = change.partition("=")
            sets[column.strip().lower()] = value.strip()
        if unknown := set(sets) - {f.name.lower() for f in t.schema}:
            raise ValueError(f"no columns {sorted(unknown)}")
        value = lambda f: f"CASE WHEN _hit THEN {sets[f.name.lower()]} ELSE {f.name} END AS {f.name}"
        columns = ", ".join(value(f) if f.name.lower() in sets else f.name for f in t.schema)
        rows = self._sql(f"SELECT _hit, {columns} FROM (SELECT *, {f'coalesce({where}, false)' if where else 'true'} AS _hit FROM {name}) AS {name}", params)
        seen = Observation()
        rows = rows.observe(seen, F.count_if("_hit").alias("n")).select(*[F.col(f.name).cast(f.dataType) for f in t.schema])
        path = self._written(name, rows)
        self._checked(name, t, self.spark.read.schema(t.schema).parquet(path), path, None, t.key.lower() in sets)
        self._put(name, replace(t, paths=(path,)))
        return seen.get["n"]

    def delete(self, name, where, params=()):
        t, condition = self._get(name), f"coalesce({where}, false)" if where else "true"
        seen = Observation()
        rows = self._sql(f"SELECT *, {condition} AS _hit FROM {name}", params).observe(seen, F.count_if("_hit").alias("n"))
        path = self._written(name, rows.filter("NOT _hit").drop("_hit"))
        self._put(name, replace(t, paths=(path,)))
        return seen.get["n"]

    def save(self, name="", params=()):
        self.saved.append((name or "", dict(self.tables)))

    def commit(self, params=()):
        if not self.saved:
            raise ValueError("no transaction")
        self.saved.clear()

    def rollback(self, name=None, params=()):
        """To the start of the transaction, which ends, or to a savepoint, which stays."""
        at = next((i for i in reversed(range(len(self.saved))) if self.saved[i][0] == (name or "")), None)
        if at is None:
            raise ValueError("no such transaction or savepoint")
        gone, then = set(self.tables), dict(self.saved[at][1])
        del self.saved[at + bool(name) :]
        self.tables = {}
        for k in gone - set(then):
            self.spark.catalog.dropTempView(k)
        for k, t in then.items():
            self._put(k, t)

    def show(self, params=()):
        return self.spark.createDataFrame([(k,) for k in sorted(self.tables)], "table string")

    def describe(self, name, params=()):
        t = self._get(name)
        rows = [(f.name, f.dataType.simpleString(), f.name not in t.required, t.declared and f.name == t.key) for f in t.schema]
        return self.spark.createDataFrame(rows, "column string, type string, nullable boolean, key boolean")


ACTIONS = [
    (rf"create\s+table\s+(if\s+not\s+exists\s+)?({NAME})\s*(\(.*)", Database.create),
    (rf"drop\s+table\s+(if\s+exists\s+)?({NAME})", Database.drop),
    (rf"alter\s+table\s+({NAME})\s+add\s+(?:column\s+)?(.*)", Database.add_column),
    (rf"alter\s+table\s+({NAME})\s+auto_increment\s*=\s*(\d+)", Database.set_counter),
    (rf"create\s+(?:{NAME}\s+)?index\s+({NAME})\s+on\s+({NAME}).*", Database.create_index),
    (rf"drop\s+index\s+({NAME}).*", Database.drop_index),
    (rf"insert\s+into\s+({NAME})\s*(?:\(([^()]*)\))?\s*values\s*(.*)", Database.insert),
    (r"update\s+(.*)", Database.update),
    (rf"delete\s+from\s+({NAME})(?:\s+where\s+(.*))?", Database.delete),
    (r"begin(?:\s+transaction)?", Database.save),
    (r"commit", Database.commit),
    (rf"savepoint\s+({NAME})", Database.save),
    (rf"rollback(?:\s+to\s+(?:savepoint\s+)?({NAME}))?", Database.rollback),
    (r"show\s+tables", Database.show),
    (rf"(?:describe|desc)\s+({NAME})", Database.describe),
    (r"(?:checkpoint|vacuum).*", lambda db, params=(): None),
]
