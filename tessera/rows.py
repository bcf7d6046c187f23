"""Calls beside SQL: single rows, batches, searches and bounded results. Mixed into session.Database.

Rows are known by the table's key. A call for one row reads or rewrites as its SQL would; a batch is one append.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fulltext, spatial_search, vector_search


class RowApi:
    # rows
    def batch_insert(self, name: str, rows: Iterable[Sequence[Any]]) -> int:
        """Rows with all columns, in the table's order; the number of them."""
        return self.append(name, self.spark.createDataFrame([tuple(r) for r in rows], self._get(name).schema))

    def batch_insert_map(self, name: str, rows: Iterable[Mapping[str, Any]]) -> int:
        """Rows as column names and values; columns that no row has get their defaults, others null where a row hasn't."""
        rows, schema = [dict(r) for r in rows], self._get(name).schema
        fields = [f for f in schema if any(f.name in r for r in rows)]
        if unknown := {k for r in rows for k in r} - {f.name for f in schema}:
            raise ValueError(f"no columns {sorted(unknown)}")
        frame = self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], type(schema)(fields))
        return self.append(name, frame)

    def insert_row(self, name: str, row: Sequence[Any]) -> int:
        return self.batch_insert(name, [row])

    def insert_row_map(self, name: str, row: Mapping[str, Any]) -> int:
        return self.batch_insert_map(name, [row])

    def get_row(self, name: str, key: Any) -> tuple | None:
        found = self.table(name).filter(F.col(self._get(name).key) == F.lit(key)).take(1)
        return tuple(found[0]) if found else None

    def get_row_map(self, name: str, key: Any) -> dict[str, Any] | None:
        found = self.get_row(name, key)
        return dict(zip([f.name for f in self._get(name).schema], found, strict=True)) if found else None

    def update_row(self, name: str, key: Any, row: Sequence[Any]) -> int:
        """The number of rows changed, 0 or 1."""
        fields = [f.name for f in self._get(name).schema]
        sets = ", ".join(f"{f} = ?{i}" for i, f in enumerate(fields, 1))
        return self.execute(f"UPDATE {name} SET {sets} WHERE {self._get(name).key} = ?{len(fields) + 1}", (*row, key))

    def delete_row(self, name: str, key: Any) -> int:
        return self.execute(f"DELETE FROM {name} WHERE {self._get(name).key} = ?", (key,))

    def row_count(self, name: str) -> int:
        return self.table(name).count()

    # searches
    def query_by_column(self, name: str, column: str, value: Any) -> DataFrame:
        return self.table(name).filter(F.col(column) == F.lit(value))

    def query_by_column_range(self, name: str, column: str, low: Any, high: Any) -> DataFrame:
        """low included, high not."""
        return self.table(name).filter((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))

    def query_by_column_between(self, name: str, column: str, low: Any, high: Any) -> DataFrame:
        return self.table(name).filter(F.col(column).between(F.lit(low), F.lit(high)))

    def query_timestamp_range(self, name: str, start: Any, end: Any) -> DataFrame:
        """Both ends included; the table must have a time column."""
        time = self._get(name).time
        if not time:
            raise ValueError(f"{name!r} has no time column")
        return self.query_by_column_between(name, time, start, end)

    def text_search(self, name: str, column: str, query: str) -> DataFrame:
        return fulltext.search_all(self.table(name), column, query)

    def text_search_ranked(self, name: str, column: str, query: str, k: int) -> DataFrame:
        return fulltext.bm25_rank(self.table(name), self._get(name).key, column, query, k)

    def vector_search(self, name: str, column: str, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
        return vector_search.knn(self.table(name), column, query, k, self._get(name).key, metric)

    def spatial_knn(self, name: str, column: str, at: tuple[float, ...], k: int) -> DataFrame:
        return spatial_search.st_knn(self.table(name), column, at, k, self._get(name).key)

    # results
    @contextmanager
    def _timed(self):
        """Jobs within are cancelled when the time is up."""
        if self.timeout is None:
            yield
            return
        context, group = self.spark.sparkContext, f"query-{uuid.uuid4().hex}"
        context.setJobGroup(group, "bounded query", interruptOnCancel=True)
        over, done = threading.Event(), threading.Event()

        def watch() -> None:
            wait = self.timeout
            while not done.wait(wait):  # again and again, as a query may start further jobs
                over.set()
                context.cancelJobGroup(group)
                wait = 0.2

        threading.Thread(target=watch, daemon=True).start()
        try:
            yield
        except Exception as error:
            if over.is_set():
                raise TimeoutError(f"over {self.timeout} s") from error
            raise
        finally:
            done.set()
            context.setLocalProperty("spark.jobGroup.id", None)
        if over.is_set():
            raise TimeoutError(f"over {self.timeout} s")

    def _rows(self, sql: str, params: Sequence[Any]) -> DataFrame:
        found = self.execute(sql, params)
        if not isinstance(found, DataFrame):
            raise ValueError("not a query")
        return found

    def query(self, sql: str, params: Sequence[Any] = ()) -> list[tuple]:
        """All rows of a query; an error if there are more than max_result_rows."""
        found = self._rows(sql, params)
        with self._timed():
            rows = (found if self.max_result_rows is None else found.limit(self.max_result_rows + 1)).collect()
        if self.max_result_rows is not None and len(rows) > self.max_result_rows:
            raise ValueError(f"over {self.max_result_rows} rows")
        return [tuple(r) for r in rows]

    def for_each(self, sql: str, each: Callable[[tuple], Any], params: Sequence[Any] = ()) -> int:
        """Calls each row, a partition at a time in the driver, until `each` returns False; the number of calls. An error
        at the row after max_result_rows."""
        n = 0
        with self._timed():
            for row in self._rows(sql, params).toLocalIterator(prefetchPartitions=True):
                if n == self.max_result_rows:
                    raise ValueError(f"over {self.max_result_rows} rows")
                n += 1
                if each(tuple(row)) is False:
                    break
        return n

    def materialize(self, sql: str, path: str, params: Sequence[Any] = ()) -> None:
        """A query's rows as a Parquet folder; nothing comes to the driver."""
        with self._timed():
            self._rows(sql, params).write.option("compression", "zstd").parquet(path)
