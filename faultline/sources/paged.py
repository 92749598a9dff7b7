"""Issues read page by page through a Python data source, with keyset tokens and pushed filters.

For stores that hand out pages: a page is asked for with a token, the ``(updated, key)`` of
the last row seen, never with an offset, so rows that change meanwhile neither shift nor
repeat others. :class:`ParquetPages` is such a store over Parquet files; another one passes its own class.

    spark.dataSource.register(PagedIssues)
    spark.read.format("paged_issues").option("path", path).load()
"""

from __future__ import annotations

import datetime
import importlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema

#: Filters on a column that a page can be asked with.
PUSHED = {
    EqualTo: lambda c, v: c == v,
    GreaterThan: lambda c, v: c > v,
    GreaterThanOrEqual: lambda c, v: c >= v,
    LessThan: lambda c, v: c < v,
    LessThanOrEqual: lambda c, v: c <= v,
    In: lambda c, v: c.isin(list(v)),
}


#: Bytes of rows that are read ahead of a page.
HELD_BYTES = 64 << 20


class ParquetPages:
    """Pages of Parquet files in the order of ``updated`` (rows without it are left out) and ``key``.

    :meth:`page` reads the row groups whose statistics reach behind its token, and holds at
    most two pages of rows while it looks for the first ones. :meth:`pages` goes through one
    row group and reads ahead, so a table in any order is read about once.
    """

    def __init__(self, path: str, updated: str, key: str) -> None:
        if "://" in path:
            self.files, root = pyarrow.fs.FileSystem.from_uri(path)
        else:
            self.files, root = pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")
        self.updated, self.key = updated, key
        self.data = ds.dataset(root, filesystem=self.files, format="parquet")

    def schema(self) -> T.StructType:
        return from_arrow_schema(self.data.schema)

    def value(self, moment):
        """A token's moment (ISO text, if it is a time) as a value of the column."""
        kind = self.data.schema.field(self.updated).type
        if moment is None or not pa.types.is_temporal(kind):
            return moment
        return self._literal(self.updated, datetime.datetime.fromisoformat(moment))

    def _literal(self, name: str, value):
        """A time as the column has it, with or without a zone; other values as they are."""
        kind = self.data.schema.field(name).type
        if not isinstance(value, datetime.datetime) or not pa.types.is_timestamp(kind):
            return value
        if kind.tz is None and value.tzinfo:
            value = value.astimezone(datetime.UTC).replace(tzinfo=None)
        elif kind.tz is not None and not value.tzinfo:
            value = value.replace(tzinfo=datetime.UTC)
        return pa.scalar(value, pa.timestamp("us", kind.tz))

    def token(self, table: pa.Table, row: int) -> list:
        moment, key = table[self.updated][row], table[self.key][row].as_py()
        if pa.types.is_temporal(moment.type):
            moment = moment.cast(pa.timestamp("us", getattr(moment.type, "tz", None))).as_py().isoformat()
        else:
            moment = moment.as_py()
        return [moment, key]

    def _behind(self, token: list) -> ds.Expression:
        at = self.value(token[0])
        return (ds.field(self.updated) > at) | ((ds.field(self.updated) == at) & (ds.field(self.key) > token[1]))

    def _test(self, where: list, after: list | None, until: list | None) -> ds.Expression | None:
        test = None
        parts = [PUSHED[kind](ds.field(name), self._literal(name, value)) for kind, name, value in where]
        parts += [self._behind(after)] if after else []
        parts += [~self._behind(until)] if until else []
        for part in parts:
            test = part if test is None else test & part
        return test

    def page(
        self, columns: list[str], where: list, after: list | None, until: list | None, rows: int
    ) -> pa.Table:
        """The first ``rows`` rows behind ``after`` and not behind ``until`` that pass the filters."""
        test = self._test(where, after, until)
        order = [(self.updated, "ascending"), (self.key, "ascending")]
        names = list(dict.fromkeys([*columns, self.updated, self.key]))
        best = None
        for batch in self.data.scanner(columns=names, filter=test, batch_size=rows).to_batches():
            if batch.num_rows:
                some = pa.Table.from_batches([batch])
                best = some if best is None else pa.concat_tables([best, some])
                best = best.take(pc.select_k_unstable(best, min(rows, best.num_rows), order))
        empty = pa.schema([self.data.schema.field(n) for n in names]).empty_table()
        return empty if best is None else best

    def groups(self) -> list[tuple[str, int, int]]:
        """File, number and rows of every row group."""
        pieces = [g for f in self.data.get_fragments() for g in f.split_by_row_group()]
        return [(g.path, g.row_groups[0].id, g.row_groups[0].num_rows) for g in pieces]

    def pages(
        self, group: tuple[str, int, int], columns: list[str], where: list, after: list | None, until: list | None, rows: int
    ) -> Iterator[pa.Table]:
        """The row group's rows behind ``after`` and not behind ``until``, in order, ``rows`` a page.

        A scan gives the first ``HELD_BYTES`` of them (one page at least); if there are more,
        the next one goes on behind the last token. Rows of one token stay together. Rows without
        a time are left out; those without a key come first, in no order, if there is no ``until``.
        """
        piece = self.data.format.make_fragment(group[0], filesystem=self.files, row_groups=[group[1]])
        names = list(dict.fromkeys([*columns, self.updated, self.key]))
        order = [(self.updated, "ascending"), (self.key, "ascending")]
        timed, keyed = ds.field(self.updated).is_valid(), ds.field(self.key).is_valid()

        def scan(test: ds.Expression, after: list | None) -> Iterator[pa.Table]:
            asked = self._test(where, after, until)
            test = test if asked is None else test & asked
            batches = piece.scanner(schema=self.data.schema, columns=names, filter=test, batch_size=rows).to_batches()
            return (pa.Table.from_batches([b]) for b in batches if b.num_rows)

        if after is None and until is None:
            yield from scan(timed & ~keyed, None)
        while True:
            held, size, beyond = [], 0, None
            for some in scan(timed & keyed, after):
                held.append(some if beyond is None else some.filter(~beyond))
                size += held[-1].nbytes
                if size > 2 * HELD_BYTES:
                    own = pa.concat_tables(held)
                    most = max(rows, own.num_rows * HELD_BYTES // size)
                    if most < own.num_rows:
                        best = pc.select_k_unstable(own, most, order)
                        beyond = self._behind(self.token(own, best[most - 1].as_py()))
                        own = own.filter(~beyond)
                    held, size = [own], own.nbytes
            if not held:
                return
            best = pa.concat_tables(held).sort_by(order)
            for at in range(0, best.num_rows, rows):
                yield best.slice(at, rows)
            if beyond is None:
                return
            after = self.token(best, best.num_rows - 1)

    def cuts(self, slices: int) -> list[list]:
        """Tokens that cut the table into about equal slices, from the files' statistics alone."""
        groups = []
        for file in self.data.files:
            with self.files.open_input_file(file) as source:
                meta = pq.ParquetFile(source).metadata
            place = meta.schema.to_arrow_schema().get_field_index(self.updated)
            for k in range(meta.num_row_groups):
                stats = meta.row_group(k).column(place).statistics
                if stats is not None and stats.has_min_max:
                    groups.append((stats.max, meta.row_group(k).num_rows))
        groups.sort(key=lambda g: g[0])
        total, seen, out = sum(n for _, n in groups), 0, []
        for top, n in groups[:-1]:
            seen += n
            if seen * slices >= (len(out) + 1) * total and len(out) < slices - 1:
                moment = top.isoformat() if isinstance(top, datetime.datetime | datetime.date) else top
                if not out or out[-1] != moment:
                    out.append(moment)
        return out

    def last(self, after: list | None) -> list | None:
        """The token of the last row behind ``after``."""
        test = self._behind(after) if after else None
        best = None
        for batch in self.data.scanner(columns=[self.updated, self.key], filter=test).to_batches():
            if batch.num_rows:
                some = pa.Table.from_batches([batch])
                best = some if best is None else pa.concat_tables([best, some])
                best = best.take(pc.select_k_unstable(best, 1, [(self.updated, "descending"), (self.key, "descending")]))
        return self.token(best, 0) if best is not None else after


class Slice(InputPartition):
    """Rows whose ``updated`` lies above ``low`` and not above ``high`` (None: open), or, for a
    stream, between two tokens; of a store that has row groups, those of some of them."""

    def __init__(
        self, low=None, high=None, after: list | None = None, until: list | None = None, groups: list | None = None
    ) -> None:
        super().__init__(None)
        self.low, self.high, self.after, self.until, self.groups = low, high, after, until, groups


class _Pages:
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.options, self.schema, self.where = dict(options), schema, []
        self.rows, self.slices = int(options.get("page_rows", "10000")), int(options.get("slices", "16"))

    def store(self):
        return _store(self.options)

    def dealt(self, groups: list, after: list | None = None, until: list | None = None) -> list[Slice]:
        """The row groups in slices of about as many rows, one slice at least."""
        parts = [Slice(after=after, until=until, groups=[]) for _ in range(max(1, min(self.slices, len(groups))))]
        sizes = [0] * len(parts)
        for group in sorted(groups, key=lambda g: -g[2]):
            least = sizes.index(min(sizes))
            parts[least].groups.append(group)
            sizes[least] += group[2]
        return parts

    def pages(self, part: Slice) -> Iterator[pa.RecordBatch]:
        store, where, after = self.store(), list(self.where), part.after
        names = [f.name for f in self.schema]
        if part.groups is not None:
            for group in part.groups:
                for page in store.pages(group, names, where, after, part.until, self.rows):
                    yield from page.select(names).combine_chunks().to_batches()
            return
        if part.low is not None:
            where.append((GreaterThan, store.updated, store.value(part.low)))
        if part.high is not None:
            where.append((LessThanOrEqual, store.updated, store.value(part.high)))
        while True:
            page = store.page(names, where, after, part.until, self.rows)
            if page.num_rows:
                yield from page.select(names).combine_chunks().to_batches()
            if page.num_rows < self.rows:
                return
            after = store.token(page, page.num_rows - 1)


class IssueReader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        nested = T.ArrayType | T.MapType | T.StructType
        known = {f.name for f in self.schema if not isinstance(f.dataType, nested)}
        named = [(f, ".".join(f.attribute) if hasattr(f, "attribute") else None) for f in filters]
        self.where += [(type(f), name, f.value) for f, name in named if name in known and type(f) in PUSHED]
        asked = {name for _, name, _ in self.where}  # a row that passes has no null there
        for f, name in named:
            if not (name in known and (type(f) in PUSHED or isinstance(f, IsNotNull) and name in asked)):
                yield f

    def partitions(self) -> list[Slice]:
        store = self.store()
        if hasattr(store, "groups"):
            return self.dealt(store.groups())
        cuts = store.cuts(self.slices)
        return [Slice(low, high) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.pages(partition)


class IssueStreamReader(_Pages, DataSourceStreamReader):
    """New and changed issues behind the last token; the offset is the token."""

    def initialOffset(self) -> dict:
        return {"token": json.dumps(None)}

    def latestOffset(self) -> dict:
        return {"token": json.dumps(self.store().last(getattr(self, "_seen", None)))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        after, until = json.loads(start["token"]), json.loads(end["token"])
        self._seen = after
        if not until or until == after:
            return []
        store = self.store()
        return self.dealt(store.groups(), after, until) if hasattr(store, "groups") else [Slice(after=after, until=until)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.pages(partition)

    def commit(self, end: dict) -> None:
        self._seen = json.loads(end["token"])


class PagedIssues(DataSource):
    """Format ``paged_issues``. Options: path, updated, key, page_rows (10000), slices (16) and
    ``store`` (``module:Class`` with the methods of :class:`ParquetPages`; ``groups`` and ``pages`` if it
    can read parts of itself)."""

    @classmethod
    def name(cls) -> str:
        return "paged_issues"

    def schema(self) -> T.StructType:
        return _store(self.options).schema()

    def reader(self, schema: T.StructType) -> IssueReader:
        return IssueReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> IssueStreamReader:
        return IssueStreamReader(self.options, schema)


def _store(options):
    module, name = options.get("store", "faultline.sources.paged:ParquetPages").split(":")
    kind = getattr(importlib.import_module(module), name)
    return kind(options["path"], options.get("updated", "updated"), options.get("key", "key"))


def read_pages(spark, path: str, updated: str = "updated", key: str = "key", stream: bool = False, **options):
    """The issues below ``path`` as a batch or a stream, see :class:`PagedIssues`."""
    spark.dataSource.register(PagedIssues)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = (spark.readStream if stream else spark.read).format("paged_issues")
    return reader.options(path=path, updated=updated, key=key, **{k: str(v) for k, v in options.items()}).load()
