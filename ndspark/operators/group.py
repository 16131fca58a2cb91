"""Groups: hierarchies of arrays and groups in a store."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import formats
from ..errors import ArgumentError
from ..meta import ArrayMeta, GroupMeta, dumps
from ..sources.stores import CachingStore, ConsolidatedStore, Store, check_path, join, open_store
from .frame import ArrayFrame
from .node import check_empty, child_nodes, open_meta, write_meta


@dataclass(frozen=True)
class Group:
    spark: SparkSession
    store: Store
    path: str
    meta: GroupMeta
    writeable: bool = False

    @classmethod
    def open(cls, spark: SparkSession, where, path: str = "", mode: str = "r", consolidated: bool = False, format: int | None = None) -> Group:
        store, path = open_store(where), check_path(path)
        store = ConsolidatedStore(store, path) if consolidated else store
        meta = open_meta(store, path, format)
        if not isinstance(meta, GroupMeta):
            raise ArgumentError(f"{path!r} is an array")
        return cls(spark, store, path, meta, mode != "r")

    @classmethod
    def create(cls, spark: SparkSession, where, path: str = "", format: int = formats.DEFAULT_FORMAT, attrs: dict | None = None, indent: bool = False) -> Group:
        if format not in (2, 3):
            raise ArgumentError(f"format {format!r} is not known")
        store, path = open_store(where), check_path(path)
        check_empty(store, path)
        meta = GroupMeta(format, attrs or {})
        write_meta(store, path, meta, indent)
        return cls(spark, store, path, meta, True)

    def _writeable(self) -> None:
        if not self.writeable:
            raise ArgumentError(f"group {self.path!r} is not writeable")

    def create_group(self, name: str, attrs: dict | None = None) -> Group:
        self._writeable()
        return Group.create(self.spark, self.store, join(self.path, name), self.meta.format, attrs)

    def create_array(self, name: str, kind: str, shape: tuple[int, ...], **options) -> ArrayFrame:
        self._writeable()
        options = {"format": self.meta.format} | options
        return ArrayFrame.create(self.spark, kind, shape, self.store, join(self.path, name), **options)

    def with_attrs(self, **attrs) -> Group:
        """Change attributes of the group; None takes one away."""
        self._writeable()
        kept = {k: v for k, v in (self.meta.attrs | attrs).items() if v is not None}
        meta = GroupMeta(self.meta.format, kept)
        write_meta(self.store, self.path, meta)
        return Group(self.spark, self.store, self.path, meta, True)

    def _wrap(self, name: str, meta) -> ArrayFrame | Group:
        path = join(self.path, name)
        if isinstance(meta, ArrayMeta):
            return ArrayFrame.of_store(self.spark, self.store, path, meta, self.writeable)
        return Group(self.spark, self.store, path, meta, self.writeable)

    def __getitem__(self, name: str) -> ArrayFrame | Group:
        here = self
        for part in check_path(name).split("/"):
            found = dict(child_nodes(here.store, here.path)) if isinstance(here, Group) else {}
            if part not in found:
                raise KeyError(name)
            here = here._wrap(part, found[part])
        return here

    def __contains__(self, name: str) -> bool:
        try:
            return self[name] is not None
        except KeyError:
            return False

    def arrays(self) -> dict[str, ArrayFrame]:
        return {n: self._wrap(n, m) for n, m in child_nodes(self.store, self.path) if isinstance(m, ArrayMeta)}

    def groups(self) -> dict[str, Group]:
        return {n: self._wrap(n, m) for n, m in child_nodes(self.store, self.path) if isinstance(m, GroupMeta)}

    def _walk(self, path: str, name: str) -> Iterator[tuple[str, ArrayMeta | GroupMeta]]:
        for child, meta in child_nodes(self.store, path):
            yield join(name, child), meta
            if isinstance(meta, GroupMeta):
                yield from self._walk(join(path, child), join(name, child))

    def catalog(self) -> DataFrame:
        """(name, kind, element_type, shape, chunks) of all nodes below, one row each."""
        rows = [
            (name, "array", m.dtype.tag, list(m.shape), list(m.chunks)) if isinstance(m, ArrayMeta) else (name, "group", None, None, None)
            for name, m in self._walk(self.path, "")
        ]
        return self.spark.createDataFrame(rows, "name string, kind string, element_type string, shape array<bigint>, chunks array<bigint>")

    def consolidate(self) -> None:
        """Gather the metadata of all nodes into one document at this group."""
        self._writeable()
        nodes = [("", self.meta), *self._walk(self.path, "")]
        if self.meta.format == 3:
            inline = {name: m.to_json() for name, m in nodes if name}
            own = self.meta.to_json() | {"consolidated_metadata": {"kind": "inline", "must_understand": False, "metadata": inline}}
            self.store.put(join(self.path, formats.V3_NODE), dumps(own))
            return
        documents = {}
        for name, m in nodes:
            kind = formats.V2_ARRAY if isinstance(m, ArrayMeta) else formats.V2_GROUP
            documents[join(name, kind)] = m.to_json()
            if m.attrs:
                documents[join(name, formats.V2_ATTRS)] = m.attrs
        whole = {"metadata": documents, formats.CONSOLIDATED_KEY: 1}
        self.store.put(join(self.path, formats.V2_ALL), json.dumps(whole).encode())

    def cached(self, where) -> Group:
        """The same group, read through a cache in another store."""
        return Group(self.spark, CachingStore(self.store, open_store(where)), self.path, self.meta, False)


def open_node(spark: SparkSession, where, path: str = "", mode: str = "r", **options) -> ArrayFrame | Group:
    """An array or a group, whichever there is."""
    store, path = open_store(where), check_path(path)
    if options.pop("consolidated", False):
        store = ConsolidatedStore(store, path)
    meta = open_meta(store, path, options.pop("format", None))
    if isinstance(meta, ArrayMeta):
        return ArrayFrame.open(spark, store, path, mode, **options)
    return Group(spark, store, path, meta, mode != "r")


def cached_array(array: ArrayFrame, where) -> ArrayFrame:
    """The same array, read through a cache in another store, chunk by chunk. A cache that was
    made of an array with other metadata is an error."""
    store = CachingStore(array.store, open_store(where))
    mark, own = f"{store.marks}/{join(array.path, 'metadata')}", dumps(array.meta.to_json())
    if (found := store.cache.get(mark)) not in (None, own):
        raise ArgumentError("the cache holds chunks of an array with other metadata")
    if found is None:
        store.cache.put(mark, own)
    return ArrayFrame.of_store(array.df.sparkSession, store, array.path, array.meta, False, array.fill_as_missing)
