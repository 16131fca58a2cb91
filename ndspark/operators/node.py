"""Finding and writing the metadata of arrays and groups."""

from __future__ import annotations

import warnings

from .. import formats
from ..errors import ArgumentError
from ..meta import ArrayMeta, GroupMeta, dumps, loads
from ..sources.stores import Store, check_path, join


def _attrs(store: Store, path: str) -> dict:
    raw = store.get(join(path, formats.V2_ATTRS))
    return loads(raw) if raw else {}


def node_format(store: Store, path: str) -> int | None:
    """2 before 3; None where there is no node."""
    if store.exists(join(path, formats.V2_ARRAY)) or store.exists(join(path, formats.V2_GROUP)):
        return 2
    return 3 if store.exists(join(path, formats.V3_NODE)) else None


def open_meta(store: Store, path: str = "", format: int | None = None) -> ArrayMeta | GroupMeta:
    path = check_path(path)
    found = format or node_format(store, path)
    if found == 2:
        if raw := store.get(join(path, formats.V2_ARRAY)):
            return ArrayMeta.from_v2(loads(raw), _attrs(store, path))
        if store.get(join(path, formats.V2_GROUP)) is not None:
            return GroupMeta(2, _attrs(store, path))
    elif found == 3 and (raw := store.get(join(path, formats.V3_NODE))):
        d = loads(raw)
        if d.get(formats.FORMAT_KEY) != 3:
            raise ArgumentError(f"format {d.get(formats.FORMAT_KEY)!r} is not 3")
        return ArrayMeta.from_v3(d) if d.get("node_type") == "array" else GroupMeta.from_v3(d)
    elif found not in (None, 2, 3):
        raise ArgumentError(f"format {found!r} is not known")
    raise ArgumentError(f"there is no array or group at {path!r}")


def write_meta(store: Store, path: str, meta: ArrayMeta | GroupMeta, indent: bool = False) -> None:
    """The last step of any write: readers see a node once its metadata is there."""
    if meta.format == 3:
        store.put(join(path, formats.V3_NODE), dumps(meta.to_json(), indent))
        return
    if meta.attrs or store.exists(join(path, formats.V2_ATTRS)):
        store.put(join(path, formats.V2_ATTRS), dumps(meta.attrs, indent))
    name = formats.V2_ARRAY if isinstance(meta, ArrayMeta) else formats.V2_GROUP
    store.put(join(path, name), dumps(meta.to_json(), indent))


def check_empty(store: Store, path: str) -> None:
    folders, names = store.children(path)
    if folders or names:
        raise ArgumentError(f"{path!r} is not empty")


def child_nodes(store: Store, path: str) -> list[tuple[str, ArrayMeta | GroupMeta]]:
    """(name, metadata) of the arrays and groups right below a path; a node of format 3 that
    can't be read is left out, with a warning."""
    out = []
    for name in store.children(path)[0]:
        below = join(path, name)
        found = node_format(store, below)
        if found is None:
            continue
        try:
            out.append((name, open_meta(store, below, found)))
        except ArgumentError as e:
            if found == 2:
                raise
            warnings.warn(f"{below} is left out: {e}", stacklevel=2)
    return out
