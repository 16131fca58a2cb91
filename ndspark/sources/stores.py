"""Key to bytes stores. All can be pickled, so executors read and write chunks themselves."""

from __future__ import annotations

import io
import json
import os
import re
import threading
import urllib.error
import urllib.parse
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Protocol

import pyarrow.fs as pafs

from .. import formats
from ..errors import ArgumentError, NotWriteable


REMOTE_FETCHES = 50  # reads under way in a task, of a store behind a network


class Store(Protocol):
    """What the engine needs; keys have "/" between parts and none at either end."""

    def get(self, key: str) -> bytes | None: ...
    def get_range(self, key: str, offset: int, n: int) -> bytes | None:
        """n bytes of a value from an offset, from its end if that is negative."""

    def put(self, key: str, value: bytes) -> None: ...
    def delete(self, key: str) -> None: ...
    def exists(self, key: str) -> bool: ...
    def walk(self, path: str) -> Iterator[tuple[str, int]]:
        """(key, bytes) of all keys below a path."""

    def children(self, path: str) -> tuple[list[str], list[str]]:
        """Names of folders and of keys right below a path."""


def normalize(path: str) -> str:
    """One "/" between parts, no empty, "." or ".." parts left, none at the ends."""
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if out:
                out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def join(path: str, key: str) -> str:
    return f"{path}/{key}" if path and key else path or key


def check_path(path: str) -> str:
    if path.startswith("/"):
        raise ArgumentError(f"{path!r} must not start with /")
    return normalize(path)


def cut(value: bytes | None, offset: int, n: int) -> bytes | None:
    if value is None:
        return None
    lo = offset if offset >= 0 else max(0, len(value) + offset)
    return value[lo : lo + n]


class _Listed:
    """children() and size() for stores that can walk; ranges from whole values for those that
    have no better way. fetches: how many reads a task may have under way."""

    writeable, fetches = True, 1

    def get_range(self, key: str, offset: int, n: int) -> bytes | None:
        return cut(self.get(key), offset, n)

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def children(self, path: str) -> tuple[list[str], list[str]]:
        folders, names, lead = set(), set(), f"{path}/" if path else ""
        for key, _ in self.walk(path):
            head, rest, _ = key[len(lead) :].partition("/")
            (folders if rest else names).add(head)
        return sorted(folders), sorted(names)

    def size(self, path: str) -> int:
        """Bytes of the chunks below a path."""
        return sum(n for key, n in self.walk(path) if key.rpartition("/")[2] not in formats.METADATA_NAMES)

    def put(self, key: str, value: bytes) -> None:
        raise NotWriteable(f"{type(self).__name__} is for reading")

    def delete(self, key: str) -> None:
        raise NotWriteable(f"{type(self).__name__} is for reading")


@dataclass
class MemoryStore(_Listed):
    """A dict on the driver; executors get a copy, so only the driver's writes are kept."""

    values: dict[str, bytes] = field(default_factory=dict)
    local = True

    def get(self, key):
        return self.values.get(key)

    def put(self, key, value):
        self.values[key] = bytes(value)

    def delete(self, key):
        self.values.pop(key, None)

    def walk(self, path):
        lead = f"{path}/" if path else ""
        return iter(sorted((k, len(v)) for k, v in self.values.items() if k.startswith(lead)))


# Schemes whose file systems take credentials of their own.
KEYED = {"s3": "S3FileSystem", "gs": "GcsFileSystem", "gcs": "GcsFileSystem", "abfs": "AzureFileSystem", "abfss": "AzureFileSystem"}


def _located(uri: str, credentials: dict | None = None) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a path, and the path in it."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    if credentials:
        scheme, _, rest = uri.partition("://")
        if scheme not in KEYED or not hasattr(pafs, KEYED[scheme]):
            raise ArgumentError(f"{scheme or uri!r} takes no credentials")
        return getattr(pafs, KEYED[scheme])(**credentials), rest
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


class FileStore(_Listed):
    """A folder of any file system that Arrow opens: local, HDFS, S3, GCS. credentials: options of
    the cloud's Arrow file system, such as access_key and secret_key, or anonymous; without them
    the environment's count. They travel with plans to the executors."""

    local = False

    def __init__(self, uri: str, credentials: dict | None = None):
        self.uri, self.credentials = uri, credentials
        self._open()

    def _open(self):
        self.fs, self.root = _located(self.uri, self.credentials)

    def __getstate__(self):
        return {"uri": self.uri, "credentials": self.credentials}

    def __setstate__(self, state):
        self.uri, self.credentials = state["uri"], state["credentials"]
        self._open()

    def _at(self, key: str) -> str:
        return f"{self.root}/{key}" if key else self.root

    def get(self, key):
        try:
            with self.fs.open_input_file(self._at(key)) as f:
                return f.read()
        except (FileNotFoundError, IsADirectoryError):
            return None
        except OSError:
            if self.fs.get_file_info(self._at(key)).type != pafs.FileType.File:
                return None
            raise

    @property
    def fetches(self) -> int:
        return 4 if self.fs.type_name == "local" else REMOTE_FETCHES

    def get_range(self, key, offset, n):
        try:
            with self.fs.open_input_file(self._at(key)) as f:
                size = f.size()
                lo = offset if offset >= 0 else max(0, size + offset)
                return f.read_at(max(0, min(n, size - lo)), lo)
        except (FileNotFoundError, IsADirectoryError):
            return None
        except OSError:
            if self.fs.get_file_info(self._at(key)).type != pafs.FileType.File:
                return None
            raise

    def exists(self, key):
        return self.fs.get_file_info(self._at(key)).type == pafs.FileType.File

    def put(self, key, value):
        """By a temporary file and a rename, so that a reader never sees half a value."""
        at = self._at(key)
        if self.fs.type_name != "local":  # an object appears as a whole when it is closed
            with self.fs.open_output_stream(at) as f:
                f.write(value)
            return
        os.makedirs(os.path.dirname(at), exist_ok=True)
        temporary = f"{at}.{uuid.uuid4().hex}.part"
        with open(temporary, "wb") as f:
            f.write(value)
        os.replace(temporary, at)

    def delete(self, key):
        if self.exists(key):
            self.fs.delete_file(self._at(key))

    def walk(self, path):
        chosen = pafs.FileSelector(self._at(path), recursive=True, allow_not_found=True)
        for info in self.fs.get_file_info(chosen):
            if info.type == pafs.FileType.File and not info.path.endswith(".part"):
                yield os.path.relpath(info.path, self.root), info.size

    def children(self, path):
        chosen = pafs.FileSelector(self._at(path), allow_not_found=True)
        infos = self.fs.get_file_info(chosen)
        return (
            sorted(i.base_name for i in infos if i.type == pafs.FileType.Directory),
            sorted(i.base_name for i in infos if i.type == pafs.FileType.File),
        )


@dataclass
class HttpStore(_Listed):
    """Reads keys below a URL. missing: the status codes that mean a key is absent."""

    url: str
    missing: tuple[int, ...] = (404,)
    local, writeable, fetches = False, False, 50

    def _fetch(self, key: str, headers: dict[str, str]):
        try:
            request = urllib.request.Request(f"{self.url.rstrip('/')}/{urllib.parse.quote(key)}", headers=headers)
            with urllib.request.urlopen(request) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            if e.code in self.missing:
                return e.code, None
            if e.code == 416:  # nothing lies in the range
                return e.code, b""
            raise OSError(f"status {e.code} for {key}; add it to `missing` if it means that a key is absent") from e

    def get(self, key):
        return self._fetch(key, {})[1]

    def get_range(self, key, offset, n):
        """A server that knows no ranges sends the whole value."""
        status, found = self._fetch(key, {"Range": f"bytes={offset}-{offset + n - 1}" if offset >= 0 else f"bytes={offset}"})
        return found if status == 206 else cut(found, offset, n)

    def walk(self, path):
        raise ArgumentError("a web server lists no keys; open a consolidated hierarchy")


class ZipStore(_Listed):
    """Reads the entries of a zip archive, from its path, its URI or its bytes. Only bytes travel
    with a plan; a file is opened where it is read."""

    local, writeable = False, False

    def __init__(self, source: str | bytes):
        self.source = source
        self._open()

    def _open(self):
        self.lock = threading.Lock()
        if isinstance(self.source, bytes):
            where = io.BytesIO(self.source)
        else:
            fs, path = _located(self.source)
            where = fs.open_input_file(path)
        self.zip = zipfile.ZipFile(where)

    def __getstate__(self):
        return {"source": self.source}

    def __setstate__(self, state):
        self.source = state["source"]
        self._open()

    def get(self, key):
        try:
            with self.lock:
                return self.zip.read(key)
        except KeyError:
            return None

    def walk(self, path):
        lead = f"{path}/" if path else ""
        for i in self.zip.infolist():
            if i.filename.startswith(lead) and not i.is_dir():
                yield i.filename, i.file_size


def write_zip(store: Store, target, path: str = "") -> None:
    """Write all keys below a path to a zip archive: a file name, a URI or a binary file."""
    if isinstance(target, (str, os.PathLike)):
        fs, at = _located(os.fspath(target))
        with fs.open_output_stream(at) as out:
            write_zip(store, out, path)
        return
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as z:
        for key, _ in store.walk(path):
            z.writestr(key[len(path) :].lstrip("/"), store.get(key))


class ConsolidatedStore(_Listed):
    """Metadata from one document at the root, everything else from the store below."""

    local = False

    def __init__(self, inner: Store, path: str = ""):
        self.inner, self.writeable = inner, getattr(inner, "writeable", True)
        raw = inner.get(join(path, formats.V2_ALL))
        self.documents: dict[str, dict] = {}
        if raw is not None:
            self.documents = {join(path, k): v for k, v in json.loads(raw)["metadata"].items()}
        else:
            raw = inner.get(join(path, formats.V3_NODE))
            inline = (json.loads(raw) if raw else {}).get("consolidated_metadata")
            if not inline:
                raise ArgumentError(f"no consolidated metadata at {path!r}")
            self.documents = {join(path, join(k, formats.V3_NODE)): v for k, v in inline["metadata"].items()}
            self.documents[join(path, formats.V3_NODE)] = json.loads(raw)

    def get(self, key):
        if key.rpartition("/")[2] in formats.METADATA_NAMES:
            found = self.documents.get(key)
            return None if found is None else json.dumps(found).encode()
        return self.inner.get(key)

    @property
    def fetches(self) -> int:
        return self.inner.fetches

    def get_range(self, key, offset, n):
        return self.inner.get_range(key, offset, n)

    def put(self, key, value):
        if key.rpartition("/")[2] in formats.METADATA_NAMES:
            raise ArgumentError("consolidated metadata can't be written")
        self.inner.put(key, value)

    def delete(self, key):
        self.inner.delete(key)

    def walk(self, path):
        return self.inner.walk(path)

    def children(self, path):
        """From the documents, so that a store without listing will do."""
        lead = f"{path}/" if path else ""
        below = [k[len(lead) :].split("/") for k in self.documents if k.startswith(lead)]
        return sorted({k[0] for k in below if len(k) > 1}), sorted({k[0] for k in below if len(k) == 1})

    def size(self, path):
        return self.inner.size(path)


@dataclass
class CachingStore(_Listed):
    """Reads through to a remote store and keeps what it got, absent keys as an empty mark."""

    remote: Store
    cache: Store
    marks: str = "absent"
    local = False

    @property
    def fetches(self) -> int:
        return self.remote.fetches

    def get(self, key):
        found = self.cache.get(key)
        if found is not None or self.cache.exists(f"{self.marks}/{key}"):
            return found
        found = self.remote.get(key)
        if found is None:
            self.cache.put(f"{self.marks}/{key}", b"")
        else:
            self.cache.put(key, found)
        return found

    def put(self, key, value):
        self.cache.put(key, value)

    def delete(self, key):
        self.cache.delete(key)
        self.cache.put(f"{self.marks}/{key}", b"")

    def walk(self, path):
        own = dict(self.remote.walk(path)) | {k: n for k, n in self.cache.walk(path) if not k.startswith(f"{self.marks}/")}
        return iter(sorted(own.items()))

    def children(self, path):
        found = [s.children(path) for s in (self.remote, self.cache)]
        return (
            sorted({x for f in found for x in f[0]} - ({self.marks} if not path else set())),
            sorted({x for f in found for x in f[1]}),
        )


REGISTRY: list[tuple[re.Pattern, Callable[[str], Store]]] = []


def register_store(pattern: str) -> Callable:
    """Register how URLs that match a pattern are opened; the first match counts."""

    def put(f):
        REGISTRY.append((re.compile(pattern), f))
        return f

    return put


# Hosts under which buckets of a cloud store are also web addresses.
BUCKET_HOST = r"^https?://(?:storage\.googleapis\.com|storage\.cloud\.google\.com)/"


@register_store(BUCKET_HOST)
def _bucket(url: str) -> Store:
    return FileStore(re.sub(BUCKET_HOST, "gs://", url))


@register_store(r"^(?:s3|s3a|s3n|gs|hdfs|viewfs|file)://")
def _files(url: str) -> Store:
    return FileStore(url)


@register_store(r"^https?://")
def _web(url: str) -> Store:
    store = HttpStore(url)
    try:
        return ConsolidatedStore(store)
    except (ArgumentError, OSError):
        return store


def open_store(where, credentials: dict | None = None) -> Store:
    """A store as it is, or that of a URL, a zip file or a folder."""
    if not isinstance(where, (str, os.PathLike)):
        return where
    where = os.fspath(where)
    if credentials:
        return FileStore(re.sub(BUCKET_HOST, "gs://", where), credentials)
    if where.endswith(".zip") and not re.match(r"^https?://", where):
        fs, path = _located(where)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return ZipStore(where)
    for pattern, make in REGISTRY:
        if pattern.match(where):
            return make(where)
    return FileStore(where)


def serve(store: Store) -> ThreadingHTTPServer:
    """A web server of a store's keys on a free local port, running; for tests."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            found = store.get(normalize(urllib.parse.unquote(self.path)))
            asked = re.fullmatch(r"bytes=(\d*)-(\d+)?", self.headers.get("Range", ""))
            if found is not None and asked:
                lo, hi = asked[1], asked[2]
                found = found[-int(hi) :] if not lo else found[int(lo) : int(hi) + 1 if hi else None]
            self.send_response(404 if found is None else 206 if asked else 200)
            self.end_headers()
            self.wfile.write(found or b"")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
