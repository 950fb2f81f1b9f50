"""Files of HDUs: bytes wherever they lie, and where each HDU starts."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import sys
from dataclasses import dataclass

from ..format.header import Header
from ..format.status import FitsError
from ..format.tables import geometry


def local(path: str) -> str | None:
    """The path on this machine's file system, or None for another store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def open_bytes(path: str):
    """A seekable binary file from the local disk or any store that Arrow knows; gzip is recognised by its first bytes."""
    if name := local(path):
        if not os.path.exists(name) and os.path.exists(name + ".gz"):
            name += ".gz"
        if not os.path.exists(name):
            raise FitsError(104, path)
        f = open(name, "rb")
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        f = store.open_input_file(inner)
    magic = f.read(2)
    f.seek(0)
    if magic == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=f)
    return f


def list_files(path: str) -> list[str]:
    """The files of a folder by name, hidden ones left out, or the one file."""
    name = local(path)
    if name is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        info = store.get_file_info(inner)
        if info.type != fs.FileType.Directory:
            return [path]
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.partition("://")[0] + "://"
        return [prefix + i.path for i in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda i: i.path) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
    if os.path.isdir(name):
        return [os.path.join(name, f) for f in sorted(os.listdir(name)) if f[0] not in "._"]
    return [name]


class Mounted:
    """Where files are written: a folder of this machine's file system, which a cluster shares."""

    def __init__(self, path: str) -> None:
        self.path = path

    def create(self, name: str):
        return open(name, "wb")

    def open(self, name: str):
        return open(name, "rb")

    def exists(self, name: str) -> bool:
        return os.path.exists(name)

    def folder(self, name: str) -> None:
        os.makedirs(name, exist_ok=True)

    def move(self, old: str, new: str) -> None:
        os.replace(old, new)

    def remove(self, name: str) -> None:
        """A file, or a folder with all in it; nothing if it is not there."""
        if os.path.isdir(name):
            shutil.rmtree(name, ignore_errors=True)
        elif os.path.exists(name):
            os.remove(name)


class Store:
    """Where files are written: a store that Arrow knows. It is opened anew in each process."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.uri, self.path = uri, fs.FileSystem.from_uri(uri)[1]

    @property
    def fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)[0]

    def create(self, name: str):
        return self.fs.open_output_stream(name)

    def open(self, name: str):
        return self.fs.open_input_stream(name)

    def _is(self, name: str):
        return self.fs.get_file_info(name).type.name

    def exists(self, name: str) -> bool:
        return self._is(name) != "NotFound"

    def folder(self, name: str) -> None:
        self.fs.create_dir(name, recursive=True)

    def move(self, old: str, new: str) -> None:
        self.fs.move(old, new)

    def remove(self, name: str) -> None:
        kind = self._is(name)
        if kind == "Directory":
            self.fs.delete_dir(name)
        elif kind != "NotFound":
            self.fs.delete_file(name)


def place(path: str, mounted: bool = True) -> Mounted | Store:
    name = local(path)
    if mounted and name is not None:
        return Mounted(name)
    return Store(path if name is None else f"file://{os.path.abspath(name)}")


@dataclass
class Hdu:
    number: int
    header: Header
    header_start: int
    data_start: int
    data_bytes: int

    @property
    def end(self) -> int:
        return self.data_start + -(-self.data_bytes // 2880) * 2880

    @property
    def kind(self) -> str:
        """image, ascii or binary; a compressed image counts as an image."""
        x = (self.header.get("XTENSION") or "").strip()
        if x == "BINTABLE":
            return "image" if self.header.get("ZIMAGE", False) is True else "binary"
        return "ascii" if x == "TABLE" else "image"


def scan(f) -> list[Hdu]:
    """All HDUs of an open file; data are skipped unread. The end, or a record of zeros, ends the list."""
    out, at = [], 0
    while True:
        f.seek(at)
        data = f.read(2880)
        if len(data) < 2880 or not data.strip(b"\0"):
            break
        while True:
            try:
                header, size = Header.parse(data)
                break
            except FitsError:
                more = f.read(2880 * 16)
                if not more or len(data) > 1024 * 2880:
                    raise
                data += more
        out.append(Hdu(len(out) + 1, header, at, at + size, geometry(header)))
        at = out[-1].end
    if not out:
        raise FitsError(104, "no HDU")
    return out


def find(hdus: list[Hdu], hdu: str | int | None = None, extname: str | None = None, extver: int = 0, kind: str | None = None) -> Hdu:
    """By number from 1, or by name without case (and version, 0 for any; kind). Without either the first table, else the first HDU."""
    if hdu is not None:
        n = int(hdu)
        if n < 1:
            raise FitsError(301, str(n))
        if n > len(hdus):
            raise FitsError(107, str(n))
        return hdus[n - 1]
    if extname is not None:
        for x in hdus:
            names = [x.header.get(k) for k in ("EXTNAME", "HDUNAME")]
            if any(isinstance(v, str) and v.strip().lower() == extname.strip().lower() for v in names) and (not extver or x.header.get("EXTVER", 1) == extver) and kind in (None, x.kind):
                return x
        raise FitsError(301, extname)
    return next((x for x in hdus if x.kind != "image"), hdus[0])


def read_all(path: str) -> bytes:
    """A whole file, or standard input for -."""
    if path.strip() in ("-", "stdin"):
        return sys.stdin.buffer.read()
    with open_bytes(path) as f:
        return f.read()


def in_memory(data: bytes) -> io.BytesIO:
    """gzip is undone."""
    return io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)


def scan_bytes(data: bytes) -> list[Hdu]:
    return scan(in_memory(data))
