"""Files of the warehouse, on a local path or on whatever Hadoop's file systems reach."""

from __future__ import annotations

import io
import os
import uuid
from pathlib import Path


#: Stores without a rename that is one step; a file there appears whole when it is closed, and a conditional create refuses a second one.
OBJECT_STORES = {"s3a", "s3", "gs", "oss", "cosn", "wasb", "wasbs"}


class _Tail(io.RawIOBase):
    """A file of which only the end is known; what stands before reads as zeros."""

    def __init__(self, size: int, tail: bytes):
        self.size, self.data, self.at = size, tail, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        stop = self.size if n < 0 else min(self.size, self.at + n)
        low = self.size - len(self.data)
        out = b"\0" * max(0, min(stop, low) - self.at) + self.data[max(0, self.at - low) : max(0, stop - low)]
        self.at = max(self.at, stop)
        return out


class Files:
    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.local = "://" not in root or root.startswith("file://")
        self.base = os.path.abspath(self.root.removeprefix("file://")) if self.local else self.root

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _fs(self, key: str):
        return self._hadoop(self.path(key))

    def path(self, key: str) -> str:
        return f"{self.base if self.local else self.root}/{key}" if key else self.base

    def plain(self, key: str) -> str:
        """The path of a file without its file system."""
        return self.path(key) if self.local else self._fs(key)[0].toUri().getPath()

    def create(self, key: str, data: bytes) -> bool:
        """Put the file there unless one exists; false if it does. Never half a file under that name."""
        if not self.local:
            return self._create(key, data)
        target = Path(self.path(key))
        target.parent.mkdir(parents=True, exist_ok=True)
        staged = target.parent / f".{uuid.uuid4().hex}"
        with staged.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(staged, target)
            folder = os.open(target.parent, os.O_RDONLY)
            try:
                os.fsync(folder)
            finally:
                os.close(folder)
            return True
        except FileExistsError:
            return False
        finally:
            staged.unlink()

    def _create(self, key: str, data: bytes) -> bool:
        path, fs = self._fs(key)
        if path.toUri().getScheme() in OBJECT_STORES:
            try:
                out = fs.createFile(path).overwrite(False).opt("fs.option.create.conditional.overwrite", True).recursive().build()
                out.write(data)
                out.close()
                return True
            except Exception:
                if fs.exists(path):
                    return False
                raise
        staged = self.spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(data)
        (out.hsync if out.hasCapability("hsync") else out.flush)()
        out.close()
        return self._rename(staged, path, fs)

    def _rename(self, source, path, fs) -> bool:
        """Rename in one step unless the target exists; then the source goes."""
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, path, none)
            return True
        except Exception:
            if fs.exists(path):
                fs.delete(source, False)
                return False
            raise

    def move(self, source: str, key: str) -> bool:
        """Rename a staged file to its key unless that exists; false, and the staged file goes, if it does."""
        if self.local:
            target = Path(self.path(key))
            target.parent.mkdir(parents=True, exist_ok=True)
            try:
                os.link(source.removeprefix("file://"), target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(source.removeprefix("file://"))
        path, fs = self._fs(key)
        fs.mkdirs(path.getParent())
        return self._rename(self.spark._jvm.org.apache.hadoop.fs.Path(source), path, fs)

    def read(self, n: int = -1) -> bytes:
        stop = self.size if n < 0 else min(self.size, self.at + n)
        low = self.size - len(self.data)
        out = b"\0" * max(0, min(stop, low) - self.at) + self.data[max(0, self.at - low) : max(0, stop - low)]
        self.at = max(self.at, stop)
        return out


class Files:
    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.local = "://" not in root or root.startswith("file://")
        self.base = os.path.abspath(self.root.removeprefix("file://")) if self.local else self.root

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _fs(self, key: str):
        return self._hadoop(self.path(key))

    def path(self, key: str) -> str:
        return f"{self.base if self.local else self.root}/{key}" if key else self.base

    def plain(self, key: str) -> str:
        """The path of a file without its file system."""
        return self.path(key) if self.local else self._fs(key)[0].toUri().getPath()

    def create(self, key: str, data: bytes) -> bool:
        """Put the file there unless one exists; false if it does. Never half a file under that name."""
        if not self.local:
            return self._create(key, data)
        target = Path(self.path(key))
        target.parent.mkdir(parents=True, exist_ok=True)
        staged = target.parent / f".{uuid.uuid4().hex}"
        with staged.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(staged, target)
            folder = os.open(target.parent, os.O_RDONLY)
            try:
                os.fsync(folder)
            finally:
                os.close(folder)
            return True
        except FileExistsError:
            return False
        finally:
            staged.unlink()

    def _create(self, key: str, data: bytes) -> bool:
        path, fs = self._fs(key)
        if path.toUri().getScheme() in OBJECT_STORES:
            try:
                out = fs.createFile(path).overwrite(False).opt("fs.option.create.conditional.overwrite", True).recursive().build()
                out.write(data)
                out.close()
                return True
            except Exception:
                if fs.exists(path):
                    return False
                raise
        staged = self.spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(data)
        (out.hsync if out.hasCapability("hsync") else out.flush)()
        out.close()
        return self._rename(staged, path, fs)

    def _rename(self, source, path, fs) -> bool:
        """Rename in one step unless the target exists; then the source goes."""
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, path, none)
            return True
        except Exception:
            if fs.exists(path):
                fs.delete(source, False)
                return False
            raise

    def move(self, source: str, key: str) -> bool:
        """Rename a staged file to its key unless that exists; false, and the staged file goes, if it does."""
        if self.local:
            target = Path(self.path(key))
            target.parent.mkdir(parents=True, exist_ok=True)
            try:
                os.link(source.removeprefix("file://"), target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(source.removeprefix("file://"))
        path, fs = self._fs(key)
        fs.mkdirs(path.getParent())
        return fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(source), path)

    def read(self, key: str) -> bytes:
        if self.local:
            return Path(self.path(key)).read_bytes()
        path, fs = self._fs(key)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if self.local:
            p = Path(self.path(folder))
            return sorted(x.name for x in p.iterdir() if x.name[0] != ".") if p.is_dir() else []
        path, fs = self._fs(folder)
        found = (s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else ()
        return sorted(n for n in found if n[0] != ".")

    def ages(self, folder: str) -> list[tuple[str, int]]:
        """Name and time of the last change (ms) of what is in a folder."""
        path, fs = self._fs(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def missing(self, keys: list[str]) -> list[str]:
        """The keys without a file, by one listing a folder."""
        held = {f: set(self.names(f)) for f in {k.rpartition("/")[0] for k in keys}}
        return [k for k in keys if k.rpartition("/")[2] not in held[k.rpartition("/")[0]]]

    def size(self, path: str) -> int:
        """Bytes of a file or folder anywhere."""
        p, fs = self._hadoop(path)
        return sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(p) or ())

    def end(self, path: str, least: int = 1 << 16) -> tuple[int, io.RawIOBase]:
        """Size of a file by its full path, and a reader for its Parquet footer."""
        if self.local:
            path = path.removeprefix("file://")
            return os.path.getsize(path), open(path, "rb")
        p, fs = self._hadoop(path)
        size = fs.getFileStatus(p).getLen()

        def tail(n: int) -> bytes:
            stream = fs.open(p)
            try:
                stream.seek(size - n)
                return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()

        data = tail(min(size, least))
        wanted = int.from_bytes(data[-8:-4], "little") + 8
        return size, _Tail(size, data if wanted <= len(data) else tail(min(size, wanted)))

    def exists(self, key: str) -> bool:
        if self.local:
            return Path(self.path(key)).exists()
        path, fs = self._fs(key)
        return fs.exists(path)

    def delete(self, key: str) -> None:
        path, fs = self._fs(key)
        fs.delete(path, True)
