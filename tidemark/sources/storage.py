"""Small files on any Hadoop file system, from the driver: text, listing, rename, put-if-absent."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

#: Schemes of stores where a file appears whole when it is closed, and where a rename is a copy.
OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "oss", "cosn", "obs"}


class Storage:
    """Driver-side access to the file systems that Spark itself uses."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read_bytes(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode("utf-8")

    def put_if_absent(self, path: str, text: str | bytes) -> bool:
        """Create path with this content, whole or not at all; False if it exists already.

        The content is written aside first and then given its name without overwriting: by a hard link on local disks, by
        a rename that fails if the name is taken elsewhere. On object stores the file appears when it is closed; there
        the creation is asked to be conditional, which a store without conditional writes only checks beforehand.
        """
        data = text.encode("utf-8") if isinstance(text, str) else text
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        if fs.exists(p):
            return False
        scheme = fs.getUri().getScheme()
        if scheme in OBJECT_STORES:
            try:
                build = fs.createFile(p).overwrite(False).opt("fs.option.create.conditional.overwrite", True)
                self._write(build.build(), data)
            except Exception as e:  # noqa: BLE001 - py4j wraps what the store raises
                if "AlreadyExists" in str(e) or "412" in str(e):
                    return False
                raise
            return True
        aside = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.tmp")
        if scheme == "file":
            name = aside.toUri().getPath()
            try:
                self._write_local(name, data)
                os.link(name, p.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                if os.path.exists(name):
                    os.remove(name)
            return True
        self._write(fs.create(aside, True), data)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        none[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(aside, p, none)
        except Exception as e:  # noqa: BLE001 - py4j wraps FileAlreadyExistsException
            fs.delete(aside, False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    @staticmethod
    def _write(stream, data: bytes) -> None:
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    @staticmethod
    def _write_local(name: str, data: bytes) -> None:
        with open(name, "wb") as f:
            f.write(data)

    def put(self, path: str, text: str) -> None:
        """Write aside, then rename over path."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        aside = self._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(aside, p):
            raise OSError(f"could not publish {path}")

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        q = self._at(new)[1]
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"could not rename {old} to {new}")

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.delete(p, True)

    def list(self, path: str) -> list[tuple[str, int, int, bool]]:
        """(full path, size, modification time in ms, is a folder) of each entry, by name."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found = [(s.getPath().toString(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in fs.listStatus(p)]
        return sorted(found)
