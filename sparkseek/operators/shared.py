"""Small files in a folder that all workers share, each created whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import SparkSession


class SharedFolder:
    """JSON files by name. create() writes a temporary file and then gives it its name in one step that fails if the name is taken: a hard
    link on a local or mounted file system, a rename without overwriting elsewhere (atomic on HDFS). So a writer that dies leaves at most
    a temporary file, never a name without its content, and of two rivals one wins."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._local = self._fs.getUri().getScheme() == "file"

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _plain(self, name: str) -> str:
        return unquote(urlparse(self.folder).path) + f"/{name}"

    def exists(self, name: str) -> bool:
        return os.path.exists(self._plain(name)) if self._local else bool(self._fs.exists(self._path(self.at(name))))

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        if self._local:
            with open(self._plain(name), encoding="utf-8") as f:
                return json.load(f)
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def names(self, name: str, hidden: bool = False) -> list[str]:
        """The files of a folder, sorted; none if there is no such folder. One listing. Names that begin with a dot or underscore count as hidden."""
        if not self.exists(name):
            return []
        found = os.listdir(self._plain(name)) if self._local else [x.getPath().getName() for x in self._fs.listStatus(self._path(self.at(name)))]
        return sorted(n for n in found if hidden or not n.startswith((".", "_")))

    def create(self, name: str, content: dict) -> bool:
        """False if the name is taken."""
        if self.exists(name):
            return False
        part = f"_tmp/{uuid.uuid4().hex}"
        text = json.dumps(content, default=str)
        if self._local:
            os.makedirs(self._plain("_tmp"), exist_ok=True)
            with open(self._plain(part), "x", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
        else:
            out = self._fs.create(self._path(self.at(part)), False)
            out.write(bytearray(text.encode()))
            out.close()
        return self._publish(part, name)

    def delete(self, name: str) -> None:
        """A file, or a folder with all that is in it."""
        self._fs.delete(self._path(self.at(name)), True)

    def replace(self, name: str, content: dict) -> None:
        """create() over what is there."""
        self.delete(name)
        self.create(name, content)

    def _publish(self, part: str, name: str) -> bool:
        if self._local:
            os.makedirs(os.path.dirname(self._plain(name)), exist_ok=True)
            try:
                os.link(self._plain(part), self._plain(name))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(self._plain(part))
        target = self._path(self.at(name))
        self._fs.mkdirs(target.getParent())
        never = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._path(self.at(part)), target, never)
            return True
        except Exception:
            if not self.exists(name):
                raise
            self._fs.delete(self._path(self.at(part)), False)
            return False


def file_name(text: str) -> str:
    """text as the name of a file; different texts have different names."""
    return quote(text, safe="").replace(".", "%2E").replace("_", "%5F")


def from_file_name(name: str) -> str:
    return unquote(name)
