"""Numbered commits in a shared folder: each number goes to one writer only.

A commit is a small JSON document that appears whole or not at all. Its file is written under a
name of its own and then moved to the number's name, which fails where that is taken: a hard link on
a local folder, a rename elsewhere, so the store's rename must refuse an existing target, as HDFS does.
Only the driver works on commits, and no Spark job is needed to read them.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._known: dict[int, dict] = {}

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """Names in a folder below the path, in order; none where there is no such folder."""
        files, at = self._files(), self._at(folder)
        if not files.exists(at):
            return []
        return sorted(status.getPath().getName() for status in files.listStatus(at))

    def remove(self, *parts: str) -> None:
        self._files().delete(self._at(*parts), True)

    def numbers(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in self.names("commits") if name.endswith(".json")]

    def last(self) -> int:
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        """A commit's document; commits never change, so one read is enough."""
        if number not in self._known:
            source = self._files().open(self._at("commits", _name(number)))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            finally:
                source.close()
            self._known[number] = json.loads(text)
        return self._known[number]

    def claim(self, number: int, document: dict) -> bool:
        """Makes ``document`` the commit of that number, unless another writer has it."""
        files = self._files()
        files.mkdirs(self._at("commits"))
        draft, target = self._at("commits", f".draft-{uuid.uuid4().hex}"), self._at("commits", _name(number))
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        try:
            if files.getUri().getScheme() != "file":
                return not files.exists(target) and files.rename(draft, target)
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        finally:
            files.delete(draft, False)


def _name(number: int) -> str:
    return f"{number:019d}.json"
