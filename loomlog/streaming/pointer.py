"""The replay pointer: one active position and, during a replay, a staged one; small files in a shared folder."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession


class Pointer:
    """Every change writes a new numbered file and renames it into place; the highest number is the pointer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        p, fs = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[8:-5]) for n in names if n.startswith("pointer-") and n.endswith(".json"))

    def status(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"active": None, "staged": None, "updated_at": None}
        p, fs = self._fs(f"pointer-{versions[-1]}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write(self, active, staged) -> None:
        n = (self._versions() or [0])[-1] + 1
        tmp, fs = self._fs(f".pointer-{n}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps({"active": active, "staged": staged, "updated_at": time.time()}).encode()))
        out.close()
        final, _ = self._fs(f"pointer-{n}.json")
        if not fs.rename(tmp, final):
            raise RuntimeError("another writer moved the pointer")

    def position(self):
        return self.status()["active"]

    def save(self, position: int) -> None:
        self._write(position, self.status()["staged"])

    def stage(self, position: int) -> None:
        self._write(self.status()["active"], position)

    def promote(self) -> None:
        """The staged position becomes the active one; an error where nothing is staged."""
        staged = self.status()["staged"]
        if staged is None:
            raise ValueError("nothing is staged")
        self._write(staged, None)

    def set(self, position: int) -> None:
        self._write(position, None)
