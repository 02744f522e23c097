"""Results kept by query text and generation."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.config import Config
from sparkseek.operators.shared import SharedFolder

TTL = 30 * 86400.0
MOST_BYTES = 128 << 20


class ResultCache:
    """Persisted results under (generation, key), for whole queries, terms or stages alike.

    A new generation makes older entries unreachable; they leave when room is needed, the least recently used first. Entries expire after
    ttl seconds. At most `entries` results of together at most `most_bytes` (as Spark holds them) are kept in memory. A result that alone is larger
    goes to the executors' disks and pushes no other out of memory; there at most `entries` results of together at most `entries` times `most_bytes` are
    kept, the newest whatever its size. With a folder results are kept there as Parquet instead, and found again by later sessions.
    """

    def __init__(self, entries: int = 64, ttl: float = TTL, clock: Callable[[], float] = time.time, most_bytes: int = MOST_BYTES, spark: SparkSession | None = None, folder: str | None = None):
        self.entries, self.ttl, self.clock, self.most_bytes = entries, ttl, clock, most_bytes
        self._held: OrderedDict[tuple[int, str], tuple[float, DataFrame, int]] = OrderedDict()
        self._large: OrderedDict[tuple[int, str], tuple[float, DataFrame, int]] = OrderedDict()  # on disk
        self._files = SharedFolder(spark, folder) if folder is not None else None
        self.hits = self.misses = 0

    @classmethod
    def of(cls, config: Config, **options) -> ResultCache:
        return cls(entries=config.cache_entries, **options)

    def get(self, generation: int, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        k = (generation, key)
        for among in (self._held, self._large):
            if k in among and self.clock() - among[k][0] < self.ttl:
                among.move_to_end(k)
                self.hits += 1
                return among[k][1]
        self._drop(k)
        kept = self._stored(k)
        if kept is not None:
            self.hits += 1
            return kept
        self.misses += 1
        df = make()
        if self._files is not None:
            return self._store(k, df)
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        size = int(str(df._jdf.queryExecution().withCachedData().stats().sizeInBytes()))
        if size <= self.most_bytes:
            self._keep(self._held, k, df, size, self.most_bytes)
            return df
        large = df.where(F.lit(True)).persist(StorageLevel.DISK_ONLY)  # to Spark another plan than df, copied from its blocks in their order
        large.count()
        df.unpersist()
        self._keep(self._large, k, large, size, self.entries * self.most_bytes)
        return large

    def _keep(self, among: OrderedDict, k: tuple[int, str], df: DataFrame, size: int, most: int) -> None:
        among[k] = (self.clock(), df, size)
        while len(among) > self.entries or sum(x[2] for x in among.values()) > most and len(among) > 1:
            self._drop(next(iter(among)))

    def _name(self, k: tuple[int, str]) -> str:
        return f"{k[0]:012d}-{hashlib.sha256(k[1].encode()).hexdigest()[:32]}"

    def _stored(self, k: tuple[int, str]) -> DataFrame | None:
        if self._files is None:
            return None
        found = self._files.read(f"entries/{self._name(k)}")
        if found is None or self.clock() - found["at"] >= self.ttl:
            return None
        return self._files.spark.read.parquet(found["path"])

    def _store(self, k: tuple[int, str], df: DataFrame) -> DataFrame:
        name = self._name(k)
        path = self._files.at(f"data/{name}-{int(self.clock() * 1000)}")
        df.write.mode("overwrite").parquet(path)
        if not self._files.create(f"entries/{name}", {"at": self.clock(), "path": path, "key": k[1]}):
            self._files.replace(f"entries/{name}", {"at": self.clock(), "path": path, "key": k[1]})
        return self._files.spark.read.parquet(path)

    def _drop(self, k: tuple[int, str]) -> None:
        for among in (self._held, self._large):
            if k in among:
                among.pop(k)[1].unpersist()

    def invalidate(self, before: int) -> None:
        """Drop what is older than a generation."""
        for k in [k for k in (*self._held, *self._large) if k[0] < before]:
            self._drop(k)
        if self._files is not None:
            for name in self._files.names("entries"):
                if int(name.partition("-")[0]) < before:
                    path = self._files.read(f"entries/{name}")["path"]
                    self._files.delete(f"entries/{name}")
                    self._files.delete(path[len(self._files.folder) + 1 :])

    def clear(self) -> None:
        for k in (*self._held, *self._large):
            self._drop(k)

    def __len__(self) -> int:
        return len(self._held) + len(self._large)
