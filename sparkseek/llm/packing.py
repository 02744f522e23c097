"""Filling containers of one fixed capacity by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import importlib.util
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.session import cut

# Fixed value: how the byte-level vocabularies cut a text into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The file of a public tokenizer, in `folder` or where the package public_tokenizers keeps it, else in /opt/tokenizers."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"
    return str(Path(folder, name))


def load_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


_encoders: dict[int, object] = {}


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    if len(ranks) not in _encoders:
        _encoders[len(ranks)] = tiktoken.Encoding("sparkseek", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encoders[len(ranks)]


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_tokens of every row; NULL and empty texts have 0. The driver reads the vocabulary and sends it to the executors once."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary or vocabulary_path()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "id bigint, n_tokens bigint")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of the sizes in so many windows of nearly equal sums.

    Each size starts as a partial partition: itself in one window, the others empty. Time and again the two partial partitions
    with the greatest spread are merged, fullest window upon emptiest, so that their imbalances oppose each other.
    A partial partition holds only its windows that are not empty and counts the rest.
    """
    heap: list[tuple[int, int, list[tuple[int, tuple]]]] = []
    for i, s in enumerate(sizes):
        spread = s if windows > 1 else 0
        heap.append((-spread, i, [(s, (i,))]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # both in descending order, their empty windows last: a's fullest meets b's emptiest
        free_a, free_b = windows - len(a), windows - len(b)
        merged = a[: min(len(a), free_b)] + b[: min(len(b), free_a)]
        over_a, over_b = a[free_b:] if free_b < len(a) else [], b[free_a:] if free_a < len(b) else []
        for (s, x), (t, y) in zip(over_a, reversed(over_b)):
            merged.append((s + t, (x, y)))
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], serial, merged))
        serial += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                items.append(x)
            else:
                todo.extend(x)
        out.append(items)
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as differencing needs for none to exceed the capacity: their number rises until it fits. No size may exceed it.

    From 200 windows on it rises by a hundredth at a time; once it fits, the numbers passed over are tried as well.
    """
    fits = lambda found: all(sum(sizes[i] for i in w) <= capacity for w in found)
    windows = max(1, -(-sum(sizes) // capacity))
    step = max(1, windows // 100)
    while not fits(found := differencing(sizes, windows)):
        windows += step
    for fewer in range(max(1, windows - step + 1), windows):
        if fits(better := differencing(sizes, fewer)):
            return better
    return found


class _Group:
    """Rows (id, piece, first_token, n_tokens) of one task that are packed together. Small ones are tied into bundles of at least `bundle` tokens,
    which go into a window as one, so that the sizes to be packed stay few however short the items are."""

    def __init__(self, bundle: int):
        self.rows = [array("q") for _ in range(4)]
        self.bundle, self.sizes, self.members, self.load = bundle, [], [], 0
        self._open, self._open_size = array("q"), 0

    def add(self, row: tuple[int, int, int, int]) -> None:
        at, n = len(self.rows[0]), row[3]
        for column, value in zip(self.rows, row):
            column.append(value)
        self.load += n
        if n >= self.bundle:
            self.sizes.append(n)
            self.members.append([at])
            return
        self._open.append(at)
        self._open_size += n
        if self._open_size >= self.bundle:
            self._close()

    def _close(self) -> None:
        self.sizes.append(self._open_size)
        self.members.append(self._open)
        self._open, self._open_size = array("q"), 0

    def packed(self, capacity: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Window of each row, and the rows' columns."""
        if len(self._open):
            self._close()
        window = np.zeros(len(self.rows[0]), np.int64)
        for w, items in enumerate(pack(self.sizes, capacity)):
            for i in items:
                window[np.asarray(self.members[i])] = w
        return window, [np.array(c, np.int64) for c in self.rows]


def containers(counts: DataFrame, capacity: int, windows: int = 128) -> DataFrame:
    """Every item in a container: container, id, piece, first_token, n_tokens.

    counts: id (unique), n_tokens. Items larger than the capacity are divided into pieces of exactly the capacity, each of which fills a
    container of its own, and a rest; no other item is divided. The others are spread by hash over tasks, and each task fills groups of
    about `windows` containers at a time, so a task holds one group whatever its share; a group is closed by the tokens in it alone.
    NULL and negative counts are 0; items of 0 tokens go into the first container of a group. Containers are numbered by task, group and window,
    the same in every run over equal rows and partitions, full pieces apart by negative numbers. An empty table has no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = cut(counts.select("id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n")))
    whole = F.floor((F.col("n") - 1) / capacity) * F.when(F.col("n") > capacity, 1).otherwise(0)
    pieces = sized.withColumn("whole", whole.cast("int"))
    total = pieces.agg(F.sum(F.col("n") - F.col("whole") * capacity)).first()[0] or 0
    tasks = max(1, min(100_000, int(total // (8 * windows * capacity))))
    rest = pieces.select("id", F.col("whole").alias("piece"), (F.col("whole").cast("bigint") * capacity).alias("first_token"), (F.col("n") - F.col("whole") * capacity).alias("n"))
    rest = rest.repartition(tasks, F.xxhash64("id")).sortWithinPartitions(F.xxhash64(F.lit("order"), "id"), "id")
    # a little less than full, for differencing to succeed without a further window, which would cost 1 / windows
    goal = int(windows * capacity * (1 - 0.5 / windows - 0.005))
    bundle = max(1, capacity // 64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        group = _Group(bundle)

        def out(window: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
            arrays = [pa.array((task << 40) | (number << 20) | window), *(pa.array(c.astype(k)) for c, k in zip(columns, (np.int64, np.int32, np.int64, np.int64)))]
            return pa.RecordBatch.from_arrays(arrays, names=["container", "id", "piece", "first_token", "n_tokens"])

        for batch in batches:
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("id", "piece", "first_token", "n")]
            empty = columns[3] == 0
            if empty.any():
                yield out(np.zeros(int(empty.sum()), np.int64), [c[empty] for c in columns])
            for row in zip(*(c[~empty].tolist() for c in columns)):
                if group.load and group.load + row[3] > goal:
                    yield out(*group.packed(capacity))
                    group, number = _Group(bundle), number + 1
                group.add(row)
        if group.load:
            yield out(*group.packed(capacity))

    packed = rest.mapInArrow(fill, "container bigint, id bigint, piece int, first_token bigint, n_tokens bigint")
    full = pieces.where("whole > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"))
    number = -F.monotonically_increasing_id() - 1
    full = full.select(number.alias("container"), "id", F.col("piece"), (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    return packed.unionByName(full)


def filling(packed: DataFrame, counts: DataFrame, capacity: int) -> DataFrame:
    """One row on how containers were filled: items, over (containers above the capacity), lost (items whose tokens are not all there), divided
    (items that would have fitted but are in pieces), share (of the space in use)."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    space = per.agg(F.count(F.when(F.col("n") > capacity, 1)).alias("over"), (F.sum("n") / (F.count("*") * F.lit(capacity))).alias("share"))
    item = packed.groupBy("id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"))
    both = counts.select("id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n")).join(item, "id", "left")
    whole = both.agg(
        F.count("*").alias("items"), F.count(F.when(~F.col("n").eqNullSafe(F.col("got")), 1)).alias("lost"), F.count(F.when((F.col("pieces") > 1) & (F.col("n") <= capacity), 1)).alias("divided")
    )
    return whole.crossJoin(space)  # one row by one row
