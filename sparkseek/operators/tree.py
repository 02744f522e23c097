"""Parent-child links to full hierarchies by tree contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.session import broadcast_if, cut, release

SEPARATOR = "\\"
RELEASE_EVERY = 4
PER_PARTITION = 50_000
FOUND = "id bigint, root bigint, depth bigint, below bigint, path string"


def latest_entries(entries: DataFrame) -> DataFrame:
    """One row per frn: of several rows the one with the highest usn, and of equal ones the greatest in parent and name.

    A parent of 0, NULL or one that has no entry counts as none (NULL). Rows with a NULL frn are dropped.
    """
    last = entries.where(F.col("frn").isNotNull()).groupBy("frn").agg(F.max(F.struct("usn", "parent", "name")).alias("e"))
    return last.select("frn", F.when(F.col("e.parent") != 0, F.col("e.parent")).alias("parent"), F.col("e.name").alias("name"))


def _contract(state: DataFrame, with_path: bool) -> DataFrame:
    """One round: rakes all leaves, then splices an independent set of unary nodes. Adds what: keep, raked, spliced.

    state has one row per node: id, up (parent), gap (edges that the link to up stands for), hidden (nodes that went
    into that link, with all below them), below (nodes raked into this one), kids (children left), x (XOR of their ids) and
    trail (names along the link); turn numbers the rounds, as a column, so that all rounds run the same compiled code. Only sums, counts and XORs travel to a parent, so a folder with a third of all entries is
    combined on the map side like any other. what is decided from the node's own row.
    """
    leaf = F.col("up").isNotNull() & (F.col("up") != F.col("id")) & (F.col("kids") == 0)
    gains = state.where(leaf).groupBy(F.col("up").alias("id")).agg(
        F.count("*").alias("g_kids"), F.bit_xor("id").alias("g_x"), F.sum(F.col("below") + F.col("hidden") + 1).alias("g_below")
    )
    none = F.lit(0).cast("long")
    rank = lambda c: F.xxhash64(F.col(c), F.col("turn"))
    # lower rank than both neighbours: no two neighbours are spliced in one round
    inner = F.col("up").isNotNull() & (F.col("up") != F.col("id")) & (F.col("kids") == 1) & (F.col("x") != F.col("id"))
    inner = inner & (rank("id") < rank("up")) & (rank("id") < rank("x"))
    rest = state.withColumn("raked", leaf).join(gains, "id", "left").select(
        "id", "up", "gap", "hidden", "trail", "name", "raked", "turn",
        (F.col("below") + F.coalesce("g_below", none)).alias("below"),
        (F.col("kids") - F.coalesce("g_kids", none)).alias("kids"),
        F.col("x").bitwiseXOR(F.coalesce("g_x", none)).alias("x"),
    )
    rest = rest.withColumn("what", F.when(F.col("raked"), F.lit("raked")).when(inner, F.lit("spliced")).otherwise(F.lit("keep"))).drop("raked")
    link = F.struct("up", "gap", (F.col("hidden") + F.col("below") + 1).alias("hidden"), "trail")
    empty = F.lit(None).cast("struct<up:bigint,gap:bigint,hidden:bigint,trail:string>")
    to_parent = F.struct(F.col("up").alias("id"), F.col("id").bitwiseXOR(F.col("x")).alias("n_x"), empty.alias("link"))
    to_child = F.struct(F.col("x").alias("id"), none.alias("n_x"), link.alias("link"))
    news = rest.where(F.col("what") == "spliced").select(F.explode(F.array(to_parent, to_child)).alias("n")).select("n.*")
    news = news.groupBy("id").agg(F.bit_xor("n_x").alias("n_x"), F.max("link").alias("link"))
    moved = F.col("link").isNotNull() & (F.col("what") == "keep")
    trail = F.when(moved, F.concat(F.col("link.trail"), F.lit(SEPARATOR), F.col("trail"))).otherwise(F.col("trail")) if with_path else F.col("trail")
    return rest.join(news, "id", "left").select(
        "id",
        F.when(moved, F.col("link.up")).otherwise(F.col("up")).alias("up"),
        F.when(moved, F.col("gap") + F.col("link.gap")).otherwise(F.col("gap")).alias("gap"),
        F.when(moved, F.col("hidden") + F.col("link.hidden")).otherwise(F.col("hidden")).alias("hidden"),
        "below",
        "kids",
        F.when(F.col("what") == "keep", F.col("x").bitwiseXOR(F.coalesce("n_x", none))).otherwise(F.col("x")).alias("x"),
        trail.alias("trail"),
        "name",
        (F.col("turn") + 1).alias("turn"),
        "what",
    )


class _Rest:
    """The same contraction over arrays, for a rest of nodes that fits one task; nodes are indices, up is -1 where there is none."""

    def __init__(self, ids: np.ndarray, up: np.ndarray, gap: np.ndarray, hidden: np.ndarray, below: np.ndarray, trail: list[str] | None, name: list[str] | None):
        n = len(ids)
        self.ids, self.up, self.gap, self.hidden, self.below, self.trail, self.name = ids, up, gap, hidden, below, trail, name
        has = np.flatnonzero(up >= 0)
        self.kids, self.x = np.bincount(up[has], minlength=n), np.zeros(n, np.int64)
        np.bitwise_xor.at(self.x, up[has], has)
        self.root, self.depth, self.total = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)

    def solve(self) -> None:
        up, gap, hidden, below, kids, x = self.up, self.gap, self.hidden, self.below, self.kids, self.x
        alive, rounds, turn = np.ones(len(up), bool), [], 0
        own = np.arange(len(up))
        # of what remains only the nodes with a parent other than themselves are looked at again
        open_ = np.flatnonzero((up >= 0) & (up != own))
        while len(open_):
            raked = open_[kids[open_] == 0]
            np.add.at(below, up[raked], below[raked] + hidden[raked] + 1)
            np.subtract.at(kids, up[raked], 1)
            np.bitwise_xor.at(x, up[raked], raked)
            alive[raked] = False
            left = open_[alive[open_]]
            rank = _mixed(own, turn)
            one = left[(kids[left] == 1) & (x[left] != left)]
            spliced = one[(rank[one] < rank[up[one]]) & (rank[one] < rank[x[one]])]
            child = x[spliced]
            rounds.append((raked, spliced, child))
            if len(spliced):
                np.bitwise_xor.at(x, up[spliced], spliced ^ child)
                if self.trail is not None:
                    for v, c in zip(spliced.tolist(), child.tolist()):
                        self.trail[c] = f"{self.trail[v]}{SEPARATOR}{self.trail[c]}"
                up[child] = up[spliced]
                gap[child] += gap[spliced]
                hidden[child] += hidden[spliced] + below[spliced] + 1
                alive[spliced] = False
            left = left[alive[left]]
            open_ = left[up[left] != left]
            turn += 1
        roots = np.flatnonzero(alive & (up < 0))
        self.root[roots], self.depth[roots], self.total[roots] = self.ids[roots], 0, below[roots]
        for raked, spliced, child in reversed(rounds):
            # hidden of the child is what it was after the splice again, as later rounds' additions were taken off on the way
            self._place(spliced)
            known = self.depth[spliced] >= 0
            ok, c = spliced[known], child[known]
            self.total[ok] = hidden[c] - hidden[ok] + self.total[c]
            hidden[child] -= hidden[spliced] + below[spliced] + 1
            self._place(raked)
            ok = raked[self.depth[raked] >= 0]
            self.total[ok] = below[ok]

    def _place(self, nodes: np.ndarray) -> None:
        above = self.up[nodes]
        known = self.depth[above] >= 0
        at, above = nodes[known], above[known]
        self.root[at] = self.root[above]
        self.depth[at] = self.depth[above] + self.gap[at]

    def path(self, i: int) -> str | None:
        if self.depth[i] < 0:
            return None
        parts = []
        while self.up[i] >= 0:
            parts.append(self.trail[i])
            i = self.up[i]
        parts.append(self.name[i])
        return SEPARATOR.join(reversed(parts))


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def _finish(batches: Iterator[pa.RecordBatch], with_path: bool) -> Iterator[pa.RecordBatch]:
    """Nodes (id, up, gap, hidden, below, trail, name), all in one task -> rows of FOUND."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    t = pa.Table.from_batches(table).sort_by("id")
    column = lambda c: t.column(c).to_numpy().astype(np.int64)
    ids, has = column("id"), t.column("up").is_valid().to_numpy()
    up = np.where(has, np.searchsorted(ids, t.column("up").fill_null(0).to_numpy()), -1)
    texts = [t.column(c).to_pylist() if with_path else None for c in ("trail", "name")]
    rest = _Rest(ids, up, column("gap").copy(), column("hidden").copy(), column("below").copy(), *texts)
    rest.solve()
    step = 500 if with_path else 100_000
    for at in range(0, len(ids), step):
        these = slice(at, at + step)
        paths = [rest.path(i) for i in range(at, min(at + step, len(ids)))] if with_path else [None] * len(ids[these])
        arrays = [pa.array(a[these]) for a in (ids, rest.root, rest.depth, rest.total)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(paths, pa.string())], names=["id", "root", "depth", "below", "path"])


def _told(nodes: DataFrame, above: DataFrame, hot: DataFrame | None) -> DataFrame:
    """nodes joined with the row of their parent (above, by up). The parents with very many children (hot, a bounded number) are
    broadcast, so that their children stay where they are."""
    if hot is None:
        return nodes.join(above, "up")
    busy = F.broadcast(hot)
    few = nodes.join(busy, "up", "left_anti").join(above, "up")
    return few.unionByName(nodes.join(F.broadcast(above.join(busy, "up", "left_semi")), "up"))


def hierarchy(links: DataFrame, with_path: bool = False, max_rounds: int = 500, small: int = 100_000, busy: int = 50_000) -> DataFrame:
    """Root, depth and number of descendants (and full path) of every node of a forest given by parent links.

    links: frn, parent (NULL = none), name; one row per frn, see latest_entries. Tree contraction: rounds of leaf raking
    and unary-chain compression shrink the forest geometrically until only roots are left; the recorded contractions
    are then undone from last to first, each round restoring its nodes from their neighbours by one equi-join. A core that
    never becomes a root shrinks to a node that is its own parent, which exposes a cycle: nodes on it or below it get
    -1 for root_frn, depth and descendants, and a NULL path. The number of rounds grows with the logarithm of the
    nodes, however deep the chains are; partitions shrink with the nodes, and once no more than `small` nodes are left (counted after
    every round) the same contraction goes on over arrays in one task.

    Children learn of their parent by a join on it. A parent with more than max(busy, nodes / 10 000) children is told apart: there are at most
    10 000 of them, whose rows are broadcast.

    Parents that have no row are none. A NULL name counts as empty in the path; paths join names with a backslash.
    An empty table gives an empty result. Returns frn, root_frn, depth, descendants and, with_path, path.
    """
    spark = links.sparkSession
    most_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_for = lambda n: max(1, min(most_parts, -(-n // PER_PARTITION)))
    nodes = links.select(F.col("frn").alias("id"), F.col("parent").alias("up"), F.coalesce("name", F.lit("")).alias("name") if with_path else F.lit("").alias("name"))
    # grouped, not repartitioned, by id: what latest_entries() left in place stays there
    nodes = cut(nodes.groupBy("id").agg(F.first("up").alias("up"), F.first("name").alias("name")), partitioned=True)
    n = nodes.count()
    parts = most_parts
    kids = nodes.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.count("*").alias("kids"), F.bit_xor("id").alias("x"))
    kids = cut(kids, partitioned=True, parts=parts)
    hot = cut(kids.where(F.col("kids") > max(busy, n // 10_000)).select(F.col("id").alias("up")))
    hot = None if hot.isEmpty() else hot
    missing = cut(kids.join(nodes.select("id"), "id", "left_anti").select(F.col("id").alias("up"), F.lit(True).alias("lost")), partitioned=True, parts=parts)
    if not missing.isEmpty():
        few, bounded = broadcast_if(missing, 100_000)
        if bounded:
            nodes = nodes.join(few, "up", "left")
        else:
            orphans = _told(nodes, missing, hot).select("id", "lost")
            nodes = nodes.join(orphans, "id", "left")
        nodes = nodes.select("id", F.when(F.col("lost").isNull(), F.col("up")).alias("up"), "name")
    zero = F.lit(0).cast("long")
    state = nodes.join(kids, "id", "left").select(
        "id", "up", F.lit(1).cast("long").alias("gap"), zero.alias("hidden"), zero.alias("below"),
        F.coalesce("kids", zero).alias("kids"), F.coalesce("x", zero).alias("x"), F.col("name").alias("trail"), "name", F.lit(0).alias("turn"),
    )
    # a fixed partitioning by id, which checkpoints keep: the joins below then move the messages only, never the nodes
    state = cut(state, partitioned=True, parts=parts)
    unfinished = F.col("up").isNotNull() & (F.col("up") != F.col("id"))
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0))
    rounds: list[tuple[DataFrame, int]] = []
    left, more = n, n > small and not state.where(unfinished).isEmpty()
    while more and left > small:
        if len(rounds) >= max_rounds:
            raise RuntimeError(f"not contracted after {max_rounds} rounds")
        if 4 * parts_for(left) <= parts:
            parts = parts_for(left)
            state = state.repartition(parts, "id")
        done = cut(_contract(state, with_path), partitioned=True, parts=parts)
        rounds.append((done, parts))
        state = done.where(F.col("what") == "keep").drop("what")
        sums = state.agg(F.count("*").alias("left"), count(unfinished).alias("more")).first()
        left, more = sums["left"], sums["more"] > 0
        if len(rounds) % RELEASE_EVERY == 0:
            release(spark)
    if left <= small:
        rest = state.select("id", "up", "gap", "hidden", "below", "trail", "name").coalesce(1)
        found = rest.mapInArrow(lambda it: _finish(it, with_path), FOUND)
    else:
        cyclic = F.col("up").isNotNull()
        none = F.lit(-1).cast("long")
        found = state.select(
            "id",
            F.when(cyclic, none).otherwise(F.col("id")).alias("root"),
            F.when(cyclic, none).otherwise(zero).alias("depth"),
            F.when(cyclic, none).otherwise(F.col("below")).alias("below"),
            (F.when(cyclic, F.lit(None)).otherwise(F.col("name")) if with_path else F.lit(None)).cast("string").alias("path"),
        )
    if rounds:
        parts = rounds[-1][1]
        found = cut(found.repartition(parts, "id"), partitioned=True, parts=parts)
    for n_undone, (done, parts) in enumerate(reversed(rounds), 1):
        found = _undo(found, done, parts, hot, with_path, last=n_undone == len(rounds))
        if n_undone % RELEASE_EVERY == 0:
            release(spark)
    result = found.select(F.col("id").alias("frn"), F.col("root").alias("root_frn"), F.col("depth").cast("int").alias("depth"), F.col("below").alias("descendants"), "path")
    return result if with_path else result.drop("path")


def _undo(found: DataFrame, done: DataFrame, parts: int, hot: DataFrame | None, with_path: bool, last: bool) -> DataFrame:
    """found with the nodes that one round removed."""
    none = F.lit(-1).cast("long")
    lost = lambda c, otherwise: F.when(F.col("u_depth") < 0, none).otherwise(otherwise).alias(c)
    place = ["id", lost("root", F.col("u_root")), lost("depth", F.col("u_depth") + F.col("gap"))]
    path = (F.concat("u_path", F.lit(SEPARATOR), "trail") if with_path else F.lit(None).cast("string")).alias("path")
    above_of = lambda df: df.select(F.col("id").alias("up"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"), F.col("path").alias("u_path"))
    # the link child -> parent holds the link child -> node, the node with its own branches, and the link node -> parent
    held = done.where(F.col("what") == "keep").select(F.col("id").alias("x"), F.col("hidden").alias("c_hidden"))
    child = found.select(F.col("id").alias("x"), F.col("below").alias("c_below"))
    spliced = _told(done.where(F.col("what") == "spliced").join(held.join(child, "x"), "x"), above_of(found), hot)
    found = found.unionByName(spliced.select(*place, lost("below", F.col("c_hidden") - F.col("hidden") + F.col("c_below")), path))
    found = cut(found.repartition(parts, "id"), partitioned=True, parts=parts)
    raked = _told(done.where(F.col("what") == "raked"), above_of(found), hot)
    found = found.unionByName(raked.select(*place, lost("below", F.col("below")), path))
    return found if last else cut(found.repartition(parts, "id"), partitioned=True, parts=parts)


def lineages(links: DataFrame) -> DataFrame:
    """frn, root_frn, depth, descendants and lineage: the frns from the root to the node itself, 16 hexadecimal digits each, joined with a backslash.

    All that lies below a node is the rows whose lineage begins with its own, so a subtree is one range of the table sorted by
    lineage. Nodes on a loop or below one have a NULL lineage.
    """
    named = links.select("frn", "parent", F.lpad(F.hex("frn"), 16, "0").alias("name"))
    return hierarchy(named, with_path=True).withColumnRenamed("path", "lineage")


def subtree(tree: DataFrame, frn: int) -> DataFrame:
    """The rows of lineages() below one node, the node left out; none if it is unknown or on a loop."""
    top = tree.where(F.col("frn") == frn).select(F.col("lineage").alias("__top"))
    return tree.join(F.broadcast(top), F.startswith("lineage", F.concat("__top", F.lit(SEPARATOR)))).select(*tree.columns)


def descendants(tree: DataFrame) -> DataFrame:
    """frn, below_frn: every node with every node below it, a row per pair. The rows are as many as the depths add up to."""
    above = F.transform(F.split("lineage", r"\\"), lambda h: F.conv(h, 16, -10).cast("bigint"))
    pairs = tree.where("depth > 0").select(F.col("frn").alias("below_frn"), F.explode(above).alias("frn")).where("frn != below_frn")
    return pairs.select("frn", "below_frn")
