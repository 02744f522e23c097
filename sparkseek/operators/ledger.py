"""Processing only new or changed records: a ledger of work items with leases and fencing tokens."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkseek.functions.hashes import fingerprint
from sparkseek.operators.shared import SharedFolder, file_name, from_file_name
from sparkseek.session import broadcast_if, cut

PENDING, LEASED, DONE = "pending", "leased", "done"
LEASES = "item string, token bigint, worker string, until timestamp_ntz, minor bigint, scanned timestamp_ntz"
COMMITS = "item string, token bigint, path string, major bigint"


class StaleWriter(RuntimeError):
    """A commit with a token that is no longer the newest one granted for its item."""


@dataclass(frozen=True)
class Lease:
    batch: str
    token: int
    until: datetime
    path: str


class WorkLedger:
    """Durable states of work items in a folder that all workers share.

    An item is pending until a worker leases it; lease() gives a fencing token greater than every earlier one of the
    item. A lease that expires makes the item pending again, and the next lease gets a new token. commit() accepts
    the newest token only, once: a worker that was thought dead is rejected (StaleWriter) and a commit repeated after a
    lost answer does no harm. Output goes to a path named by item and token, so a retry never mixes with the
    files of an earlier try and readers see only the path the commit names.

    Every step is one small file that appears whole or not at all under a name that must be free (SharedFolder), so a worker may die at
    any step: it leaves a temporary file, a lease that expires, or output that no commit names. Items that come as whole
    tables of leases and commits are entered by load(), as Parquet under a name of their own; entering them again replaces them.
    rows() gives all of it as one table.
    """

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], datetime] = datetime.now):
        self.spark, self.clock = spark, clock
        self.files = SharedFolder(spark, folder)
        self.folder = self.files.folder
        self._open: deque[str] = deque()

    def add(self, batch: str, about: dict | None = None) -> bool:
        """Enter an item as pending; False if it was entered before."""
        return self.files.create(f"items/{file_name(batch)}", about or {})

    def batches(self) -> list[str]:
        return sorted(map(from_file_name, self.files.names("items")))

    def about(self, batch: str) -> dict | None:
        return self.files.read(f"items/{file_name(batch)}")

    def _lease_file(self, batch: str, token: int) -> str:
        return f"leases/{file_name(batch)}.{token:08d}"

    def _done_file(self, batch: str) -> str:
        return f"done/{file_name(batch)}"

    def _last(self, batch: str, known: int = 0) -> tuple[int, dict | None]:
        """The newest token of an item, which is at least `known`, and its lease; tokens have no gaps."""
        token = known
        while self.files.exists(self._lease_file(batch, token + 1)):
            token += 1
        return token, self.files.read(self._lease_file(batch, token)) if token else None

    def _tokens(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for name in self.files.names("leases"):
            item, _, token = name.rpartition(".")
            found[item] = max(found.get(item, 0), int(token))
        return found

    def state(self, batch: str) -> str:
        if self.files.exists(self._done_file(batch)):
            return DONE
        _, lease = self._last(batch)
        return LEASED if lease and datetime.fromisoformat(lease["until"]) > self.clock() else PENDING

    def _grant(self, batch: str, seconds: float, worker: str, known: int = 0) -> Lease | None:
        if self.files.exists(self._done_file(batch)):
            return None
        last, lease = self._last(batch, known)
        if lease and datetime.fromisoformat(lease["until"]) > self.clock():
            return None
        token, until = last + 1, self.clock() + timedelta(seconds=seconds)
        content = {"item": batch, "token": token, "worker": worker, "until": until.isoformat()}
        if not self.files.create(self._lease_file(batch, token), content):
            return None
        return Lease(batch, token, until, f"{self.folder}/data/{file_name(batch)}/{token:08d}")

    def lease(self, seconds: float, worker: str = "", only: Sequence[str] | None = None) -> Lease | None:
        """Take one pending item; None if there is none. Of two rivals one gets the token and the other goes on.

        What is open is listed once and then worked through, and listed again only when nothing is left, so the cost follows the items.
        """
        if only is not None:
            return next((got for b in only if (got := self._grant(b, seconds, worker))), None)
        for listed in (False, True):
            if listed:
                done = set(self.files.names("done"))
                self._open = deque(n for n in self.files.names("items") if n not in done)
                known = self._tokens()
            while self._open:
                name = self._open.popleft()
                if (got := self._grant(from_file_name(name), seconds, worker, known.get(name, 0) if listed else 0)) is not None:
                    return got
        return None

    def commit(self, lease: Lease) -> bool:
        """Mark the item done with this lease's output. True also if this very lease did so before."""
        name = self._done_file(lease.batch)
        done = self.files.read(name)
        if done is None:
            if self.files.exists(self._lease_file(lease.batch, lease.token + 1)):
                raise StaleWriter(f"{lease.batch}: token {lease.token} was superseded")
            if self.files.create(name, {"item": lease.batch, "token": lease.token, "path": lease.path}):
                return True
            done = self.files.read(name)
        if done["token"] != lease.token:
            raise StaleWriter(f"{lease.batch} was done with token {done['token']}")
        return True

    def outputs(self) -> list[str]:
        """The paths of the outputs that were committed, one per done item."""
        return [self.files.read(f"done/{n}")["path"] for n in self.files.names("done")]

    def run(self, work: Callable[[str, dict], DataFrame], seconds: float = 3600, worker: str = "") -> int:
        """Lease, compute, write and commit until nothing is pending; returns the number of items done."""
        n = 0
        while (lease := self.lease(seconds, worker)) is not None:
            work(lease.batch, self.about(lease.batch) or {}).write.mode("overwrite").parquet(lease.path)
            self.commit(lease)
            n += 1
        return n

    def load(self, name: str, leases: DataFrame, commits: DataFrame) -> None:
        """Enter whole tables: leases (of LEASES item, token and any others), commits (of COMMITS item, token and any others)."""
        for kind, df, schema in (("leases", leases, LEASES), ("commits", commits, COMMITS)):
            wanted = [c.split() for c in schema.split(", ")]
            picked = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted])
            picked.write.mode("overwrite").parquet(self.files.at(f"tables/{kind}/{file_name(name)}"))

    def _table(self, kind: str, folder: str, schema: str) -> DataFrame:
        found = [self.spark.read.schema(schema).json(self.files.at(folder))] if self.files.names(folder) else []
        found += [self.spark.read.schema(schema).parquet(self.files.at(f"tables/{kind}/{name}")) for name in self.files.names(f"tables/{kind}")]
        if not found:
            return self.spark.createDataFrame([], schema)
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def rows(self, as_of: datetime | None = None) -> DataFrame:
        """item, token, state, until, worker, path, major, minor, scanned: a row per lease, see lease_states; items that were never leased have
        token 0 and are pending. as_of is the time leases are held against, by default the ledger's clock."""
        leases, commits = self._table("leases", "leases", LEASES), self._table("commits", "done", COMMITS)
        found = lease_states(leases, commits, as_of or self.clock())
        entered = self.batches()
        if not entered:
            return found
        waiting = self.spark.createDataFrame([(b,) for b in entered], "item string").join(leases.select("item"), "item", "left_anti")
        return found.unionByName(waiting.select("item", F.lit(0).cast("bigint").alias("token"), F.lit(PENDING).alias("state")), allowMissingColumns=True)


def lease_states(leases: DataFrame, commits: DataFrame, as_of: datetime) -> DataFrame:
    """Each lease with its state: done if a commit carries its token, leased if its time is not up at as_of and no greater token of its
    item was granted, else pending: its holder died or was superseded, and what it held is open again. Repeats count once; a lease without
    an end is over."""
    newest = leases.groupBy("item").agg(F.max("token").alias("newest"))
    marked = commits.distinct().withColumn("committed", F.lit(True))
    held = leases.distinct().join(marked, ["item", "token"], "left").join(newest, "item")
    live = (F.col("token") == F.col("newest")) & (F.col("until") > F.lit(as_of).cast("timestamp_ntz"))
    state = F.when(F.col("committed"), DONE).when(live, LEASED).otherwise(PENDING)
    return held.select("item", "token", state.alias("state"), "until", "worker", "path", "major", "minor", "scanned")


def enter_runs(book: WorkLedger, index_state: DataFrame, db_header: DataFrame) -> None:
    """Enter the indexer's own tables: each run (index_state) is a lease of its volume whose token is the generation it meant to commit, reaching to
    last_usn and the deliveries of its scan time; each header is a commit of its generation, in its journal. A run names no end: it is over
    when the next one asks."""
    runs = index_state.select(F.col("volume_id").cast("string").alias("item"), F.col("generation").alias("token"), F.concat(F.lit("run "), F.col("run_id")).alias("worker"), F.col("last_usn").alias("minor"), F.col("last_scan_time").alias("scanned"))
    heads = db_header.select(F.col("volume_id").cast("string").alias("item"), F.col("generation").alias("token"), F.col("journal_seq").alias("major"))
    book.load("indexer", runs, heads)


def done_reaches(rows: DataFrame) -> DataFrame:
    """item, major, minor, scanned of the done rows of a ledger; a commit that does not say its journal covers no change."""
    known = rows.where(F.col("state") == DONE).dropna(subset=["major", "minor", "scanned"])
    return known.select("item", "major", "minor", "scanned").distinct()


def settle(
    items: DataFrame, done: DataFrame, scope: str, position: Sequence[str], received: str, max_steps: int = 64, most: int = 200_000, salts: int = 64
) -> DataFrame:
    """items with state: done if some done row of the ledger covers it, else pending.

    done: item (the scope as a string), major, minor, scanned, see done_reaches. A row covers the items of its scope received by its scan
    time and not after its reach (the positions compare in order). Per scope the rows form a staircase: going down in reach, only a row
    with a later scan time than all that reach further matters. The steps travel as arrays of at most max_steps, so that an item meets its
    scope's staircase with one equi-join. Up to `most` arrays are broadcast, so a scope with a third of all items stays spread; beyond,
    the join takes a salt of `salts` values. Items keep all their rows and columns. NULLs in scope, position or received are never covered.
    """
    reach_of = F.struct(F.col("major").cast("long").alias("p0"), F.col("minor").cast("long").alias("p1"))
    w = W.partitionBy("item").orderBy(F.col("__reach").desc(), F.col("scanned").desc())
    steps = done.select("item", reach_of.alias("__reach"), "scanned").withColumn("__best", F.max("scanned").over(w.rowsBetween(W.unboundedPreceding, -1)))
    steps = steps.where(F.col("__best").isNull() | (F.col("scanned") > F.col("__best")))
    numbered = steps.withColumn("__n", F.row_number().over(W.partitionBy("item").orderBy(F.col("__reach").desc())))
    packs = numbered.groupBy("item", F.floor((F.col("__n") - 1) / max_steps).alias("__pack")).agg(
        F.collect_list(F.struct(F.col("__reach").alias("reach"), F.col("scanned").alias("scanned"))).alias("__steps")
    )
    packs = packs.groupBy(F.col("item").alias("__scope")).agg(F.collect_list("__steps").alias("__packs"))
    packs, small = broadcast_if(cut(packs), most)
    on = F.col(scope).cast("string") == F.col("__scope")
    here = items
    if not small:
        packs = packs.withColumn("__p_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        here = here.withColumn("__salt", F.pmod(F.xxhash64(*position, received), F.lit(salts)).cast("int"))
        on = on & (F.col("__salt") == F.col("__p_salt"))
    at = F.struct(*[F.col(c).cast("long").alias(f"p{i}") for i, c in enumerate(position)])
    known = F.lit(True)
    for c in position:
        known = known & F.col(c).isNotNull()
    joined = here.join(packs, on, "left")
    covered = F.exists("__packs", lambda pack: F.exists(pack, lambda s: (s.reach >= at) & (s.scanned >= F.col(received))))
    state = F.when(known & F.coalesce(covered, F.lit(False)), DONE).otherwise(PENDING)
    return joined.select(*items.columns, state.alias("state"))


def pending_files(deliveries: DataFrame, done: DataFrame) -> DataFrame:
    """The files the next run must handle: those whose state after all done changes differs from their state after all changes.

    deliveries: rows of file_changes(); done: see done_reaches. A file's state is absent, or present with a modified_time (NULL is a
    value of its own). A change is done if any of its deliveries is. Both last changes of a file come from one aggregation by the
    fingerprint of the file, combined on the map side, so a hot file or volume moves as one row per task. Returns volume_id, journal_seq, usn of the
    last change, and op.
    """
    items = settle(deliveries, done, "volume_id", ["journal_seq", "usn"], "received_at")
    image = F.struct("journal_seq", "usn", "op", "modified_time", "volume_id")
    keyed = items.select(fingerprint(["volume_id", "file_path", "file_name"]).alias("k"), image.alias("i"), (F.col("state") == DONE).alias("d"))
    both = keyed.groupBy("k.hi", "k.lo").agg(F.max("i").alias("last"), F.max(F.when(F.col("d"), F.col("i"))).alias("handled"))
    present = lambda s: F.coalesce(F.col(f"{s}.op") == 0, F.lit(False))
    same = F.when(
        present("last") & present("handled"), F.col("last.modified_time").eqNullSafe(F.col("handled.modified_time"))
    ).otherwise(~present("last") & ~present("handled"))
    return both.where(~same).select("last.volume_id", "last.journal_seq", "last.usn", "last.op")


def journal_gaps(deliveries: DataFrame, done: DataFrame) -> DataFrame:
    """volume_id, journal_seq, first_usn, reason of the volumes whose feed cannot be resumed where their last done row ended, so that a full
    scan is due: "new journal" if the journal was made anew since, "lost" if the oldest change still there lies after the place to resume at, "never" if no row is done.

    volume_id NULL has no gaps. An empty feed has none.
    """
    seen = deliveries.where(F.col("volume_id").isNotNull() & F.col("journal_seq").isNotNull() & F.col("usn").isNotNull())
    per_journal = seen.groupBy("volume_id", "journal_seq").agg(F.min("usn").alias("first_usn"))
    now = per_journal.groupBy("volume_id").agg(F.max(F.struct("journal_seq", "first_usn")).alias("j")).select("volume_id", "j.*")
    last = done.groupBy("item").agg(F.max(F.struct("major", "minor")).alias("r")).select(F.col("item").alias("__item"), "r.*")
    joined = now.join(last, F.col("volume_id").cast("string") == F.col("__item"), "left")
    reason = F.when(F.col("__item").isNull(), "never").when(F.col("journal_seq") > F.col("major"), "new journal").when(F.col("first_usn") > F.col("minor"), "lost")
    return joined.select("volume_id", "journal_seq", "first_usn", reason.alias("reason")).where(F.col("reason").isNotNull())
