"""Rebuilding a table from a feed of inserts, updates and deletes, newest change first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkseek.functions.hashes import fingerprint
from sparkseek.functions.paths import canonical_path, lowercase_ascii
from sparkseek.session import broadcast_if, cut

UPSERT, DELETE = 0, 1


def file_changes(feed: DataFrame) -> DataFrame:
    """The usable deliveries of a file change feed, with the identity of their file.

    Adds file_path and file_name (canonical spellings) and drops rows with a NULL parent_path or name or with
    an op other than 0 and 1. NULL journal_seq or usn rank below every number.
    """
    usable = feed.where(F.col("parent_path").isNotNull() & F.col("name").isNotNull() & F.col("op").isin(UPSERT, DELETE))
    return usable.withColumn("file_path", canonical_path(F.col("parent_path"))).withColumn("file_name", lowercase_ascii(F.col("name")))


def batch_edges(changes: DataFrame, scope: Sequence[str], major: str, minor: str, batches: int, grain: int = 8) -> DataFrame:
    """scope, edges: the places in the change order at which batches 1, 2, ... begin, going backwards from the newest change.

    One pass over the scope and order columns: a row per (scope, major) with its number of changes and approximate quantiles of minor,
    combined on the map side. Per scope the places are then chosen so that batches hold about equally many changes.
    """
    low = F.lit(-(2**62))
    cuts = [k / (grain * batches) for k in range(1, grain * batches + 1)]
    one = changes.select(*scope, F.coalesce(F.col(major), low).alias("__major"), F.coalesce(F.col(minor), low).alias("__minor"))
    stats = one.groupBy(*scope, "__major").agg(F.count("*").alias("__n"), F.percentile_approx("__minor", cuts, F.lit(1000)).alias("__at"))
    w = W.partitionBy(*scope) if scope else W.partitionBy(F.lit(0))
    newer = F.coalesce(F.sum("__n").over(w.orderBy(F.desc("__major")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stats = stats.withColumn("__newer", newer).withColumn("__all", F.sum("__n").over(w))
    stats = stats.select(*scope, "__major", "__n", "__newer", "__all", F.posexplode("__at").alias("__k", "__minor"))
    before = F.col("__newer") + F.col("__n") * (1 - (F.col("__k") + 1) / F.lit(grain * batches))
    place = F.struct(F.col("__major").alias("major"), F.col("__minor").alias("minor"))
    firsts = [F.max(F.when(before >= F.col("__all") * (b / batches), place)).alias(f"e{b}") for b in range(1, batches)]
    return stats.groupBy(*scope).agg(*firsts).select(*scope, F.array(*[f"e{b}" for b in range(1, batches)]).alias("__edges"))


def order_batches(changes: DataFrame, scope: Sequence[str], major: str, minor: str, batches: int, sketched: DataFrame | None = None, most: int = 100_000, salts: int = 64) -> DataFrame:
    """changes with __batch, 0 the newest; one batch of a scope never reaches into a newer one.

    The edges have one row per scope. Up to `most` scopes they are broadcast, so that a scope with a third of all changes stays
    spread; beyond, they are joined with a salt of `salts` values for the same reason. sketched: rows with scope and order to take the edges from, by default the changes
    themselves; it only decides how even the batches are.
    """
    if batches <= 1:
        return changes.withColumn("__batch", F.lit(0))
    edges = cut(batch_edges(changes if sketched is None else sketched, scope, major, minor, batches))
    edges = edges.select(*[F.col(c).alias(f"__e_{c}") for c in scope], "__edges")
    edges, small = broadcast_if(edges, most)
    on = F.lit(True)
    for c in scope:
        on = on & F.col(c).eqNullSafe(F.col(f"__e_{c}"))
    placed = changes
    if not small:
        edges = edges.withColumn("__e_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        placed = placed.withColumn("__salt", F.pmod(F.xxhash64(major, minor), F.lit(salts)).cast("int"))
        on = on & (F.col("__salt") == F.col("__e_salt"))
    low = F.lit(-(2**62))
    place = F.struct(F.coalesce(F.col(major), low).alias("major"), F.coalesce(F.col(minor), low).alias("minor"))
    passed = F.aggregate("__edges", F.lit(0), lambda n, e: n + F.when(e.isNotNull() & (place <= e), 1).otherwise(0))
    return placed.join(edges, on, "left").select(*changes.columns, F.coalesce(passed, F.lit(0)).alias("__batch"))


def current_state(
    feed: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    op: str = "op",
    values: Sequence[str] = (),
    scope: Sequence[str] = (),
    base: DataFrame | None = None,
    batches: int = 4,
    with_key: bool = True,
    sketched: DataFrame | None = None,
) -> DataFrame:
    """The rows that exist after all changes: key (without with_key only scope), order and values of each row's last change.

    Newest-first resolution. The feed is cut into batches along the change order, and each task reduces its rows to one image per
    key and batch before the one exchange there is, by key; so repeats and a hot key move as one row per task. Going backwards, a batch
    adds the images of the keys that no newer batch has resolved (left anti join, on the partitioning of that exchange, so nothing
    moves again); a delete adds a tombstone, which resolves its key and shows nothing. At last the rows of base that no change touches
    are appended.

    order names two numeric columns (major, minor) that place the changes within scope; scope must be part of key.
    Repeats of a change count once; of deliveries that share a place in the order the one with the greatest
    values holds. Deletes of unknown keys do nothing, updates of unknown keys add them. NULL key parts are values
    of their own, NULL order values come first, an empty feed gives base. base needs key, order and values.
    """
    if not set(scope) <= set(key):
        raise ValueError("scope must be part of key")
    major, minor = order
    carried = [*key, *values] if with_key else [*scope, *values]
    batched = order_batches(feed.select(*dict.fromkeys([*key, *order, op, *values])), scope, major, minor, batches, sketched)
    image = F.struct(*order, op, *[c for c in carried if c not in order])
    keyed = batched.select(fingerprint(key).alias("__key"), "__batch", image.alias("__image")).select("__key.hi", "__key.lo", "__batch", "__image")
    per_batch = [F.max(F.when(F.col("__batch") == b, F.col("__image"))).alias(f"i{b}") for b in range(batches)]
    images = keyed.groupBy("hi", "lo").agg(*per_batch)
    held = F.filter(F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"i{b}").alias("i")) for b in range(batches)]), lambda x: x.i.isNotNull())
    images = images.select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), F.explode(held).alias("__x"))
    images = cut(images.select("__hi", "__lo", F.col("__x.b").alias("__batch"), F.col("__x.i").alias("__image")), partitioned=True)
    resolved = None
    for batch in range(batches):
        new = images.where(F.col("__batch") == batch)
        if batch:
            newer = images.where(F.col("__batch") < batch).select("__hi", "__lo")
            new = new.join(newer, ["__hi", "__lo"], "left_anti")
        new = new.select("__image.*")
        resolved = new if resolved is None else resolved.unionAll(new)
    wanted = list(dict.fromkeys([*(key if with_key else scope), *order, *values]))
    live = resolved.where(F.col(op) == UPSERT).select(*wanted)
    if base is None:
        return live
    touched = images.select("__hi", "__lo")
    old = base.withColumn("__key", fingerprint(key)).withColumn("__hi", F.col("__key.hi")).withColumn("__lo", F.col("__key.lo"))
    return live.unionByName(old.join(touched, ["__hi", "__lo"], "left_anti").select(*wanted))


def current_files(feed: DataFrame, values: Sequence[str] = (), base: DataFrame | None = None, batches: int = 4, with_key: bool = True) -> DataFrame:
    """current_state of a file change feed; a file is volume_id, parent_path and name in any spelling.

    Out come volume_id, file_path, file_name (with_key), journal_seq, usn and values of the last change of each file that exists.
    """
    key, order = ["volume_id", "file_path", "file_name"], ["journal_seq", "usn"]
    return current_state(file_changes(feed), key, order, values=values, scope=["volume_id"], base=base, batches=batches, with_key=with_key, sketched=feed)
