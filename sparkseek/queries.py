"""Queries of the general operators over the tables of a data directory, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators import changes, ledger, tree
from sparkseek.session import read_table, work_folder

NOW = dt.datetime(2026, 4, 1)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.current_files(read_table(spark, sf_dir, "work_items"), with_key=False).select("volume_id", "journal_seq", "usn")


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table itself: each file with the values of its last change."""
    state = changes.current_files(read_table(spark, sf_dir, "work_items"), values=["modified_time"])
    return state.select("volume_id", "file_path", "file_name", "journal_seq", "usn", "modified_time")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.hierarchy(tree.latest_entries(read_table(spark, sf_dir, "frn_entries")))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths as well."""
    return tree.hierarchy(tree.latest_entries(read_table(spark, sf_dir, "frn_entries")), with_path=True)


def p2_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with everything below it."""
    return tree.descendants(tree.lineages(tree.latest_entries(read_table(spark, sf_dir, "frn_entries"))))


def _book(spark: SparkSession, sf_dir: str) -> ledger.WorkLedger:
    book = ledger.WorkLedger(spark, work_folder(spark, "ledger"), lambda: NOW)
    ledger.enter_runs(book, read_table(spark, sf_dir, "index_state"), read_table(spark, sf_dir, "db_header"))
    return book


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.done_reaches(_book(spark, sf_dir).rows())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pending_files(changes.file_changes(read_table(spark, sf_dir, "work_items")), _done(spark, sf_dir)).select("volume_id", "journal_seq", "usn")


def p4_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's own rows: the state of every run's lease on its volume."""
    return _book(spark, sf_dir).rows().select(F.col("item").cast("int").alias("volume_id"), F.col("token").alias("generation"), "state", "minor", F.coalesce("major", F.lit(-1)).alias("major")).distinct()


def q_journal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volumes whose journal cannot be resumed after the last committed run."""
    return ledger.journal_gaps(read_table(spark, sf_dir, "work_items"), _done(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p2_found, p2_paths, p2_below, p4_found, p4_ledger, q_journal_gaps)}

_CHANGES = r"""usable AS (
  SELECT DISTINCT volume_id, journal_seq, usn, op, modified_time, received_at,
    translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS file_name,
    translate(parent_path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ/', 'abcdefghijklmnopqrstuvwxyz\') AS p
  FROM work_items WHERE parent_path IS NOT NULL AND name IS NOT NULL AND op IN (0, 1)
), changes AS (
  SELECT volume_id, journal_seq, usn, op, modified_time, received_at, file_name,
    rtrim(CASE WHEN starts_with(p, '\\?\') THEN substr(p, 5) ELSE p END, '\') AS file_path
  FROM usable
)"""

_TREE = r"""e AS (
  SELECT frn, CASE WHEN parent <> 0 THEN parent END AS parent, name FROM frn_entries WHERE frn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY frn ORDER BY usn DESC NULLS LAST, parent DESC NULLS LAST, name DESC NULLS LAST) = 1
), n AS (
  SELECT e.frn, q.frn AS up, coalesce(e.name, '') AS name FROM e LEFT JOIN e q ON e.parent = q.frn
), down AS (
  SELECT frn, frn AS root, 0 AS depth, name AS path FROM n WHERE up IS NULL
  UNION ALL
  SELECT n.frn, d.root, d.depth + 1, d.path || '\' || n.name FROM n JOIN down d ON n.up = d.frn
), above AS (
  SELECT up AS a FROM n JOIN down USING (frn) WHERE up IS NOT NULL
  UNION ALL
  SELECT n.up FROM above JOIN n ON n.frn = above.a WHERE n.up IS NOT NULL
), below AS (SELECT a, count(*) AS c FROM above GROUP BY a)"""

ORACLE_SQL = {
    "p1_found": f"""WITH {_CHANGES}, last AS (
  SELECT *, row_number() OVER (PARTITION BY volume_id, file_path, file_name ORDER BY journal_seq DESC, usn DESC) AS rn FROM changes
) SELECT volume_id, journal_seq, usn FROM last WHERE rn = 1 AND op = 0""",
    "p1_state": f"""WITH {_CHANGES}, last AS (
  SELECT *, row_number() OVER (PARTITION BY volume_id, file_path, file_name ORDER BY journal_seq DESC, usn DESC) AS rn FROM changes
) SELECT volume_id, file_path, file_name, journal_seq, usn, modified_time FROM last WHERE rn = 1 AND op = 0""",
    "p2_found": f"""WITH RECURSIVE {_TREE}
SELECT n.frn, coalesce(d.root, -1) AS root_frn, CAST(coalesce(d.depth, -1) AS INTEGER) AS depth,
  CASE WHEN d.frn IS NULL THEN -1 ELSE coalesce(b.c, 0) END AS descendants
FROM n LEFT JOIN down d ON n.frn = d.frn LEFT JOIN below b ON b.a = n.frn""",
    "p2_paths": f"""WITH RECURSIVE {_TREE}
SELECT n.frn, coalesce(d.root, -1) AS root_frn, CAST(coalesce(d.depth, -1) AS INTEGER) AS depth,
  CASE WHEN d.frn IS NULL THEN -1 ELSE coalesce(b.c, 0) END AS descendants, d.path
FROM n LEFT JOIN down d ON n.frn = d.frn LEFT JOIN below b ON b.a = n.frn""",
    "p2_below": f"""WITH RECURSIVE {_TREE.replace("SELECT up AS a FROM n JOIN", "SELECT up AS a, n.frn AS f FROM n JOIN").replace("SELECT n.up FROM above", "SELECT n.up, above.f FROM above")}
SELECT a AS frn, f AS below_frn FROM above""",
    "p4_found": f"""WITH {_CHANGES}, runs AS (
  SELECT DISTINCT s.volume_id, h.journal_seq, s.last_usn, s.last_scan_time
  FROM index_state s JOIN db_header h ON h.volume_id = s.volume_id AND h.generation = s.generation WHERE h.journal_seq IS NOT NULL
), c AS (
  SELECT volume_id, file_path, file_name, journal_seq, usn, op, modified_time, min(received_at) AS first_received
  FROM changes GROUP BY ALL
), h AS (
  SELECT *, EXISTS (SELECT 1 FROM runs r WHERE r.volume_id = c.volume_id AND c.first_received <= r.last_scan_time
    AND (c.journal_seq < r.journal_seq OR (c.journal_seq = r.journal_seq AND c.usn <= r.last_usn))) AS handled FROM c
), f AS (
  SELECT volume_id, file_path, file_name, arg_max({{'s': journal_seq, 'u': usn, 'op': op, 'm': modified_time}}, (journal_seq, usn)) AS last,
    arg_max({{'s': journal_seq, 'u': usn, 'op': op, 'm': modified_time}}, (journal_seq, usn)) FILTER (WHERE handled) AS done
  FROM h GROUP BY ALL
) SELECT volume_id, last.s AS journal_seq, last.u AS usn FROM f
WHERE (last.op = 0) IS DISTINCT FROM coalesce(done.op = 0, false)
  OR (last.op = 0 AND last.m IS DISTINCT FROM done.m)""",
    "p4_ledger": """SELECT DISTINCT s.volume_id, s.generation, CASE WHEN h.generation IS NOT NULL THEN 'done' ELSE 'pending' END AS state, s.last_usn AS minor, coalesce(h.journal_seq, -1) AS major
FROM index_state s LEFT JOIN db_header h ON h.volume_id = s.volume_id AND h.generation = s.generation""",
    "q_journal_gaps": """WITH done AS (
  SELECT s.volume_id, max({'j': h.journal_seq, 'u': s.last_usn}) AS r FROM index_state s JOIN db_header h ON h.volume_id = s.volume_id AND h.generation = s.generation
  WHERE h.journal_seq IS NOT NULL AND s.last_usn IS NOT NULL AND s.last_scan_time IS NOT NULL GROUP BY 1
), j AS (
  SELECT volume_id, journal_seq, min(usn) AS first_usn FROM work_items WHERE volume_id IS NOT NULL AND journal_seq IS NOT NULL AND usn IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY journal_seq DESC) = 1
), c AS (
  SELECT j.volume_id, j.journal_seq, j.first_usn, CASE WHEN done.volume_id IS NULL THEN 'never' WHEN j.journal_seq > done.r.j THEN 'new journal' WHEN j.first_usn > done.r.u THEN 'lost' END AS reason
  FROM j LEFT JOIN done USING (volume_id)
) SELECT * FROM c WHERE reason IS NOT NULL""",
}
