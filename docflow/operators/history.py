"""The newest items of each owner."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.strings import run_sql

NEWEST = 50


def ranked(history: DataFrame) -> DataFrame:
    return run_sql("SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts_ms DESC, id) AS nth FROM {h}", h=history)


def newest_history(history: DataFrame, n: int = NEWEST) -> DataFrame:
    """The newest ``n`` of each owner; the rank filter is planned as a group limit before the shuffle."""
    return ranked(history).where(f"nth <= {n}").drop("nth")


def evicted(history: DataFrame, n: int = NEWEST) -> DataFrame:
    """Items beyond the newest ``n``, for clean-up."""
    return ranked(history).where(f"nth > {n}").drop("nth")


def apply_changes(history: DataFrame, changes: DataFrame, n: int = NEWEST) -> DataFrame:
    """``history (owner, id, text, image_uri, ts_ms)`` after ``changes (owner, seq, op, id, text, image_uri, ts_ms)``.

    ``insert``, ``update`` (the text of a known, non-blank id), ``delete`` and ``clear`` by sequence; the newest ``n`` stay.  Only what comes after an owner's
    last clear counts; of an id, the last insert or delete decides whether it is there, and updates after its insert its text.
    """
    return newest_history(
        run_sql(
            """
            WITH c AS (SELECT c.*, cleared FROM {changes} c LEFT JOIN (SELECT owner, max(seq) AS cleared FROM {changes} WHERE op = 'clear' GROUP BY owner) x ON c.owner = x.owner),
            a AS (SELECT owner, id, text, image_uri, ts_ms, -1L AS seq, 'insert' AS op FROM {history} h LEFT ANTI JOIN (SELECT DISTINCT owner FROM {changes} WHERE op = 'clear') x USING (owner)
                  UNION ALL SELECT owner, id, text, image_uri, ts_ms, seq, op FROM c WHERE op <> 'clear' AND trim(coalesce(id, '')) <> '' AND (cleared IS NULL OR seq > cleared)),
            b AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY owner, id) AS gone FROM a),
            k AS (SELECT *, min(CASE WHEN op = 'insert' THEN seq END) OVER (PARTITION BY owner, id) AS born FROM b WHERE gone IS NULL OR seq > gone),
            t AS (SELECT owner, id, max_by(text, seq) FILTER (WHERE text IS NOT NULL AND seq >= born) AS text, max_by(struct(image_uri, ts_ms), seq) FILTER (WHERE op = 'insert') AS made FROM k GROUP BY owner, id)
            SELECT owner, id, text, made.image_uri AS image_uri, made.ts_ms AS ts_ms FROM t WHERE made IS NOT NULL
            """,
            history=history, changes=changes,
        ),
        n,
    )
