"""Matching, path rules and reports over the whole catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segue import standins as S
from segue.catalog.registry import query
from segue.catalog.sql import with_views
from segue.operators.match import match_report, match_tracks
from segue.options import MergeOptions

OPTIONS = MergeOptions(path_rules=S.PATH_RULES)


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return match_tracks(S.tracks_a(spark, sf), S.tracks_b(spark, sf), OPTIONS)


@query(
    "match_report",
    with_views(
        "matches",
        """SELECT 'ab' AS pair_id, rule, count(*) AS tracks FROM matches GROUP BY rule
           UNION ALL SELECT 'ab', 'added', (SELECT count(*) FROM tracks_b) - (SELECT count(*) FROM matches)""",
    ),
)
def report(spark, sf):
    """J9 + G2: which tracks are the same, by which rule, and how many are new."""
    return match_report(S.tracks_a(spark, sf), S.tracks_b(spark, sf), matched(spark, sf))


@query(
    "match_tracks",
    with_views("matches", "SELECT incoming_id, base_id, rule FROM matches"),
)
def tracks(spark, sf):
    """Every matched pair."""
    return matched(spark, sf).select("incoming_id", "base_id", "rule")
