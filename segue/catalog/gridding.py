"""Grid operators over every track's markers, and over event times as irregular beats."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue import standins as S
from segue.catalog.registry import query
from segue.catalog.scalars import milli, sql_milli
from segue.catalog.sql import view, with_views
from segue.operators import grids as G

c = F.col
T = ["track_id"]
END = "(p_size * 1000.0 + 60000.0)"

view(
    "grid_a",
    f"""SELECT t.*, {END}::DOUBLE AS end_ms, lead(position_ms) OVER w AS nxt, row_number() OVER w AS r
        FROM tempo_b t JOIN part ON track_id = 'b:' || p_partkey WINDOW w AS (PARTITION BY track_id ORDER BY position_ms)""",
    "tempo_b",
)
view(
    "beats_a",
    """SELECT track_id, start + k * len AS position_ms, ((b0 + k) % 4 + 1)::INT AS beat, bpm FROM (
         SELECT *, unnest(range(0, greatest(0, ceil((coalesce(nxt - len / 2, end_ms) - start) / len))::BIGINT)) AS k FROM (
           SELECT *, position_ms - back * len AS start, (((beat - 1 - back) % 4) + 4) % 4 AS b0 FROM (
             SELECT *, 60000.0 / bpm AS len, CASE WHEN r = 1 AND position_ms >= 0 THEN floor(position_ms / (60000.0 / bpm))::BIGINT ELSE 0 END AS back FROM grid_a)))""",
    "grid_a",
)
view(
    "device_beats",
    """SELECT track_id, ((b0 + k) % 4 + 1)::INT AS beat, round_even(bpm * 100, 0)::INT AS tempo,
         round_even(start + k * len, 0)::BIGINT AS ms FROM (
         SELECT *, unnest(range(0, CASE WHEN nxt IS NOT NULL THEN greatest(1, round_even((nxt - start) / len, 0)::BIGINT)
             ELSE greatest(0, ceil((end_ms - start) / len)::BIGINT) END)) AS k FROM (
           SELECT *, position_ms - back * len AS start, (((beat - 1 - back) % 4) + 4) % 4 AS b0 FROM (
             SELECT *, 60000.0 / bpm AS len, CASE WHEN r = 1 THEN floor(position_ms / (60000.0 / bpm))::BIGINT ELSE 0 END AS back FROM grid_a)))""",
    "grid_a",
)


def _ended(spark, sf):
    part = S.table(spark, sf, "part").select(
        F.concat(F.lit("b:"), c("p_partkey").cast("string")).alias("track_id"),
        (c("p_size") * 1000.0 + 60000.0).alias("end_ms"),
    )
    return S.tempo(spark, sf, "b").join(part, "track_id").select(
        "track_id", "position_ms", "bpm", "beat", "end_ms"
    )


_SIMPLE = """l1 AS (SELECT track_id, list({'p': position_ms, 't': bpm, 'b': beat} ORDER BY position_ms, bpm) AS l FROM
        (SELECT track_id, position_ms, bpm, beat FROM tempo_a UNION ALL SELECT track_id, position_ms, bpm, beat FROM beats_a) GROUP BY 1),
    gwalk AS (SELECT track_id, l, 2 AS k, l[1] AS last, true AS keep FROM l1
      UNION ALL
      SELECT track_id, l, k + 1, CASE WHEN hit THEN last ELSE l[k] END, NOT hit FROM (
        SELECT *, abs(bt - round_even(bt, 0)) * (60000.0 / last.t) <= 2.0 AND abs(l[k].t - last.t) <= 0.01
          AND l[k].b = (((last.b - 1 + round_even(bt, 0)::BIGINT) % 4) + 4) % 4 + 1 AS hit FROM (
          SELECT *, (l[k].p - last.p) / (60000.0 / last.t) AS bt FROM gwalk WHERE k <= len(l))))"""


@query(
    "simplified_grids",
    with_views(
        "tempo_a beats_a",
        f"SELECT track_id, {sql_milli('last.p')} AS at, {sql_milli('last.t')} AS bpm, last.b AS beat FROM gwalk WHERE keep",
        _SIMPLE,
    ),
)
def simplified_grids(spark, sf):
    """F1 over sparse grids and over one marker per beat."""
    per_beat = G.expand(_ended(spark, sf), T, "end_ms")
    own = S.tempo(spark, sf, "a").select("track_id", "position_ms", "bpm", "beat")
    out = G.simplify(own.unionByName(per_beat), T)
    return out.select("track_id", milli(c("position_ms")).alias("at"), milli(c("bpm")).alias("bpm"), "beat")


@query(
    "expanded_beats",
    with_views("beats_a", f"SELECT track_id, {sql_milli('position_ms')} AS at, beat FROM beats_a"),
)
def expanded_beats(spark, sf):
    """F2."""
    return G.expand(_ended(spark, sf), T, "end_ms").select(
        "track_id", milli(c("position_ms")).alias("at"), "beat"
    )


@query("device_beats", with_views("device_beats", "SELECT track_id, beat, tempo, ms FROM device_beats"))
def device_beats(spark, sf):
    """F3."""
    return G.expand_for_device(_ended(spark, sf), T, "end_ms")


def _section_walk(source: str, key: str) -> str:
    return f"""l1 AS ({source}),
    swalk AS (SELECT {key}, l, 1 AS i, 1 AS j, false AS done FROM l1 WHERE len(l) >= 2
      UNION ALL
      SELECT {key}, l, CASE WHEN done THEN j ELSE i END,
        CASE WHEN done THEN j + 1 WHEN grow THEN j + 1 ELSE j END,
        CASE WHEN done THEN false WHEN grow THEN false ELSE true END
      FROM (SELECT *, j < len(l) AND (j = i OR abs((l[j + 1] - l[j]) - (l[i + 1] - l[i])) <= 2.0) AS grow
            FROM swalk WHERE NOT (done AND j >= len(l)))
      WHERE NOT (done AND j >= len(l)))"""


_SECTIONS = f"""SELECT {{key}}, {sql_milli('l[i]')} AS at, {sql_milli('60000.0 * (j - i) / (l[j] - l[i])')} AS bpm,
      ((i - 1) % 4 + 1)::INT AS beat FROM swalk WHERE done"""


@query(
    "tempo_sections",
    with_views(
        "beats_a", _SECTIONS.format(key="track_id"),
        _section_walk("SELECT track_id, list(position_ms ORDER BY position_ms) AS l FROM beats_a GROUP BY 1", "track_id"),
    ),
)
def tempo_sections(spark, sf):
    """expanded grids segmented again."""
    out = G.sections(G.expand(_ended(spark, sf), T, "end_ms"), T)
    return out.select("track_id", milli(c("position_ms")).alias("at"), milli(c("bpm")).alias("bpm"), "beat")


_EVENT_MS = "epoch_us(ts) / 1000.0"


@query(
    "event_tempo_sections",
    "WITH RECURSIVE " + _section_walk(
        "SELECT user_id, list(round_even((epoch_us(ts) - 1704067200000000) / 1000.0, 0) ORDER BY ts) AS l FROM events GROUP BY 1", "user_id"
    ) + _SECTIONS.format(key="user_id").replace("SELECT", " SELECT", 1),
)
def event_tempo_sections(spark, sf):
    """F4 on irregular times."""
    ms = F.rint((F.unix_micros(c("ts").cast("timestamp")) - 1704067200000000) / F.lit(1000.0))
    e = S.table(spark, sf, "events").select("user_id", ms.alias("position_ms"))
    out = G.sections(e, ["user_id"])
    return out.select("user_id", milli(c("position_ms")).alias("at"), milli(c("bpm")).alias("bpm"), "beat")


@query(
    "compressed_beats",
    with_views(
        "device_beats",
        f"SELECT track_id, {sql_milli('last.p')} AS at, {sql_milli('last.t')} AS bpm, last.b AS beat FROM pwalk WHERE keep",
        """l1 AS (SELECT track_id, list({'p': ms::DOUBLE, 't': tempo / 100.0::DOUBLE, 'b': beat} ORDER BY ms, tempo, beat) AS l FROM device_beats GROUP BY 1),
      pwalk AS (SELECT track_id, l, 2 AS k, l[1] AS last, 0 AS since, true AS keep FROM l1
        UNION ALL
        SELECT track_id, l, k + 1, CASE WHEN hit THEN last ELSE l[k] END, CASE WHEN hit THEN since + 1 ELSE 0 END, NOT hit FROM (
          SELECT *, abs(last.t - l[k].t) < 0.001 AND abs(l[k].p - (last.p + (since + 1) * 60000.0 / last.t)) <= 2.0 AS hit
          FROM pwalk WHERE k <= len(l)))""",
    ),
)
def compressed_beats(spark, sf):
    """device beats back to tempo markers."""
    beats = G.expand_for_device(_ended(spark, sf), T, "end_ms")
    beats = beats.withColumn("i", c("ms") * 1_000_000 + c("tempo") * 10 + c("beat"))
    out = G.compress(beats, T, "i")
    return out.select("track_id", milli(c("position_ms")).alias("at"), milli(c("bpm")).alias("bpm"), "beat")


_SERATO_SQL = f"""moved AS (SELECT track_id, position_ms - 25 AS position_ms, bpm, (beat + p_size) % 4 + 1 AS beat
        FROM tempo_b JOIN part ON track_id = 'b:' || p_partkey),
    g1 AS (SELECT track_id, bpm, position_ms, row_number() OVER w AS r,
        CASE WHEN row_number() OVER w > 1 THEN position_ms WHEN d < 0 THEN d + 4 * (60000.0 / bpm) ELSE d END AS px
      FROM (SELECT *, position_ms - ((beat - 1) % 4) * (60000.0 / bpm) AS d FROM moved)
      WINDOW w AS (PARTITION BY track_id ORDER BY position_ms)),
    g2 AS (SELECT * FROM (SELECT *, max(px) OVER (PARTITION BY track_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g1)
      WHERE top IS NULL OR px > top),
    serato AS (SELECT track_id, px / 1000.0 AS position_s, CASE WHEN n IS NULL THEN bpm END AS bpm,
        CASE WHEN n IS NOT NULL THEN greatest(1, round_even((n - px) * bpm / 60000.0, 0)::INT) END AS beats_to_next
      FROM (SELECT *, lead(px) OVER (PARTITION BY track_id ORDER BY px) AS n FROM g2))"""


def _serato(spark, sf):
    part = S.table(spark, sf, "part").select(
        F.concat(F.lit("b:"), c("p_partkey").cast("string")).alias("track_id"), "p_size"
    )
    moved = S.tempo(spark, sf, "b").join(part, "track_id").select(
        "track_id", (c("position_ms") - 25).alias("position_ms"), "bpm",
        ((c("beat") + c("p_size")) % 4 + 1).alias("beat"),
    )
    return G.to_serato(moved, T)


@query(
    "serato_grids",
    with_views(
        "tempo_b",
        f"SELECT track_id, {sql_milli('position_s')} AS at, {sql_milli('bpm')} AS bpm, beats_to_next FROM serato",
        _SERATO_SQL,
    ),
)
def serato_grids(spark, sf):
    """F7."""
    return _serato(spark, sf).select(
        "track_id", milli(c("position_s")).alias("at"), milli(c("bpm")).alias("bpm"), "beats_to_next"
    )


@query(
    "tempo_from_serato_grids",
    with_views(
        "tempo_b",
        f"""SELECT track_id, {sql_milli('p')} AS at, {sql_milli('coalesce(bpm, beats_to_next * 60000.0 / (n - p))')} AS bpm FROM (
          SELECT *, position_s * 1000.0 AS p, lead(position_s) OVER (PARTITION BY track_id ORDER BY position_s) * 1000.0 AS n FROM serato)
          WHERE bpm IS NOT NULL OR n > p""",
        _SERATO_SQL,
    ),
)
def tempo_from_serato_grids(spark, sf):
    """F6."""
    g = _serato(spark, sf).withColumn("i", F.rint(c("position_s") * 1_000_000).cast("bigint"))
    return G.from_serato(g, T).select(
        "track_id", milli(c("position_ms")).alias("at"), milli(c("bpm")).alias("bpm")
    )
