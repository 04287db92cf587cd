"""Signal summaries over event values, decoder offsets and audio facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue import standins as S
from segue.catalog.registry import query
from segue.catalog.scalars import milli, paths, sql_milli
from segue.catalog.sql import view, with_views
from segue.operators import offsets as O
from segue.operators import signal as G
from segue.plans.ordered import ranked

c = F.col
RATE = 375  # two and a half frames per column, so column borders need rounding to even


def samples(spark, sf):
    e = S.table(spark, sf, "events").select(
        c("user_id").cast("string").alias("track_id"),
        F.unix_micros(c("ts").cast("timestamp")).alias("us"),
        (c("value") / 500 * F.when(c("event_id") % 3 == 0, -1).otherwise(1)).alias("full"),
        (c("event_id") % 4).alias("q"),
    )
    r = ranked(e, ["track_id"], "us", "rank")
    full = c("full")
    return r.select(
        "track_id", (c("rank") - 1).alias("frame"), "full", (full * c("q") * 0.25).alias("white"),
        (full * 0.5).alias("low"), F.when(c("q") == 0, 0.0).otherwise(full * 0.25).alias("mid"),
        (full * c("q") * 0.125).alias("high"),
    )


view(
    "samples",
    """SELECT track_id, r - 1 AS frame, f AS full_, f * q * 0.25 AS white, f * 0.5 AS low, CASE WHEN q = 0 THEN 0.0 ELSE f * 0.25 END AS mid, f * q * 0.125 AS high
       FROM (SELECT CAST(user_id AS VARCHAR) AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r,
         value / 500 * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS f, event_id % 4 AS q FROM events)""",
)
view(
    "scols",
    f"""SELECT track_id, col, coalesce(peak, 0) AS peak, coalesce(white, 0) AS white, coalesce(low, 0) AS low, coalesce(mid, 0) AS mid,
         coalesce(high, 0) AS high, coalesce(sumsq, 0) AS sumsq, samples FROM (
       SELECT b.track_id, b.col, max(abs(full_)) AS peak, max(abs(s.white)) AS white, max(abs(s.low)) AS low, max(abs(s.mid)) AS mid,
         max(abs(s.high)) AS high, sum(full_ * full_) AS sumsq, count(s.frame) AS samples
       FROM (SELECT track_id, frames, unnest(range(0, greatest(1, ceil(frames * 150 / {RATE}.0))::BIGINT)) AS col FROM
              (SELECT track_id, count(*) AS frames FROM samples GROUP BY 1)) b
       LEFT JOIN samples s ON s.track_id = b.track_id AND s.frame >= round_even(col * {RATE} / 150.0::DOUBLE, 0) AND s.frame < round_even((col + 1) * {RATE} / 150.0::DOUBLE, 0)
       GROUP BY 1, 2)""",
    "samples",
)
view(
    "senv",
    """SELECT track_id, col, peak, white, low, mid, high, sumsq, samples, low AS e0, mid AS e1, high AS e2 FROM scols WHERE col = 0
       UNION ALL
       SELECT s.track_id, s.col, s.peak, s.white, s.low, s.mid, s.high, s.sumsq, s.samples, greatest(s.low, e0 * 0.97), greatest(s.mid, e1 * 0.93), greatest(s.high, e2 * 0.9)
       FROM senv e JOIN scols s ON s.track_id = e.track_id AND s.col = e.col + 1""",
    "scols",
)


def _gain(j: int) -> str:
    return f"""CASE WHEN max(e{j}) OVER w > 0 THEN least({G.GAIN_CAP[j]}, greatest({G.GAIN_FLOOR[j]}, round_even({G.GAIN_TARGET[j]}::DOUBLE / max(e{j}) OVER w, 0))) ELSE {G.GAIN_FLOOR[j]} END"""


view(
    "sdetail",
    f"""SELECT *, least(127, round_even(1.25::DOUBLE * g0 * e0, 0))::INT AS s0, least(127, round_even(1.15::DOUBLE * g1 * e1, 0))::INT AS s1, least(127, round_even(0.6::DOUBLE * g2 * e2, 0))::INT AS s2 FROM (
       SELECT *, CASE WHEN max(peak) OVER w > 0 THEN least(31, floor(31.5::DOUBLE * (peak / max(peak) OVER w) * (peak / max(peak) OVER w))) ELSE 0 END::INT AS height,
         CASE WHEN peak <= 0 THEN 7 ELSE 7 - least(7, floor(8 * least(1.0, greatest(0.0, white / peak)))) END::INT AS whiteness,
         {_gain(0)}::INT AS g0, {_gain(1)}::INT AS g1, {_gain(2)}::INT AS g2, greatest(low, mid, high) AS strongest, count(*) OVER w AS n
       FROM senv WINDOW w AS (PARTITION BY track_id))""",
    "senv",
)


def details(spark, sf):
    return G.detail(G.signal_columns(samples(spark, sf), RATE))


def _micro(x):
    return F.rint(x * 1_000_000).cast("bigint")


def _sql_micro(x):
    return f"round_even(({x}) * 1000000, 0)::BIGINT"


def _steps(x):
    """Millionths, with the cut away from exact halves: decay is computed in logarithms."""
    return F.floor(x * 1_000_000 + 0.2713).cast("bigint")


def _sql_steps(x):
    return f"floor(({x}) * 1000000 + 0.2713::DOUBLE)::BIGINT"


@query(
    "signal_columns",
    with_views(
        "scols",
        f"SELECT track_id, col, {_sql_micro('peak')} AS peak, {_sql_micro('white')} AS white, {_sql_micro('low')} AS low, {_sql_micro('mid')} AS mid, {_sql_micro('high')} AS high, {sql_milli('sumsq')} AS sumsq, samples FROM scols",
    ),
)
def signal_columns(spark, sf):
    """W1."""
    q = G.signal_columns(samples(spark, sf), RATE)
    return q.select(
        "track_id", "col", *[_micro(c(n)).alias(n) for n in ("peak", "white", "low", "mid", "high")],
        milli(c("sumsq")).alias("sumsq"), "samples",
    )


@query(
    "signal_heights",
    with_views(
        "sdetail",
        """SELECT track_id, col, height, whiteness, whiteness * 32 + height AS packed,
             height * 4 + 8192 * l0 + 1024 * l1 + 128 * l2 AS relative FROM (SELECT *,
               CASE WHEN strongest <= 0 THEN 0 ELSE least(7, round_even(7 * sqrt(low / strongest), 0))::INT END AS l0,
               CASE WHEN strongest <= 0 THEN 0 ELSE least(7, round_even(7 * sqrt(mid / strongest), 0))::INT END AS l1,
               CASE WHEN strongest <= 0 THEN 0 ELSE least(7, round_even(7 * sqrt(high / strongest), 0))::INT END AS l2 FROM sdetail)""",
    ),
)
def signal_heights(spark, sf):
    """W2, W5."""
    return details(spark, sf).select("track_id", "col", "height", "whiteness", "packed", "relative")


@query(
    "signal_envelopes",
    with_views(
        "senv",
        f"SELECT track_id, col, {_sql_steps('e0')} AS low, {_sql_steps('e1')} AS mid, {_sql_steps('e2')} AS high FROM senv",
    ),
)
def signal_envelopes(spark, sf):
    """W3."""
    return details(spark, sf).select(
        "track_id", "col", *[_steps(c(f"env_{b}")).alias(b) for b in G.BANDS]
    )


@query(
    "signal_bands",
    with_views("sdetail", "SELECT track_id, col, s0 AS low, s1 AS mid, s2 AS high, g0 AS gain_low, g1 AS gain_mid, g2 AS gain_high FROM sdetail"),
)
def signal_bands(spark, sf):
    """W4."""
    return details(spark, sf).select(
        "track_id", "col", *[c(f"scaled_{b}").alias(b) for b in G.BANDS], *[f"gain_{b}" for b in G.BANDS]
    )


def _ranges(parts: int) -> str:
    """Buckets per track by their defining bounds."""
    return f"""SELECT track_id, k, least(k * n // {parts}, n - 1) AS a, least(greatest((k + 1) * n // {parts}, least(k * n // {parts}, n - 1) + 1), n) AS z
      FROM (SELECT track_id, n, unnest(range(0, {parts})) AS k FROM (SELECT track_id, max(n) AS n FROM sdetail GROUP BY 1))"""


_IN = "sdetail d ON d.track_id = r.track_id AND d.col >= r.a AND d.col < r.z GROUP BY 1, 2"


@query(
    "signal_preview",
    with_views(
        "sdetail",
        """SELECT track_id, k AS bucket, least(7, w)::INT * 32 + CASE WHEN top > 0 THEN least(31, round_even(24 * rms / top, 0))::INT ELSE 0 END AS packed
           FROM (SELECT *, max(rms) OVER (PARTITION BY track_id) AS top FROM p400) JOIN p200 USING (track_id) WHERE p200.h = k // 2""",
        f"""r400 AS ({_ranges(400)}), r200 AS ({_ranges(200)}),
        p400 AS (SELECT r.track_id, r.k, CASE WHEN sum(samples) > 0 THEN sqrt(sum(sumsq) / sum(samples)) ELSE 0 END AS rms FROM r400 r JOIN {_IN}),
        p200 AS (SELECT r.track_id, r.k AS h, round_even(sum(whiteness) / count(*), 0) AS w FROM r200 r JOIN {_IN})""",
    ),
)
def signal_preview(spark, sf):
    """W6, 400 columns."""
    return G.preview(details(spark, sf))


@query(
    "signal_tiny_preview",
    with_views(
        "sdetail",
        "SELECT track_id, k AS bucket, CASE WHEN top > 0 THEN least(15, round_even(15 * sqrt(rms / top), 0))::INT ELSE 0 END AS level FROM (SELECT *, max(rms) OVER (PARTITION BY track_id) AS top FROM p100)",
        f"""r100 AS ({_ranges(100)}),
        p100 AS (SELECT r.track_id, r.k, CASE WHEN sum(samples) > 0 THEN sqrt(sum(sumsq) / sum(samples)) ELSE 0 END AS rms FROM r100 r JOIN {_IN})""",
    ),
)
def signal_tiny_preview(spark, sf):
    """W6, 100 columns."""
    return G.tiny_preview(details(spark, sf))


_BANDED = f"""r1200 AS ({_ranges(1200)}),
        p1200 AS (SELECT r.track_id, r.k, least(127, round_even(0.56::DOUBLE * sum(s0) / count(*), 0))::INT AS low, least(127, round_even(0.71::DOUBLE * sum(s1) / count(*), 0))::INT AS mid,
          least(127, round_even(2.0::DOUBLE * sum(s2) / count(*), 0))::INT AS high FROM r1200 r JOIN {_IN})"""


@query(
    "signal_band_preview",
    with_views("sdetail", "SELECT track_id, k AS bucket, low, mid, high FROM p1200", _BANDED),
)
def signal_band_preview(spark, sf):
    """W6, 1200 columns of three bands."""
    return G.band_preview(details(spark, sf))


@query(
    "signal_colour_preview",
    with_views(
        "sdetail",
        """SELECT track_id, bucket, b0, CASE WHEN m > 0 THEN least(255, greatest(0, round_even(203 - 0.49::DOUBLE * b0, 0)))::INT ELSE 0 END AS b1, b2, b3, b4, b5 FROM (
          SELECT *, CASE WHEN m > 0 THEN least(127, round_even(0.88::DOUBLE * m + 38, 0))::INT ELSE 0 END AS b0,
            CASE WHEN m > 0 THEN least(127, round_even(0.91::DOUBLE * sqrt(b3 * b3 + b4 * b4 + b5 * b5), 0))::INT ELSE 0 END AS b2 FROM (
            SELECT *, greatest(b3, b4, b5) AS m FROM (
              SELECT track_id, k AS bucket, least(127, round_even(2.4::DOUBLE * low, 0))::INT AS b3, least(127, round_even(1.6::DOUBLE * mid, 0))::INT AS b4, least(127, round_even(1.1::DOUBLE * high, 0))::INT AS b5 FROM p1200)))""",
        _BANDED,
    ),
)
def signal_colour_preview(spark, sf):
    """W6, the colour preview."""
    return G.colour_preview(G.band_preview(details(spark, sf)))


@query(
    "flat_signal",
    """SELECT track_id, col, 140 AS packed, 28208 AS relative, 40 AS scaled_low, 40 AS scaled_mid, 40 AS scaled_high FROM (
         SELECT 'a:' || p_partkey AS track_id, unnest(range(0, greatest(1, ceil(p_size / 10.0 * 150))::BIGINT)) AS col FROM part)""",
)
def flat_signal(spark, sf):
    """W7."""
    t = S.tracks_a(spark, sf).select("track_id", (c("duration_s") / 10).alias("duration_s"))
    return G.flat_detail(t)


# --- audio facts -----------------------------------------------------------------------------
def audio_tracks(spark, sf):
    ext = (
        F.when(c("n") % 4 == 0, ".mp3").when(c("n") % 4 == 1, ".m4a").when(c("n") % 4 == 2, ".flac")
        .otherwise(".MP3")
    )
    return paths(spark, sf).select(
        F.lit("A").alias("library_id"), c("n").cast("string").alias("track_id"), "n", "p_size",
        F.concat(F.lit("/m/"), "title", F.lit(" "), c("n").cast("string"), ext).alias("location"),
        (c("n") % 3 * 22050).cast("int").alias("sample_rate"), (c("p_size") * 10).alias("bitrate"),
        c("p_size").cast("double").alias("duration_s"), F.lit(None).cast("int").alias("colour"),
        F.lit(False).alias("bpm_locked"),
    )


def audio_facts(spark, sf):
    """Facts for tracks longer than five seconds; the others' files were not found."""
    t = audio_tracks(spark, sf).where("p_size > 5")
    m = c("n") % 7
    case = (
        F.when(m == 0, "A").when(m == 1, "B").when(m == 2, "C").when(m == 3, "D")
        .when(m == 4, "unreadable")
    )
    return t.select(
        "location", case.alias("header_case"), F.when(c("n") % 5 == 0, "alac").otherwise("mp4a").alias("codec"),
        F.when(m == 5, 0).otherwise(48000).alias("sample_rate"), F.when(m < 3, 0).otherwise(1024).alias("priming"),
        F.lit(44100).alias("timescale"), (c("p_size") + 0.5).alias("duration_s"),
        F.when(m == 6, 0).otherwise(320).alias("bitrate"),
    )


view(
    "audio_tracks",
    """SELECT n, n::VARCHAR AS track_id, p_size, '/m/' || title || ' ' || n || CASE n % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.m4a' WHEN 2 THEN '.flac' ELSE '.MP3' END AS location,
        CASE n % 4 WHEN 1 THEN 'm4a' WHEN 2 THEN 'flac' ELSE 'mp3' END AS ext, n % 3 * 22050 AS sample_rate, p_size * 10 AS bitrate, p_size::DOUBLE AS duration_s FROM paths""",
    "paths",
)
view(
    "audio_facts",
    """SELECT n AS fn, CASE n % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'unreadable' END AS hc,
         CASE WHEN n % 5 = 0 THEN 'alac' ELSE 'mp4a' END AS codec, CASE WHEN n % 7 = 5 THEN 0 ELSE 48000 END AS rate, CASE WHEN n % 7 < 3 THEN 0 ELSE 1024 END AS priming,
         p_size + 0.5 AS secs, CASE WHEN n % 7 = 6 THEN 0 ELSE 320 END AS kbps FROM audio_tracks WHERE p_size > 5""",
    "audio_tracks",
)
_CASES = {
    d: "CASE hc " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.MP3_OFFSETS[d].items()) + " ELSE 0 END"
    for d in O.MP3_OFFSETS
}


@query(
    "decoder_offsets",
    with_views(
        "audio_tracks audio_facts",
        " UNION ALL ".join(
            f"""SELECT track_id, '{d}' AS decoder,
              {sql_milli(f'''CASE WHEN ext = 'm4a' THEN CASE WHEN fn IS NULL OR coalesce(hc, '') = 'unreadable' THEN 48.0
                  ELSE CASE WHEN priming = 0 THEN CASE WHEN codec = 'mp4a' THEN 2112 ELSE 0 END ELSE priming END * 1000.0 / 44100 END
                WHEN ext = 'mp3' THEN CASE WHEN fn IS NULL THEN {O.MP3_OFFSETS[d].get('D', 0)} ELSE {_CASES[d]} END ELSE 0.0 END''')} AS mixxx,
              {sql_milli("CASE WHEN ext = 'mp3' AND hc IN ('B', 'C') AND rate > 0 THEN 1152000.0 / rate ELSE 0.0 END")} AS serato,
              ext <> 'flac' AND (fn IS NULL OR coalesce(hc, '') = 'unreadable') AS reported
            FROM audio_tracks LEFT JOIN audio_facts ON fn = n"""
            for d in O.MP3_OFFSETS
        ),
    ),
)
def decoder_offsets(spark, sf):
    """T1, T2, T3 for each decoder."""
    out = None
    for d in O.MP3_OFFSETS:
        rows = O.with_offsets(audio_tracks(spark, sf), audio_facts(spark, sf), d).select(
            "track_id", F.lit(d).alias("decoder"), milli(c("mixxx_ms")).alias("mixxx"),
            milli(c("serato_ms")).alias("serato"), c("issue").isNotNull().alias("reported"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "measured_audio",
    with_views(
        "audio_tracks audio_facts",
        """SELECT track_id, coalesce(secs, duration_s)::DOUBLE AS duration_s, coalesce(nullif(kbps, 0), bitrate) AS bitrate,
             coalesce(nullif(rate, 0), nullif(sample_rate, 0), 44100) AS sample_rate,
             coalesce(nullif(rate, 0), nullif(sample_rate, 0)) IS NULL AS rate_unknown, fn IS NOT NULL AS found
           FROM audio_tracks LEFT JOIN audio_facts ON fn = n""",
    ),
)
def measured_audio(spark, sf):
    """J17."""
    out = O.measured_or_stated(audio_tracks(spark, sf), audio_facts(spark, sf))
    return out.select("track_id", "duration_s", "bitrate", "sample_rate", "rate_unknown", "found")


@query(
    "tagged_tracks",
    with_views(
        "audio_tracks audio_facts",
        """SELECT track_id, CASE WHEN fn IS NULL THEN n % 2 = 0 WHEN hc IS NULL THEN n % 2 = 0 ELSE hc = 'A' END AS bpm_locked,
             CASE WHEN n % 3 = 0 THEN 5 WHEN fn IS NOT NULL THEN priming END AS colour, fn IS NOT NULL AS tagged
           FROM audio_tracks LEFT JOIN audio_facts ON fn = n""",
    ),
)
def tagged_tracks(spark, sf):
    """Header cases stand in for the tag's lock, priming for its colour."""
    tags = audio_facts(spark, sf).select(
        "location", (c("header_case") == "A").alias("locked"), c("priming").alias("colour")
    )
    t = audio_tracks(spark, sf).withColumn("bpm_locked", c("n") % 2 == 0).withColumn(
        "colour", F.when(c("n") % 3 == 0, 5)
    )
    return O.with_tags(t, tags).select("track_id", "bpm_locked", "colour", "tagged")


@query(
    "tagged_cues",
    with_views(
        "audio_tracks audio_facts cues_a cues_b",
        f"""SELECT track_id, ordinal, source, {sql_milli('position_ms')} AS at, {sql_milli('end_ms')} AS end_at FROM (
             SELECT n::VARCHAR AS track_id, ordinal, 'row' AS source, position_ms, end_ms FROM cues_a
               JOIN audio_tracks ON cues_a.track_id = 'a:' || n WHERE n NOT IN (SELECT fn FROM audio_facts)
             UNION ALL SELECT fn::VARCHAR, ordinal, 'tag', position_ms - ms, end_ms - ms FROM cues_b
               JOIN (SELECT fn, CASE WHEN fn % 2 = 0 THEN 26.0 ELSE 0.0 END AS ms FROM audio_facts) ON track_id = 'b:' || fn)""",
    ),
)
def tagged_cues(spark, sf):
    """Odd suppliers' lines are the catalogue's cues, even ones' those in the tags."""
    tags = audio_facts(spark, sf).select("location", F.lit(True).alias("locked"), F.lit(None).cast("int").alias("colour"))
    tagged = O.with_tags(audio_tracks(spark, sf), tags).where("tagged").withColumn(
        "serato_ms", F.when(c("n") % 2 == 0, 26.0)
    )

    def side(name: str, source: str):
        return S.cues(spark, sf, name).select(
            F.lit("A").alias("library_id"), F.substring("track_id", 3, 20).alias("track_id"), "ordinal", F.lit(source).alias("source"),
            "position_ms", "end_ms",
        )

    out = O.tags_replace(side("a", "row"), side("b", "tag"), tagged, ["position_ms", "end_ms"])
    return out.select("track_id", "ordinal", "source", milli(c("position_ms")).alias("at"), milli(c("end_ms")).alias("end_at"))
