"""Scalar functions on literal cases."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from segue.functions import colours as K
from segue.functions import grid as G
from segue.functions import keys as KEY
from segue.functions import locations as L
from segue.functions import numbers as N
from segue.functions import text as T
from segue.operators.rewrite import apply_rule_table, apply_rules, infer_mounts, parse_rule_lines
from segue.sinks.rekordbox_xml import attributes


def column(spark, values, kind, expr):
    """Values through an expression, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_key_texts(spark):
    cases = {
        "8A": (9, True), "8B": (0, False), "12A": (1, True), "01B": (11, False), "1m": (9, True),
        "1d": (0, False), "Am": (9, True), "F#min": (6, True), "Bb": (10, False), "Ebm": (3, True),
        "C#": (1, False), "A minor": (9, True), "13A": None, "0m": None, "H": None, "": None,
        "AM": (9, False), "B♭ Major": (10, False), "Cb": (11, False),
    }
    got = column(spark, list(cases), "string", KEY.parse_key)
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_keys_round_trip(spark):
    for notation in ("camelot", "open_key", "musical"):
        same = lambda i: KEY.parse_key(KEY.format_key(KEY.key_from_chromatic_id(i), notation))  # noqa: B023, E731
        assert column(spark, range(1, 25), "int", lambda i: KEY.chromatic_id(same(i))) == list(range(1, 25))
    assert column(spark, [22], "int", lambda i: KEY.format_key(KEY.key_from_chromatic_id(i), "open_key")) == ["1m"]


def test_first_downbeat(spark):
    df = spark.sql("SELECT * FROM VALUES (2250D, 120D, 3), (100D, 120D, 2) AS t(p, b, n)")
    got = [r[0] for r in df.select(G.first_downbeat_ms(F.col("p"), F.col("b"), F.col("n"))).collect()]
    assert got == pytest.approx([1250, 1600])


def test_numbers(spark):
    assert column(spark, ["44100", "44.1", "44.1k", "48.0 kHz", ""], "string", N.sample_rate) == [44100, 44100, 44100, 48000, 0]
    assert column(spark, ["3:20", "1:02:03.5", "75", "x"], "string", N.clock_seconds) == [200, 3723.5, 75, 0]
    assert column(spark, ["12.9", "-3.2", "12d", "", "abc"], "string", N.lenient_int) == [12, -3, 0, 0, 0]
    assert column(spark, [1.5, 0.0, -0.0, 100.0, 12.3456], "double", T.number_text) == ["1.5", "0", "0", "100", "12.346"]
    assert column(spark, [255, 128, 0], "int", N.stars_from_255) == [5, 3, 0]


def test_file_names(spark):
    paths = ["/a/b/c.tar.MP3", "C:\\x\\y.wav", "\\\\nas\\s\\z", "C:plain.flac", "/a/we\\ird.ogg", "noext", "/a/.hidden", "/a/b/"]
    assert column(spark, paths, "string", T.file_name) == ["c.tar.MP3", "y.wav", "z", "plain.flac", "we\\ird.ogg", "noext", ".hidden", "b"]
    assert column(spark, paths, "string", T.extension) == ["mp3", "wav", "", "flac", "ogg", "", "hidden", ""]


def test_locations(spark):
    pairs = {
        "file://localhost/C:/Music/a%20b.mp3": "C:/Music/a b.mp3", "file:///Users/x/%C3%A9+1.mp3": "/Users/x/é+1.mp3",
        "/plain/50%.mp3": "/plain/50%.mp3",
    }
    assert column(spark, list(pairs), "string", L.location_to_path) == list(pairs.values())
    back = {"C:\\Music\\a b.mp3": "file://localhost/C:/Music/a%20b.mp3", "/x/é~*+(1).mp3": "file://localhost/x/%C3%A9~%2A%2B%281%29.mp3", "\\\\nas\\m\\x": "file://nas/m/x"}
    assert column(spark, list(back), "string", L.path_to_location) == list(back.values())


def test_analysis_folder(spark):
    got = column(spark, ["/Contents/XamarA/UnknownAlbum/Unreal.mp3", ""], "string", L.analysis_folder)
    assert got == ["/PIONEER/USBANLZ/P060/00012938", "/PIONEER/USBANLZ/P000/00000000"]


def test_root_relative(spark):
    cases = [("/Users/me/Music/a.mp3", "/", "Users/me/Music/a.mp3"), ("C:\\Users\\me\\a.mp3", "/", "Users/me/a.mp3"), ("/Volumes/USB/Music/a.mp3", "/Volumes/USB", "Music/a.mp3")]
    df = spark.createDataFrame(cases, "p string, r string, want string")
    assert all(r[0] == r[1] for r in df.select(L.to_root_relative(F.col("p"), F.col("r")), "want").collect())
    back = spark.createDataFrame([("Music/a.mp3", "/Volumes/USB", "/Volumes/USB/Music/a.mp3"), ("Users/me/a.mp3", "C:/", "C:/Users/me/a.mp3"), ("a", "/", "/a")], "p string, r string, want string")
    assert all(r[0] == r[1] for r in back.select(L.from_root_relative(F.col("p"), F.col("r")), "want").collect())


def test_rules(spark):
    text = "/home/me/Music => /Users/me/Music\nD:\\DJ => /Volumes/USB/DJ\n => /nothing\nno arrow"
    rules = parse_rule_lines(spark.createDataFrame([("r", text)], "rule_set string, text string"), "text", ["rule_set"])
    listed = [(r.old, r.new) for r in rules.orderBy("ordinal").collect()]
    assert listed == [("/home/me/Music", "/Users/me/Music"), ("D:\\DJ", "/Volumes/USB/DJ")]
    paths = {
        "/home/me/Music/a/b.mp3": "/Users/me/Music/a/b.mp3", "D:\\DJ\\x.mp3": "/Volumes/USB/DJ/x.mp3",
        "/other/x\\y.mp3": "/other/x\\y.mp3", "/home/me/Musicals/a": "/home/me/Musicals/a", "/HOME/me/music": "/Users/me/Music",
    }
    assert column(spark, list(paths), "string", lambda p: apply_rules(p, listed)) == list(paths.values())
    rows = spark.createDataFrame([("r", i, p) for i, p in enumerate(paths)], "rule_set string, i int, p string")
    for limit in (100, 0):  # broadcast and shuffled
        out = apply_rule_table(rows, rules, ["i"], "p", "q", limit)
        assert [r.q for r in out.orderBy("i").collect()] == list(paths.values())
    assert column(spark, ["/Users/me/Music/x.mp3"], "string", lambda p: apply_rules(p, [("/Users/me", "C:\\Users\\me")])) == ["C:\\Users\\me\\Music\\x.mp3"]


def test_mounts(spark):
    missing = spark.createDataFrame(
        [("l", 0, "C:/users/dj/Music/house/a.mp3"), ("l", 1, "C:\\users\\dj\\Music\\house\\b.mp3"), ("l", 2, "gone.mp3")],
        "library_id string, ordinal bigint, location string",
    )
    inventory = spark.createDataFrame([("/home/me/Music", 1, "house/a.mp3"), ("/home/me/Music", 1, "house/b.mp3")], "root string, root_order int, rel_path string")
    assert [(r.prefix, r.root, r.votes) for r in infer_mounts(missing, inventory).collect()] == [("C:/users/dj/Music", "/home/me/Music", 2)]


def test_colours(spark):
    assert column(spark, [0xFF0000, 0x00FE00, None, -1], "int", K.rekordbox_track_colour) == [0xFF0000, 0x00FF00, None, None]
    shown = column(spark, list(K.SERATO_TRACK), "int", lambda x: K.serato_track_shown(K.serato_track_stored(x)))
    assert shown == list(K.SERATO_TRACK)
    assert column(spark, [0xCC0000, 0xFFFFFF, 0x123456], "int", K.serato_cue_shown) == [0xC02626, None, 0x123456]


def test_fat_safe(spark):
    df = spark.createDataFrame([("a/b?c. ",), ("...",), ("e\u0301 x",)], "x string")
    assert [r.x for r in T.with_fat_safe(df, {"x": 80}).collect()] == ["a_b_c", "Unknown", "é x"]


def test_number_text_equals_the_formatter(spark):
    values = [None, 0.0, -0.0, 0.0005, -0.0004, 1.005, 12.3455, -12.5, 1e15, 1e17, float("nan"), float("inf"), 999999999999.999, *[k / 1000 for k in range(-2500, 2500, 7)]]
    for places in (2, 3):
        text = [("null" if v is None else "NaN" if v != v else "Infinity" if v > 1e300 else None) or f"{Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):f}" for v in values]
        want = [(t[:places] if t == "null" else t if "." not in t else t.rstrip("0").rstrip(".")) for t in text]
        assert column(spark, values, "double", lambda v: T.number_text(v, places)) == ["0" if t in ("", "-0") else t for t in want]


def test_document_texts_are_escaped_and_numbers_written(spark):
    texts = [(f"T{i}", F.lit(t)) for i, t in enumerate(["a&b", "", '<">', "\t\r\n"])]
    for some in (texts, texts[:2]):
        shown = attributes(*some, ("N", F.lit(7)), ("Z", F.lit(None).cast("int")), plain=("N", "Z"))
        kept = attributes(*some, keep_empty=True)
        got = spark.range(1).select(shown.alias("a"), kept.alias("b")).first()
        ends = ' T2="&lt;&quot;&gt;" T3="&#09;&#13;&#10;"' if some is texts else ""
        assert got.a == f' T0="a&amp;b"{ends} N="7"' and got.b == f' T0="a&amp;b" T1=""{ends}'


def test_rare_formatting_is_no_part_of_generated_code(spark):
    """Written out, the formatter and its patterns make methods the JVM does not compile."""
    plan = spark.range(1).select(T.number_text(F.col("id") / 7))._jdf.queryExecution().executedPlan().toString()
    assert "transform(" in plan and "*(1) Project" not in plan
