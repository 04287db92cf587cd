"""Readers on literal inputs; undo; written tables and documents."""

import struct
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from segue import standins as S
from segue.catalog.load import QUERIES
from segue.operators import offsets as O
from segue.operators import slots as X
from segue.operators import targets as T
from segue.operators import undo as U
from segue.operators.playlists import crate_tree, tree_paths
from segue.sinks import neutral
from segue.sources import binary as B
from segue.sources import rekordbox as R
from segue.sources.discover import find_libraries

DOC = """<?xml version="1.0" encoding="UTF-8"?>
<DJ_PLAYLISTS Version="1.0.0">
  <PRODUCT Name="any" Version="1" Company="any"/>
  <COLLECTION Entries="2">
    <TRACK TrackID="1" Name="One &amp; two" Artist="A" Year="0" TotalTime="172" AverageBpm="128.00" DateAdded="2022-04-09"
           Rating="204" Size="100" Tonality="Fm" TrackNumber="0" Colour="0xFF007F" Location="file://localhost/C:/Music/a%20b.mp3">
      <TEMPO Inizio="0.025" Bpm="128.00" Metro="4/4" Battito="1"/>
      <TEMPO Inizio="1.000" Bpm="0" Metro="4/4" Battito="2"/>
      <POSITION_MARK Name="Drop" Type="0" Start="15.025" Num="0" Red="40" Green="226" Blue="20"/>
      <POSITION_MARK Name="" Type="4" Start="30.0" End="31.5" Num="-1"/>
    </TRACK>
    <TRACK TrackID="2" Name="Solo" Location="file://localhost/x/y.wav"/>
    <TRACK TrackID="1" Name="Again" Location="file://localhost/other.mp3"/>
  </COLLECTION>
  <PLAYLISTS>
    <NODE Type="0" Name="ROOT" Count="2">
      <NODE Type="0" Name="Sets" Count="1">
        <NODE Name="Friday" Type="1" KeyType="0" Entries="3"><TRACK Key="2"/><TRACK Key="9"/><TRACK Key="1"/></NODE>
      </NODE>
      <NODE Name="By place" Type="1" KeyType="1" Entries="1"><TRACK Key="file://localhost/x/y.wav"/></NODE>
    </NODE>
  </PLAYLISTS>
</DJ_PLAYLISTS>
"""


def test_xml_document(spark, tmp_path):
    (tmp_path / "one.xml").write_text(DOC)
    lib, issues = R.read_xml(spark, str(tmp_path))
    tracks = {r.track_id: r for r in lib.tracks.collect()}
    one = tracks["rb:1"]
    assert set(tracks) == {"rb:1", "rb:2"} and issues.count() == 0
    assert (one.title, one.location, one.rating, one.year, one.track_number, one.colour) == ("One & two", "C:/Music/a b.mp3", 4, "", None, 0xFF007F)
    assert tuple(one.key) == (5, True) and str(one.date_added) == "2022-04-09" and one.file_size == 100
    cues = lib.cues.orderBy("position_ms").collect()
    assert [(r.role, r.position_ms, r.end_ms, r.slot, r.name, r.colour) for r in cues] == [
        ("cue", 15025.0, None, 0, "Drop", 0x28E214), ("loop", 30000.0, 31500.0, None, "", None),
    ]
    assert [(r.position_ms, r.bpm, r.beat) for r in lib.tempo.collect()] == [(25.0, 128.0, 1)]
    paths = {r.node_id: tuple(r.path) for r in lib.nodes.where("NOT is_folder").collect()}
    entries = [(paths[r.node_id], r.track_id) for r in lib.entries.orderBy("node_id", "position").collect()]
    assert sorted(entries) == [(("By place",), "rb:2"), (("Sets", "Friday"), "rb:1"), (("Sets", "Friday"), "rb:2")]


def test_tree_deeper_than_the_first_schema_is_read_whole(spark, tmp_path):
    deep = "".join(f'<NODE Type="0" Name="f{i}">' for i in range(6)) + "</NODE>" * 6
    (tmp_path / "deep.xml").write_text(f"<DJ_PLAYLISTS><PLAYLISTS>{deep}</PLAYLISTS></DJ_PLAYLISTS>")
    nodes, _, _ = R.read_xml_playlists(spark, str(tmp_path))
    assert [r.name for r in nodes.orderBy(F.size("path")).collect()] == [f"f{i}" for i in range(1, 6)]


def test_long_device_paths_and_issue_details_stay_whole(spark, tmp_path):
    name = "/media/stick/" + "a" * 12_000 + "/b.mp3"
    track = spark.createDataFrame([(name, name, "A", "B")], "location string, local string, artist string, album string")
    assert T.place_on_device(track, "/media/stick/").first().device_path == name.removeprefix("/media/stick")
    broken = '<TRACK TrackID="1" Name="' + "x" * 400 + '" BPM=oops></TRACK>'
    (tmp_path / "l.xml").write_text(f"<DJ_PLAYLISTS><COLLECTION>{broken}</COLLECTION></DJ_PLAYLISTS>")
    issues = R.read_xml_tracks(spark, str(tmp_path / "l.xml"))[3].collect()
    assert len(issues) == 1 and "x" * 400 in issues[0].detail


def test_database_tables(spark):
    t = lambda ddl, *rows: spark.createDataFrame([("L", *r) for r in rows], "library_id string, " + ddl)
    dims = {n: t("ID string, Name string") for n in ("djmdAlbum", "djmdGenre", "djmdLabel")}
    content = t(
        "ID string, FolderPath string, Title string, ArtistID string, AlbumID string, GenreID string, BPM int, Length int, TrackNo int, BitRate int, "
        "Commnt string, Rating int, ReleaseYear int, RemixerID string, LabelID string, KeyID string, ColorID int, DJPlayCount int, FileSize int, ComposerID string, SampleRate int, DateCreated string, rb_local_deleted int",
        ("1", "C:/Music/Demo Track 1.mp3", "Demo Track 1", "a1", None, None, 12800, 172, 3, 320, "hi", 4, 2020, None, None, "k1", 5, 7, 6899624, None, 44100, "2022-04-09", 0),
    )
    cues = t(
        "ID int, ContentID string, InMsec int, OutMsec int, Kind int, ColorTableIndex int, Comment string, rb_local_deleted int",
        (1, "1", 25, -1, 0, 0, "", 0), (2, "1", 15025, -1, 1, 3, "Drop", 0), (3, "1", 30025, -1, 5, 0, "", 0),
        (4, "1", 45025, 46900, 2, 0, "Loop", 0), (5, "1", 50000, -1, 3, 0, "gone", 1), (6, "9", 1, -1, 0, 0, "", 0),
    )
    lists = t("ID string, Seq int, Name string, Attribute int, ParentID string", ("f1", 1, "Sets", 1, "root"), ("p1", 1, "Friday", 0, "f1"), ("p2", 2, "Smart", 4, "root"), ("p3", 3, "Cloud", -128, "root"))
    lib, issues = R.read_rekordbox_tables({
        **dims, "djmdContent": content, "djmdArtist": t("ID string, Name string", ("a1", "Loopmasters")), "djmdKey": t("ID string, ScaleName string", ("k1", "Fm")),
        "djmdCue": cues, "djmdPlaylist": lists, "djmdSongPlaylist": t("PlaylistID string, ContentID string, TrackNo int", ("p1", "1", 1), ("p1", "404", 2)),
    })
    [r] = lib.tracks.collect()
    assert (r.title, r.artist, r.bpm, r.rating, r.play_count, r.colour, r.album, tuple(r.key)) == ("Demo Track 1", "Loopmasters", 128.0, 4, 7, 0x00FF00, "", (5, True))
    assert [(c.position_ms, c.slot, c.end_ms, c.name) for c in lib.cues.orderBy("position_ms").collect()] == [
        (25, None, None, ""), (15025, 0, None, "Drop"), (30025, 3, None, ""), (45025, 1, 46900, "Loop"),
    ]
    assert {tuple(n.path) for n in lib.nodes.collect()} == {("Sets",), ("Sets", "Friday")}
    assert [(e.node_id, e.position, e.track_id) for e in lib.entries.collect()] == [("p1", 1, "rbdb:1")]
    assert [(i.rule, i.entity_id) for i in issues.collect()] == [("smart list not converted", "p2")]


def test_records(spark):
    field = lambda tag, body: tag + struct.pack(">I", len(body)) + body
    inner = field(b"tsng", "é".encode("utf-16-be")) + field(b"bbgl", b"\1")
    data = field(b"vrsn", "2".encode("utf-16-be")) + field(b"otrk", inner) + field(b"otrk", b"abc") + field(b"orow", field(b"otrk", inner))
    rows = [("whole", data), ("cut", data[:-1]), ("empty", b""), ("none", None), ("many", field(b"otrk", inner) * 5000)]
    df = spark.createDataFrame(rows, "library_id string, data binary")
    got = {}
    for r in B.explode_records(df, ["library_id"], "data").collect():
        got.setdefault(r.library_id, []).append((r.top, r.seq, r.parent, r.depth, r.tag, r.error))
    whole = [(0, 0, -1, 0, "vrsn"), (1, 0, -1, 0, "otrk"), (1, 1, 0, 1, "tsng"), (1, 2, 0, 1, "bbgl"), (2, 0, -1, 0, "otrk"),  # not a list after all
             (3, 0, -1, 0, "orow"), (3, 1, 0, 1, "otrk"), (3, 2, 1, 2, "tsng"), (3, 3, 1, 2, "bbgl")]
    assert sorted(got["whole"]) == [(*r, None) for r in whole]
    at = len(data) - len(field(b"orow", field(b"otrk", inner)))
    assert sorted(got["cut"]) == [(*r, None) for r in whole[:5]] + [(3, 0, -1, 0, "", f"damaged field at byte {at}")]
    assert got.keys() == {"whole", "cut", "many"} and len(got["many"]) == 15_000 and {r[0] for r in got["many"]} == set(range(5000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows are one task
    try:
        parts = B.explode_records(df, ["library_id"], "data").where("library_id = 'many'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1  # one database's records are read in several tasks


def test_xml_playlists_of_odd_shapes(spark, tmp_path):
    deep = '<NODE Name="L" Type="1" KeyType="0" Entries="2"><TRACK Key="7"/><X><TRACK Key="no"/></X><TRACK Key="8"/></NODE>'
    for n in range(200, 0, -1):
        deep = f'<NODE Name="f{n}" Type="0" Count="1">{deep}</NODE>'
    odd = '<NODE Name="é &amp; b" Type="1" KeyType="1"><TRACK Key="file://x"/><NODE Name="inside a list" Type="0"/></NODE><NODE><TRACK Key="9"/></NODE>'
    head = '<?xml version="1.0" encoding="UTF-8"?><DJ_PLAYLISTS><COLLECTION><TRACK TrackID="1"/></COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT">'
    (tmp_path / "a.xml").write_text(f"{head}{deep}{odd}</NODE><NODE Type='0'><NODE Type='0'/></NODE></PLAYLISTS></DJ_PLAYLISTS>")
    (tmp_path / "b.xml").write_text(f"{head}<NODE Name='kept' Type='1'/><NODE")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.codegen.wholeStage",)}
    nodes, entries, issues = R.read_xml_playlists(spark, str(tmp_path))
    got = {tuple(n.path): (n.is_folder, n.seq) for n in nodes.collect()}
    chain = tuple(f"f{n}" for n in range(1, 201))
    assert got == {chain[:n]: (True, 0) for n in range(1, 201)} | {(*chain, "L"): (False, 0), ("é & b",): (False, 1), ("",): (False, 2), ("kept",): (False, 0)}
    assert sorted((e.position, e.key_type, e.key) for e in entries.collect()) == [(0, "0", "7"), (0, "0", "9"), (0, "1", "file://x"), (1, "0", "8")]
    assert [(i.rule, i.library_id.endswith("b.xml")) for i in issues.collect()] == [("unreadable playlists", True)]
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_trees_of_any_depth_and_rings(spark):
    rows = [("A", f"n{i}", f"n{i - 1}" if i else None, i % 3, f"x{i}") for i in range(500)]
    rows += [("A", "self", "self", 0, "s"), ("A", "below", "self", 0, "b"), ("B", "p", "q", 0, "p"), ("B", "q", "r", 0, "q"), ("B", "r", "p", 0, "r"), ("B", "n1", None, 0, "top")]
    rows += [("B", f"t{i}", "p" if not i else f"t{i - 1}", 0, "t") for i in range(40)] + [("B", None, "n1", 0, "no id"), ("B", "orphan", "gone", 1, "o"), (None, "x", None, 0, "x")]
    tree, issues = tree_paths(spark.createDataFrame(rows, "library_id string, node_id string, parent_id string, seq int, name string"))
    got = {(r.library_id, r.node_id): r for r in tree.collect()}
    assert got["A", "n499"].path == [f"x{i}" for i in range(500)] and got["A", "n499"].sort_key[7].id == "n7"
    assert got.keys() == {("A", f"n{i}") for i in range(500)} | {("B", "n1"), ("B", "orphan"), (None, "x")} and got["B", "orphan"].path == ["o"]
    lost = {(r.library_id, r.entity_id) for r in issues.collect()}
    assert lost == {("A", "self"), ("A", "below")} | {("B", x) for x in ("p", "q", "r", *[f"t{i}" for i in range(40)])}


def test_crates_that_repeat_their_parents_name(spark):
    names = {"A": ["B", "B%%B", "B%%B%%A"], "B": ["b", "B%%B%%B", "B%%x", "B", "C", "C%%D"], "C": ["B%%B", "B%%B%%C"]}
    rows = [(lib, crate, i + 1) for lib, crates in names.items() for i, crate in enumerate(crates)] + [("D", "B", 0), ("D", "B%%B", 4), ("D", "B%%B%%A", 0)]
    got = {}
    for r in crate_tree(spark.createDataFrame(rows, "library_id string, crate string, n_tracks bigint")).collect():
        got.setdefault(r.library_id, set()).add(("/".join(r.path), r.crate, r.n_tracks))
    assert got["A"] == {("B", None, None), ("B/B", None, None), ("B/B/B", "B", 1), ("B/B", "B%%B", 2), ("B/B/A", "B%%B%%A", 3)}
    assert got["B"] == {("b", "b", 1), ("B", None, None), ("B/B", None, None), ("B/B/B", "B%%B%%B", 2), ("B/x", "B%%x", 3), ("B/B/B", "B", 4), ("C", None, None), ("C/C", "C", 5), ("C/D", "C%%D", 6)}
    assert got["C"] == {("B", None, None), ("B/B", None, None), ("B/B/B", "B%%B", 1), ("B/B/C", "B%%B%%C", 2)}
    assert got["D"] == {("B", None, None), ("B/B", None, None), ("B/B/B", "B%%B", 4), ("B/B/A", "B%%B%%A", 0)}


def test_binary_numbers(spark):
    df = spark.createDataFrame([(bytearray.fromhex("42F6E979"), bytearray.fromhex("06300000"))], "f binary, p binary")
    r = df.select(B.float32(B.unsigned(F.col("f"), 0, 4)).alias("f"), B.packed24(B.unsigned(F.col("p"), 0, 4)).alias("p")).first()
    assert r.f == pytest.approx(123.456, abs=1e-5) and r.p == 0xCC0000


def test_found_libraries(spark):
    inv = spark.createDataFrame(
        [("/m/stick", "PIONEER/rekordbox/export.pdb"), ("/m/stick", "_Serato_/database V2"), ("/m/rb", "master.db"), ("/m/stick", ".Trashes/mixxxdb.sqlite")],
        "root string, rel_path string",
    )
    got = {(r.format, r.path, r.serato_root) for r in find_libraries(inv).collect()}
    assert got == {("rekordbox_usb", "/m/stick", None), ("serato", "/m/stick/_Serato_", "/"), ("rekordbox_db", "/m/rb/master.db", None)}


def test_offsets(spark):
    tracks = spark.createDataFrame([("L", "1", "/a.mp3"), ("L", "2", "/b.mp3"), ("L", "3", "/c.m4a"), ("L", "4", "/d.flac")], "library_id string, track_id string, location string")
    facts = spark.createDataFrame([("/a.mp3", "B", None, 44100, None, None), ("/c.m4a", None, "mp4a", 44100, 0, 44100)], "location string, header_case string, codec string, sample_rate int, priming bigint, timescale int")
    got = {r.track_id: (round(r.mixxx_ms, 3), round(r.serato_ms, 3), r.issue is None) for r in O.with_offsets(tracks, facts).collect()}
    assert got == {"1": (0, 26.122, True), "2": (26, 0, False), "3": (47.891, 0, True), "4": (0, 0, True)}


def test_upsert_undone_is_the_original(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    plan = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    image, created = U.before_image(old, plan, ["id"])
    after = old.join(plan, "id", "left_anti").unionByName(plan)
    assert sorted(map(tuple, U.revert(after, image, created, ["id"]).collect())) == [(1, "a"), (2, "b")]


def test_tables_written_and_read(spark, tmp_path):
    tracks = S.tracks_a(spark, "/root/testdata/sf0.001").drop("pair_id")
    neutral.write_tables({"tracks": tracks}, str(tmp_path))
    back = neutral.read_tables(spark, str(tmp_path), ("tracks",))["tracks"]
    assert back.count() == tracks.count() and (tmp_path / "tracks" / "library_id=A").is_dir()


def test_document_is_well_formed(spark):
    lines = QUERIES["xml_documents"](spark, "/root/testdata/sf0.001").orderBy("library_id", "section")
    lines = lines.withColumn("k", F.from_json("key", "array<struct<seq:bigint,id:string>>")).orderBy("library_id", "section", "k")
    root = ET.fromstring("\n".join(r.line for r in lines.collect()).split("\n", 1)[1])
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    tracks = root.findall("COLLECTION/TRACK")
    assert root.tag == "DJ_PLAYLISTS" and len(tracks) == n == int(root.find("COLLECTION").get("Entries"))
    assert [t.get("TrackID") for t in tracks] == [str(i) for i in range(1, n + 1)]
    lists = root.findall("PLAYLISTS/NODE/NODE")
    assert len(lists) == int(root.find("PLAYLISTS/NODE").get("Count"))
    assert all(len(x.findall("TRACK")) == int(x.get("Entries")) for x in lists)


def test_closeness_is_exact(spark):
    marks = spark.createDataFrame([("t", 10.0), ("t", 19.9)], "track_id string, position_ms double")
    df = spark.createDataFrame([("t", p) for p in (5.0, 5.1, 14.9, 15.0, 24.8, 24.9, 30.0)], "track_id string, position_ms double")
    got = {r.position_ms: r.near for r in X.close_to(df, marks, ["track_id"]).collect()}
    assert got == {5.0: False, 5.1: True, 14.9: True, 15.0: True, 24.8: True, 24.9: False, 30.0: False}


def test_xml_document_in_parts_and_in_splits(spark, tmp_path):
    """One document read whole, in small splits, and as part files in name order gives the same rows."""
    lists = "".join(f'<NODE Name="l{i} &gt;" Type="1" KeyType="0" Entries="2">\n<TRACK Key="{i}"/><X><NODE/></X><TRACK Key="{i + 1}"></TRACK></NODE>\n' for i in range(40))
    tree = f'<NODE Type="0" Name="ROOT">{lists}<NODE Name="f" Type="0"><NODE Name="g" Type="0">{lists}</NODE>{lists}</NODE></NODE><NODE Type="0"><NODE Name="second root" Type="0"/></NODE>'
    tracks = "".join(f'<TRACK TrackID="{i}" Name="t{i}"><TEMPO Inizio="0.5" Bpm="120" Battito="1"/></TRACK>\n' for i in range(45))
    text = f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- <NODE> -->\n<DJ_PLAYLISTS><COLLECTION>{tracks}</COLLECTION><PLAYLISTS>{tree}</PLAYLISTS></DJ_PLAYLISTS>'
    cuts = [0, *(text.index(x, len(text) // 2) for x in ('<NODE Name="l7', '<TRACK Key="9"', "</NODE>\n<NODE Name=\"l30")), len(text)]
    cuts = sorted({*cuts, text.index('<TRACK TrackID="20"')})
    for folder, texts in {"whole": [text], "parts": [text[a:z] for a, z in zip(cuts, cuts[1:])], "broken": [text[: cuts[3]], "<NODE Name=</NODE>", text[cuts[3] :]]}.items():
        (tmp_path / folder / "library_id=L").mkdir(parents=True)
        for i, part in enumerate(texts):
            (tmp_path / folder / "library_id=L" / f"part-{i:05}.xml").write_text(part)

    def read(folder):
        nodes, entries, issues = R.read_xml_playlists(spark, str(tmp_path / folder))
        got = [sorted(map(str, d.collect())) for d in (nodes, entries)]
        return *got, [r.rule for r in issues.collect()]

    whole = read("whole")
    assert [len(x) for x in whole] == [122, 240, 0]
    assert read("parts") == whole
    broken = read("broken")
    assert broken[2] == ["unreadable playlists"] and 0 < len(broken[0]) < 122 and set(broken[0]) < set(whole[0])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert read("whole") == whole
        order = [r.track_id for r in R.read_xml_tracks(spark, str(tmp_path / "parts"))[0].orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert order == [f"rb:{i}" for i in range(45)]


def test_commented_elements_are_no_tracks(spark, tmp_path):
    (tmp_path / "library_id=L").mkdir()
    (tmp_path / "library_id=L" / "a.xml").write_text('<DJ_PLAYLISTS><COLLECTION><!-- <TRACK TrackID="9" Name="no"/> --><TRACK TrackID="1" Name="a > b /"/></COLLECTION></DJ_PLAYLISTS>')
    (tmp_path / "library_id=M").mkdir()
    (tmp_path / "library_id=M" / "b.xml").write_text('<DJ_PLAYLISTS><COLLECTION><TRACK TrackID="2" Name="x/>y"/><TRACK TrackID="3"></TRACK></COLLECTION></DJ_PLAYLISTS>')
    tracks = R.read_xml_tracks(spark, str(tmp_path))[0]
    assert sorted((r.library_id, r.track_id, r.title) for r in tracks.collect()) == [("L", "rb:1", "a > b /"), ("M", "rb:2", "x/>y"), ("M", "rb:3", "")]


def test_lines_of_written_documents_are_not_kept(spark, tmp_path):
    import glob

    from segue.session import shared_folder
    from segue.sinks import rekordbox_xml

    kept = f"{shared_folder(spark).removeprefix('file:')}/segue/xml-lines-*"
    before = set(glob.glob(kept))
    key = "array<struct<seq:bigint,id:string>>"
    lines = spark.createDataFrame([("A", 0, [(0, "")], "<a>"), ("A", 1, [], "</a>")], f"library_id string, section int, key {key}, line string")
    rekordbox_xml.write_documents(lines, f"{tmp_path}/out")
    assert "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/out/library_id=A/*.txt"))) == "<a>\n</a>\n"
    assert set(glob.glob(kept)) == before
