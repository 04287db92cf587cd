import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from segue.llm import simhash
from segue.llm.catalog import QUERIES, SQL
from segue.llm.components import components
from segue.llm.languages import predict_languages
from segue.llm.line_dedup import delete_repeated_lines
from segue.llm.mixing import mix
from segue.llm.simhash import near_duplicates
from segue.llm.toxicity import score_toxicity

EXTRA = "doc_id long, text string, lang string, source string, score string, _gone int"


def docs(spark, rows):
    rows = [(i, t, *(more or ("en", "src1"))) for i, t, *more in [(r[0], r[1], *r[2:]) for r in rows]]
    return spark.createDataFrame([(*r[:4], "x", 1) for r in rows], EXTRA)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


# --- SimHash -----------------------------------------------------------------------------
def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("chunk", [256, 8])
def test_families_of_templates_are_joined_where_texts_alike_and_only_there(spark, monkeypatch, chunk):
    """Texts of one template share much, at all similarities around 0.8: every pair of 0.8 or more ends in
    one class, and a class holds nothing that no such pairs join."""
    monkeypatch.setattr(simhash, "CHUNK_TEXTS", chunk)
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for changes in (0, 1, 2, 3, 4, 6, 9):
        for _ in range(3):
            template = prose(rng, 200, vocabulary).split()
            for _ in range(25):
                copy = list(template)
                for at in rng.sample(range(200), changes):
                    copy[at] = rng.choice(vocabulary)
                rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "two words"), (len(rows) + 3, prose(rng, 70_000, vocabulary))]
    rows += [(len(rows), rows[-1][1] + " end"), (len(rows) + 1, rows[-1][1].upper())]
    sets, prints = [shingle_set(t) for _, t in rows], [plain_fingerprint(t, 5) for _, t in rows]
    near, root = [], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike or (prints[i] ^ prints[j]).bit_count() <= 2:
                near.append((i, j))
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root] if a != b else root
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows), words=5, max_bits=2, similarity=0.8).collect()}
    assert sum(got[i] == got[j] for i, j in near) >= 0.998 * len(near)
    parts = {}
    for i, c in got.items():
        parts.setdefault(c, set()).add(root[i])
    assert all(len(p) == 1 for p in parts.values())
    assert 25 < len(set(root)) < len(rows) - 100


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_components_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = prose(rng, 400, vocabulary).split()
        for j in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(j):
                copy[rng.randrange(400)] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(copy)))
    rows += [(2000, ""), (2001, None), (2002, " \t\n"), (2003, "One Two"), (2004, "one\ttwo"), (2005, "ÄÖ b c"), (2005, "ÄÖ b c"), (None, "one two"), (None, "alone here")]
    got = near_duplicates(docs(spark, rows), words=3, max_bits=2).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (doc, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    want = sorted((str(doc), f"{p:016x}", str(least[r])) for (doc, _), p, r in zip(rows, prints, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len({r for r in root}) < len(set(prints))  # some different fingerprints are linked
    assert near_duplicates(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(docs(spark, rows), max_bits=3)


def test_similar_texts_are_linked_and_others_are_not(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, same = [], {}
    shared = prose(rng, 120, vocabulary)
    for i in range(0, 200, 2):
        words = prose(rng, 300, vocabulary).split()
        rows.append((i, " ".join(words) + " " + shared))
        if i % 10 == 0:
            for at in rng.sample(range(0, 300, 12), 4):
                words[at] = "changed"
            rows.append((i + 1, " ".join(words) + " " + shared))
            same[i + 1] = i
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), similarity=0.8).collect()}
    assert got == {i: same.get(i, i) for i, _ in rows}


def test_similar_pairs_inside_a_family_of_less_similar_texts_are_linked(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    shared, rows, same = prose(rng, 400, vocabulary), [], {}
    for i in range(0, 120, 2):  # 0.75 within the family; every fifth text has a copy of 0.82
        own = prose(rng, 60, vocabulary).split()
        rows.append((i, shared + " " + " ".join(own)))
        if i % 10 == 0:
            own[4:49:5] = ["changed"] * 9
            rows.append((i + 1, shared + " " + " ".join(own)))
            same[i + 1] = i
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), similarity=0.8).collect()}
    assert got == {i: same.get(i, i) for i, _ in rows}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- lines -------------------------------------------------------------------------------
WORD = r"[^ \t\n\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def plain_dedup(rows, min_words):
    """Every maximal repeated run with an earlier copy, by comparing all places."""
    lines = []
    for d, (_, text) in enumerate(rows):
        full = [(n, x.strip(" \t\r")) for n, x in enumerate(text.split("\n")) if x.strip(" \t\r")]
        lines.append(full)
    gone = [set() for _ in rows]
    places = [(d, i) for d, full in enumerate(lines) for i in range(len(full))]
    for d, i in places:
        for e, j in places:
            if (e, j) >= (d, i):
                break
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n][1] == lines[e][j + n][1]:
                n += 1
            if sum(max(1, len(re.findall(WORD, lines[d][i + m][1]))) for m in range(n)) >= min_words:
                gone[d] |= {lines[d][i + m][0] for m in range(n)}
    return gone


def test_words_between_any_white_space_count(spark):
    text = "\t".join(f"w{i}" for i in range(30)) + " " + "\u3000".join(f"v{i}" for i in range(30))
    got = {r.doc_id: r.removed_lines for r in delete_repeated_lines(docs(spark, [(1, text), (2, text + "\nmore")])).collect()}
    assert got == {1: [], 2: [0]}


def test_repeated_runs_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [prose(rng, rng.choice([1, 2, 3, 5, 9]), "abcdefgh") for _ in range(14)]
    pool += [x.replace(" ", rng.choice(["\t", " \t ", "\x0b", "\u2003"])) for x in pool[:5]]
    rows = []
    for i in range(40):
        chosen = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        if i % 3 == 0 and rows:
            chosen += rows[rng.randrange(len(rows))][1].split("\n")
        rows.append((i, "\n".join(f" {x}\r" if rng.random() < 0.1 else x for x in chosen)))
        if rng.random() < 0.2:
            rows[-1] = (i, rows[-1][1].replace("\n", "\n\n", 1))
    for min_words in (1, 6, 12):
        got = {r.doc_id: r for r in delete_repeated_lines(docs(spark, rows), min_words).collect()}
        for (i, text), gone in zip(rows, plain_dedup(rows, min_words)):
            assert set(got[i].removed_lines) == gone, (min_words, i)
            assert got[i].text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)


def test_sql_of_repeated_lines_counts_words_alike(spark, tmp_path):
    import duckdb

    passage = [f"w{i}" for i in range(60)]
    rows = [(1, "\t".join(passage)), (2, "\t".join(passage)), (3, " ".join(passage[:49]) + "\u2003x"), (4, " ".join(passage[:49]) + "\u2003x\nend")]
    rows += [(5, "\x0b".join(passage[:40])), (6, "\x0b".join(passage[:40])), (7, None), (8, "")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark_rows = sorted(tuple(r) for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).select("doc_id", "removed", "n_removed", "text_md5").collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.sql(SQL["op7_line_dedup"]).select("doc_id, removed, n_removed, text_md5").fetchall()) == spark_rows
    assert [r[1] for r in spark_rows] == ["", "0", "", "0", "", "", "", ""]


def test_a_very_long_text_of_repeated_lines(spark):
    lines = [f"line {i % 30_000} " + "word " * 9 for i in range(60_000)]
    got = delete_repeated_lines(docs(spark, [(1, "\n".join(lines)), (2, "other")]), 50).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text == "\n".join(lines[:30_000]) and by_id[1].removed_lines == list(range(30_000, 60_000))


def test_lines_of_odd_rows(spark):
    long = " ".join(map(str, range(60)))
    rows = [(1, long), (2, long), (3, None), (4, ""), (None, long), (5, "short"), (5, "short"), (6, f"{long}\n{long}"), (7, f"x\n\n{long}\ny")]
    got = sorted(((r.doc_id or 0), r.text, r.removed_lines) for r in delete_repeated_lines(docs(spark, rows), 50).select("doc_id", "text", "removed_lines").collect() if r.text is not None)
    assert got == [(0, long, []), (1, "", [0]), (2, "", [0]), (4, "", []), (5, "short", []), (5, "short", []), (6, "", [0, 1]), (7, "x\n\ny", [2])]
    assert delete_repeated_lines(docs(spark, []), 50).collect() == []


# --- mixing ------------------------------------------------------------------------------
def test_shortages_go_to_siblings_before_ancestors(spark):
    sizes = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("a", "de", "s1"): 5, ("b", "en", "s1"): 2000}
    rows = [(i, "x", d, l, s) for i, (d, l, s) in enumerate(k for k, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame(rows, "doc_id long, text string, d string, l string, s string")
    path = {"d": F.col("d"), "l": F.col("l"), "s": F.col("s")}
    mixed = mix(table, path, {("a",): 1, ("b",): 1, ("a", "en"): 1, ("a", "de"): 1}, F.lit(1), budget=1200)
    got = {(r.d, r.l, r.s): r.n for r in mixed.groupBy("d", "l", "s").agg(F.sum("taken").alias("n")).collect()}
    # a and b get 600 each; de can give 5 of its 300, en takes 595: s1 gives 10 of its part, s2 the rest
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 585, ("a", "de", "s1"): 5, ("b", "en", "s1"): 600}


def test_epochs_repeat_whole_leaves_and_end_in_a_prefix(spark):
    rows = [(i, "x" * (i % 7), "en", "s") for i in range(100)] + [(None, "abc", None, "s"), (3, None, "en", "s"), (5, "", "en", None)]
    path = {"lang": F.col("lang"), "source": F.col("source")}
    mixed = mix(docs(spark, rows), path, {}, F.octet_length("text"), share=2.5, max_epochs=4, seed=3)
    taken = mixed.groupBy("lang", "source").agg(F.sum("taken").alias("n")).collect()
    there = sum(i % 7 for i in range(100)) + 3
    assert sum(r.n for r in taken) == int(2.5 * there)
    per_epoch = {r.epoch: (r.n, r.cut) for r in mixed.where("lang = 'en'").groupBy("epoch").agg(F.sum("taken").alias("n"), F.sum((F.col("taken") < F.col("tokens")).cast("int")).alias("cut")).collect()}
    whole = there - 3
    assert [n for e, (n, _) in sorted(per_epoch.items())][:-1] == [whole] * (len(per_epoch) - 1)
    assert all(cut == 0 for e, (n, cut) in per_epoch.items() if n == whole) and sum(c for _, c in per_epoch.values()) <= 1
    again = mix(docs(spark, rows), path, {}, F.octet_length("text"), share=2.5, max_epochs=4, seed=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))
    assert mix(docs(spark, []), path, {}, F.octet_length("text")).collect() == []


# --- models ------------------------------------------------------------------------------
def test_toxic_words_are_learned_and_held_out_texts_are_scored(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(["ba", "do", "ki", "lu", "men", "ra", "so", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    bad = ["zzgrumph", "qwykkle", "vroxxan"]
    rows, labels = [], []
    for i in range(700):
        words = prose(rng, 80, vocabulary).split()
        if i % 3 == 0:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    odd = [(900, ""), (901, None), (None, "ki lu"), (902, "word " * 50_000)]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    scored = score_toxicity(docs(spark, rows + odd), marks).collect()
    assert len(scored) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    truth = {i: t for i, _, t in labels}
    known = [r for r in scored if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in known) >= 0.97 * len(known)
    assert all(r.predicted == 0 for r in scored if r.doc_id not in truth)
    none = score_toxicity(docs(spark, rows[:5]), marks.limit(0)).collect()
    assert len(none) == 5 and all(r.predicted == 0 for r in none)
    assert score_toxicity(docs(spark, []), marks).collect() == []


def test_languages_and_mixtures(spark):
    rng = random.Random(10)
    words = {"en": ["the", "and", "with", "ing", "ought"], "fr": ["les", "eaux", "été", "dans", "quoi"], "de": ["sch", "und", "ein", "über", "nicht"]}
    rows = [(i, prose(rng, 60, words[k]), k, "s") for i, k in enumerate(["en", "fr", "de"] * 80)]
    both = prose(rng, 60, words["en"]) + " " + prose(rng, 30, words["fr"])
    rows += [(1000, both, None, "s"), (1001, "", "en", "s"), (1002, None, "fr", "s"), (1003, "12 !? 34", "de", "s"), (None, "und nicht ein", None, "s")]
    got = {r.doc_id: r for r in predict_languages(docs(spark, rows)).collect()}
    assert all(got[i].lang_pred == k and got[i].languages == [k] for i, _, k, _ in rows[:240])
    assert got[1000].languages == ["en", "fr"] and got[1000].score == pytest.approx(2 / 3, abs=0.1)
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1002].score == 0
    assert got[None].lang_pred == "de" and got[None].held_out
    assert predict_languages(docs(spark, [])).collect() == []
    unknown = predict_languages(docs(spark, [(1, "some text", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in unknown] == [("und", 0.0)]
