import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "do", "ki", "lu", "men", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(11)
    passage = prose(rng, 70)
    rows, labels = {}, []
    for i in range(300):
        text = prose(rng, 90)
        if i % 4 == 0:
            text = text.replace(" ", " zzgrumph ", 3)
        labels.append((i, 1, int(i % 4 == 0)))
        rows[i] = text
    rows[301], rows[302] = f"{prose(rng, 20)}\n{passage}\nthe end", f"{passage}\n{prose(rng, 20)}"
    rows[303] = rows[1]
    rows[304] = rows[2].rsplit(" ", 1)[0] + " changed"
    rows[305] = rows[306] = None
    sf = str(tmp_path)
    data = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(data, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, kept, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.dtypes == kept.dtypes
        after.write.parquet(f"{sf}/{name.replace(' ', '_')}")
        kept = spark.read.parquet(f"{sf}/{name.replace(' ', '_')}")
        left.append({r.doc_id: r for r in kept.collect()})
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & left[0].keys()) <= 2 and len(rows.keys() - toxic - left[0].keys()) <= 2
    assert passage in left[1][301].text and passage not in left[1][302].text and left[1][302].n_chars == len(left[1][302].text)
    assert 303 not in left[1]  # its one line is an exact copy
    assert left[1].keys() | {303} == left[0].keys()
    assert left[2].keys() == left[1].keys() - {304, 306}
    assert left[3].keys() < left[2].keys() and len(left[3]) >= 0.6 * len(left[2])
    assert left[4].keys() == left[3].keys()


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_other_columns_come_through_unchanged_whatever_their_names(spark, tmp_path):
    rng = random.Random(12)
    columns = f"{COLUMNS}, score string, tokens string, domain string, epoch int, predicted int, tag string, removed_lines string, class_id int, _t string, _doc int, _tag int, _gone string, _lines int, _code int, _full int, `a.b` int"
    extra = lambda i: (f"s{i}", f"t{i}", f"d{i}", i, i, f"g{i}", f"r{i}", i, f"x{i}", i, i, f"y{i}", i, i, i, i)
    rows, labels = [], []
    passage = prose(rng, 60)
    for i in range(60):
        text = prose(rng, 80).replace(" ", " zzgrumph ", 3 * (i % 4 == 0)) + (f"\n{passage}" if i % 10 == 1 else "")
        rows.append((i, text, None if i % 7 == 1 else "en", None if i % 5 == 1 else f"src{i % 5}", None if i == 2 else len(text), *extra(i)))
        labels.append((i, 1, int(i % 4 == 0)))
    sf = str(tmp_path)
    spark.createDataFrame(rows, columns).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in kept.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.dtypes == kept.dtypes, name
        after.write.parquet(f"{sf}/{name.replace(' ', '_')}")
        kept = spark.read.parquet(f"{sf}/{name.replace(' ', '_')}")
        got = kept.collect()
        assert len(got) > 25
        for r in got:
            old = before[r.doc_id]
            changed = r.text != old.text
            assert not changed or r.n_chars == len(r.text)
            assert [r[c] for c in kept.columns if c not in ("text", "n_chars")] == [old[c] for c in kept.columns if c not in ("text", "n_chars")]
            assert changed or r.n_chars == old.n_chars
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() >= len(got)
