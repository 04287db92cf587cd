import random
import zlib

import pytest
from pyspark.sql import functions as F

from segue.llm.sharding import shard_documents, write_shards

COLUMNS = "doc_id long, text string, size string, shard string, record int"


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], COLUMNS).repartition(parts)


def size(text):
    return len((text or "").encode()) + 8


def crc(text):
    return zlib.crc32((text or "").encode())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    some = [(i, "wörd " * rng.randint(0, 60)) for i in range(900)]
    some += [(7, "copy of one text")] * 500  # a third of all rows are one record
    some += [(None, None), (None, "no id"), (3, None), (11, "x" * 20_000), (12, "")]
    return some


def check(got, rows, shards):
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i is not None, i, size(t), crc(t)) for i, t in rows)
    by_shard = {}
    for r in got:
        assert 0 <= r.shard < shards and r.grown_shard is None
        by_shard.setdefault(r.shard, []).append(r)
    for some in by_shard.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in order]
    assert keys == sorted(keys)  # shards are stretches of one order
    return {s: (sum(r.size for r in some), len(some)) for s, some in by_shard.items()}


@pytest.mark.parametrize("options", [{}, {"range_rows": 20, "samples": 2}])
def test_shards_are_near_equal_in_bytes(spark, rows, options):
    got = shard_documents(documents(spark, rows), 24, "bytes", **options).collect()
    sizes = check(got, rows, 24)
    total, largest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    assert all(abs(b - total / 24) <= largest for b, _ in sizes.values())
    without = [abs(sizes.get(s, (0, 0))[0] - total / 24) for s in range(24)]
    assert sorted(without)[17] <= 400  # most shards have no very long text near their borders
    assert {r.law for r in got} == {"bytes"}


def test_shards_are_one_row_apart_at_most(spark, rows):
    got = shard_documents(documents(spark, rows), 7, "rows", range_rows=50).collect()
    counts = [n for _, n in check(got, rows, 7).values()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1


def test_partitions_of_the_input_do_not_matter(spark, rows):
    digest = lambda parts: sorted((r.shard, r.slot, r.doc_id or -1, r.size) for r in shard_documents(documents(spark, rows, parts), 24).collect())
    assert digest(1) == digest(7)


def test_few_and_no_rows(spark):
    assert shard_documents(documents(spark, []), 24).collect() == []
    check(shard_documents(documents(spark, [(1, "a")]), 24).collect(), [(1, "a")], 24)
    few = [(2, None), (2, None), (None, "b")]
    check(shard_documents(documents(spark, few), 24).collect(), few, 24)
    with pytest.raises(ValueError):
        shard_documents(documents(spark, few), 24, "hash")


def test_whole_documents_are_written_in_slot_order(spark, rows, tmp_path):
    docs = documents(spark, rows)
    write_shards(docs, f"{tmp_path}/shards", 5, range_rows=100)
    back = spark.read.parquet(f"{tmp_path}/shards")
    placed = {(r.shard, r.slot): (r.doc_id, r.size) for r in shard_documents(docs, 5, range_rows=100).collect()}
    got = {(r.shard, r.slot): (r.record.doc_id, r["size"]) for r in back.collect()}
    assert got == placed
    assert back.where(F.octet_length(F.coalesce("record.text", F.lit(""))) + 8 != F.col("size")).count() == 0
    assert back.select("record.*").columns == docs.columns
