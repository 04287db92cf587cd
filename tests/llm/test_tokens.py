import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from segue.llm.bytebpe import ByteBpe
from segue.llm.packing import best_fit_decreasing, pack_documents
from segue.llm.token_counts import Counter, count_tokens
from segue.llm.token_store import PackedIds, pack_ids, stored_documents, tokens_at, write_tokens

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PIECES = ["a", "Word", "é", "ß", "'s", "don't", "12", ",", ".", "!!", "<|endoftext|>", "日本", "İ", "🙂", "\x1c", "\n", "\t", "\0", " ", " ", "  ", "　", "Ġ", "̸"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


DOCS = [
    (5, "one two three " * 900), (1, ""), (None, "no id"), (3, None), (2, "same"), (2, "same"), (2, "other"),
    (4, " ".join(odd_texts(400))), (9, "x" * 30_000), (7, "ünïcode — text\n\nwith lines"),
]


def docs(spark, rows=None):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in (DOCS if rows is None else rows)], "doc_id long, text string, ids string, start int")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(BYTE))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_ids_equal_the_librarys(library):
    texts = odd_texts(3000)
    got = ByteBpe(BYTE).encode(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in got] == [library(t) for t in texts]


def test_counts_of_parts_add_up_to_the_librarys():
    c = Counter(WORD)
    assert c.adds_up
    texts = odd_texts(3000, 2)
    assert [sum(c.parts(t.split(" "), {"a": 1})) for t in texts] == c.whole(texts)


def test_packed_ids_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 512, 513, 5000):
        ids = rng.choice([0, 255, 256, 50_000, 65_536, 2**32 - 1], n).astype(np.uint32)
        packed = PackedIds(pack_ids(ids))
        assert len(packed) == n and packed.all().tolist() == ids.tolist()
        assert [packed[i] for i in range(0, n, 37)] == ids[::37].tolist()


def test_store_holds_every_document_in_order(spark, tmp_path, library):
    path = str(tmp_path / "store")
    write_tokens(docs(spark), path, segment_tokens=500)
    rows = stored_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 2, 3, 4, 5, 7, 9]
    texts = {i: t for i, t in DOCS if i != 2}
    start, whole = 0, []
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        if r.doc_id != 2:
            assert ids == [*library(texts[r.doc_id]), 0]
        start, whole = start + len(ids), whole + ids
    places = [0, 1, 499, 500, start - 1, start // 2]
    asked = spark.createDataFrame([(p,) for p in [*places, start, -1, None]], "position long")
    assert {r.position: r.token for r in tokens_at(spark, path, asked, cell=300).collect()} == {p: whole[p] for p in places}


def test_store_of_an_empty_table(spark, tmp_path):
    write_tokens(docs(spark, []), str(tmp_path / "none"))
    assert stored_documents(spark, str(tmp_path / "none")).collect() == []


def test_plan_is_the_one_made_piece_by_piece():
    rng = random.Random(4)
    for capacity in (10, 64):
        counts = {n: rng.randint(0, 60) for n in range(1, capacity + 1)}
        counts = {n: c for n, c in counts.items() if c}
        room, bins = [], 0  # the plain algorithm: tightest open bin, or a new one
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [r for r in room if r >= n]
                if fits:
                    room.remove(min(fits))
                    room.append(min(fits) - n)
                else:
                    room.append(capacity - n)
                    bins += 1
        used = {}
        for n, lo, hi, first, each, offset in best_fit_decreasing(counts, capacity):
            for i in range(hi - lo):
                used.setdefault(first + i // each, []).append((offset + i % each * n, n))
        assert len(used) == bins and sorted(capacity - sum(n for _, n in u) for u in used.values()) == sorted(room)
        for u in used.values():
            ends = [0, *np.cumsum([n for _, n in sorted(u)]).tolist()]
            assert [o for o, _ in sorted(u)] == ends[:-1] and ends[-1] <= capacity
        assert {n: sum(x[1] == n for u in used.values() for x in u) for n in counts} == counts


def test_packing_keeps_every_token_once(spark, library):
    rows = pack_documents(docs(spark), capacity=64, keep_ids=True).collect()
    sequences, of_doc = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length <= 64 and crc(ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        of_doc.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == [0, *np.cumsum([n for _, n in placed]).tolist()[:-1]] and sum(n for _, n in placed) <= 64
    for doc_id, text in DOCS:
        if doc_id != 2:
            pieces = sorted(of_doc[doc_id])
            assert [i for _, _, ids in pieces for i in ids] == [*library(text), 2]
            assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(len(ids) == 64 for _, _, ids in pieces[1:])
    assert len(of_doc[2]) == 3
    assert pack_documents(docs(spark, [])).collect() == []


def test_token_counts_equal_the_librarys(spark):
    t = Tokenizer.from_file(public_tokenizers.path(WORD))
    want = sorted((i or 0, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in DOCS)
    rows = count_tokens(docs(spark), limit=100, frequent=50).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert count_tokens(docs(spark, [])).collect() == []
    pieces = count_tokens(docs(spark), vocabulary="piece_bpe_32k.model").collect()
    assert len(pieces) == len(DOCS) and all(r.n_tokens > 0 for r in pieces if r.n_bytes)
