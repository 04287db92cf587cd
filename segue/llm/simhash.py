"""Near duplicates by SimHash, linked through the anchors of a covering code.

A fingerprint has 64 bits; bit i is the majority of bit i over the hashes of all word shingles. Its
first 61 bits are three words of perfect codes: two of the binary Golay code (23 bits, covering radius
3) and one of the Hamming code (15 bits, covering radius 1). The code words of all three together are
the anchors. Two fingerprints that differ in up to two bits have a word between them that differs
from each in one bit at most, and that word has an anchor within the covering radius. So each
fingerprint is sent to every anchor within the covering radius plus half the threshold: its own, and
those one bit further off in one of the three words (1 + 5 + 5 + 7 at most). Both meet at an anchor,
where they are compared. No link is lost, and none is made without comparing all 64 bits.

Equal fingerprints are one node. At an anchor, links that join what is already joined there are not
sent on, so a group of n copies yields n - 1 links there. Anchors are many (2 ** 35), and what
meets at one is the different fingerprints within a few bits of each other.

Defined results: NULL text is the empty text, whose fingerprint is zero and linked like any other;
texts with fewer words than a shingle are one shingle; repeated rows are kept, and a NULL doc_id is
no component id unless its component has nothing else; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.components import components
from segue.llm.shared import lean, strings, text_slices
from segue.session import discard, materialise

SEED, TOGETHER, VIEWS, SAMPLE = 42, 1 << 16, 24, 6
CHUNK_TEXTS, CHUNK_SHINGLES = 256, 1 << 19
_MIX, _ODD = np.random.default_rng(SEED).integers(1, 1 << 32, (2, VIEWS * SAMPLE, 1), dtype=np.uint32)
_ODD |= np.uint32(1)
_OF_VIEW = np.random.default_rng(SEED + 1).integers(1, 1 << 63, SAMPLE, dtype=np.uint64) | np.uint64(1)


def word_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of ``words`` words, in order and with repeats, some at a time."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    for at in range(0, n, TOGETHER):
        some = zip(first[at : at + TOGETHER], last[at : at + TOGETHER])
        yield np.array([xxh64_intdigest(joined[a:z], SEED) for a, z in some], dtype=np.uint64)


def fingerprint(text: str, words: int, sketched: bool = False) -> tuple[int, int, np.ndarray]:
    """The SimHash of all shingles, their number, and (if ``sketched``) the least values of
    ``VIEWS * SAMPLE`` orders of them."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    least = np.full(VIEWS * SAMPLE if sketched else 0, np.iinfo(np.uint32).max, dtype=np.uint32)
    for hashes in word_hashes(text, words):
        ones, n = ones + _bits(hashes).sum(axis=0, dtype=np.int64), n + len(hashes)
        upper = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(upper) if sketched else 0, TOGETHER // 16):
            order = (upper[None, at : at + TOGETHER // 16] ^ _MIX) * _ODD
            order ^= order >> np.uint32(15)
            order *= _ODD[::-1]
            least = np.minimum(least, order.min(axis=1))
    majority = np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0]
    return int(majority), n, least if n else least[:0]


def views(least: np.ndarray) -> list[int]:
    """A number for each ``SAMPLE`` least values; equal for texts that agree in all of them."""
    mixed = (least.reshape(-1, SAMPLE).astype(np.uint64) * _OF_VIEW).sum(axis=1, dtype=np.uint64)
    return (mixed ^ mixed >> np.uint64(31)).view(np.int64).tolist()


def agreement(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of each of ``others`` (rows), the part of its least values that equals ``sketch``'s: an estimate of
    the Jaccard similarity."""
    return (others == sketch).mean(axis=1)


def least_agreement(similarity: float) -> float:
    """What texts of that similarity agree in but for 3 of 100,000 pairs: four standard deviations less."""
    return similarity - 4 * (similarity * (1 - similarity) / (VIEWS * SAMPLE)) ** 0.5


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class PerfectCode:
    """A perfect cyclic code: from a word to its code word, and to those one step beyond its radius."""

    def __init__(self, bits: int, radius: int, generator: int):
        degree = generator.bit_length() - 1
        self.bits, self.mask = bits, (1 << bits) - 1
        remainders = []
        for i in range(bits):
            r = 1 << i
            while r.bit_length() > degree:
                r ^= generator << (r.bit_length() - degree - 1)
            remainders.append(r)
        of_bits = lambda some: np.bitwise_xor.reduce([remainders[i] for i in some]) if some else 0
        errors = lambda size: [(int(of_bits(e)), sum(1 << i for i in e)) for e in itertools.combinations(range(bits), size)]
        self.leader = np.zeros(1 << degree, dtype=np.int64)
        for size in range(radius + 1):
            for syndrome, error in errors(size):
                self.leader[syndrome] = error
        beyond: dict[int, list[int]] = {}
        for syndrome, error in errors(radius + 1):
            beyond.setdefault(syndrome, []).append(error)
        self.beyond = np.full((1 << degree, max(map(len, beyond.values()))), -1, dtype=np.int64)
        for syndrome, found in beyond.items():
            self.beyond[syndrome, : len(found)] = found
        tables = []
        for low in range(0, bits, 8):
            part = np.zeros(256, dtype=np.int64)
            for value in range(256):
                part[value] = of_bits([low + i for i in range(8) if value >> i & 1 and low + i < bits])
            tables.append(part)
        self.tables = tables

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        for i, part in enumerate(self.tables):
            out ^= part[words >> (8 * i) & 255]
        return out

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's own code word, and (-1: none) those at its radius plus one."""
        s = self.syndromes(words)
        further = self.beyond[s]
        return words ^ self.leader[s], np.where(further < 0, -1, words[:, None] ^ further)


# Bits, covering radius and generator polynomial of the binary Golay and Hamming codes.
CODES = ((23, 3, 0b110001110101), (23, 3, 0b110001110101), (15, 1, 0b10011))
_codes: list[PerfectCode] = []


def anchors(fingerprints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, place of the fingerprint) for every anchor a fingerprint is sent to."""
    if not _codes:
        _codes.extend(PerfectCode(*c) for c in CODES)
    shift, own, further = 0, np.zeros(len(fingerprints), dtype=np.int64), []
    for code in _codes:
        word, beyond = code.near(fingerprints >> shift & code.mask)
        own |= word << shift
        further.append((shift, word, beyond))
        shift += code.bits
    place = np.arange(len(fingerprints))
    keys, places = [own], [place]
    for shift, word, beyond in further if max_bits else ():
        at, column = np.nonzero(beyond >= 0)
        keys.append(own[at] ^ (word[at] ^ beyond[at, column]) << shift)
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the absolute value's bits


def local_links(group: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what is linked among different fingerprints, none between what already is."""
    label, links = np.arange(len(group)), []
    for i in range(len(group) - 1):
        near = i + 1 + np.flatnonzero(distance(group[i + 1 :], group[i]) <= max_bits)
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                links.append((int(group[i]), int(group[j])))
                label[label == label[j]] = label[i]
    return links


def fingerprint_links(fingerprints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links that join all of ``fp`` (different longs) that differ in up to ``max_bits`` bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the anchors cover thresholds up to 2 bits")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp"), dtype=np.int64)
            keys, places = anchors(fps, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[places])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(key)) + 1
            start, stop = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            pair = start[stop - start == 2]
            pair = pair[distance(fp[pair], fp[pair + 1]) <= max_bits]
            large = [local_links(fp[a:z], max_bits) for a, z in zip(start.tolist(), stop.tolist()) if z - a > 2]
            more = np.array([x for found in large for x in found], dtype=np.int64).reshape(-1, 2)
            return rows(np.concatenate((fp[pair], more[:, 0])), np.concatenate((fp[pair + 1], more[:, 1])))

        for batch in batches:
            key = np.concatenate((key, np.asarray(batch.column("anchor"), dtype=np.int64)))
            fp = np.concatenate((fp, np.asarray(batch.column("fp"), dtype=np.int64)))
            if len(key) and key[0] != key[-1]:
                done = int(np.searchsorted(key, key[-1]))  # the last anchor's rows may go on in the next batch
                yield links(key[:done], fp[:done])
                key, fp = key[done:], fp[done:]
        if len(key):
            yield links(key, fp)

    sent = fingerprints.select("fp").mapInArrow(lean(send), "anchor long, fp long")
    return sent.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(lean(compare), "a long, b long").distinct()


def fingerprints(docs: DataFrame, words: int, sketched: bool = False) -> DataFrame:
    """(doc_id, tag, fp) of every document, ``tag`` a hash of its text; if ``sketched``, also the number of its
    shingles, a byte of each least value, and the number of each view."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = (part.to_pylist() for _, part in text_slices(strings(batch.column("text"))))
            made = [fingerprint(t, words, sketched) for part in parts for t in part]
            columns = [batch.column("doc_id"), batch.column("tag"), pa.array([x[0] for x in made], pa.int64())]
            if sketched:
                columns += [pa.array([x[1] for x in made], pa.int64()), pa.array([x[2].astype(np.uint8).tobytes() for x in made], pa.binary())]
                columns += [pa.array([views(x[2]) for x in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, tag long, fp long" + ", n long, sketch binary, views array<long>" * sketched
    names = [part.split()[0] for part in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text")
    return rows.mapInArrow(lean(count), schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by ``keys``, each whole, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [np.asarray(batch.column(k), dtype=np.int64) for k in keys]
        changed = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _sketches(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, VIEWS * SAMPLE)


def _candidates(group: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a group that may be similar: in the group's two chunks, of different classes, whose
    least values agree enough, and that share no earlier view (there they are candidates already)."""
    sketches, view = _sketches(group), group.column("view")[0].as_py()
    own, label = (np.asarray(group.column(c), dtype=np.int64) for c in ("own", "class"))
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    for i in np.flatnonzero(own == low).tolist():
        others = np.flatnonzero(own == high)
        others = others[(others > i) if low == high else slice(None)]
        others = others[label[others] != label[i]]
        others = others[agreement(sketches[i], sketches[others]) >= least]
        shared = (sketches[others] == sketches[i]).reshape(len(others), VIEWS, SAMPLE).all(axis=2)
        others = others[~shared[:, :view].any(axis=1)]
        if len(others):
            yield i, others


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def similar_texts(docs: DataFrame, found: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """(fp, root): components of fingerprints over ``links`` and over texts whose sets of shingles have a
    Jaccard similarity of ``similarity`` or more.

    The least values of ``VIEWS * SAMPLE`` orders of its shingles are a text's sketch; texts that agree in
    all ``SAMPLE`` values of one of the ``VIEWS`` meet in that view's bucket. At 0.8 a pair does so with
    probability 0.9993, at 0.5 with 0.31. Pairs whose sketches then agree too little for the similarity go
    no further; all others are compared, by their whole sets, unless one class holds them already.

    First every text is compared with the first of its buckets, which joins a group of n copies by n - 1
    comparisons. Buckets that still hold several classes are cut into chunks, and each pair of chunks is a
    task's group: it gets the sketches, then the sets of those texts that have a candidate there, once
    each, and gives links that join what is not joined there yet, so no table of pairs is written.
    """
    bucket, least = ["view", "sample"], least_agreement(similarity)
    texts = found.groupBy("tag").agg(F.min(F.struct("doc_id", "fp", "n", "sketch", "views")).alias("x")).select("tag", "x.*")
    roots = components(links)
    label = roots.select(F.col("node").alias("fp"), F.col("root").alias("class"))
    texts = texts.join(label, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    texts = materialise(texts, "texts")
    samples = texts.select("tag", "class", F.posexplode("views").alias("view", "sample"))
    several = samples.groupBy(*bucket).agg(F.min("class").alias("_lo"), F.max("class").alias("_hi"), F.min("tag").alias("first")).where("_lo < _hi")
    members = materialise(samples.join(several.select(*bucket, "first"), bucket).select(*bucket, "tag", "first"), "members")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = (part.to_pylist() for _, part in text_slices(strings(batch.column("text"))))
            sets = [np.unique(np.concatenate([np.empty(0, np.uint64), *word_hashes(t, words)])) for part in parts for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("tag"), pa.array([x.tobytes() for x in sets], pa.binary())], ["tag", "hashes"])

    used = members.select("tag").distinct().join(texts.select("tag", "doc_id"), "tag")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    same = whole.doc_id.eqNullSafe(used.doc_id) & (whole.tag == used.tag)
    sets = whole.join(used, same).select(used.tag, "text").dropDuplicates(["tag"]).mapInArrow(lean(shingles), "tag long, hashes binary")
    sets = materialise(sets, "shingles")

    # every text with the first of each of its buckets
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, VIEWS * SAMPLE) for c in ("a_sketch", "b_sketch"))
            kept = pa.array((a == b).mean(axis=1) >= least, pa.bool_())
            yield batch.select(["first", "tag", "a_class", "b_class"]).filter(kept)

    side = lambda p, key: texts.select(F.col("tag").alias(key), F.col("class").alias(f"{p}_class"), F.col("sketch").alias(f"{p}_sketch"))
    stars = members.where("tag <> first").select("first", "tag").distinct().join(side("a", "first"), "first").join(side("b", "tag"), "tag")
    stars = stars.where("a_class <> b_class").select("first", "tag", "a_class", "b_class", "a_sketch", "b_sketch")
    stars = materialise(stars.mapInArrow(lean(agree), "first long, tag long, a_class long, b_class long"), "stars")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, x, keep = None, None, []
            for i, tag in enumerate(batch.column("first").to_pylist()):
                if tag != first:
                    first, x = tag, np.frombuffer(batch.column("x")[i].as_buffer(), dtype=np.uint64)
                keep.append(_jaccard(x, np.frombuffer(batch.column("y")[i].as_buffer(), dtype=np.uint64)) >= similarity)
            yield batch.select(["a_class", "b_class"]).rename_columns(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = stars.join(sets.withColumnRenamed("hashes", "y"), "tag").join(sets.select(F.col("tag").alias("first"), F.col("hashes").alias("x")), "first")
    star_links = materialise(met.select("first", "a_class", "b_class", "x", "y").mapInArrow(lean(alike), "a long, b long"), "star-links")
    above = components(star_links)  # of classes

    # all that a bucket still holds in several classes
    after = above.select(F.col("node").alias("class"), "root")
    now = texts.select("tag", "class", "n", "sketch").join(after, "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root")
    now = materialise(now.join(members.select("tag").distinct(), "tag", "left_semi"), "classes")
    labelled = members.select(*bucket, "tag").join(now.select("tag", "class", "n"), "tag")
    left = labelled.groupBy(*bucket).agg(F.min("class").alias("_lo"), F.max("class").alias("_hi"), F.count("*").alias("_n"), F.sum("n").alias("_s")).where("_lo < _hi")
    chunks = F.greatest(F.ceil(F.col("_n") / CHUNK_TEXTS), F.ceil(F.col("_s") / CHUNK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("tag"), F.col("chunks")).cast("int")
    rows = labelled.select(*bucket, "tag").join(left.select(*bucket, chunks.alias("chunks")), bucket).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(*bucket, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "tag")
    group = [*bucket, "low", "high"]

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _groups(batches, group):
            some = some.combine_chunks()
            found = [x for i, others in _candidates(some, least) for x in (i, *others.tolist())]
            if found:
                yield from some.take(pa.array(np.unique(found))).to_batches()

    slim = "view int, sample long, low int, high int, own int, tag long, class long, sketch binary"
    stream = rows.join(now.drop("n"), "tag").select(*group, "own", "tag", "class", "sketch")
    close = stream.repartition(*group).sortWithinPartitions(*group, "tag").mapInArrow(lean(promising), slim)
    close = materialise(close, "candidates")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _groups(batches, group):
            some = some.combine_chunks()
            label, links = np.asarray(some.column("class"), dtype=np.int64).copy(), []
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in some.column("hashes")]
            for i, others in _candidates(some, least):
                for j in others.tolist():
                    if label[i] != label[j] and _jaccard(sets[i], sets[j]) >= similarity:
                        links.append((int(label[i]), int(label[j])))
                        label[label == label[j]] = label[i]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    stream = close.join(sets, "tag").select(*group, "own", "tag", "class", "sketch", "hashes")
    chunk_links = stream.repartition(*group).sortWithinPartitions(*group, "tag").mapInArrow(lean(joined), "a long, b long")
    top = components(materialise(chunk_links, "chunk-links"))
    step = lambda t, old, new: t.select(F.col("node").alias(old), F.col("root").alias(new))
    out = texts.select("fp", "class").distinct().join(step(above, "class", "c1"), "class", "left").withColumn("c1", F.coalesce("c1", "class"))
    out = out.join(step(top, "c1", "c2"), "c1", "left").select("fp", F.coalesce("c2", "c1").alias("root"))
    out = materialise(out, "roots")
    discard(texts, members, sets, stars, star_links, now, close)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, max_bits: int = 2, similarity: float | None = None) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hexadecimal digits), component_id (the least
    doc_id reachable over links), class_id (equal within a component), tag (a hash of the text).

    With ``similarity``, texts that alike are linked too: SimHash alone sees a pair of Jaccard similarity
    0.8 some ten bits apart, beyond what any code of few anchors covers.
    """
    found = materialise(fingerprints(docs, words, similarity is not None), "fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    links = fingerprint_links(nodes, max_bits)
    if similarity is None:
        roots = components(links).withColumnRenamed("node", "fp")
    else:
        roots = similar_texts(docs, found, links, words, similarity)
    linked = nodes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "root", "component_id")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("class_id"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", "class_id", "tag")
