"""Toxicity by compression distance: windows of a text against two zstandard dictionaries.

The dictionaries come from a bounded sample of labelled documents. Both hold the ordinary text's most frequent words; the toxic one goes on with the words that toxic
text uses significantly more often, counted by their different neighbours so that copies of one
document do not count again. A window of ``WINDOW_WORDS`` words then compresses to the same length
with either, but for what only the toxic dictionary knows. A logistic function of a text's window
margins is fitted on the sample, with its threshold at 0.5; each half of the sample is measured with
dictionaries made from the other.

Bounds of the sample: ``rows`` documents of each label, ``sample_bytes`` bytes in all. Everything
else covers all rows and whole texts.

Defined results: NULL and empty texts are scored as a text of one empty window; a document with
several labels counts as toxic if one says so; labels of unknown documents and NULL labels teach
nothing; repeated rows are scored each; a NULL doc_id is held out; without both kinds of labels every
score is the share of toxic labels (0 without any); other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segue.llm.shared import held_out, lean, strings, text_slices

WINDOW_WORDS, ROWS, SAMPLE_BYTES = 12, 6000, 64 << 20
ORDINARY_WORDS, MIN_CONTEXTS, MIN_RATIO, MIN_Z, MIN_MATCH = 8000, 4, 15.0, 3.0, 6
PAD = b"\n" * 16  # the library does not index a dictionary's last bytes
MARKS = b".,!?;:\"'()[]{}*%#&$-"  # stripped from words before they are counted
MODEL = "ordinary binary, toxic binary, weights array<double>"


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    parts = text.lower().encode("utf-8", "replace").split()
    return [b" ".join(parts[i : i + words]) for i in range(0, len(parts), words)] or [b""]


def _contexts(texts: list[str]) -> Counter:
    """For each word, in how many different (word before, word after) it stands."""
    number: dict[bytes, int] = {b"": 0}
    runs = []
    for text in texts:
        words = (w.strip(MARKS) for w in text.lower().encode("utf-8", "replace").split())
        runs.append(np.fromiter((0, *(number.setdefault(w, len(number)) for w in words), 0), dtype=np.int32))
    if not runs:
        return Counter()
    places = np.concatenate(runs)
    word, before, after = places[1:-1], places[:-2].astype(np.int64), places[2:]
    around = before << 32 | after
    order = np.lexsort((around, word))
    word, around = word[order], around[order]
    new = np.ones(len(word), dtype=bool)
    new[1:] = (word[1:] != word[:-1]) | (around[1:] != around[:-1])
    counts = np.bincount(word[new], minlength=len(number))
    counts[0] = 0
    return Counter({w: int(counts[i]) for w, i in number.items() if counts[i]})


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Dictionary contents for ordinary and for toxic text; the best content is last, where it is
    cheapest to refer to."""
    bad, good = _contexts(toxic), _contexts(ordinary)
    n_bad, n_good = max(1, sum(bad.values())), max(1, sum(good.values()))
    frequent = sorted(((n, w) for w, n in good.items()), reverse=True)[:ORDINARY_WORDS]

    def z(word: bytes) -> float:
        a, b = bad[word] + 0.5, good[word] + 0.5
        ratio = a / n_bad * n_good / b
        return math.log(ratio) / math.sqrt(1 / a + 1 / b) if ratio > MIN_RATIO else 0.0

    telling = sorted((z(w), w) for w, n in bad.items() if n >= MIN_CONTEXTS and len(w) >= 3)
    base = b" ".join(w for _, w in reversed(frequent)) + b" "
    return base, base + b"".join(w + b" " for score, w in telling if score > MIN_Z)


class Margins:
    """By how many bytes the toxic dictionary compresses each window better than the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as zs

        def compressor(content: bytes):
            # matches below MIN_MATCH bytes are syllables, found by chance in any text
            known = zs.ZstdCompressionDict(content + PAD, dict_type=zs.DICT_TYPE_RAWCONTENT)
            tuned = zs.ZstdCompressionParameters(
                strategy=zs.STRATEGY_GREEDY, min_match=MIN_MATCH, search_log=5, hash_log=17, chain_log=17, window_log=20,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            return zs.ZstdCompressor(compression_params=tuned, dict_data=known)

        self.ordinary, self.toxic = compressor(ordinary).compress, compressor(toxic).compress

    def features(self, text: str) -> list[float]:
        margins = sorted((len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)), reverse=True)
        strong = [m for m in margins if m >= 4]
        n = len(margins)
        second = margins[1] if n > 1 else 0
        very = sum(m >= 6 for m in strong)
        return [1.0, margins[0], max(0, margins[0] - 5), second, math.log2(n), math.log1p(len(strong)), math.log1p(very), 10 * sum(strong) / n]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all weights but the constant's."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[str, int, int]]) -> tuple[bytes, bytes, list[float]]:
    """``rows``: text, label, half. The logistic function is fitted on margins of texts that had no part
    in the dictionaries they are measured with: each half against those of the other."""
    share = sum(label for _, label, _ in rows) / max(1, len(rows))
    plain = [math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0)] + [0.0] * 7
    texts = {(label, half): [t for t, x, h in rows if (x, h) == (label, half)] for label in (0, 1) for half in (0, 1)}
    if not all(texts.values()):
        return b"", b"", plain
    x, y = [], []
    for half in (0, 1):
        margins = Margins(*dictionaries(texts[1, 1 - half], texts[0, 1 - half]))
        for label in (0, 1):
            x += [margins.features(t) for t in texts[label, half]]
            y += [label] * len(texts[label, half])
    ordinary, toxic = dictionaries(texts[1, 0] + texts[1, 1], texts[0, 0] + texts[0, 1])
    return ordinary, toxic, fit_logistic(np.array(x), np.array(y, dtype=float)).tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, label, half, order): up to ``rows`` documents of each label that may be learned from,
    chosen by a hash of their id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known.where(~held_out()).withColumn("order", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("label") == k).orderBy("order", "doc_id").limit(rows) for k in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * rows rows at most
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int")
    return docs.select("doc_id", "text").join(few, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label", half.alias("half"), "order", "doc_id")


def toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[bytes, bytes, list[float]]:
    """The model, made by one task from the bounded sample."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, size = [], 0
        for batch in batches:
            for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half"))):
                if size <= sample_bytes:
                    sample.append((text, label, half))
                    size += len(text.encode("utf-8", "replace"))
        made = train(sample)
        yield pa.RecordBatch.from_arrays([pa.array([made[0]]), pa.array([made[1]]), pa.array([made[2]])], ["ordinary", "toxic", "weights"])

    sample = labelled_sample(docs, labels, rows).repartition(1).sortWithinPartitions("order", "doc_id", "text")
    row = sample.select("text", "label", "half").mapInArrow(lean(learn), MODEL).first()
    return (bytes(row.ordinary), bytes(row.toxic), list(row.weights)) if row else train([])


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) as further
    columns; clashing columns of ``docs`` are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, rows, sample_bytes))  # under 1 MB
    kept = docs.drop("score", "predicted")
    names = kept.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic, weights = model.value
        margins, w = Margins(ordinary, toxic), np.array(weights)
        for batch in batches:
            parts = (part.to_pylist() for _, part in text_slices(strings(batch.column("text"))))
            x = np.array([margins.features(t) for part in parts for t in part]).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(lean(score), schema)
