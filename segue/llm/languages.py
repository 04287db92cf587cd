"""Language proportions of a document by expectation-maximisation over a mixture of n-gram models.

Each language is a distribution over hashed byte trigrams of lower-cased words. A word's likelihood in
a language is the product over its trigrams; a document is a mixture in which every word belongs to
one language. Expectation-maximisation estimates the shares. Then the sets of the 1, 2, ... largest
languages are fitted alone, and the set with the best likelihood, less a penalty for each language that
grows with the logarithm of the words, is the document's.

The models come from a sample of about ``rows`` documents of each language, chosen by a hash of their
id. Everything else covers all rows and whole texts.

Defined results: NULL texts and texts without a letter are ``und`` with score 0, as is every text if
nothing can be learned; ties go to the language first by name; repeated rows are predicted each; a NULL
doc_id is held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.shared import held_out, lean, strings, text_slices

BUCKETS, ROWS, STEPS, REFIT_STEPS, PENALTY, SMOOTHING = 1 << 16, 3000, 12, 6, 3.0, 0.5
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words, where each word starts among them, and each word's text."""
    lower = pc.binary_join_element_wise(pc.utf8_lower(texts), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    ends = np.frombuffer(lower.buffers()[1], dtype=np.int64)[: len(lower) + 1]
    data = np.empty(ends[-1] + 2, dtype=np.uint8)
    data[[0, -1]] = 32
    data[1:-1] = np.frombuffer(lower.buffers()[2], dtype=np.uint8)[: ends[-1]]
    letter = _LETTER[data]
    at = np.flatnonzero(letter)
    data = np.where(letter, data, 32).astype(np.uint32)
    grams = (data[at - 1] << 16 | data[at] << 8 | data[at + 1]) * np.uint32(2_654_435_761)
    starts = np.flatnonzero(~letter[at - 1])
    return (grams >> 16).astype(np.intp), starts, np.searchsorted(ends, at[starts] - 1, side="right") - 1


def language_models(docs: DataFrame, rows: int = ROWS) -> tuple[list[str], np.ndarray]:
    """Language names and the logarithms of their trigram probabilities (languages x buckets)."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for name in names for x in (name, int((1 << 30) * min(1.0, rows / sizes[name])))]) if names else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, part in text_slices(strings(batch.column("text"))):
                grams, starts, doc = trigrams(part)
                lang = np.array(batch.column("lang").slice(first, len(part)).to_pylist(), dtype=object)
                of_gram = np.repeat(doc, np.diff(np.append(starts, len(grams))))
                for name in set(lang.tolist()):
                    own = grams[np.isin(of_gram, np.flatnonzero(lang == name))]
                    counts[name] = counts.get(name, 0) + np.bincount(own, minlength=BUCKETS)
        for name, n in counts.items():
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(on), pa.string()), pa.array(on.astype(np.int32)), pa.array(n[on])], ["lang", "bucket", "n"])

    if not names:
        return [], np.empty((0, BUCKETS), np.float32)
    counted = known.where(place < share[F.col("lang")]).select("text", "lang").mapInArrow(lean(count), "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets rows at most
    counts = np.zeros((len(names), BUCKETS))
    order = np.array([names.index(x) for x in table.column("lang").to_pylist()], dtype=np.intp)
    counts[order, np.asarray(table.column("bucket"))] = np.asarray(table.column("n"))
    counts += SMOOTHING
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _fit(r: np.ndarray, share: np.ndarray, first: np.ndarray, doc: np.ndarray, n: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (languages x documents) after some steps, and the documents' log-likelihoods."""
    for _ in range(steps):
        mixed = r * share[:, doc]
        mixed /= mixed.sum(axis=0)
        share = np.add.reduceat(mixed, first, axis=1) / n
    return share, np.add.reduceat(np.log((r * share[:, doc]).sum(axis=0)), first)


def mixtures(texts: pa.Array, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the texts that have words: their places, and the chosen languages' shares (languages x texts)."""
    grams, starts, doc_of_word = trigrams(texts)
    places, first = np.unique(doc_of_word, return_index=True)
    if not len(places):
        return places, np.empty((len(logs), 0))
    doc = np.searchsorted(places, doc_of_word)
    n = np.diff(np.append(first, len(doc_of_word))).astype(np.float32)
    likely = np.stack([np.add.reduceat(row[grams], starts) for row in logs])
    r = np.maximum(np.exp(likely - likely.max(axis=0)), np.float32(1e-30))
    share, _ = _fit(r, np.full((len(logs), len(places)), 1 / len(logs), dtype=np.float32), first, doc, n, STEPS)
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
    best, chosen = np.full(len(places), -np.inf), share
    for size in range(1, len(logs) + 1):
        start = np.where(rank < size, np.maximum(share, np.float32(1e-9)), np.float32(0))
        fitted, log_likelihood = _fit(r, (start / start.sum(axis=0)).astype(np.float32), first, doc, n, REFIT_STEPS if size > 1 else 0)
        worth = log_likelihood - PENALTY * (size - 1) * np.log(n + 1)
        better = worth > best
        best, chosen = np.where(better, worth, best), np.where(better, fitted, chosen)
    return places, chosen


def predict_languages(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred (the largest share), score (that share), and the chosen languages
    with their shares, largest first."""
    names, logs = language_models(docs, rows)
    model = docs.sparkSession.sparkContext.broadcast(logs)  # languages x 256 kB

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            sets: list[list[str]] = [[] for _ in lang]
            shares: list[list[float]] = [[] for _ in lang]
            for at, part in text_slices(strings(batch.column("text")), 2 << 20):
                if not names:
                    continue
                lettered = np.asarray(pc.match_substring_regex(part, r"\p{L}"))
                places, chosen = mixtures(part, model.value)
                order = np.argsort(-chosen, axis=0, kind="stable").T.tolist()
                for place, ranked, share in zip(places.tolist(), order, chosen.T.tolist()):
                    if lettered[place]:
                        kept = [x for x in ranked if share[x] > 0]
                        lang[at + place], score[at + place] = names[kept[0]], min(1.0, share[kept[0]])
                        sets[at + place], shares[at + place] = [names[x] for x in kept], [share[x] for x in kept]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)]
            columns += [pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    schema = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(lean(predict), schema)
