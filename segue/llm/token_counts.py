"""Token counts by a two-tier lookup in the map tasks.

The tokenizer drops white space, so a text's count is the sum over its parts between spaces, and
most of these are a few frequent ones. Each task sums up the parts it meets in a table of bounded
size; the tables are merged in a tree to one of the most frequent parts, whose counts are broadcast.
Parts it lacks are encoded once by each worker and kept in a cache. No part is shuffled for each of
its occurrences, and both tables only save work: counts never depend on them.

Defined results: NULL text is the empty text and has no tokens; repeated rows, NULL doc_id and texts
of any length are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.bytebpe import MARKS, vocabulary_file
from segue.llm.shared import lean, strings, text_slices

FREQUENT, CACHED, FAN_IN = 1 << 15, 400_000, 32
_counters: dict[str, Counter] = {}


class Counter:
    """The library's counts for one vocabulary, with a bounded cache of the parts met."""

    def __init__(self, vocabulary: str):
        path = vocabulary_file(vocabulary)
        self.cache: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.adds_up = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
            return
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            pre = json.load(f)["pre_tokenizer"] or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        self.adds_up = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
        self.whole = lambda texts: [
            len(x) for i in range(0, len(texts), 2048) for x in tokenizer.encode_batch_fast(texts[i : i + 2048], add_special_tokens=False)
        ]

    def parts(self, parts: list[str], frequent: dict[str, int]) -> list[int]:
        """Counts of parts: frequent ones from the broadcast, others from the cache. Latin letters and
        the marks after them are pre-tokens of their own, so each is encoded and kept alone."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        found = [frequent.get(p) for p in parts]
        left = [i for i, n in enumerate(found) if n is None]
        pairs = [(i, *self._cut(parts[i])) for i in left]
        misses = list({x for _, word, marks in pairs for x in (word, marks) if x not in self.cache and x not in frequent})
        self.cache.update(zip(misses, self.whole(misses)))
        one = lambda x: self.cache[x] if x in self.cache else frequent[x]
        for i, word, marks in pairs:
            found[i] = one(word) + (one(marks) if marks else 0)
        return found

    @staticmethod
    def _cut(part: str) -> tuple[str, str]:
        word = part.rstrip(MARKS)
        return (word, part[len(word) :]) if word.isalpha() and max(word) < "Ā" else (part, "")


def counter(vocabulary: str) -> Counter:
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def _most(counts: dict[str, int], n: int) -> dict[str, int]:
    return dict(heapq.nlargest(n, counts.items(), key=lambda x: (x[1], x[0])))


def _as_row(task: int, counts: dict[str, int]) -> pa.RecordBatch:
    columns = [pa.array([task], pa.int64()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["task", "parts", "n"])


SUMMARY = "task long, parts array<string>, n array<long>"


def frequent_parts(docs: DataFrame, n: int = FREQUENT) -> list[str]:
    """About the ``n`` most frequent parts over all texts; no table holds more than ``8 * n`` parts."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for _, part in text_slices(strings(batch.column("text"))):
                found = pc.split_pattern(part, " ").flatten().value_counts()
                found = found.filter(pc.greater(found.field("counts"), 1))  # once in some megabytes is not frequent
                for p, k in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                    counts[p] = counts.get(p, 0) + k
                if len(counts) > 8 * n:
                    counts = _most(counts, 4 * n)
        yield _as_row(TaskContext.get().partitionId(), _most(counts, n))

    def merge(rows: pa.Table) -> pa.Table:
        counts: dict[str, int] = {}
        for parts, ns in zip(rows.column("parts").to_pylist(), rows.column("n").to_pylist()):
            for p, k in zip(parts, ns):
                counts[p] = counts.get(p, 0) + k
        return pa.Table.from_batches([_as_row(rows.column("task")[0].as_py() // FAN_IN, _most(counts, n))])

    texts = docs.select("text")
    tables, left = texts.mapInArrow(lean(summarise), SUMMARY), texts.rdd.getNumPartitions()
    while left > 1:
        tables = tables.groupBy(F.expr(f"task div {FAN_IN}")).applyInArrow(merge, SUMMARY)
        left = -(-left // FAN_IN)
    return [p for row in tables.select("parts").collect() for p in row.parts][:n]


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark, known = docs.sparkSession, counter(vocabulary)
    parts = frequent_parts(docs, frequent) if known.adds_up else []
    table = spark.sparkContext.broadcast(dict(zip(parts, known.whole(parts))))  # at most ``frequent`` entries

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            texts = strings(batch.column("text"))
            counts: list[np.ndarray] = []
            for _, part in text_slices(texts):
                if not tokens.adds_up:
                    counts.append(np.array(tokens.whole(part.to_pylist()), dtype=np.int64))
                    continue
                lists = pc.split_pattern(part, " ")
                coded = lists.flatten().dictionary_encode()
                each = np.array(tokens.parts(coded.dictionary.to_pylist(), table.value), dtype=np.int64)
                first = np.asarray(lists.offsets)[:-1].astype(np.int64) - lists.offsets[0].as_py()
                counts.append(np.add.reduceat(each[np.asarray(coded.indices)], first))
            n = np.concatenate(counts) if counts else np.empty(0, np.int64)
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(count), schema)
