"""Sections of ordered rows, where the next section's start depends on this one's.

A section starts at a row and takes the rows after it while they fit that first row; the first that
doesn't starts the next. Which rows are starts is a chain from the first row on, so a group can't simply
be split. Here a group that `plans.ordered.cut` has cut into chunks is walked in all chunks at once:

1. Every chunk is walked as if a section started at its first row. Groups of one chunk are done.
2. A chunk maps the section that is open before it to the one that is open after it. Chains soon meet,
   so each chunk is also walked with the section that its neighbour's first walk left open.
3. A pass over the known steps of a group (a few numbers a chunk) follows the true chain as far as they
   reach. Where a step is missing it is asked for, and for 2, 4, 8, ... chunks further on in case the
   section lasts so long: jumps double, so a section over n chunks takes log2(n) rounds.
4. Chunks whose true entry isn't the first guess are walked once more, for their sections.

Rounds write small tables of steps. No array of rows holds a group, and a task holds one chunk.

Where no group is large, groups aren't cut: those of some 65,536 rows are walked side by side, in arrays, and
rows that are already laid out by their keys are sorted where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segue.plans.ordered import _C, CHUNK, _met, cut, large
from segue.session import materialise

#: ``walk(entry, columns, base, before, last) -> (sections, open)``. ``entry`` and ``open``: the open section's
#: numbers ([]: none), one more than a section has at most; ``columns``: one array a column; ``base``: rows of the group before this chunk, of which
#: ``before`` is the last; ``last``: nothing follows, so an open section ends here.
Walk = Callable[[list[float], list[np.ndarray], int, list[float] | None, bool], tuple[list[list[float]], list[float]]]
#: ``fits(columns, rows, firsts)``: which rows fit the section that begins at a row of ``firsts``.
Fits = Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]
#: How whole groups are walked side by side: ``fits``; ``numbers(columns, starts, firsts, stops)``, one array a number, of
#: sections of groups that begin at ``starts``; and 1 if the rows are intervals, of which a group has one less, else 0.
Many = tuple[Fits, Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], int]
NUMBERS = "array<double>"
ROWS = 1 << 16  # that are walked side by side
FEW_GROUPS = 8  # that are walked one by one


def first_break(fits: Callable[[int, int], np.ndarray], at: int, n: int) -> int:
    """The first row from ``at`` on that doesn't fit, looked for in growing steps; ``n`` if all do."""
    step = 16
    while at < n:
        stop = min(n, at + step)
        broken = np.flatnonzero(~fits(at, stop))
        if len(broken):
            return at + int(broken[0])
        at, step = stop, min(step * 4, 1 << 15)
    return n


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; NULLs are equal."""
    if len(column) < 2:
        return np.zeros(0, dtype=bool)
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differs = np.asarray(pa.compute.fill_null(pa.compute.not_equal(a, b), False))
    return differs | (np.asarray(a.is_null()) != np.asarray(b.is_null()))


def _starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where another group begins than that of the row before."""
    changed = np.zeros(batch.num_rows - 1, dtype=bool)
    for k in keys:
        changed |= _changes(batch.column(k))
    return [0, *(np.flatnonzero(changed) + 1).tolist()]


def _numbers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([np.asarray(batch.column(f"x{i}").fill_null(0), dtype=np.float64) for i in range(width)], axis=1)


def _chains(fits: Fits, columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, few: int) -> tuple[list, np.ndarray]:
    """The sections of several groups at once, as (groups, first rows, ends), and the groups that were left when no
    more than ``few`` were open: arrays of a few rows take longer than a walk by itself."""
    group = np.flatnonzero(starts < ends)
    first, end = starts[group], ends[group]
    at, step, found = first + 1, np.full(len(group), 8), []
    while len(group) > few:
        stop = np.minimum(end, at + step)
        size = stop - at
        offset = np.cumsum(size) - size
        rows = np.arange(int(size.sum())) + np.repeat(at - offset, size)
        bad = np.flatnonzero(~fits(columns, rows, np.repeat(first, size)))
        own = np.searchsorted(offset, bad, side="right") - 1
        leading = np.flatnonzero(np.diff(own, prepend=-1))
        broken = np.full(len(group), -1)
        broken[own[leading]] = rows[bad[leading]]
        broke = broken >= 0
        done = ~broke & (stop == end)
        closed = broke | done
        found.append((group[closed], first[closed], np.where(broke, broken, end)[closed]))
        first, at = np.where(broke, broken, first), np.where(broke, broken + 1, stop)
        step = np.where(broke, 8, np.minimum(step * 4, 1 << 15))
        group, first, at, end, step = (x[~done] for x in (group, first, at, end, step))
    return found, group


def _all_sections(walk: Walk, many: Many, columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The groups and the numbers of all sections of whole groups."""
    fits, numbers, between = many
    with np.errstate(all="ignore"):
        found, left = _chains(fits, columns, starts, ends - between, FEW_GROUPS)
    group, first, stop = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=int),) * 3
    kept = ~np.isin(group, left)
    group, first, stop = group[kept], first[kept], stop[kept]
    values = numbers(columns, starts[group], first, stop)
    for g in left.tolist():
        own, _ = walk([], [c[starts[g] : ends[g]] for c in columns], 0, None, True)
        group = np.append(group, np.full(len(own), g))
        values = [np.append(v, x) for v, x in zip(values, np.array(own).reshape(len(own), len(values)).T)]
    return group, values


def _walked_whole(keys: list[str], width: int, out: int, walk: Walk, many: Many):
    """Walks a stream of whole groups' rows in order."""
    import pyarrow.compute  # noqa: F401

    names = [*keys, *[f"v{i}" for i in range(out)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walked(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            """Sections, and the rows of the last group, which may not be whole."""
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            starts = np.array([*_starts(batch, keys), batch.num_rows])
            starts, ends = (starts[:-1], starts[1:]) if last else (starts[:-2], starts[1:-1])
            columns = [np.ascontiguousarray(c) for c in _numbers(batch, width).T]
            group, values = _all_sections(walk, many, columns, starts, ends)
            own = [batch.column(k).take(pa.array(starts[group])) for k in keys]
            made = pa.RecordBatch.from_arrays([*own, *[pa.array(v, pa.float64()) for v in values]], names)
            return made, batch.slice(ends[-1] if len(ends) else 0)

        held, new = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            new += batch.num_rows
            if new >= ROWS:
                made, rest = walked(held, False)
                held, new = [rest], 0
                yield made
        if held:
            yield walked(held, True)[0]

    return run


def _walked(keys: list[str], width: int, out: int, walk: Walk, sections: bool):
    """Walks streams of groups' chunks: a chunk's headers (kind 0), then its rows (kind 1) in order."""
    import pyarrow.compute  # noqa: F401

    group = [*keys, _C]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []  # rows that wait for their batch: key, kind, entry, open, numbers
        none = [0.0] * out

        def close(key: list, headers: list[dict], rows: list[np.ndarray]) -> None:
            data = rows[0] if len(rows) == 1 else np.concatenate(rows) if rows else None
            columns = [np.empty(0)] * width if data is None else list(data.T)
            for h in headers or [{"entry": [], "base": 0, "before": None, "last": True}]:
                found, left = walk(list(h["entry"]), columns, h["base"], h["before"], h["last"])
                if sections:
                    made.extend((key, 0, None, None, numbers) for numbers in found)
                if headers:
                    made.append((key, 1, h["entry"], left, none))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            named, kinds, entries, opens, numbers = zip(*rows)
            arrays = [pa.array(v, t) for v, t in zip(zip(*named), types)]
            arrays += [pa.array(kinds, pa.int32()), pa.array(entries, pa.list_(pa.float64())), pa.array(opens, pa.list_(pa.float64()))]
            arrays += [pa.array(v) for v in np.array(numbers, dtype=np.float64).reshape(-1, out).T]
            return pa.RecordBatch.from_arrays(arrays, [*group, "kind", "entry", "open", *[f"v{i}" for i in range(out)]])

        def header(row: dict) -> dict:
            entry = [row[f"e{i}"] for i in range(out + 1) if row[f"e{i}"] is not None]
            before = [row[f"x{i}"] or 0.0 for i in range(width)] if row["base"] else None
            return {"entry": entry, "base": row["base"], "before": before, "last": row["last"]}

        key, headers, rows, types = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in group]
            starts = _starts(batch, group)
            kinds = np.asarray(batch.column("kind"))
            values = _numbers(batch, width)
            names = zip(*[batch.column(k).take(pa.array(starts)).to_pylist() for k in group])
            for a, z, own in zip(starts, [*starts[1:], batch.num_rows], names):
                if own != key:
                    if key is not None:
                        close(key, headers, rows)
                    key, headers, rows = own, [], []
                    if len(made) >= 4096:
                        yield batch_of(made)
                        made.clear()
                first = a + int(np.searchsorted(kinds[a:z], 1))
                if first > a:
                    headers += map(header, batch.slice(a, first - a).to_pylist())
                if first < z:
                    rows.append(values[first:z])
        if key is not None:
            close(key, headers, rows)
        if made:
            yield batch_of(made)

    return run


def _true_chain(keys: list[str], ahead: int):
    """Of one group's known steps: the entries of all its chunks, or the steps that are missing."""

    def follow(steps: pd.DataFrame) -> pd.DataFrame:
        known = {(c, tuple(e)): tuple(o) for c, e, o in zip(steps[_C], steps["entry"], steps["open"])}
        chunks = sorted({c for c, _ in known})
        state, found, done = (), [], True
        for i, c in enumerate(chunks):
            if state:
                found.append((c, state))
            if (c, state) not in known:
                further = zip(chunks[1:], (known[b, ()] for b in chunks)) if not ahead else ((b, state) for b in chunks[i : i + ahead])
                found, done = [x for x in further if x not in known], False
                break
            state = known[c, state]
        out = pd.DataFrame({k: [steps[k].iloc[0]] * len(found) for k in keys})
        out[_C], out["entry"], out["done"] = [c for c, _ in found], [list(s) for _, s in found], done
        return out

    return follow


def sections_of(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], walk: Walk, many: Many, out: int,
    ties: Sequence[str] = (), chunk: int = CHUNK,
) -> DataFrame:
    """``keys`` and the numbers ``v0`` ... of every section. ``columns`` go to ``walk`` as doubles; without a large
    group ``many`` finds the sections of many groups at once."""
    keys, ties = list(keys), list(ties)
    known = {c: f"o{i}" for i, c in enumerate(dict.fromkeys([order, *ties, *columns]))}
    slim = df.select(*keys, *[F.col(c).alias(o) for c, o in known.items()])
    o = [known[c] for c in dict.fromkeys([order, *ties])]
    x = [F.col(known[c]).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    key_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
    numbers = [f"v{i} double" for i in range(out)]
    rows = cut(slim, keys, o[0], o[1:], chunk, plain=True)
    if _C not in rows.columns:  # no large group; rows that are laid out by their keys are not moved again
        stream = rows.repartition(*keys).sortWithinPartitions(*keys, *o).select(*keys, *x)
        return materialise(stream.mapInArrow(_walked_whole(keys, len(x), out, walk, many), ", ".join([*key_types, *numbers])), "sections")
    across = W.partitionBy(*keys).orderBy(_C)
    edges = large(rows).groupBy(*keys, _C).agg(F.count("*").alias("n"), F.max_by(F.struct(*x), F.struct(*o)).alias("end"))
    heads = edges.select(
        *keys, _C, F.coalesce(F.sum("n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lag("end").over(across).alias("before"), F.lead("n").over(across).isNull().alias("last"),
    )
    no_entry = F.array().cast(NUMBERS)
    schema = ", ".join([*key_types, f"{_C} int", "kind int", f"entry {NUMBERS}", f"open {NUMBERS}", *numbers])

    def walked(some: DataFrame, headers: DataFrame, sections: bool) -> DataFrame:
        # numbers of headers in columns of their own: lists of NULL take Spark's Arrow writer the square of a batch's rows
        own = {"base": "bigint", "last": "boolean", **{f"e{i}": "double" for i in range(out + 1)}}
        data = some.select(*keys, _C, F.lit(1).alias("kind"), *o, *x, *[F.lit(None).cast(t).alias(n) for n, t in own.items()])
        kinds = {f.name: f.dataType for f in some.schema.fields}
        headers = headers.select(
            *keys, _C, F.lit(0).alias("kind"), *[F.lit(None).cast(kinds[n]).alias(n) for n in o], "before.*", "base", "last",
            *[F.get("entry", F.lit(i)).alias(f"e{i}") for i in range(out + 1)],
        )
        stream = data.unionByName(headers).repartition(*keys, _C).sortWithinPartitions(*keys, _C, "kind", *o).drop(*o)
        return stream.mapInArrow(_walked(keys, len(x), out, walk, sections), schema)

    values = [*keys, *[f"v{i}" for i in range(out)]]
    first = materialise(walked(rows, heads.withColumn("entry", no_entry), True), "sections")
    steps = first.where("kind = 1").select(*keys, _C, "entry", "open")
    if steps.isEmpty():
        return first.select(*values)

    rows, heads = materialise(large(rows), "section-rows"), materialise(heads, "section-heads")
    wanted = ", ".join([*key_types, f"{_C} int", f"entry {NUMBERS}", "done boolean"])
    ahead = 0
    while True:
        chain = materialise(steps.groupBy(*keys).applyInPandas(_true_chain(keys, ahead), wanted), "section-chain")
        asked = chain.where("NOT done")
        if asked.isEmpty():
            break
        some = _met(rows, asked.select(*keys, _C).distinct(), keys, _C, how="left_semi")
        more = walked(some, _met(asked.select(*keys, _C, "entry"), heads, keys, _C, how="inner"), False)
        steps = steps.unionByName(materialise(more.select(*keys, _C, "entry", "open"), "section-steps"))
        ahead = max(2, 2 * ahead)
    entries = chain.select(*keys, _C, "entry")
    again = _met(rows, entries.select(*keys, _C), keys, _C, how="left_semi")
    again = walked(again, _met(entries, heads, keys, _C, how="inner"), True).where("kind = 0")
    kept = _met(first.where("kind = 0"), entries.select(*keys, _C, F.lit(True).alias("__again")), keys, _C).where("__again IS NULL")
    return kept.select(*values).unionByName(again.select(*values))
