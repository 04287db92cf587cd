"""Ordered operators that never put one group into one task.

A plain window partitioned by library, track or playlist sorts the whole group in a single task; one
key may hold a third of all rows. Here groups of more than about ``CHUNK`` rows are cut into chunks of
that many rows at splitters: quantiles, by the whole order (the order column and the ties), of a sample
of their rows. The window runs per (group, chunk), and one small row per chunk carries the running value
across chunk borders. All other groups are one chunk, and have no row in any side table.

The sample is drawn first, by a job of its own: where it shows no large group, which is most often so, the
operators are plain windows over ``keys`` and the data is read by them alone. Splitters and carries have
one row, or one array entry, for each ``CHUNK`` rows of the data, so both are broadcast and the data is
shuffled once. `cut` lays rows out once for several operators of one order.

Results equal the plain window's: NULL keys are one group, and rows of NULL order come first in theirs.
The sample is drawn by a hash of the row's keys and order, so every step sees the same one. Rows equal
in order and ties are one place in the order and can't be cut apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segue.session import materialise

CHUNK = 1 << 17
SAMPLED = 64  # rows of a chunk that are in the sample
MOST_SPLITTERS = 20  # of one group, as a power of two
_C = "__chunk"


def _window(rows: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str]):
    return W.partitionBy(*keys, *[_C for c in rows.columns if c == _C]).orderBy(order, *ties)


def _across(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(_C)


def _before(keys: Sequence[str]):
    return _across(keys).rowsBetween(W.unboundedPreceding, -1)


def _met(rows: DataFrame, side: DataFrame, keys: Sequence[str], *also: str, how: str = "left") -> DataFrame:
    """``rows`` with the other columns of the small table ``side``; NULL keys meet NULL keys."""
    side = side.withColumnsRenamed({k: f"__on_{k}" for k in (*keys, *also)})
    same = [f"`{k}` <=> `__on_{k}`" for k in keys] + [f"`{k}` = `__on_{k}`" for k in also]
    return rows.join(F.broadcast(side), F.expr(" AND ".join(same)), how).drop(*[f"__on_{k}" for k in (*keys, *also)])


def _named(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in dict.fromkeys(names))


def _place(names: Sequence[str]) -> str:
    return "named_struct(" + ", ".join(f"'p{i}', `{n}`" for i, n in enumerate(dict.fromkeys(names))) + ")"


def splitters(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """``keys`` and ``__at``: for each large group the places (structs of order and ties) at which its chunks
    begin, but for the first."""
    rate = max(1, chunk // SAMPLED)
    names = list(dict.fromkeys([*keys, order, *ties]))
    by_place = f"(PARTITION BY {_named(keys)} ORDER BY {_named([order, *ties])})"
    some = df.select(*names).where(f"pmod(xxhash64({rate}, {_named(names)}), {rate}) = 0") if rate > 1 else df.select(*names)
    some = some.repartition(*keys).groupBy(*names).agg(F.expr("count(*) AS __n"))
    some = some.selectExpr("*", f"sum(__n) OVER (PARTITION BY {_named(keys)}) AS __all", f"sum(__n) OVER {by_place} - __n AS __before")
    some = some.where(f"__all * {rate} > {2 * chunk}").selectExpr("*", f"__before * ceil(__all * {rate} / {chunk}) div __all AS __piece")
    some = some.selectExpr("*", f"lag(__piece, 1, 0L) OVER {by_place} AS __last").where("__piece > __last")
    return some.groupBy(*keys).agg(F.expr(f"array_sort(collect_list({_place([order, *ties])})) AS __at"))


_STEPS = f"array({', '.join(str(1 << k) for k in reversed(range(MOST_SPLITTERS)))})"
_FURTHER = "(found, step) -> IF(found + step <= size(__at) AND get(__at, found + step - 1) <= __here, found + step, found)"


def cut(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), chunk: int = CHUNK, plain: bool = False
) -> DataFrame:
    """``df`` with ``__chunk``: a large group's chunk from 0 on, NULL in all other groups. The operators
    below use it where it is there; `uncut` drops it. With ``plain``, ``df`` itself if no group is large."""
    rows = _cut_large(df, keys, order, ties, chunk)
    return rows if plain or _C in rows.columns else rows.withColumn(_C, F.lit(None).cast("int"))


def _cut_large(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], chunk: int) -> DataFrame:
    """As `cut`, but ``df`` itself if no group is large."""
    at = materialise(splitters(df, keys, order, ties, chunk), "splitters")
    if at.isEmpty():
        return df
    rows = _met(df, at, keys)
    rows = rows.selectExpr("*", f"IF(__at IS NULL, NULL, {_place([order, *ties])}) AS __here")
    rows = rows.selectExpr("*", f"IF(__at IS NULL, NULL, aggregate({_STEPS}, 0, {_FURTHER})) AS {_C}")
    return rows.drop("__at", "__here")


def uncut(df: DataFrame) -> DataFrame:
    return df.drop(_C)


def _laid(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], chunk: int) -> tuple[DataFrame, bool]:
    return (df, True) if _C in df.columns else (_cut_large(df, keys, order, ties, chunk), False)


def _with_carry(local: DataFrame, carry: DataFrame | None, keys: Sequence[str], laid: bool) -> DataFrame:
    if carry is None:
        return local
    out = _met(local, carry, keys, _C)
    return out if laid else uncut(out)


def _edges(rows: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame | None:
    """``aggs`` of each chunk of the groups that are cut; None if ``rows`` were not cut."""
    return large(rows).groupBy(*keys, _C).agg(*aggs) if _C in rows.columns else None


def large(rows: DataFrame) -> DataFrame:
    """The rows of groups that are cut."""
    return rows.where(F.col(_C).isNotNull())


def ranked(
    df: DataFrame, keys: Sequence[str], order: str, out: str,
    ties: Sequence[str] = (), chunk: int = CHUNK,
) -> DataFrame:
    """1-based ``row_number`` by ``order, *ties`` within ``keys``."""
    rows, laid = _laid(df, keys, order, ties, chunk)
    local = rows.withColumn("__rn", F.row_number().over(_window(rows, keys, order, ties)))
    carry, number = _edges(rows, keys, F.count("*").alias("__n")), F.col("__rn")
    if carry is not None:
        carry = carry.withColumn("__off", F.sum("__n").over(_before(keys))).drop("__n")
        number = number + F.coalesce("__off", F.lit(0))
    return _with_carry(local, carry, keys, laid).withColumn(out, number.cast("bigint")).drop("__rn", "__off")


def neighbours(
    df: DataFrame, keys: Sequence[str], order: str, take: Sequence[str], out: str,
    ties: Sequence[str] = (), chunk: int = CHUNK, step: int = -1,
) -> DataFrame:
    """The previous (``step=-1``) or next (``step=1``) row's columns as struct ``out``."""
    rows, laid = _laid(df, keys, order, ties, chunk)
    value, rank = F.struct(*take), F.struct(order, *ties)
    edge, beside = (F.max_by, F.lag) if step < 0 else (F.min_by, F.lead)
    local = rows.withColumn("__l", beside(value).over(_window(rows, keys, order, ties)))
    carry, found = _edges(rows, keys, edge(value, rank).alias("__e")), F.col("__l")
    if carry is not None:
        carry = carry.withColumn("__e", beside("__e").over(_across(keys)))
        found = F.coalesce("__l", "__e")
    return _with_carry(local, carry, keys, laid).withColumn(out, found).drop("__l", "__e")


def around(
    df: DataFrame, keys: Sequence[str], order: str, take: Sequence[str],
    ties: Sequence[str] = (), chunk: int = CHUNK,
) -> DataFrame:
    """Both neighbours of every row, as structs ``prev`` and ``next``, in one pass."""
    rows, laid = _laid(df, keys, order, ties, chunk)
    value, rank = F.struct(*take), F.struct(order, *ties)
    win = _window(rows, keys, order, ties)
    local = rows.withColumns({"__lp": F.lag(value).over(win), "__ln": F.lead(value).over(win)})
    carry = _edges(rows, keys, F.max_by(value, rank).alias("__last"), F.min_by(value, rank).alias("__first"))
    both = {"prev": F.col("__lp"), "next": F.col("__ln")}
    if carry is not None:
        across = _across(keys)
        carry = carry.select(*keys, _C, F.lag("__last").over(across).alias("__p"), F.lead("__first").over(across).alias("__n"))
        both = {"prev": F.coalesce("__lp", "__p"), "next": F.coalesce("__ln", "__n")}
    return _with_carry(local, carry, keys, laid).withColumns(both).drop("__lp", "__ln", "__p", "__n")


def running(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, kind: str, out: str,
    ties: Sequence[str] = (), chunk: int = CHUNK, inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` (non-NULL) of ``value`` in order."""
    rows, laid = _laid(df, keys, order, ties, chunk)
    rows = rows.withColumn("__v", value)
    win = _window(rows, keys, order, ties).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    if kind == "sum":
        total, carried, local = F.sum("__v"), F.sum("__t"), F.sum("__v").over(win)
    elif kind == "max":
        total, carried, local = F.max("__v"), F.max("__t"), F.max("__v").over(win)
    elif kind == "last":
        total = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(order, *ties)))
        carried, local = F.last("__t", ignorenulls=True), F.last("__v", ignorenulls=True).over(win)
    else:
        raise ValueError(kind)
    carry = _edges(rows, keys, total.alias("__t"))
    if carry is not None:
        carry = carry.withColumn("__carry", carried.over(_before(keys))).drop("__t")
    joined = _with_carry(rows.withColumn("__l", local), carry, keys, laid)
    l, c = F.col("__l"), F.col("__carry")
    if carry is None:
        value_out = F.coalesce(l, F.lit(0)) if kind == "sum" else l
    elif kind == "sum":
        value_out = F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))
    elif kind == "max":
        value_out = F.greatest(l, c)  # greatest skips NULLs
    else:
        value_out = F.coalesce(l, c)
    return joined.withColumn(out, value_out).drop("__v", "__l", "__carry")


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column],
    chunk: int = CHUNK,
) -> DataFrame:
    """Several inclusive running maxima in one pass."""
    rows, laid = _laid(df, keys, order, (), chunk)
    rows = rows.withColumns(values)
    names = list(values)
    tops = _edges(rows, keys, *[F.max(n).alias(n) for n in names])
    win = _window(rows, keys, order, ()).rowsBetween(W.unboundedPreceding, 0)
    local = rows.select(*[c for c in rows.columns if c not in names], *[F.max(n).over(win).alias(n) for n in names])
    if tops is None:
        return local
    before = _before(keys)
    carry = tops.select(*keys, _C, *[F.max(n).over(before).alias(f"__c_{n}") for n in names])
    out = _with_carry(local, carry, keys, laid)
    return out.withColumns({n: F.greatest(F.col(n), F.col(f"__c_{n}")) for n in names}).drop(*[f"__c_{n}" for n in names])


def group_values(
    df: DataFrame, keys: Sequence[str], salt: Column, aggs: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Attach group aggregates to every row without gathering a group: aggregate per
    (group, salt), then per group, and join back on (group, salt).

    ``aggs`` maps an output name to ``(max|min|sum|count, column)``. The keys travel as one struct, which
    is never NULL, so all three steps use one partitioning.
    """
    rows = df.withColumn("__s", F.struct(*keys, salt.alias("__salt")))
    first = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    second = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}
    group = F.struct(*[F.col("__s").getField(k).alias(k) for k in keys]).alias("__g")
    parts = rows.groupBy("__s").agg(*[first[k](c).alias(n) for n, (k, c) in aggs.items()])
    whole = parts.groupBy(group).agg(*[second[k](n).alias(n) for n, (k, _) in aggs.items()])
    return rows.join(parts.select("__s", group).join(whole, "__g").drop("__g"), "__s").drop("__s")
