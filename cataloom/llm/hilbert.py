"""Sharding along a Hilbert curve (operator 1).

Several metadata columns are quantised to ``bits`` bits each, at equal depth: a value's cell
is the share of rows with a lesser value, so a skewed column still spreads over its axis.
Rows are sorted by the Hilbert index of their cells, ties by ``ties`` and then the columns,
and the order is cut into runs of ``run_rows`` rows.  Neighbours on the curve are neighbours
in every dimension, so a run spans a small box, and a filter on any of the columns skips
most runs by their least and greatest values (``manifest``).

Scale: a column is counted by value, and positions come from a range-partitioned sort with
one offset a partition, so nothing is numbered on one executor.  Only the columns asked for are
sorted; ``write`` carries all of them.

Defined results: nulls are the least value; rows alike in all the named columns may stand in
any order among themselves, each with a place of its own; an empty table has no rows and no
runs; texts play no part; columns that aren't named are ignored, whatever they are called; carried
columns called like an added one (hilbert, position, run, cell_<dim>) give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import hint, table, workers_find_package

DIMS = ("lang", "source", "n_chars")
BITS = 8
RUN_ROWS = 8192


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of cells (rows x dimensions), by Skilling's transposed form."""
    x = [c.astype(np.int64).copy() for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        for k in range(len(x)):
            high = (x[k] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for own in x:
            out = (out << 1) | (((own ^ flip) >> b) & 1)
    return out


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, n, part) in order -> (v, part, before within the partition, n)."""
    total = 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        before = np.cumsum(n) - n + total
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(before), batch.column(1)], ["v", "part", "before", "n"])


def _offsets(parts: DataFrame) -> DataFrame:
    """(part, n) for each partition -> (part, offset): rows of all partitions before; one row a partition."""
    rows = sorted((r["part"], r["n"]) for r in parts.collect())
    ends = np.cumsum([n for _, n in rows])
    return parts.sparkSession.createDataFrame([(p, int(e - n)) for (p, n), e in zip(rows, ends)], "part int, offset long")


def depth_cells(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(v, cell) of every value of a column: cell = rows with a lesser value * 2^bits div rows, as a written table."""
    counts = df.groupBy(F.col(f"`{column}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.repartitionByRange(F.asc_nulls_first("v")).sortWithinPartitions(F.asc_nulls_first("v")).withColumn("part", F.spark_partition_id())
    kind = counts.schema["v"].dataType.simpleString()
    ranked = table(counts.mapInArrow(_running, f"v {kind}, part int, before long, n long"))
    offsets = _offsets(ranked.groupBy("part").agg(F.sum("n").alias("n")))
    total = ranked.agg(F.sum("n")).head()[0] or 1
    return table(ranked.join(F.broadcast(offsets), "part").select("v", F.expr(f"cast(shiftleft(before + offset, {bits}) div {total} as int)").alias("cell")))


def ordered(docs: DataFrame, dims: Sequence[str] = DIMS, ties: Sequence[str] = ("doc_id",), bits: int = BITS, run_rows: int = RUN_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """(ties, dims, carry, cell_<dim>, hilbert, position, run) of every row, as a written table read again."""
    spark = docs.sparkSession
    workers_find_package(spark)
    added = {"hilbert", "position", "run", *(f"cell_{d}".lower() for d in dims)}
    wanted = list(dict.fromkeys([*ties, *dims, *(c for c in carry if c.lower() not in added)]))
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(wanted)))
    for k, dim in enumerate(dims):
        cells = depth_cells(docs, dim, bits).select(F.col("v").alias(f"v{k}"), F.col("cell").alias(f"cell{k}"))
        own = own.join(hint(cells), F.col(f"c{wanted.index(dim)}").eqNullSafe(F.col(f"v{k}"))).drop(f"v{k}")

    @F.arrow_udf("long")
    def index(*cells: pa.Array) -> pa.Array:
        return pa.array(curve_index(np.stack([c.to_numpy(zero_copy_only=False) for c in cells], 1), bits))

    keys = ["h", *(f"c{wanted.index(c)}" for c in dict.fromkeys([*ties, *dims]))]
    order = [F.asc_nulls_first(k) for k in keys]
    placed = own.withColumn("h", index(*(F.col(f"cell{k}") for k in range(len(dims)))))
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = table(placed)
    part, row = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets = _offsets(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")))
    out = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("position", F.col("offset") + row)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(wanted)), *(F.col(f"cell{k}").alias(f"cell_{d}") for k, d in enumerate(dims)), F.col("h").alias("hilbert"), "position", F.expr(f"position div {run_rows}").alias("run"))


def manifest(rows: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(run, rows, least_<dim>, greatest_<dim>, nulls_<dim>) of every run: what a reader prunes files by."""
    bounds = [f(d).alias(f"{name}_{d}") for d in dims for f, name in ((F.min, "least"), (F.max, "greatest"))]
    nulls = [F.sum(F.col(f"`{d}`").isNull().cast("long")).alias(f"nulls_{d}") for d in dims]
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), *bounds, *nulls)


def write(docs: DataFrame, path: str, dims: Sequence[str] = DIMS, ties: Sequence[str] = ("doc_id",), bits: int = BITS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Writes ``docs`` with all columns to ``path``, a folder and a file for each run; returns the manifest."""
    rows = ordered(docs, dims, ties, bits, run_rows, carry=docs.columns)
    names = [c for c in docs.columns if c in rows.columns and c.lower() not in ("hilbert", "position", "run")]
    rows.repartition("run").sortWithinPartitions("run", "position").select(*names, "run").write.partitionBy("run").parquet(path)
    return manifest(rows, dims)


def sql(name: str = "documents", dims: Sequence[str] = DIMS, tie: str = "doc_id", bits: int = BITS, run_rows: int = RUN_ROWS) -> str:
    """The same rows as ``ordered`` for DuckDB, one subquery a step of the transform."""
    n = len(dims)
    keep = ", ".join([tie, *dims])
    cells = ", ".join(f"cell_{d}" for d in dims)
    x = [f"x{k}" for k in range(n)]
    first = ", ".join(f"cast(((rank() over (order by {d} nulls first) - 1) << {bits}) // count(*) over () as integer) as cell_{d}" for d in dims)
    parts = [f"s0 as materialized (select {keep}, {first} from {name})", f"s1 as materialized (select *, {', '.join(f'cast(cell_{d} as bigint) as x{k}' for k, d in enumerate(dims))} from s0)"]
    step = 1

    def then(values: dict[str, str], more: str = "") -> None:
        nonlocal step
        cols = ", ".join(f"{values.get(c, c)} as {c}" for c in x)
        parts.append(f"s{step + 1} as materialized (select {keep}, {cells}, {cols}{more} from s{step})")
        step += 1

    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for k in range(n):
            if k == 0:
                then({"x0": f"case when x0 & {q} <> 0 then xor(x0, {p}) else x0 end"})
            else:
                then({"x0": f"case when x{k} & {q} <> 0 then xor(x0, {p}) else xor(x0, xor(x0, x{k}) & {p}) end", f"x{k}": f"case when x{k} & {q} <> 0 then x{k} else xor(x{k}, xor(x0, x{k}) & {p}) end"})
    for k in range(1, n):
        then({f"x{k}": f"xor(x{k}, x{k - 1})"})
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, case when x{n - 1} & {1 << b} <> 0 then {(1 << b) - 1} else 0 end)"
    then({}, f", {flip} as flip")
    index = " + ".join(f"(((xor(x{k}, flip) >> {b}) & 1) << {n * b + n - 1 - k})" for b in range(bits) for k in range(n))
    final = f"select {keep}, {cells}, cast({index} as bigint) as hilbert from s{step}"
    order = ", ".join(f"{c} nulls first" for c in ["hilbert", tie, *dims])
    return f"with {', '.join(parts)}, h as ({final}), p as (select *, row_number() over (order by {order}) - 1 as position from h) select *, position // {run_rows} as run from p"
