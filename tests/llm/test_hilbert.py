"""The curve, the cells and the order against plain statements of them."""

import itertools

import numpy as np
import pytest

from cataloom.llm import hilbert


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def _brute(rows, bits, run_rows):
    """(position, run) of rows (doc_id, lang, source, n_chars) in order."""
    key = lambda v: (v is not None, v)
    cells = []
    for k in (1, 2, 3):
        values = sorted((key(r[k]) for r in rows))
        cells.append([values.index(key(r[k])) * (1 << bits) // len(rows) for r in rows])
    index = hilbert.curve_index(np.array(cells).T, bits)
    order = sorted(range(len(rows)), key=lambda i: (index[i], *(key(v) for v in rows[i])))
    return [(*rows[i], int(index[i]), p, p // run_rows) for p, i in enumerate(order)]


def test_order_as_by_sorting_all(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i) if i % 7 else None, [None, "en", "de", "fr"][draw.integers(4)], f"s{draw.integers(9)}", int(draw.integers(50)) if draw.integers(5) else None) for i in range(300)]
    rows += rows[:5]  # repeated rows
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, lang string, source string, n_chars long, run string, hilbert int")
    out = hilbert.ordered(docs, bits=5, run_rows=16)
    got = sorted((tuple(r[c] for c in ("doc_id", "lang", "source", "n_chars", "hilbert", "position", "run")) for r in out.collect()), key=lambda r: r[5])
    assert got == _brute(rows, 5, 16)
    bounds = {r["run"]: r for r in hilbert.manifest(out).collect()}
    assert sum(r["rows"] for r in bounds.values()) == len(rows) and all(r["rows"] == 16 for k, r in bounds.items() if k < max(bounds))
    for r in got:
        if r[3] is not None:
            assert bounds[r[6]]["least_n_chars"] <= r[3] <= bounds[r[6]]["greatest_n_chars"]


def test_written_runs_hold_all_rows_and_prune(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = hilbert.write(docs, str(tmp_path / "runs"), run_rows=64)
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert back.drop("run").exceptAll(docs).isEmpty() and back.count() == docs.count()
    hit = runs.filter("least_n_chars <= 100 and least_source <= 'src7' and greatest_source >= 'src7'").count()
    assert hit < runs.count() / 2  # a range on two dimensions reads less than half of the files


def test_carried_columns_that_clash(spark, tmp_path):
    docs = spark.createDataFrame([(1, "en", "s", 3, "x", 9), (1, "en", "s", 3, "y", 9)], "doc_id long, lang string, source string, n_chars long, text string, Run int")
    hilbert.write(docs, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted(r["text"] for r in back.collect()) == ["x", "y"] and {r["run"] for r in back.collect()} == {0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, source string, n_chars long")
    assert hilbert.ordered(docs).count() == 0
