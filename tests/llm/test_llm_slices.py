"""Python steps over texts hold few of them at a time, whatever the size of Spark's batches."""

import glob
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from samples import texts
from test_llm_pipeline import write_tables
from voltrail.llm import decontaminate, line_dedup, quality, slices
from voltrail.llm.quality import train_scorer
from voltrail.llm.slices import SLICE_ROWS, by_slices
from voltrail.session import large_rows_written


def test_work_sees_a_slice_at_a_time():
    sizes = []

    def work(words, numbers):
        sizes.append(len(words))
        return [(w, n) for w, n in zip(words, numbers)]

    kind = pa.struct([("word", pa.string()), ("number", pa.int64())])
    rows = [(None if i % 7 == 0 else f"w{i}", i) for i in range(2 * SLICE_ROWS + 3)]
    columns = [pa.array(x) for x in zip(*rows)]
    out = by_slices(work, kind, *columns)
    assert sizes == [SLICE_ROWS, SLICE_ROWS, 3]
    assert [tuple(x.values()) for x in out.to_pylist()] == rows
    assert len(by_slices(work, kind, *(c.slice(0, 0) for c in columns))) == 0


@pytest.mark.parametrize("name, module", [("quality", quality), ("line_dedup", line_dedup), ("decontamination", decontaminate)])
def test_stages_take_texts_in_slices(spark, tmp_path, monkeypatch, name, module):
    """A batch of 1,500 texts in one file reaches no Python step as 1,500 texts."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 100)
    folder = tmp_path / "sizes"
    folder.mkdir()
    own = slices.by_slices

    def noted(work, kind, *columns):
        def counted(*rows):
            with open(f"{folder}/{len(rows[0])}", "w"):
                return work(*rows)
        return own(counted, kind, *columns)

    monkeypatch.setattr(module, "by_slices", noted)
    rows = list(enumerate(texts(1500, 4)))
    docs = write_tables(spark, str(tmp_path), rows, [(i, 1, 0) for i in range(20)], [(1, " ".join(f"exam{i}" for i in range(40)))])
    left = dict(corpus_pipeline.STAGES)[name](spark, docs.coalesce(1), str(tmp_path))
    assert left.count() <= 1500
    left.write.parquet(f"{tmp_path}/left")
    assert max(int(f.name) for f in folder.iterdir()) == 100


def test_scorer_keeps_one_set_of_features():
    """The list is thinned where it is; rare features have no weight."""
    features = [np.array([1, 2, 100 + i], np.int32) for i in range(20)] + [np.array([3, 500 + i], np.int32) for i in range(20)]
    weights = train_scorer(features, np.repeat([1.0, 0.0], 20))
    assert [x.tolist() for x in features] == [[1, 2]] * 20 + [[3]] * 20
    assert set(np.flatnonzero(weights[:-1])) == {1, 2, 3} and weights[1] > 0 > weights[3]


def test_large_rows_after_small_ones(spark):
    """Links come before packed keys in one file: row groups stay small, and so do the buffers of who writes and reads."""
    def rows(batches):
        for _ in batches:
            yield pd.DataFrame({"a": range(500), "keys": None})
            for _ in range(200):
                yield pd.DataFrame({"a": [0], "keys": [os.urandom(200_000)]})

    held = large_rows_written(spark.range(1).coalesce(1).mapInPandas(rows, "a long, keys binary"), "large")
    assert held.count() == 700
    folder = held.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    sizes = [f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    assert sum(sizes) > 40_000_000 and max(sizes) < 24_000_000
