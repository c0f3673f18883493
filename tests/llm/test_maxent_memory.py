import pickle
import tracemalloc
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from passagemill.llm import maxent


def test_blocks_of_megabytes_are_row_groups_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maxent, "scratch_path", lambda _: str(tmp_path / "blocks"))
    rng = np.random.default_rng(4)
    rows = [(k, bytearray(rng.bytes(9 << 20))) for k in range(3)]
    blocks = spark.createDataFrame(rows, "block long, numbers binary").coalesce(1)
    blocks = maxent._written(blocks)
    groups = []
    for name in blocks.inputFiles():
        found = pq.ParquetFile(urlparse(name).path).metadata
        groups += [found.row_group(i).num_rows for i in range(found.num_row_groups)]
    assert groups == [1, 1, 1]
    in_batches = lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches)
    with maxent.small_batches(spark):
        assert [r.n for r in blocks.coalesce(1).mapInArrow(in_batches, "n long").collect()] == [1, 1, 1]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def _row(words, sizes):
    rng = np.random.default_rng(2)
    return {
        "numbers": rng.integers(0, len(words), size=sum(sizes)).astype(np.int32).tobytes(), "words": words.view(np.int64),
        "tails": np.zeros(len(words), dtype=np.int32), "sizes": np.array(sizes).tobytes(), "train": np.ones(len(sizes), dtype=np.uint8).tobytes(),
    }


def test_a_training_task_holds_its_tables_once():
    words = np.arange(40, dtype=np.uint64) << np.uint64(20)
    facts = maxent.Facts(10**9, 40, 0, words, np.arange(40), np.zeros(maxent.FAN**3, dtype=np.int64))
    tables = {level: t + np.float32(0.5) for level, t in maxent.zero(facts, [0, 1, 2]).items()}
    size = sum(t.nbytes for t in tables.values())
    sent = pickle.dumps((maxent.Start(tables), facts), protocol=5)
    del tables
    tracemalloc.start()
    try:
        start, known = pickle.loads(sent)
        tracemalloc.reset_peak()
        learnt, used = maxent.learn(iter([_row(words, [30, 20, 50])]), start.tables, known, 1)
        assert tracemalloc.get_traced_memory()[1] < 1.3 * size
    finally:
        tracemalloc.stop()
    for level, table in start.tables.items():
        assert (table == np.float32(0.5)).all() and not table.flags.writeable
        moved = (learnt[level] != table).any(axis=1)
        # A row whose tokens are predicted without any doubt need not move, but no other row does.
        assert moved.any() and not (moved & (used[level] == 0)).any()
