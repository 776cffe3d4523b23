"""Memory of the scoring step."""

import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa

from seedmill.operators.retrieval import _scored


def test_blocks_become_python_values_one_at_a_time(spark):
    frames = MagicMock()
    _scored(frames, MagicMock(), 2, ("long", "long"))
    score = frames.select.return_value.join.return_value.mapInArrow.call_args.args[0]
    rows, ids = 400, list(range(128))
    vectors = np.ones((128, 64)).tobytes()
    batch = pa.RecordBatch.from_pydict(
        {
            "block": list(range(rows)), "asked": [[7]] * rows, "queries": [np.ones(64).tobytes()] * rows,
            "n": [128] * rows, "ids": [ids] * rows, "vectors": [vectors] * rows,
        }
    )
    tracemalloc.start()
    found = sum(out.num_rows for out in score(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2 * rows
    # All rows at once would be 26 MB.
    assert peak < 8e6
