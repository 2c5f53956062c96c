"""The likelihood cut of near dedup loses no more than the README says."""

import math

import pyarrow as pa

from leadloom.llm import near_dedup as D


def test_pair_at_the_threshold_passes_the_cut():
    m, threshold = D.BANDS * D.ROWS, 0.8
    group = pa.RecordBatch.from_pydict({"node": [0], "regs": [bytes(2 * m)], "n": [1], "side": [-1]})
    cell = D.Sketched(group, m, threshold)
    errors = (threshold - cell.least) / math.sqrt(threshold * (1 - threshold) / m)
    assert math.erfc(errors / math.sqrt(2)) / 2 < 3e-7
