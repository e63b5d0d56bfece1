"""Sets of fingerprints as tables of bits, of bounded size, that tasks hold as a whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_EACH, MOST_BITS = 16, 1 << 27
_U = np.uint64
ODD = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(33))


class Bits:
    """The fingerprints of a column ``fp``: never misses one, passes few others unless it is full."""

    def __init__(self, prints: DataFrame):
        size = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * prints.count()).bit_length()))
        self.mask = _U(size - 1)

        def positions(batches):
            for batch in batches:
                at = np.concatenate(self.at(batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)))
                word, order = np.unique(at >> _U(6), return_inverse=True)
                bit = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bit, order, _U(1) << (at & _U(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bit"])

        got = prints.select("fp").mapInArrow(positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        self.table = np.zeros(size >> 6, np.uint64)
        self.table[got["word"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)

    def at(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mixed(prints) & self.mask, mixed(prints ^ ODD) & self.mask

    def holds(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), bool)
        for at in self.at(prints):
            out &= (self.table[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)
        return out
