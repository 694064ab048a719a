"""Statistics of whole texts, computed over the bytes of a batch at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_slices, utf8

#: Shares of a text's bytes: name and the bytes counted.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "mark": b".,;:'\"?()-",
    "shout": b"!",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
}
STATS = ["log_words", "mean_word", "longest_word", "distinct_words", "top_word", "long_run", "log_lines", "mean_line", "distinct_lines", "top_line", "sentences", "other"] + list(_CLASSES)


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for i, own in enumerate(_CLASSES.values(), 1):
        table[list(own)] = i
    return table


def text_stats(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``STATS`` for each text; all zero for null, empty and blank ones."""
    texts = [t or b"" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), len(STATS)))
    kinds = _class_table()[np.frombuffer(b"".join(texts) or b"\0", np.uint8)]
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    at = len(STATS) - len(_CLASSES)
    if len(full):
        for i in range(len(_CLASSES)):
            out[full, at + i] = np.add.reduceat((kinds == i + 1).view(np.uint8), starts, dtype=np.int64) / sizes[full]
        out[full, at - 1] = np.maximum(0, 1 - out[full, at:].sum(axis=1))
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if not n:
            out[i] = 0
            continue
        counts = Counter(words)
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        by_line = Counter(lines)
        ends = t.count(b".") + t.count(b"!") + t.count(b"?")
        run = max(counts.values())
        repeats = sum(map(bytes.__eq__, words, words[1:]))
        out[i, :11] = [
            np.log2(1 + n), (len(t) - n) / n, max(map(len, counts)), len(counts) / n, run / n, repeats / n,
            np.log2(1 + len(lines)), n / len(lines), len(by_line) / len(lines), max(by_line.values()) / len(lines), ends / n,
        ]
    return out


def with_text_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, *STATS)`` for every row. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                stats = text_stats(utf8(part.column("t")).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array(stats[:, i]) for i in range(len(STATS)))], [id_col, *STATS])

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(kernel, f"`{id_col}` {kind}, " + ", ".join(f"{s} double" for s in STATS))
