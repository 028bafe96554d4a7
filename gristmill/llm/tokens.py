"""Words of whole batches of texts as 64-bit hashes, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gristmill.llm.ngram_join import BLANK, BYTE, Powers, U, mix

#: Bytes of text that are looked at together, about; a longer text is alone.
BLOCK = 1 << 22
#: What separates terms: ASCII but for letters and digits.
NO_TERM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
__all__ = ["BLANK", "NO_TERM", "blocks", "hashed_words"]


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in column number text have about so many bytes each time (one text may have more)."""
    for batch in batches:
        sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text).cast(pa.large_binary())), np.int64, batch.num_rows)
        part = np.cumsum(sizes) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def hashed_words(texts: pa.Array, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts (A-Z lower-cased), and how many words each text has. blank: by byte, whether it separates words."""
    each = [(t.as_py() or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(each).lower(), np.uint8)  # lower() of bytes is A-Z only
    gap = np.r_[True, blank[data], True]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = Powers.upto(len(data) + 1)
    run = np.r_[U(0), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)]
    words = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in each])
    upto = np.searchsorted(start, limits)
    return words, np.diff(np.r_[0, upto])
