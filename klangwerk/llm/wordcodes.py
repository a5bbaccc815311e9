"""Arrow lists of words as NumPy codes, so that per-word work in Python happens once per distinct word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def list_codes(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the code of every word in order, and where each row's words start (rows + 1 entries)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    starts = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=starts[1:])
    coded = pc.dictionary_encode(lists.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), starts


def without_empty(distinct: list[str], codes: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The result of list_codes without empty words."""
    real = np.array([w != "" for w in distinct], bool)
    if real.all():
        return distinct, codes, starts
    keep = real[codes]
    number = np.cumsum(real) - 1
    return [w for w in distinct if w], number[codes[keep]], np.concatenate([[0], np.cumsum(keep)])[starts]


#: Put after every word of a marked text.
MARK = "\x01"


def marked_codes(marked: pa.Array, whole: pa.Array, words) -> tuple[list[str], np.ndarray, np.ndarray]:
    """list_codes of texts whose words are marked; ``words`` splits those that come whole, since they hold the mark."""
    lists = pc.split_pattern(pc.fill_null(marked, ""), MARK)
    if whole.null_count < len(whole):
        rows = lists.to_pylist()
        for i, text in enumerate(whole.to_pylist()):
            if text is not None:
                rows[i] = words(text)
        lists = pa.array(rows, pa.list_(pa.string()))
    return without_empty(*list_codes(lists))


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The concatenation of flat[begin[c] : begin[c] + length[c]] over codes."""
    n = length[codes]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(begin[codes] - ends + n, n) + np.arange(ends[-1])]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased, between ASCII white space) of all texts, and where each text's begin."""
    from pandas.util import hash_array

    distinct, codes, starts = list_codes(pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    if not distinct:
        return np.zeros(0, np.uint64), starts
    real = np.array([w != "" for w in distinct])[codes]
    hashes = hash_array(np.array(distinct, dtype=object), categorize=False)[codes[real]]
    return hashes, np.concatenate([[0], np.cumsum(real)])[starts]


def slices(batches, column: int, rows: int, size: int):
    """Parts of the batches with at most so many rows and bytes of the text column (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        past = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < b.num_rows:
            full = past[begin - 1] if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(past, full + size, side="right"))))
            yield b.slice(begin, end - begin)
            begin = end
