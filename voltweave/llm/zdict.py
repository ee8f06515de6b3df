"""Window compression against raw-content zstandard dictionaries, many windows a call."""

from __future__ import annotations

import numpy as np
import zstandard


class Coder:
    """Compressed lengths of windows under one raw-content dictionary."""

    def __init__(self, content: bytes, search_log: int = 4):
        # lazy matching with matches from four bytes: short words count, and the last bytes of the content are nearest
        params = zstandard.ZstdCompressionParameters(
            window_log=max(10, (len(content) + 8192).bit_length()), hash_log=17, chain_log=17, search_log=search_log, min_match=4,
            target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False,
        )
        extra = {}
        if len(content) >= 8:  # the library takes no shorter dictionary
            extra["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            extra["dict_data"].precompute_compress(compression_params=params)
        self._z = zstandard.ZstdCompressor(compression_params=params, **extra)

    def lengths(self, data: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Compressed bytes of each window ``data[starts[i]:ends[i]]``; an empty window has length 0."""
        out = np.zeros(len(starts), np.int64)
        full = np.flatnonzero(ends > starts)
        if not len(full):
            return out
        segments = np.stack([starts[full], ends[full] - starts[full]], axis=1).astype(np.uint64)
        packed = self._z.multi_compress_to_buffer(zstandard.BufferWithSegments(bytes(data), segments.tobytes()))
        out[full] = np.fromiter((len(packed[i]) for i in range(len(full))), np.int64, len(full))
        return out


def windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each row into windows of about ``width`` bytes that end at white space; no byte is left out.

    Returns row, start and end of the windows.  A word longer than ``width`` is not cut.
    """
    size = np.diff(offsets)
    k = np.maximum(1, -(-size // width))
    row = np.repeat(np.arange(len(size)), k)
    j = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    aim = offsets[row] + j * width
    space = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    at = np.searchsorted(space, aim)
    snapped = np.append(space, len(data))[at]
    start = np.where(j == 0, offsets[row], np.minimum(snapped, offsets[row + 1]))
    end = np.append(start[1:], offsets[-1])
    end = np.where(np.append(row[1:] != row[:-1], True), offsets[row + 1], end)
    keep = (end > start) | (j == 0)
    row, start, end = row[keep], start[keep], end[keep]
    return row, start, end
