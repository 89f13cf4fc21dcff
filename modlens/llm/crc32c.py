"""CRC-32C of many byte strings at once, with numpy.

The checksum is linear: strings are cut into blocks, the blocks of all strings advance together, eight
bytes a step, and block checksums join pairwise by a table for "so many zero bytes follow".
"""

from __future__ import annotations

import numpy as np

#: The Castagnoli polynomial, reversed: a fixed value of the format.
POLYNOMIAL = 0x82F63B78
BLOCK = 256


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


BYTE = _byte_table()


def _shift_one(crc: np.ndarray) -> np.ndarray:
    return BYTE[crc & 0xFF] ^ (crc >> np.uint32(8))


def _table_of(step) -> np.ndarray:
    """A linear map of 32 bits as four tables of 256 entries."""
    return np.stack([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


#: SHIFT[k] appends 2**k zero bytes.
SHIFT = [_table_of(_shift_one)]
for _ in range(40):
    SHIFT.append(_table_of(lambda crc: _apply(SHIFT[-1], _apply(SHIFT[-1], crc))))
#: What byte k of eight adds after the bytes behind it have passed.
EIGHT = [BYTE]
for _ in range(7):
    EIGHT.append(_shift_one(EIGHT[-1]))


def crc32c(strings: list[bytes]) -> np.ndarray:
    """The checksum of each string, as unsigned 32-bit integers."""
    if not strings:
        return np.zeros(0, dtype=np.uint32)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    ends = np.cumsum(blocks)
    raw = np.zeros(int(ends[-1]) * BLOCK, dtype=np.uint8)
    for s, end in zip(strings, ends.tolist(), strict=True):  # zeros in front change nothing
        if s:
            raw[end * BLOCK - len(s) : end * BLOCK] = np.frombuffer(s, dtype=np.uint8)
    columns = raw.reshape(-1, BLOCK)
    crc = np.zeros(len(columns), dtype=np.uint32)
    for at in range(0, BLOCK, 8):
        part = columns[:, at : at + 8]
        low = part[:, :4].copy().view("<u4")[:, 0] ^ crc
        crc = EIGHT[3][part[:, 4]] ^ EIGHT[2][part[:, 5]] ^ EIGHT[1][part[:, 6]] ^ EIGHT[0][part[:, 7]]
        for k in range(4):
            crc = crc ^ EIGHT[7 - k][low >> np.uint32(8 * k) & np.uint32(0xFF)]
    # Blocks join in pairs, counted from each string's end.
    level = BLOCK.bit_length() - 1
    while (blocks > 1).any():
        starts = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(len(blocks)), blocks)
        from_end = blocks[owner] - 1 - (np.arange(len(crc)) - starts[owner])
        left = from_end % 2 == 1
        joined = crc.copy()
        at = np.flatnonzero(left)
        joined[at + 1] ^= _apply(SHIFT[level], crc[at])
        crc = joined[~left]
        blocks = (blocks + 1) // 2
        level += 1
    start = np.full(len(strings), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(lengths.max()).bit_length()):
        on = (lengths >> k & 1).astype(bool)
        start[on] = _apply(SHIFT[k], start[on])
    return crc ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum as record files store it: rotated by 15 bits, plus a fixed constant of the format."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
