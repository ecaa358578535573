"""Keys from file names, and hashes that other engines can repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of stems and names; fixed values.
EXPORTED = r"(?i)^(?:[0-9a-f]{8}-)?(.*?)_jpg\.rf\.[0-9a-f]+$"
DATE, AGE, DIGITS = r"[_-]?\d{4}[-_]?\d{2}[-_]?\d{2}.*$", r"(?i)[_-]?\d{1,3}\s*yo.*$", r"[_-]?\d{6,}.*$"
SAFE = r"(?i)^rf\.[0-9a-f]{6,}\.(jpg|jpeg|png)$"


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def source_key(name: Column) -> Column:
    """The original's name without the export's prefix and suffix, else the file's stem."""
    return F.when(F.rlike(stem(name), F.lit(EXPORTED)), F.regexp_extract(stem(name), EXPORTED, 1)).otherwise(stem(name))


def patient_key(source: Column) -> Column:
    """The source without dates, ages and long runs of digits at its end, lower-cased; the lower-cased source if nothing is left."""
    cut = source
    for pattern in (DATE, AGE, DIGITS):
        cut = F.regexp_replace(cut, pattern, "")
    return F.coalesce(F.nullif(F.lower(F.btrim(cut, F.lit("_- "))), F.lit("")), F.lower(source))


def anonymous(name: Column) -> Column:
    """The name from its first 'rf.' on; names without one get a hash and their extension."""
    at = F.instr(name, "rf.")
    extension = F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)), F.lit("")), F.lit(".jpg"))
    return F.when(at > 0, F.substr(name, at)).otherwise(F.concat(F.lit("rf."), F.substring(F.sha2(name, 256), 1, 32), extension))


def hash32(key: Column) -> Column:
    """The first 32 bits of the key's md5, as a long."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return hash32(key) / F.lit(float(1 << 32))


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * float(1 << 32)).astype(np.uint32)


def md5_heads(prefix: bytes, numbers: np.ndarray, at_once: int = 8192) -> np.ndarray:
    """The first 32 bits of the md5 of the prefix and each number (0 or more) in decimals, as hash32() gives them, many at once."""
    out = np.empty(len(numbers), dtype=np.uint32)
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), numbers, "right") + 1
    if len(prefix) + int(digits.max(initial=1)) > 55:
        raise ValueError("the prefix is too long")
    for n in np.unique(digits).tolist():
        rows = np.flatnonzero(digits == n)
        for i in range(0, len(rows), at_once):
            some = rows[i : i + at_once]
            out[some] = _md5_heads(prefix, numbers[some], n)
    return out


def _md5_heads(prefix: bytes, numbers: np.ndarray, n: int) -> np.ndarray:
    """md5_heads() of numbers of n digits: one block of 16 words each, of which only those with digits differ."""
    size = len(prefix) + n
    block = np.zeros((64, len(numbers)), dtype=np.uint32)
    block[: len(prefix)] = np.frombuffer(prefix, np.uint8)[:, None]
    left = numbers.astype(np.int64)
    for k in range(size - 1, len(prefix) - 1, -1):
        left, digit = np.divmod(left, 10)
        block[k] = digit + 48
    block[size], block[56], block[57] = 128, 8 * size & 255, 8 * size >> 8
    words = [block[4 * k] | block[4 * k + 1] << 8 | block[4 * k + 2] << 16 | block[4 * k + 3] << 24 for k in range((size + 4) // 4)]
    words += [np.uint32(0)] * (14 - len(words)) + [np.uint32(8 * size), np.uint32(0)]
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(numbers), v, dtype=np.uint32) for v in start)
    for k in range(64):
        turn = k // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), k
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * k % 16
        f += a
        f += _SINES[k] if np.ndim(words[g]) == 0 and not words[g] else _SINES[k : k + 1] + words[g]
        s = int(_TURNS[turn, k % 4])
        a, d, c, b = d, c, b, b + (f << np.uint32(s) | f >> np.uint32(32 - s))
    return (a + start[0]).byteswap()
