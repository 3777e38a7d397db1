"""Shared helpers: Arrow text buffers, vectorised word and hash kernels, bounded filters.

The kernels work on the concatenated UTF-8 bytes of a chunk of documents (one
Arrow batch is cut into chunks of about ``CHUNK_BYTES``), so their memory is
bounded by the chunk, or by the longest single document. Words never span two
documents. All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postrisk.session import MATERIALIZED, materialize, release, table_path

CHUNK_BYTES = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"
_PRIME = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_PRIME, -1, 1 << 64)
_U = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def write_cut(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back (cuts lineage)."""
    out = materialize(df, f"llm-{name}", options)
    out._scratch = MATERIALIZED[-1]
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``write_cut`` that no later plan reads."""
    for t in tables:
        release(t.sparkSession, [t._scratch])


def byte_table(members: bytes | str) -> np.ndarray:
    """256 flags: which bytes belong to ``members``."""
    t = np.zeros(256, bool)
    t[list(members if isinstance(members, bytes) else members.encode())] = True
    return t


IS_BLANK = byte_table(BLANKS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 2)

        def series(base: int) -> np.ndarray:
            x = np.full(size, base, _U)
            x[0] = 1
            return np.cumprod(x)
        _powers, _inverses = series(_PRIME), series(_INVERSE)
    return _powers, _inverses


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the bytes; see ``span_hash``."""
    p, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * p[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``[start, end)`` of every span: equal bytes, equal hash."""
    _, inv = _power_tables(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words of a chunk: byte spans, owning row and position ranges by row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_gap: np.ndarray):
        word = ~is_gap[data]
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        full = offs[1:] > offs[:-1]
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
        self.mask = word
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offs)  # row r owns words bounds[r]:bounds[r + 1]
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(offs) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words, and which of them lie in one row."""
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, _U)
    for i in range(k):
        g = (g + h[i:i + n]) * _U(_PRIME)
    return mix(g), (row[:n] == row[k - 1:k - 1 + n] if n else np.zeros(0, bool))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over ``bounds[r]:bounds[r + 1]``."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def within_rows(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash that tells equal values of different rows apart."""
    return mix(h + (row.astype(_U) + _U(1)) * _U(0xA24BAED4963EE407))


def seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key: does an equal one come earlier; does an equal one come anywhere else."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    other = same.copy()
    other[:-1] |= same[1:]
    earlier, repeated = np.empty(len(s), bool), np.empty(len(s), bool)
    earlier[order], repeated[order] = same, other
    return earlier, repeated


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in any ``[start, start + length)``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:n]) > 0


def hash_sample(keys: DataFrame, n: int, column: str) -> DataFrame:
    """The first ``n`` rows of a table of distinct keys in the order of their hashes.

    A count sets a threshold that about ``4 n`` hashes pass, so the tasks together send
    that many rows to the final sort, however long the table is."""
    h = F.xxhash64(column, F.lit("sample"))
    total = keys.count()
    if total > 8 * n:
        keys = keys.where(h < F.lit(int(4 * n / total * 2 ** 64) - 2 ** 63).cast("long"))
    return keys.orderBy(h, column).limit(n)


# ---- a filter of fixed size ------------------------------------------------

FILTER_BITS = 24


def fixed_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter with two probes over a long column: always ``2**bits`` bits.

    Spark ORs the bits by machine word, so at most ``2**bits / 64`` rows reach
    the driver however many keys there are. It has no false negatives; a fuller
    filter only lets more rows pass to the exact join behind it."""
    k = F.col(column)
    probe = F.explode(F.array(F.shiftrightunsigned(k, 64 - bits), k.bitwiseAND((1 << bits) - 1)))
    rows = (keys.where(k.isNotNull()).select(probe.alias("p"))
            .groupBy(F.shiftrightunsigned("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow())  # a row object each would be 20 times as much
    out = np.zeros((1 << bits) // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(_U)


def may_contain(filter_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = (len(filter_words) * 64).bit_length() - 1
    keys = keys.astype(_U, copy=False)

    def hit(p: np.ndarray) -> np.ndarray:
        return (filter_words[p >> _U(6)] >> (p & _U(63))) & _U(1) == _U(1)
    return hit(keys >> _U(64 - bits)) & hit(keys & _U((1 << bits) - 1))
