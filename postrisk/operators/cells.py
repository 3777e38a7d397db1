"""Numpy helpers for rows whose features are a map from term to bin, used inside Arrow tasks by ``boosting`` and ``forest``.

Rows are dealt into tasks of about ``TASK_CELLS`` entries, so a task's share doesn't grow with the table
(nor with how well its files are packed). A task holds one slice of rows at a time, a matrix of that slice
by the terms that the trees ask for (at most ``MATRIX`` values, or one row), and partial sums of at most ``SUMS`` lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.session import MATERIALIZED, materialize, release

TASK_CELLS = 500_000
SLICE_CELLS = 500_000
MATRIX = 4_000_000
SUMS = 500_000
DENSE = 2_000_000


def unpack(rows: DataFrame) -> DataFrame:
    """The map as two lists, ``_terms`` and ``_bins``, which are what the tasks read."""
    return rows.withColumns({"_terms": F.map_keys("cells"), "_bins": F.map_values("cells")}).drop("cells")


def dealt(rows: DataFrame, name: str) -> DataFrame:
    """A stored copy of unpacked rows, dealt evenly into as many files as their entries fill."""
    once = materialize(rows, name)
    path = MATERIALIZED[-1]
    n = once.agg(F.sum(F.size("_terms") + 8)).first()[0] or 0
    out = materialize(once.repartition(max(1, -(-n // TASK_CELLS))), name)
    release(rows.sparkSession, [path])
    return out


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.value_lengths().fill_null(0), np.int64)


class Slice:
    """Some rows of a batch: their entries as (row, code of the term in ``terms``, bin)."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        terms, bins = (batch.column(batch.schema.get_field_index(c)) for c in ("_terms", "_bins"))
        coded = terms.flatten().dictionary_encode()
        self.terms: list[str] = coded.dictionary.to_pylist()
        self.code = np.asarray(coded.indices, np.int64)
        self.bin = np.asarray(bins.flatten(), np.int64)
        self.row = np.repeat(np.arange(len(batch)), _sizes(terms))

    def __len__(self) -> int:
        return len(self.batch)

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(self.batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def matrix(self, places: dict[str, int]) -> np.ndarray:
        """Bin of every row for the given terms (0 where absent, and in a last column for no term)."""
        place = np.array([places.get(t, -1) for t in self.terms], np.int64)
        at = place[self.code] if len(place) else self.code
        ok = at >= 0
        out = np.zeros((len(self), len(places) + 1), np.int32)
        out[self.row[ok], at[ok]] = self.bin[ok]
        return out


def slices(batches: Iterator[pa.RecordBatch], asked: int) -> Iterator[Slice]:
    """Runs of rows of up to ``SLICE_CELLS`` entries whose matrix of ``asked`` terms stays small."""
    most = max(1, MATRIX // (asked + 1))
    for b in batches:
        bounds = np.concatenate([[0], np.cumsum(_sizes(b.column(b.schema.get_field_index("_terms"))))])
        i = 0
        while i < len(b):
            j = max(i + 1, min(i + most, int(np.searchsorted(bounds, bounds[i] + SLICE_CELLS, "right")) - 1))
            yield Slice(b.slice(i, j - i))
            i = j


class Sums:
    """Integer sums by (group, term, bin), exact and in any order; ``full`` says when to send them on."""

    def __init__(self, n_values: int):
        self.n_values, self.codes, self.parts, self.size = n_values, {}, [], 0

    def add(self, group: np.ndarray, terms: list[str], code: np.ndarray, bins: np.ndarray, values: list[np.ndarray]) -> None:
        """``code`` -1 stands for no term."""
        mine = np.array([self.codes.setdefault(t, len(self.codes)) for t in terms] + [-1], np.int64)
        self._keep(group, mine[code], bins, values)

    def _keep(self, group, code, bins, values) -> None:
        if not len(group):
            return
        names, g = np.unique(group, return_inverse=True)
        n_codes, n_bins = int(code.max()) + 2, int(bins.max()) + 1
        key = (g * n_codes + code + 1) * n_bins + bins
        if len(names) * n_codes * n_bins <= DENSE and all(float(np.abs(v).max()) * len(v) < 1 << 53 for v in values):
            first = np.flatnonzero(np.bincount(key))  # sums below 2**53 are exact in doubles
            sums = [np.bincount(key, weights=v, minlength=first[-1] + 1)[first].astype(np.int64) for v in values]
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            first, sums = key[at], [np.add.reduceat(v[order], at) for v in values]
        self.parts.append((names[first // (n_codes * n_bins)], first // n_bins % n_codes - 1, first % n_bins, sums))
        self.size += len(first)
        if self.size > SUMS and len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            self._keep(*[np.concatenate([p[i] for p in parts]) for i in range(3)],
                       [np.concatenate([p[3][i] for p in parts]) for i in range(self.n_values)])

    @property
    def full(self) -> bool:
        return self.size > SUMS // 2 and len(self.parts) == 1

    def take(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, list[np.ndarray]]]:
        """Group, term, bin and sums of what was added so far."""
        if not self.parts:
            return
        if len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            self._keep(*[np.concatenate([p[i] for p in parts]) for i in range(3)],
                       [np.concatenate([p[3][i] for p in parts]) for i in range(self.n_values)])
        (g, c, b, v), names = self.parts[0], pa.array(list(self.codes), pa.string())
        yield g, names.take(pa.array(c, mask=c < 0)), b, v
        self.codes, self.parts, self.size = {}, [], 0
