"""Operator 5: token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a doubly linked list; a heap holds the rank of
every adjacent pair that has one. The lowest rank, leftmost first, is popped and
merged until no pair is left, so a pre-token counts its initial symbols minus
its merges. Token identifiers are never produced.

The vocabulary file (its path is a parameter) gives the merge ranks and the
special strings; its normaliser and pre-tokeniser are those of the lower-case
word-end family: NFC, white space to a space, lower case, then contractions,
letter runs, single digits and runs of other characters. A file of another kind
is refused. A worker parses the file once; the counts of recent pre-tokens, and of recent
pieces between ASCII white space, are kept in memos with a fixed number of entries.

Defined results: null and empty texts have 0 bytes and 0 tokens; very long texts
are counted whole; repeated rows count alike; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_ENTRIES = 400_000


class PairMerger:
    """Counts tokens of pre-tokens given as tuples of symbols."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {}
        for k, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), k)

    def count(self, symbols: list[str]) -> int:
        n = len(symbols)
        if n < 2:
            return n
        sym = list(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        # an entry is rank * n + place, so the heap orders by rank, then from the left
        heap = [r * n + i for i, pair in enumerate(zip(sym, sym[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = right[i]
            if j >= n or rank.get((sym[i], sym[j])) != r:
                continue  # one side has been merged since
            merges += 1
            sym[i], sym[j] = sym[i] + sym[j], None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, r * n + i)
            if (h := left[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, r * n + h)
        return n - merges


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Memo(dict):
    """Results of ``make`` for recent keys; emptied when it has ``MEMO_ENTRIES``."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        n = self.make(key)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(key) <= 64:
            self[key] = n
        return n


class TokenCounter:
    """Token count of a text. No pre-token holds white space, so a text is cut at ASCII white space first."""

    def __init__(self, spec: dict):
        model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        splits = pre.get("pretokenizers", [])
        if (model.get("type", "BPE") != "BPE" or model.get("byte_fallback") or model.get("dropout")
                or model.get("continuing_subword_prefix") or model.get("ignore_merges")
                or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"]
                or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]
                       for t in spec.get("added_tokens", []))):
            raise ValueError("not a lower-case byte-level vocabulary with word ends")
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger = PairMerger(pairs)
        self.byte = byte_symbols()
        # \s of the file's pattern language is the White_Space property
        self.find = regex.compile(splits[0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"), regex.V0).findall
        special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(c.isspace() for t in special for c in t):
            raise ValueError("special strings with white space are not supported")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

        self.tokens, self.pieces = Memo(self._pre_token), Memo(self._piece)

    def _pre_token(self, token: str) -> int:
        symbols = [self.byte[b] for b in token.encode()]
        symbols[-1] += self.suffix
        return self.merger.count(symbols)

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # lower case by character, not by word
        return sum(map(self.tokens.__getitem__, self.find(text.lower())))

    def _piece(self, piece: bytes) -> int:
        text = piece.decode()
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def count(self, text: bytes) -> int:
        return sum(map(self.pieces.__getitem__, text.split()))


_counters: dict[str, TokenCounter] = {}


def counter_for(raw: str) -> TokenCounter:
    """The counter of a vocabulary; a worker process keeps it, and its memo, from task to task."""
    if raw not in _counters:
        _counters.clear()
        _counters[raw] = TokenCounter(json.loads(raw))
    return _counters[raw]


def token_count(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is a path that the driver can read; the parsed file travels to
    the tasks in a broadcast, whose size is the file's and not the data's."""
    with open(vocabulary, encoding="utf-8") as f:
        raw = f.read()
    TokenCounter(json.loads(raw))  # refuse a wrong file before any job starts
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(shared.value)
        for b in batches:
            n = [counter.count(t) if t else 0 for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             [b.schema.names[0], "n_bytes", "n_tokens"])
    kind = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return (docs.select(F.col(id_col), n_bytes.alias("n_bytes"), F.col(text_col))
            .mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
