"""Operator 10: substring de-duplication by recompression.

Two naming rounds turn a document's words into a shorter string of symbols. Round
one names runs and pairs: a word's symbol says whether it starts, continues or
ends a run of equal words, and a symbol of the left half of the alphabet merges
with a following one of the right half. Round two pairs the symbols of round one
again. Names are 64-bit fingerprints of what they stand for and the halves are bits
of the names, so every executor gives equal substrings equal names, with no
dictionary to exchange. Whether two words end up in one symbol depends on at most
three words to either side; a symbol holds at most four words. So in a window of 13
words the symbols between its 4th and 10th word come out alike wherever the
window stands, and the one around the middle word is always among them.

Each window elects the least-named of these symbols. The elected symbols, with
three words on either side, are the high-level symbols that the following Spark
rounds share:

1. documents are packed into blocks of about a megabyte (compressed, in the
   checkpoint folder), whose ids all later rounds use;
2. every block sends its distinct elected symbols, dealt by name; those in two
   blocks, or in two documents of a block, are shared and go back to their blocks;
3. blocks send the fingerprints of the windows that elected a shared symbol,
   each with the smallest document id in the block; the smallest id over all
   blocks decides, and goes back where it is smaller than the block's own;
4. each block marks and removes the covered words.

A block sends a name once, whatever it holds, so a passage in a third of all
documents costs one record per block. The number of name ranges follows the
number of words, so a range is always about ``WORDS_PER_PART`` words' share.

Windows meet by a 64-bit fingerprint and are verified by a second one, which reads
their bytes again with another function: every byte of a word is hashed together
with its place, and every word with its place in the window. 32 bits of it are kept.
Both must agree (96 bits), so among 10^13 windows a single wrong match has a chance
of under one in a thousand.

Defined results: null, empty and short texts keep their words; a null id counts
as larger than every other; rows that share an id never remove from each other;
repeated windows inside one document alone stay; extra columns are ignored; an
empty table gives an empty result; very long texts make a block of their own.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.llm.common import IS_BLANK, Words, _power_tables, chunks, covered, mix, prefix_hash, span_hash, write_cut

WINDOW, REACH = 13, 3
WORDS_PER_PART = 2_000_000
MARK_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


def _pair_round(name: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, salt: int):
    """Merge each left-half symbol with a right-half symbol that follows it in its row."""
    right = (mix(name + _U(salt)) & _U(1)) == _U(1)
    merge = np.zeros(len(name), bool)  # merges with the next
    if len(name) > 1:
        merge[:-1] = ~right[:-1] & right[1:] & (row[:-1] == row[1:])
    head = np.ones(len(name), bool)
    head[1:] = ~merge[:-1]
    at = np.flatnonzero(head)
    two = merge[at]
    nxt = np.minimum(at + 1, len(name) - 1)
    joined = mix(name[at] * _U(0x9FB21C651E98DF25) + name[nxt] + _U(salt))
    return (np.where(two, joined, name[at]), row[at], start[at], length[at] + np.where(two, length[nxt], 0))


def recompress(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words) of the symbols after two rounds over word hashes ``h``."""
    n = len(h)
    same = np.zeros(n + 1, bool)
    same[1:n] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    name = mix(h + same[:n].astype(_U) * _U(0x632BE59BD9B4E019) + same[1:].astype(_U) * _U(0x8CB92BA72F3D8DD7))
    name, r, start, length = _pair_round(name, row, np.arange(n), np.ones(n, np.int64), 1)
    name, _, start, length = _pair_round(name, r, start, length, 2)
    return name, start, length


def _running(h: np.ndarray, salt: int) -> np.ndarray:
    p, _ = _power_tables(len(h) + 1)
    out = np.zeros(len(h) + 1, _U)
    np.cumsum(mix(h + _U(salt)) * p[:len(h)], out=out[1:])
    return out


def _span(running: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, inv = _power_tables(len(running))
    return mix((running[b] - running[a]) * inv[a] + (b - a).astype(_U))


def word_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every word by its bytes and their places, unrelated to ``span_hash``."""
    out = np.zeros(len(starts), _U)
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + MARK_BYTES, "right")) - 1)
        if j == i + 1:  # one word may be long: its bytes add up in parts
            total = 0
            for a in range(int(starts[i]), int(ends[i]), MARK_BYTES):
                x = data[a:min(a + MARK_BYTES, int(ends[i]))].astype(_U)
                place = np.arange(len(x), dtype=_U) + _U(a - int(starts[i]))
                total += int(mix(x + (place << _U(8))).sum(dtype=_U))
            out[i] = total & 0xFFFFFFFFFFFFFFFF
        else:
            head = size[i:j] - size[i]
            place = np.arange(size[j] - size[i]) - np.repeat(head, ends[i:j] - starts[i:j])
            x = data[np.repeat(starts[i:j], ends[i:j] - starts[i:j]) + place].astype(_U)
            out[i:j] = np.add.reduceat(mix(x + (place.astype(_U) << _U(8))), head)
        i = j
    return mix(out + (ends - starts).astype(_U))


class Parsed:
    """Words, windows and elected symbols of one block."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, elect: bool = True):
        (_, _, self.data, offs), = chunks(texts, 1 << 62)
        self.w = w = Words(self.data, offs, IS_BLANK)
        self.ids = ids
        self._marks = None
        h = span_hash(prefix_hash(self.data), w.starts, w.ends)
        n = len(h)
        m = max(0, n - WINDOW + 1)
        self.at = np.flatnonzero(w.row[:m] == w.row[n - m:]) if m else np.zeros(0, np.int64)  # first words of the windows
        self.fp = _span(_running(h, 11), self.at, self.at + WINDOW)
        self.owner = ids[w.row[self.at]] if n else np.zeros(0, np.int64)
        if not elect:
            return
        name, start, length = recompress(h, w.row)
        order = np.full(n, _TOP, _U)
        order[start] = mix(name + _U(3)) >> _U(1)
        size = np.zeros(n, np.int64)
        size[start] = length
        best = np.full(len(self.at), _TOP, _U)
        place = np.zeros(len(self.at), np.int64)
        for o in range(REACH, WINDOW - REACH):
            p = self.at + o
            x = np.where(o + size[p] <= WINDOW - REACH, order[p], _TOP)
            less = x < best
            best[less], place[less] = x[less], p[less]
        # a symbol elected by several windows in a row is one record
        self.elected, self.symbol = np.unique(place, return_inverse=True)
        key = _span(_running(h, 7), self.elected - REACH, self.elected + size[self.elected] + REACH)
        self.key = key


    def second(self, windows: np.ndarray) -> np.ndarray:
        """Second fingerprints (32 bits) of the windows with these numbers."""
        if not len(windows):
            return np.zeros(0, np.uint32)
        if self._marks is None:
            self._marks = word_marks(self.data, self.w.starts, self.w.ends)
        out, at = np.zeros(len(windows), _U), self.at[windows]
        for k in range(WINDOW):
            out += mix(self._marks[at + k] + _U(k * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        return (mix(out) >> _U(32)).astype(np.uint32)


def _groups(fp: np.ndarray, second: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both fingerprints and then owner, and the heads of equal ones in it."""
    order = np.lexsort((owner, second, fp))
    f, s = fp[order], second[order]
    return order, np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])]) if len(f) else np.zeros(0, bool)


def _least(fp: np.ndarray, second: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The smallest owner of every window's equals."""
    order, head = _groups(fp, second, owner)
    out = np.empty(len(fp), np.int64)
    out[order] = owner[order][np.flatnonzero(head)[np.cumsum(head) - 1]] if len(fp) else out
    return out


def _joint(fp: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(fp + mix(second.astype(_U) + _U(0x9E3779B97F4A7C15)))


def _code(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Name range, and 47 further bits. Names only preselect; a clash costs work, never a result."""
    return key % _U(parts), key >> _U(17)


def _pack6(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, k = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        for i, j, data, offs in chunks(b.column(1)):
            sink = io.BytesIO()
            part = b.slice(i, j - i)
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + k], pa.int64()), pa.array([int(Words(data, offs, IS_BLANK).counts.sum())], pa.int64()),
                 pa.array([sink.getvalue()], pa.binary())], ["block", "n_words", "payload"])
            k += 1


def _open_block(payload: bytes) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(id column, texts, ids for comparison) of a packed block."""
    t = pa.ipc.open_stream(payload).read_all().combine_chunks()
    ids = t.column(0).cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
    return t.column(0).combine_chunks(), t.column(1).combine_chunks(), ids


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            yield int(part[group[0]]), group


def _names(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, texts, ids = _open_block(payload)
                p = Parsed(texts, ids)
                if not len(p.key):
                    continue
                row = p.w.row[p.elected]
                part, code = _code(p.key, parts)
                order = np.lexsort((row, code, part))
                part, code, row = part[order], code[order], row[order]
                head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
                last = np.concatenate([head[1:], [len(code)]]) - 1
                several = (row[last] != row[head]).astype(_U)
                code = code[head]
                out = [(g, _pack6(code[k] << _U(1) | several[k])) for g, k in _by_part(part[head])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _ in out], pa.int32()), pa.array([block] * len(out), pa.int64()),
                     pa.array([x for _, x in out], pa.binary())], ["part", "block", "names"])
    return run


def _shared(t: pa.Table) -> pa.Table:
    """Names of a range that two blocks, or two documents of one, have: back to every block that has them."""
    lists = [_unpack6(x.as_py()) for x in t.column("names")]
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, inv, n = np.unique(flat >> _U(1), return_inverse=True, return_counts=True)
    several = np.zeros(len(n), bool)
    several[inv[(flat & _U(1)) == _U(1)]] = True
    keep = (n > 1)[inv] | several[inv]
    owner, flat = owner[keep], flat[keep] >> _U(1)
    at = np.searchsorted(owner, np.arange(len(lists) + 1))
    got = [k for k in range(len(lists)) if at[k + 1] > at[k]]
    return pa.table({"block": t.column("block").take(pa.array(got, pa.int64())),
                     "part": t.column("part").take(pa.array(got, pa.int64())),
                     "payload": pa.array([_pack6(flat[at[k]:at[k + 1]]) for k in got], pa.binary())})


def _windows(parts: int):
    def run(t: pa.Table) -> pa.Table:
        out = {"part": [], "block": [], "windows": [], "seconds": [], "ids": [], "owner": []}
        part = t.column("part").to_pylist()
        if None in part and len(part) > 1:
            payload = [x.as_py() for x in t.column("payload")]
            _, texts, ids = _open_block(payload[part.index(None)])
            p = Parsed(texts, ids)
            g, code = _code(p.key, parts)
            shared = np.concatenate([_U(k) << _U(47) | _unpack6(x) for k, x in zip(part, payload) if k is not None])
            use = np.isin(g << _U(47) | code, shared)[p.symbol]
            fp, second, owner = p.fp[use], p.second(np.flatnonzero(use)), p.owner[use]
            order, head = _groups(fp, second, owner)  # the smallest id of a window first
            fp, second, owner = (x[order][head] for x in (fp, second, owner))
            for k, at in _by_part(fp % _U(parts)):
                who, ref = np.unique(owner[at], return_inverse=True)
                out["part"].append(k)
                out["block"].append(t.column("block")[0].as_py())
                out["windows"].append(fp[at].tobytes())
                out["seconds"].append(second[at].tobytes())
                out["ids"].append(who.tobytes())
                out["owner"].append(ref.astype(np.uint16 if len(who) <= 1 << 16 else np.uint32).tobytes())
        return pa.table({"part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.int64()),
                         **{c: pa.array(out[c], pa.binary()) for c in ("windows", "seconds", "ids", "owner")}})
    return run


def _earlier(t: pa.Table) -> pa.Table:
    """Windows whose smallest document id is smaller than the block's own, back to the block."""
    fps, seconds, own = [], [], []
    for f, s, i, o in zip(t.column("windows"), t.column("seconds"), t.column("ids"), t.column("owner")):
        fp = np.frombuffer(f.as_py(), _U)
        ref = np.frombuffer(o.as_py(), np.uint16 if len(o.as_py()) == 2 * len(fp) else np.uint32)
        fps.append(fp)
        seconds.append(np.frombuffer(s.as_py(), np.uint32))
        own.append(np.frombuffer(i.as_py(), np.int64)[ref])
    fp, second, owner = np.concatenate(fps), np.concatenate(seconds), np.concatenate(own)
    late = _least(fp, second, owner) < owner
    ends = np.cumsum([len(x) for x in fps])
    blocks, payload = [], []
    for k, (b, hi) in enumerate(zip(t.column("block").to_pylist(), ends)):
        lo = hi - len(fps[k])
        if late[lo:hi].any():
            blocks.append(b)
            payload.append(b"".join(x[lo:hi][late[lo:hi]].tobytes() for x in (fp, second)))
    return pa.table({"block": pa.array(blocks, pa.int64()), "part": pa.array([0] * len(blocks), pa.int32()),
                     "payload": pa.array(payload, pa.binary())})


def _cut(with_text: bool):
    def run(t: pa.Table) -> pa.Table:
        part = t.column("part").to_pylist()
        payload = [x.as_py() for x in t.column("payload")]
        kept_id, texts, ids = _open_block(payload[part.index(None)])
        p = Parsed(texts, ids, elect=False)
        removed = np.zeros(len(p.w), bool)
        if len(p.at):
            late = np.zeros(len(p.at), bool)
            order = np.argsort(p.fp, kind="stable")
            equal = p.fp[order][1:] == p.fp[order][:-1]
            again = np.zeros(len(p.at), bool)
            again[order[1:][equal]] = again[order[:-1][equal]] = True
            again = np.flatnonzero(again)
            late[again] = p.owner[again] > _least(p.fp[again], p.second(again), p.owner[again])
            told = [x for k, x in zip(part, payload) if k is not None]  # first fingerprints, then second ones
            if told:
                first = np.concatenate([np.frombuffer(x, _U, len(x) // 12) for x in told])
                second = np.concatenate([np.frombuffer(x, np.uint32, offset=len(x) // 12 * 8) for x in told])
                met = np.flatnonzero(np.isin(p.fp, first))
                late[met] |= np.isin(_joint(p.fp[met], p.second(met)), _joint(first, second))
            removed = covered(p.at[late], WINDOW, len(p.w))
        gone = np.diff(np.concatenate([[0], np.cumsum(removed)])[p.w.bounds])
        raw, digests, texts_out = p.data.tobytes(), [], []
        for r in range(len(ids)):
            a, b = p.w.bounds[r], p.w.bounds[r + 1]
            words = [raw[s:e] for s, e, x in zip(p.w.starts[a:b], p.w.ends[a:b], removed[a:b]) if not x] if gone[r] \
                else raw[p.w.starts[a]:p.w.ends[b - 1]].split() if b > a else []
            kept = b" ".join(words)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts_out.append(kept.decode())
        cols = {"doc_id": kept_id, "n_words": pa.array(p.w.counts.astype(np.int64)),
                "n_removed": pa.array(gone.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept_text": pa.array(texts_out, pa.string())} if with_text else {}))
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and (``with_text``) kept_text: the kept words joined by one space.

    ``id_col`` is an integer column."""
    blocks = write_cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                       .mapInArrow(_pack_blocks, "block long, n_words long, payload binary"), "sub-blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, math.ceil(total / WORDS_PER_PART))
    packed = blocks.select("block", F.lit(None).cast("int").alias("part"), "payload")
    back = "block long, part int, payload binary"
    shared = write_cut(blocks.select("block", "payload").mapInArrow(_names(parts), "part int, block long, names binary")
                       .groupBy("part").applyInArrow(_shared, back), "sub-shared")
    late = write_cut(packed.unionByName(shared).groupBy("block")
                     .applyInArrow(_windows(parts), "part int, block long, windows binary, seconds binary, ids binary, owner binary")
                     .groupBy("part").applyInArrow(_earlier, back), "sub-late")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return packed.unionByName(late).groupBy("block").applyInArrow(_cut(with_text), schema)
