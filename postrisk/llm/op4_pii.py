"""Operator 4: personal data by rules and a character-level BiLSTM-CRF.

The base rules give every span whose form is certain. The tagger
(``char_tagger``) is trained in numpy on labelled spans: windows of this corpus
with the base spans as labels, and generated windows with spans in further
spellings (numbers without a country code, odd separators) and with numbers that
are none. It adds spans that don't overlap base ones and that have the digits,
parts or check sum of their kind.

A base rule takes neighbouring numbers as one run and drops it; such runs are searched again by
their digit groups (``hidden_spans``), so a card beside another or a phone beside an address is found.
Redaction goes on until neither the rules nor the tagger find anything in what is left.

Every span holds a digit or an ``@``, so only the stretches within ``MARGIN``
characters of one are tagged; all other text is outside by construction, not by
truncation. Stretches are cut into overlapping windows; where windows overlap,
their scores are averaged, weighted by how central a character is, and one
Viterbi pass over the whole stretch reconciles them, so a span can cross any window
border. Offsets are code points of the whole text.

The training windows are at most ``train_windows``, the first by hash over the
whole corpus; the fit is numpy of fixed size.

Defined results: null and empty texts have no spans; repeated rows get the same
spans; very long texts are searched whole, in time linear in their length; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.llm.char_tagger import Tagger, encode
from postrisk.llm.common import hash_sample

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 96, 64, 32

_ACTIVE = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that long tokens take linear time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # no later match can reach over this @
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) by kind, in the order of KINDS."""
    if not _ACTIVE.search(text):
        return [[], [], [], []]
    return [emails(text),
            [m.span() for m in _IP.finditer(text) if _octets(m[0])],
            [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
            [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]]


def plausible(kind: int, s: str) -> bool:
    """Whether a tagged span has what its kind needs."""
    d = _digits(s)
    if kind == 0:
        local, at, domain = s.partition("@")
        return bool(local and at and re.fullmatch(r"[^\s@]+\.[A-Za-z]{2,}", domain))
    if kind == 1:
        return s.count(".") == 3 and all(p.isascii() and p.isdigit() for p in s.split(".")) and _octets(s)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", s)
    groups = re.findall(r"[0-9]+", s)
    return 9 <= len(d) <= 15 and 2 <= len(groups) <= 6 and len(groups[-1]) >= 3 and bool(re.fullmatch(r"[+(]?[0-9() ./-]+", s))


_GROUPS = re.compile(r"[0-9]+")


def hidden_spans(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Spans inside runs that a base rule takes whole and rejects: neighbouring numbers, or a number beside a known span.

    A rejected run is cut at the ``taken`` spans and then tried from each of its digit groups on, longest first."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    for kind, rule in ((2, _CARD), (3, _PHONE), (1, _IP)):
        for m in rule.finditer(text):
            if m.span() in taken:
                continue
            # a run longer than its longest valid span holds it in few consecutive groups, so this is linear
            groups = [g.span() for g in _GROUPS.finditer(text, *m.span())]
            k = 0
            while k < len(groups):
                a = groups[k][0] - (kind == 3)
                found = None
                if kind != 3 or a >= 0 and text[a] == "+":
                    for j in range(min(len(groups), k + 20) - 1, k - 1, -1):
                        s = (a, groups[j][1])
                        d = _digits(text[s[0]:s[1]])
                        ok = (13 <= len(d) <= 19 and luhn(d) and _CARD.fullmatch(text, *s) if kind == 2
                              else 9 <= len(d) <= 15 and _PHONE.fullmatch(text, *s) if kind == 3
                              else j == k + 3 and _IP.fullmatch(text, *s) and _octets(text[s[0]:s[1]]))
                        if ok and all(s[1] <= x or s[0] >= y for x, y in taken):
                            found = j, s
                            break
                if found:
                    out[kind].append(found[1])
                    taken.append(found[1])
                    k = found[0] + 1
                else:
                    k += 1
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Maximal stretches within MARGIN characters of a digit or an @."""
    out: list[list[int]] = []
    for m in _ACTIVE.finditer(text):
        lo, hi = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover n characters, the last one flush with the end."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


_CENTRAL = (np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)) + 1.0).astype(np.float32)


def tag(tagger: Tagger, texts: list[str], group: int = 256) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) spans of each text by windows, overlap averaging and one Viterbi pass a stretch."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    todo = [(k, a, b) for k, t in enumerate(texts) for a, b in stretches(t)]
    todo.sort(key=lambda x: x[2] - x[1])  # alike lengths together
    lo = 0
    while lo < len(todo):
        hi, size = lo, 0
        while hi < len(todo) and (hi == lo or size + todo[hi][2] - todo[hi][1] <= group * WINDOW):
            size += todo[hi][2] - todo[hi][1]
            hi += 1
        part = todo[lo:hi]
        lo = hi
        places = [(r, s) for r, (_, a, b) in enumerate(part) for s in window_starts(b - a)]
        c = np.stack([encode(texts[part[r][0]][part[r][1] + s:min(part[r][2], part[r][1] + s + WINDOW)], WINDOW) for r, s in places])
        longest = max(b - a for _, a, b in part)
        total = np.zeros((len(part), longest, tagger.k), np.float32)
        weight = np.zeros((len(part), longest, 1), np.float32)
        for g in range(0, len(c), group):
            for (r, s), e in zip(places[g:g + group], tagger.emissions(c[g:g + group])):
                m = min(WINDOW, longest - s)
                total[r, s:s + m] += e[:m] * _CENTRAL[:m, None]
                weight[r, s:s + m] += _CENTRAL[:m, None]
        n = np.array([b - a for _, a, b in part])
        for (k, a, _), tags in zip(part, tagger.decode(total / np.maximum(weight, 1e-6), n)):
            for first in np.flatnonzero(tags % 2):
                end = first + 1
                while end < len(tags) and tags[end] == tags[first] + 1:
                    end += 1
                out[k].append((int(tags[first] - 1) // 2, a + int(first), a + end))
    return out


def _trim(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """Without blanks and punctuation at the ends; a phone number keeps + and an opening bracket."""
    while a < b and not (text[a].isalnum() or kind == 3 and text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def find(tagger: Tagger, texts: list[str]) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """(base spans, added spans) by kind for each text."""
    out = []
    for text, got in zip(texts, tag(tagger, texts)):
        base = base_spans(text)
        taken = sorted(s for spans in base for s in spans)
        added = hidden_spans(text, taken) if _ACTIVE.search(text) else [[], [], [], []]
        for kind, a, b in sorted(got, key=lambda x: x[1]):
            a, b = _trim(text, kind, a, b)
            edge = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if edge and plausible(kind, text[a:b]) and all(b <= x or a >= y for x, y in taken):
                added[kind].append((a, b))
                taken.append((a, b))
        out.append((base, added))
    return out


def listed(spans: list[list[tuple[int, int]]]) -> str:
    """kind:start:end by kind, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, s in zip(KINDS, spans) for a, b in sorted(s))


def redact(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """Each span gives way to its kind in angle brackets; of overlapping spans the first names the whole."""
    flat = sorted((a, b, k) for k, s in zip(KINDS, spans) for a, b in s)
    out, at, k = [], 0, 0
    while k < len(flat):
        a, b, kind = flat[k]
        k += 1
        while k < len(flat) and flat[k][0] < b:
            b = max(b, flat[k][1])
            k += 1
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted_texts(tagger: Tagger, texts: list[str]) -> list[str]:
    """Each text without spans: what is left beside a replaced span may be a span itself, so the texts that
    changed are searched again until none is found. Every round takes a digit or an @ away, so it ends."""
    out, todo = list(texts), [k for k, t in enumerate(texts) if t and _ACTIVE.search(t)]
    while todo:
        again = []
        for k, (base, added) in zip(todo, find(tagger, [out[k] for k in todo])):
            if any(base) or any(added):
                out[k] = redact(out[k], [x + y for x, y in zip(base, added)])
                if _ACTIVE.search(out[k]):
                    again.append(k)
        todo = again
    return out


# ---- training --------------------------------------------------------------

def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random, lo: int = 2, hi: int = 9) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(lo, hi)))


def _card_number(r: random.Random) -> str:
    body = _number(r, r.choice([12, 14, 15, 15, 15, 18]))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _example(r: random.Random) -> tuple[str, int | None]:
    """A generated span with its kind, or a number that is no personal data (None)."""
    x = r.random()
    if x < 0.18:
        name = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}{_number(r, 2)}", f"{_word(r)}_{_word(r)}+{_word(r)}"])
        return f"{name}@{_word(r)}.{r.choice(['com', 'org', 'net', 'co.uk', 'example.com'])}", 0
    if x < 0.32:
        return ".".join(str(r.randrange(256)) for _ in range(4)), 1
    if x < 0.50:
        d = _card_number(r)
        sep = r.choice(["", " ", "-", "-", "  ", "."])
        return sep.join(d[k:k + 4] for k in range(0, len(d), 4)), 2
    if x < 0.75:
        cc, a, b, c = _number(r, r.choice([1, 2])), _number(r, 3), _number(r, 3), _number(r, 4)
        return r.choice([f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"+{cc} ({a}) {b}-{c}", f"+{cc}{a}{b}{c}", f"({a}) {b}-{c}",
                         f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"0{a}/{b} {c}"]), 3
    return r.choice([str(r.randrange(1900, 2100)), f"{r.randrange(1, 9)}.{r.randrange(9)}", f"{r.randrange(1, 9)}.{r.randrange(9)}.{r.randrange(20)}",
                     f"20{_number(r, 2)}-{_number(r, 2)}-{_number(r, 2)}", f"{_number(r, 2)}:{_number(r, 2)}", f"${_number(r, 3)}.{_number(r, 2)}",
                     _number(r, r.choice([1, 2, 3, 5, 8])), "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32]))),
                     f"@{_word(r)}", f"id={_number(r, 6)}", f"{_number(r, 3)},{_number(r, 3)},{_number(r, 3)}"]), None


def generated(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Windows of made-up words with generated spans, and their tags."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, tags = "", []
        while len(text) < WINDOW:
            if r.random() < 0.25:
                s, kind = _example(r)
            else:
                s, kind = r.choice([str.lower, str.title])(_word(r)) + r.choice(["", "", "", ",", ".", ":"]), None
            tags += [0] * len(s) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
            gap = r.choice([" ", " ", " ", "\n"])
            text, tags = text + s + gap, tags + [0]
        shift = r.randrange(0, max(1, len(text) - WINDOW + 1))
        while tags[shift] and tags[shift] % 2 == 0:
            shift -= 1  # a window doesn't begin inside a span
        out.append((text[shift:shift + WINDOW], tags[shift:shift + WINDOW]))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around digits and @ with the tags that the base spans give."""
    for b in batches:
        out: list[list[str]] = [[], []]
        for text in b.column(0).to_pylist():
            if not text or not _ACTIVE.search(text):
                continue
            spans = base_spans(text)
            for a, e in stretches(text):
                tags = np.zeros(e - a, np.int64)
                for kind, found in enumerate(spans):
                    for x, y in found:
                        if a <= x and y <= e and not tags[x - a:y - a].any():
                            tags[x - a:y - a] = 2 + 2 * kind
                            tags[x - a] = 1 + 2 * kind
                for s in window_starts(e - a):
                    w = tags[s:s + WINDOW]
                    if w[0] and w[0] % 2 == 0:
                        continue
                    out[0].append(text[a + s:min(e, a + s + WINDOW)])
                    out[1].append("".join(map(str, w)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["text", "tags"])


def train(docs: DataFrame, train_windows: int = 1500, text_col: str = "text", steps: int = 240) -> Tagger:
    """Fit on at most ``train_windows`` different windows of the corpus, from as many texts at most,
    and as many generated ones."""
    # nothing but the text is read, so other columns may have any name
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col), F.lit("text")).alias("key"))
    active = texts.where(F.col("text").rlike("[0-9@]")).select(F.col("key").alias("chosen")).distinct()
    chosen = hash_sample(active, train_windows, "chosen")  # at most train_windows rows
    mine = (texts.join(F.broadcast(chosen), F.col("key") == F.col("chosen")).select("text").mapInArrow(_labelled, "text string, tags string")
            .select(F.xxhash64("text").alias("h"), "text", "tags").distinct().orderBy("h", "text", "tags").limit(train_windows).collect())
    rows = [(r.text, [int(c) for c in r.tags]) for r in mine] + generated(train_windows)
    c = np.stack([encode(t, WINDOW) for t, _ in rows])
    tags = np.zeros(c.shape, np.int64)
    for k, (_, x) in enumerate(rows):
        tags[k, :len(x)] = x
    return Tagger(len(KINDS)).fit(c, tags, steps=steps)


def personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text",
                  redacted: bool = False) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base, spans (kind:start:end lists), n_added,
    and with ``redacted`` the text with every span replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            busy = [k for k, t in enumerate(texts) if _ACTIVE.search(t)]
            none: list[list[tuple[int, int]]] = [[], [], [], []]
            found = [(none, none)] * len(texts)
            for k, f in zip(busy, find(shared.value, [texts[k] for k in busy])):
                found[k] = f
            both = [[x + y for x, y in zip(base, added)] for base, added in found]
            cols = [b.column(0), *[pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in range(4)],
                    pa.array([listed(base) for base, _ in found], pa.string()), pa.array([listed(x) for x in both], pa.string()),
                    pa.array([sum(map(len, added)) for _, added in found], pa.int64())]
            names = [b.schema.names[0], *[f"n_{k}" for k in KINDS], "base", "spans", "n_added"]
            if redacted:
                cols.append(pa.array(redacted_texts(shared.value, b.column(1).to_pylist()), pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(cols, names)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, n_added long"
        + (", redacted string" if redacted else ""))


def redacted_table(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """The whole table with every span of its texts replaced; rows without a digit or an @ pass unread."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            cols = list(b.columns)
            cols[place] = pa.array(redacted_texts(shared.value, texts), b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return docs.mapInArrow(run, docs.schema)
