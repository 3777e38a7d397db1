"""Operator 7: allow and block lists for URLs, matched by a broadcast trie.

A rule is (verdict, host, path prefix). It fits its host and every subdomain
when the URL's path starts with the rule's path. The trie holds reversed host
labels, and below a rule's last label the path's segments; a URL walks it once
and the longest fitting rule (host and path length together, then the longer
host, then block) decides.

Defined results: a null URL, or one without ``://``, has an empty host and path;
no rule fits it, rule is null and the verdict is the default. Repeated rows are
judged alike; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rules that are broadcast; longer lists are refused, since the trie lives in every task.
MAX_RULES = 1_000_000

Rule = tuple[str, str, str]


def parse_rule(text: str) -> Rule:
    """``"block net/es/"`` -> ("block", "net", "/es/")."""
    verdict, _, place = text.partition(" ")
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {text!r}")
    return verdict, host, "/" + path


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: label -> node; under "/" of a node the path's segments.

    A path node's "" holds (text of an unfinished last segment, rule, verdict)."""
    root: dict = {}
    n = 0
    for verdict, host, path in rules:
        n += 1
        if n > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault("." + label, {})
        node = node.setdefault("/", {})
        *whole, rest = path[1:].split("/")
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        node.setdefault("", []).append((rest, f"{host}{path}", verdict, len(host)))
    return root


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, else None."""
    if not host or not path:
        return None
    best, best_key = None, (0, 0, 0)
    node: dict | None = trie
    segments = None
    for label in reversed(host.split(".")):
        node = node.get("." + label)
        if node is None:
            break
        place = node.get("/")
        if place is None:
            continue
        segments = path[1:].split("/") if segments is None else segments
        for i, segment in enumerate(segments):
            for rest, rule, verdict, n_host in place.get("", ()):
                if segment.startswith(rest):
                    key = (len(rule), n_host, verdict == "block")
                    if key > best_key:
                        best, best_key = (rule, verdict), key
            # only a segment that a "/" ends leads on
            place = place.get("/" + segment) if i + 1 < len(segments) else None
            if place is None:
                break
    return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns: host in lower case (A-Z only), both empty without ``://``."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    tail = F.coalesce(tail, F.lit(""))
    host = F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url",
               id_col: str = "page_id") -> DataFrame:
    """Per row of ``pages``: id, host, path, rule (null if none fits), verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for b in batches:
            found = [lookup(t, h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                [*b.schema.names, "rule", "verdict"])
    kind = parts.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
