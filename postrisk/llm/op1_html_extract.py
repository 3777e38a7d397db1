"""Operator 1: main text of web pages by consensus host paths.

Pass one reads every page, drops what is never content (menus, headers, footers,
sidebars, forms, adverts, notices, comments, scripts, styles), scores the
remaining containers by the unlinked text of their blocks, and turns the scores
into votes for the container's generalised path: tags with classes and ids from
the root, digits made alike. Spark adds the votes up by host and path, after a
map-side sum, so a host with a third of the pages costs no more than its number
of different paths. Pass two extracts every page again from the container with
its host's winning path. A page without it, or where it holds under
``MIN_SHARE`` of the text of the page's own best container, uses its own best one.
The best one is found by score and then widened: to a container around it as long
as what that adds is mostly unlinked text, so that titles, leads and further
sections stay with a dominant part. Nothing is widened beyond an article or main;
only lists, tables, quotes and sections are widened to the body.

A name marks an element by its head word (``site-header``, ``ad-slot``), not by a
qualifier (``has-sidebar``, ``share-price``). What a layout mark or a form drops is
judged again once the page is read: where it holds an article or main with more
unlinked text than all that stayed, or a form holds nearly all paragraphs of a page
without either, the page is read again with it. A header inside an article stays if
it holds a heading.

A block is the text between the edges of block elements or line breaks;
character references are decoded, white space becomes one space, empty blocks
fall away, and blocks are joined in page order by one line feed.

Defined results: null and empty html give an empty text; broken markup is read
as browsers do in spirit (unclosed elements end with their parents); a null url
is a host of its own, the empty one; ties between paths go to the greater path;
repeated rows are extracted alike; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.llm.common import write_cut
from postrisk.llm.op7_url_filter import url_parts

MIN_SHARE = 0.1  # of the page's own best container
MIN_VOTE = 0.2  # containers with a smaller share of the page's best score don't vote

MAX_PATH = 1000  # longer paths are named by a digest, so deep nesting takes linear memory

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul br""".split())
_CONTAINER = frozenset("article blockquote body center details div dl fieldset figure main ol section table tbody td tr ul".split())
_NEVER = frozenset("""aside button dialog footer form head header input label menu nav object option select svg audio video canvas
map optgroup datalist""".split())
_WHOLE = frozenset("article main body html".split())
_PARTS = frozenset("blockquote dl details figure ol section table tbody td tr ul".split())
_SAFE = frozenset(("html", "body", "main"))
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",)}
_ENDS_P = _BLOCK - {"br", "body", "html", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dt", "dd", "legend", "summary"}
_FENCE = frozenset("table ul ol dl article section div body html td".split())
#: Parts of class names, ids and roles that mark what is not the article.
_MARKS = frozenset("""ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary
consent contentinfo cookie cookies dialog disqus footer gdpr header hidden masthead menu modal nav navbar navigation newsletter
notice notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond
search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser toolbar widget
""".split())
#: Marks that also name a subject: they count as a whole name, at its end, or before a word of ``_BOXES``.
_TOPICS = frozenset("""alert dialog hidden notice notification promotion recommended related replies reply respond search share
sharing social teaser""".split())
_BOXES = frozenset("""area bar block body box button buttons container content form group holder icon icons inner item items links
list listing panel posts region section slot unit widget wrap wrapper""".split())
#: Qualifiers before or after a mark that speak of the page around it.
_BEFORE = frozenset("has hide no show with without".split())
_AFTER = frozenset("active closed disabled enabled off on open".split())
#: Marks of page layout, which also turn up in the names of elements around the article.
_LAYOUT = frozenset("""banner breadcrumb breadcrumbs dialog footer header hidden masthead menu modal nav navbar navigation overlay
search share sharing sidebar social toolbar widget""".split())
_TEXTUAL = frozenset("b code em h1 h2 h3 h4 h5 h6 i li mark p q span strong td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LANDMARKS = frozenset(("article", "main"))
KEEP, DROP, LIFTABLE, HEAD = range(4)
FORM_PARAGRAPHS = 3  # a form with fewer never holds the article
FORM_SHARE = 9  # times the unlinked text outside it
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}


@lru_cache(maxsize=20_000)
def marks(name: str) -> frozenset[str]:
    """The marks that count in one class name, id or role."""
    parts = [p.lower() for p in _SPLIT.split(name) if p]
    out = set()
    for k, part in enumerate(parts):
        if part not in _MARKS or k and parts[k - 1] in _BEFORE:
            continue
        after = parts[k + 1] if k + 1 < len(parts) else None
        if after in _AFTER or part in _TOPICS and after is not None and after not in _BOXES | _MARKS and not after.isdigit():
            continue
        out.add(part)
    return frozenset(out)


def _unwanted(tag: str, a: dict[str, str], in_article: bool) -> int:
    """KEEP, DROP, LIFTABLE (dropped unless it turns out to hold the article) or HEAD (kept if it holds a heading)."""
    if tag in _NEVER:
        return HEAD if tag == "header" and in_article else LIFTABLE if tag == "form" else DROP
    if not a or tag in _SAFE:
        return KEEP
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return DROP
    names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".split()
    if tag == "article":  # only a name that says so as a whole
        return DROP if any(n.lower() in _MARKS for n in names) else KEEP
    found = frozenset().union(*map(marks, names))
    if in_article and tag in _TEXTUAL:
        found -= _TOPICS
    if not found:
        return KEEP
    if in_article and found == {"header"}:
        return HEAD
    return LIFTABLE if found <= _LAYOUT else DROP


class _Dropped:
    """What an outermost dropped element holds."""

    def __init__(self, whole: bool, form: bool):
        self.whole, self.form = whole, form
        self.free = self.paragraphs = self.landmark = 0  # unlinked characters, p elements, unlinked characters in landmarks
        self.chain: list[int] = []  # liftable elements around its first landmark, or its first paragraph


def _step(tag: str, a: dict[str, str]) -> str:
    """One step of a generalised path: tag, classes in order, id; runs of digits become 0."""
    name = tag + "".join(f".{c}" for c in sorted(set(a.get("class", "").split()))) + (f"#{a['id']}" if a.get("id") else "")
    return re.sub(r"[0-9]+", "0", name)


class Page:
    """Blocks (text, unlinked characters) in page order, and containers with the range of blocks they hold."""

    def __init__(self, source: str, lifted: frozenset[int] = frozenset()):
        self.blocks: list[tuple[str, int]] = []
        self.paths: list[str] = []
        self.tags: list[str] = []
        self.first: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.home: list[int] = []  # innermost container of each block
        self._text: list[str] = []
        self._linked = 0
        # open elements: (tag, path, container or -1, what _unwanted says of it)
        self._open: list[tuple[str, str, int, int]] = []
        self._lifted = lifted  # places of elements that stay whatever their marks
        self._chain: list[int] = []  # places of the open liftable elements that are dropped
        self._hard = 0  # open elements that are dropped for good
        self._heads: list[list[int]] = []  # open HEAD elements: blocks and containers before, headings
        self._drop: _Dropped | None = None
        self._marks_in = 0  # open landmarks inside the dropped element
        self.dropped: list[_Dropped] = []
        self._inside = [-1]  # open containers
        self._count: dict[str, int] = defaultdict(int)  # open elements by tag
        self._unwanted = self._links = 0
        self._read(source)
        while self._open:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((text, max(0, len(text) - self._linked)))
                self.home.append(self._inside[-1])
            self._text, self._linked = [], 0

    def _push(self, tag: str, raw: str, place: int) -> None:
        a = _attributes(raw)
        bad = KEEP if place in self._lifted else _unwanted(tag, a, self._count["article"] > 0)
        path = f"{self._open[-1][1]}/{_step(tag, a)}" if self._open else _step(tag, a)
        if len(path) > MAX_PATH:
            path = "~" + hashlib.md5(path.encode()).hexdigest()
        c = -1
        if bad in (DROP, LIFTABLE):
            if not self._unwanted and bad == LIFTABLE:
                whole = any(n.lower() in _MARKS for k in ("class", "id", "role") for n in a.get(k, "").split())
                self._drop = _Dropped(whole, tag == "form")
            self._unwanted += 1
            if bad == LIFTABLE:
                self._chain.append(place)
            else:
                self._hard += 1
        elif self._unwanted:
            if self._drop and not self._hard and tag in ("article", "main", "p"):
                d = self._drop
                if tag == "p":
                    d.paragraphs += 1
                if not d.landmark and (tag != "p" or not d.chain):
                    d.chain = list(self._chain)
                self._marks_in += tag != "p"
        elif bad == HEAD:
            self._heads.append([len(self.blocks), len(self.paths), 0])
        elif tag in _HEADINGS and self._heads:
            self._heads[-1][2] += 1
        if bad == HEAD and self._unwanted:
            bad = KEEP
        if tag in _CONTAINER and not self._unwanted:
            c = len(self.paths)
            self.paths.append(path)
            self.tags.append(tag)
            self.first.append(len(self.blocks))
            self.end.append(len(self.blocks))
            self.parent.append(self._inside[-1])
            self._inside.append(c)
        self._open.append((tag, path, c, bad))
        self._count[tag] += 1
        self._links += tag == "a"

    def _pop(self) -> None:
        tag, _, c, bad = self._open[-1]
        if tag in _BLOCK:
            self._flush()
        self._open.pop()
        self._count[tag] -= 1
        self._links -= tag == "a"
        if bad in (DROP, LIFTABLE):
            self._unwanted -= 1
            if bad == LIFTABLE:
                self._chain.pop()
            else:
                self._hard -= 1
            if not self._unwanted and self._drop:
                if self._drop.chain:
                    self.dropped.append(self._drop)
                self._drop, self._marks_in = None, 0
        elif self._unwanted:
            self._marks_in -= tag in _LANDMARKS and not self._hard and self._marks_in > 0
        if c >= 0:
            self.end[c] = len(self.blocks)
            self._inside.pop()
        if bad == HEAD:
            blocks, containers, headings = self._heads.pop()
            if headings:
                if self._heads:
                    self._heads[-1][2] += headings
            else:
                self._flush()
                del self.blocks[blocks:], self.home[blocks:]
                for k in range(containers, len(self.paths)):
                    self.first[k] = self.end[k] = blocks

    def _close(self, tags: tuple[str, ...], fence: frozenset[str]) -> None:
        """End the innermost open element of ``tags`` unless a fence is nearer."""
        if not any(self._count[t] for t in tags):
            return
        for k in range(len(self._open) - 1, -1, -1):
            t = self._open[k][0]
            if t in tags:
                while len(self._open) > k:
                    self._pop()
                return
            if t in fence:
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        lost: set[str] = set()  # end tags that don't come any more
        while at < n:
            m = _TOKEN.match(source, at)
            if m is None:  # an unfinished tag at the end
                break
            place, at = at, m.end()
            text = m[7]
            if text is not None:
                if self._drop and not self._hard and not self._links:
                    chars = len(text.strip())
                    self._drop.free += chars
                    self._drop.landmark += chars if self._marks_in else 0
                elif not self._unwanted:
                    text = html.unescape(text) if "&" in text else text
                    self._text.append(text)
                    if self._links:
                        self._linked += len(text.strip())
                continue
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            raw = (m[3] if m[2] else m[6]) or ""
            if m[1] or m[4]:
                if tag == "p" and not self._count["p"]:
                    self._flush()
                self._close((tag,), frozenset())
                continue
            if tag in _RAW_END:
                if tag not in lost:
                    e = _RAW_END[tag].search(source, at)
                    at = e.end() if e else n
                continue
            if tag in _BLOCK:
                if tag in _ENDS_P:
                    self._close(("p",), _FENCE)
                if tag in _CLOSES:
                    self._close(_CLOSES[tag], frozenset(("table", "ul", "ol", "dl", "select")))
                self._flush()
            if tag == "body":  # an unclosed head ends here
                self._close(("head",), frozenset())
            if tag not in _VOID and not raw.endswith("/") or tag in _CONTAINER:
                self._push(tag, raw, place)

    def misjudged(self) -> list[int]:
        """Places of dropped elements that hold the article after all; outermost first."""
        if not self.dropped:
            return []
        outside = sum(free for _, free in self.blocks)
        kept = any(t in _LANDMARKS and e > f for t, f, e in zip(self.tags, self.first, self.end))
        found = [d for d in self.dropped if d.landmark > outside and not (d.whole and kept)]
        if not found and not any(t in _LANDMARKS for t in self.tags):
            found = [d for d in self.dropped if d.form and d.paragraphs >= FORM_PARAGRAPHS and d.free > FORM_SHARE * outside]
        return max(found, key=lambda d: (d.landmark, d.free)).chain if found else []

    def scores(self) -> list[float]:
        """Per container: unlinked characters of its own blocks, half of its children's, a quarter of theirs."""
        out = [0.0] * len(self.paths)
        for (text, free), c in zip(self.blocks, self.home):
            worth = free * free / max(1, len(text)) + 10 * min(5, text.count(","))
            for share in (1, 0.5, 0.25):
                if c < 0:
                    break
                out[c] += share * worth
                c = self.parent[c]
        return out

    def widened(self, c: int) -> int:
        """The outermost container around ``c`` that adds mostly unlinked text at each step."""
        size, free = [0], [0]
        for text, n in self.blocks:
            size.append(size[-1] + len(text))
            free.append(free[-1] + n)
        p = self.parent[c]
        while p >= 0 and self.tags[c] not in _WHOLE and (self.tags[p] not in ("body", "html") or self.tags[c] in _PARTS):
            more = [x[self.end[p]] - x[self.first[p]] - x[self.end[c]] + x[self.first[c]] for x in (size, free)]
            if more[0]:
                if 2 * more[1] < more[0]:
                    break
                c = p
            elif self.tags[p] in _WHOLE:
                break
            p = self.parent[p]
        return c

    def text_of(self, containers: list[int]) -> str:
        """Blocks of the containers in page order; one inside another counts once."""
        out, done = [], 0
        for c in sorted(containers, key=lambda c: self.first[c]):
            lo = max(done, self.first[c])
            out += [t for t, _ in self.blocks[lo:self.end[c]]]
            done = max(done, self.end[c])
        return "\n".join(out)


def read(source: str) -> Page:
    """The page, read again where a dropped element turns out to hold the article."""
    page = Page(source)
    places = page.misjudged()
    return Page(source, frozenset(places)) if places else page


def votes(page: Page) -> dict[str, float]:
    """Share of the best score by path, for the containers that come near it; 1 for the widened
    best one, and half for what lies inside that."""
    s = page.scores()
    best = max(s, default=0.0)
    out: dict[str, float] = defaultdict(float)
    if best > 0:
        top = s.index(best)
        wide = page.widened(top)
        inside = range(wide + 1, len(s)) if wide != top else ()
        for c, (path, x) in enumerate(zip(page.paths, s)):
            if c == wide or x >= MIN_VOTE * best:
                within = c in inside and page.end[c] <= page.end[wide] and page.first[c] < page.end[wide]
                out[path] = max(out[path], 1.0 if c == wide else x / best / (2 if within else 1))
    return out


def extract(source: str | None, path: str | None) -> tuple[str, bool]:
    """(main text, whether the host's path gave it)."""
    if not source:
        return "", False
    page = read(source)
    s = page.scores()
    own = page.text_of([page.widened(max(range(len(s)), key=lambda c: (s[c], -c)))]) if s else page.text_of([]) or "\n".join(t for t, _ in page.blocks)
    if path is not None:
        text = page.text_of([c for c, p in enumerate(page.paths) if p == path])
        if text and len(text) >= MIN_SHARE * len(own):
            return text, True
    return own, False


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total: dict[tuple[str, str], list[float]] = {}
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for path, v in votes(read(source)).items() if source else ():
                t = total.setdefault((host, path), [0.0, 0])
                t[0] += v
                t[1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()),
             pa.array([round(v * 1e6) for v, _ in total.values()], pa.int64()), pa.array([n for _, n in total.values()], pa.int64())],
            ["host", "path", "votes", "n_pages"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes, n_pages: the winning container path of every host."""
    host, _ = url_parts(F.col(url_col))
    cast = pages.select(host.alias("host"), F.col(html_col).alias("html")).mapInArrow(
        _vote, "host string, path string, votes long, n_pages long")
    summed = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("n_pages").alias("n_pages"))
    best = F.max(F.struct("votes", "path", "n_pages")).alias("b")
    return summed.groupBy("host").agg(best).select("host", "b.path", "b.votes", "b.n_pages")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points), by_host (whether the host's path gave the text)."""
    # written, so that the join knows its size and broadcasts it only while it is small
    paths = write_cut(host_paths(pages, url_col, html_col).select(F.col("host").alias("__host"), "path"), "host-paths")
    host, _ = url_parts(F.col(url_col))
    joined = (pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host.alias("__at"))
              .join(paths, F.col("__at") == F.col("__host"), "left").select(id_col, url_col, html_col, F.col("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(s, p) for s, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([t for t, _ in got], pa.string()),
                 pa.array([len(t) for t, _ in got], pa.int64()), pa.array([h for _, h in got], pa.bool_())],
                [b.schema.names[0], b.schema.names[1], "text", "n_chars", "by_host"])
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long, by_host boolean")
