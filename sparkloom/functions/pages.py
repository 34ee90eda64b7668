"""Raw pages as positions of their markup: visible text, redaction, safe views and probes in linear time.

A page is looked through for tags and comments, and each operation is a list of spans to take
out or replace, found by pairing sorted positions. No pattern looks past the next "<", so a
page with thousands of unclosed comments or elements costs what its length costs. The functions
run on Arrow batches of pages.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from html.entities import html5 as HTML5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Span = tuple[int, int, str]  # from, to, what comes in its place

#: Elements without visible text, in the order in which they are taken out; and those that end a line.
HIDDEN = ("script", "style", "noscript", "template", "svg", "head")
BLOCKS = frozenset(
    "address article aside blockquote br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: What redaction removes whole, by the name of its count.
REMOVED = {"script": ("script",), "noscript": ("noscript",), "frame": ("iframe", "frame"), "embed": ("object",)}
LONE = {"embed": ("object", "embed")}
REDACTED = "[redacted]"
_COUNTS = pa.map_(pa.string(), pa.int64())

_TAG = re.compile(r"<(/?)([A-Za-z!][A-Za-z0-9]*)\b[^<>]*>|<!--")
_ENTITY = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+)|[A-Za-z][A-Za-z0-9]*);")
_BLANKS = re.compile("[ \t\f\v\u00a0]+")


class Markup:
    """Where a page's tags of some names begin, and what has been taken out of it so far."""

    def __init__(self, page: str, names: Iterable[str]):
        self.page = page
        self.opened: dict[str, list[int]] = {n: [] for n in names}
        self.closed: dict[str, list[tuple[int, int]]] = {n: [] for n in names}
        any_of = "|".join(sorted(self.opened, key=len, reverse=True))
        for m in re.finditer(rf"<(?:({any_of})\b|/({any_of})\s*>)", page, re.I):
            if m[1]:
                self.opened[m[1].lower()].append(m.start())
            else:
                self.closed[m[2].lower()].append((m.start(), m.end()))
        self.spans: list[Span] = []
        self._starts: list[int] = []
        self._ends: list[int] = []

    def gone(self, at: int) -> bool:
        i = bisect_right(self._starts, at) - 1
        return i >= 0 and at < self._ends[i]

    def take(self, spans: list[Span]) -> None:
        """Adds spans, which may hold earlier ones but not cut them."""
        merged: list[Span] = []
        for s in sorted([*self.spans, *spans], key=lambda x: (x[0], -x[1])):
            if not merged or s[0] >= merged[-1][1]:
                merged.append(s)
        self.spans = merged
        self._starts, self._ends = [s[0] for s in merged], [s[1] for s in merged]

    def elements(self, name: str, inside: bool = False) -> int:
        """Takes out each element from an opening tag to the next closing one (with ``inside`` what is between the two); how many."""
        closes = [c for c in self.closed[name] if not self.gone(c[0])]
        starts = [c[0] for c in closes]
        spans, free, many = [], 0, 0
        for at in self.opened[name]:
            if at < free or self.gone(at):
                continue
            i = bisect_left(starts, at)
            if i == len(closes):
                break
            first = at
            if inside:
                first = self.page.find(">", at, starts[i]) + 1
                if not first:
                    continue
            spans.append((first, starts[i] if inside else closes[i][1], ""))
            free = closes[i][1]
            many += 1
        self.take(spans)
        return many

    def lone(self, names: Iterable[str], to: str = "") -> int:
        """Takes out the opening tags that are left of some names; how many."""
        spans = []
        for name in names:
            for at in self.opened[name]:
                if not self.gone(at) and (m := _TAG.match(self.page, at)) and m[0] != "<!--":
                    spans.append((m.start(), m.end(), to))
        self.take(spans)
        return len(spans)

    def text(self) -> str:
        out, at = [], 0
        for a, z, to in self.spans:
            out += [self.page[at:a], to]
            at = z
        return "".join([*out, self.page[at:]])


def without_comments(page: str) -> str:
    """A blank for each comment; one that isn't closed runs to the end."""
    out, at = [], 0
    while (start := page.find("<!--", at)) >= 0:
        out.append(page[at:start])
        end = page.find("-->", start + 4)
        if end < 0:
            return " ".join(out)
        at = end + 3
    return " ".join([*out, page[at:]])


def body_of(page: str) -> str:
    """From behind the first body tag to the last closing one, or to the end; a page without the tag is all body."""
    m = re.search(r"<body\b[^<>]*>", page, re.I)
    if not m:
        return page
    ends = [x.start() for x in re.finditer(r"</body\s*>", page, re.I) if x.start() >= m.end()]
    return page[m.end() : ends[-1] if ends else len(page)]


def _spoken(m: re.Match) -> str:
    name = (m[2] or "").lower()
    return "\n" if name in BLOCKS else " " if name in ("td", "th") else ""


def _closed_entity(m: re.Match) -> str:
    return entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in HTML5 else m[0]


def visible_text(page: str, closed: bool = False) -> str:
    """A page's text: a line end for each block's tag, a blank for each cell's, no other tags, all entities decoded.

    Browsers also decode some entities without their semicolon ("&amp" as "&"); with ``closed`` these are left as they are.

    Comments and HIDDEN elements are left out. Runs of blanks are one, lines have none at their
    ends, and no more than one line in a row is empty.
    """
    marks = Markup(without_comments(body_of(page)), HIDDEN)
    for name in HIDDEN:
        marks.elements(name)
    marks.lone(HIDDEN, " ")
    text = _TAG.sub(_spoken, marks.text())
    text = _ENTITY.sub(_closed_entity, text) if closed else entities.unescape(text)
    lines = [_BLANKS.sub(" ", x).strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def own_patterns(values: Iterable[str], names: Iterable[str]) -> list[re.Pattern]:
    """Patterns of a person's own details (in any letter case) and single names (as written), the longest first.

    A number of seven digits or more may have any separators; what has under three characters is left alone.
    """
    found = []
    for texts, flags in ((values, re.I), (names, 0)):
        for v in (v.strip() for v in texts if v):
            digits = [c for c in v if c.isdecimal()]
            if len(digits) >= 7 and len(digits) + 4 >= len("".join(v.split())):
                found.append((r"(?<!\d)" + r"[\s().+-]*".join(digits) + r"(?!\d)", flags))
            elif len(v) >= 3:
                found.append((r"(?<!\w)" + re.escape(v) + r"(?!\w)", flags))
    return [re.compile(p, f) for p, f in sorted(found, key=lambda x: -len(x[0]))]


_VALUE = r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"
_HANDLER = re.compile(rf"\son[a-z]+{_VALUE}", re.I)
_CONTROL = re.compile(r"<(input|option|button|meta)\b[^<>]*>", re.I)
_FILLED = re.compile(rf"\s(?:data-)?value{_VALUE}", re.I)
_IS_HIDDEN = re.compile(r"\btype\s*=\s*[\"']?hidden\b", re.I)
_IS_TOKEN = re.compile(r"\b(?:name|property)\s*=\s*[\"'][^\"']*(?:token|csrf|xsrf|session|nonce)", re.I)


def redacted(page: str, own: list[re.Pattern] = ()) -> tuple[str, dict[str, int]]:
    """The page without scripts, frames, handlers, hidden inputs, form values, text areas' texts and token metas, and with
    own details as REDACTED; and how many of each rule there were, those with none left out.
    """
    counts: Counter[str] = Counter()
    marks = Markup(page, {n for names in [*REMOVED.values(), *LONE.values()] for n in names})
    for rule, names in REMOVED.items():
        for name in names:
            counts[rule] += marks.elements(name)
    for rule, names in REMOVED.items():
        counts[rule] += marks.lone(LONE.get(rule, names))
    page, counts["event_handler"] = _HANDLER.subn("", marks.text())

    def control(m: re.Match) -> str:
        tag, name = m[0], m[1].lower()
        if name == "input" and _IS_HIDDEN.search(tag):
            counts["hidden_input"] += 1
            return ""
        if name == "meta":
            drop = bool(_IS_TOKEN.search(tag))
            counts["token_meta"] += drop
            return "" if drop else tag
        at = [x.span() for x in _FILLED.finditer(tag)]
        if at:
            counts["form_value"] += 1
            return tag[: at[0][0]] + tag[at[0][1] :]
        return tag

    areas = Markup(_CONTROL.sub(control, page), ["textarea"])
    counts["textarea_text"] = areas.elements("textarea", inside=True)
    page = areas.text()
    for pattern in own:
        page, n = pattern.subn(REDACTED, page)
        counts["own_details"] += n
    return page, {k: n for k, n in sorted(counts.items()) if n}


def safe_view(page: str) -> str:
    """The page without anything that runs code, embeds a site or sends the reader on."""
    whole, single = ("script", "noscript", "iframe"), ("object", "embed", "base", "meta")
    marks = Markup(page, [*whole, *single])
    for name in whole:
        marks.elements(name)
    marks.lone(whole)
    marks.lone(("object", "embed", "base"))
    sends = []
    for at in marks.opened["meta"]:
        m = _TAG.match(page, at)
        if m and not marks.gone(at) and re.search(r"http-equiv\s*=\s*[\"']?refresh", m[0], re.I):
            sends.append((m.start(), m.end(), ""))
    marks.take(sends)
    return _HANDLER.sub("", marks.text())


#: Fixed value: pages of an Arrow batch that are Python strings at a time.
SLICE = 64


def _over(pages: Iterator[pa.Array], f: Callable[[str], object], kind: pa.DataType) -> Iterator[pa.Array]:
    """``f`` of each page, a slice of a batch after the other, so a task holds a batch as Arrow and no copy of it as strings."""
    for batch in pages:
        for at in range(0, len(batch), SLICE):
            yield pa.array([None if x is None else f(x) for x in batch.slice(at, SLICE).to_pylist()], kind)


@F.arrow_udf(StringType())
def _texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _over(pages, visible_text, pa.string())


@F.arrow_udf(StringType())
def _closed_texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _over(pages, partial(visible_text, closed=True), pa.string())


@F.arrow_udf(StringType())
def _views(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _over(pages, safe_view, pa.string())


def text_of(page: Column, closed: bool = False) -> Column:
    """``visible_text`` of a column of pages; null for null."""
    return _closed_texts(page) if closed else _texts(page)


def view_of(page: Column) -> Column:
    """``safe_view`` of a column of pages; null for null."""
    return _views(page)


def redaction_of(page: Column, own_values: Iterable[str] = (), own_names: Iterable[str] = ()) -> Column:
    """``redacted`` of a column of pages as a struct of html and counts (a map by rule); nulls for null."""
    values, names = list(own_values), list(own_names)

    both = pa.struct([("html", pa.string()), ("counts", _COUNTS)])

    @F.arrow_udf("html string, counts map<string,long>")
    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = own_patterns(values, names)
        for a in _over(pages, lambda x: (lambda r: {"html": r[0], "counts": list(r[1].items())})(redacted(x, own)), both):
            yield pa.StructArray.from_arrays(a.flatten(), fields=list(both))  # nulls inside for null

    return run(page)


def redaction_counts_of(page: Column, own_values: Iterable[str] = (), own_names: Iterable[str] = ()) -> Column:
    """The counts of ``redaction_of`` alone; the pages don't come back from Python."""
    values, names = list(own_values), list(own_names)

    @F.arrow_udf("map<string,long>")
    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = own_patterns(values, names)
        yield from _over(pages, lambda x: list(redacted(x, own)[1].items()), _COUNTS)

    return run(page)


def page_verdict(url: Column, title: Column, html: Column, text: Column, challenge: Column, fillable: Column, login_urls: list[str], already: list[str], closed: list[str], confirmed: list[str], confirmed_urls: list[str], most_forms: int = 2, least_text: int = 600) -> Column:
    """What a page is, by the first of these that holds: gated, login, missing, applied, closed, form, success, structured, unknown.

    ``challenge`` and ``fillable`` are those of functions.html; ``text`` is the visible text.
    A login wall is a login address, or a password field on a page of few forms and little text.
    Phrases are looked for in the lower-cased text, address markers in the lower-cased address.
    """
    low, where = F.lower(text), F.lower(url)

    def holds(c: Column, words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | c.contains(w)
        return F.coalesce(out, F.lit(False))

    passwords = F.regexp_count(html, F.lit("(?i)<input\\b[^<>]*type\\s*=\\s*[\"']?password\\b"))
    forms = F.regexp_count(html, F.lit("(?i)<form\\b[^<>]*>"))
    wall = holds(where, login_urls) | ((passwords >= 1) & (forms <= most_forms) & (F.length(text) < least_text))
    posting = F.exists(F.regexp_extract_all(html, F.lit("(?i)<script\\b[^<>]*application/ld\\+json[^<>]*>([^<]*)"), F.lit(1)), lambda x: x.contains("JobPosting"))
    return (
        F.when(challenge == "gated", "gated")
        .when(wall, "login")
        .when(holds(F.lower(title), ["404", "page not found"]), "missing")
        .when(holds(low, already), "applied")
        .when(holds(low, closed), "closed")
        .when(F.coalesce(fillable, F.lit(False)), "form")
        .when(holds(low, confirmed) | holds(where, confirmed_urls), "success")
        .when(F.coalesce(posting, F.lit(False)), "structured")
        .otherwise("unknown")
    )
