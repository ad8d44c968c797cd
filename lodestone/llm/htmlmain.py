"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines (one per block element). Pages of a host are sorted by URL path; a page is paired with the
neighbour whose path is nearest (longest common beginning), the two pages' lines are aligned by longest common
subsequence, and shared lines are deleted: what a site repeats from page to page is not the article.

Markup speaks only where it is plain: lines in elements that are menus, footers, sidebars, forms, reader comments or
hidden, or whose class, id or role says nothing but that, go; headings, lists and cells inside an article's container
stay even if another page repeats them. Paragraphs of an article go if they are short (NOTICE characters at most, as
notices and adverts are) and the nearest page has them too, unless the two articles share most of their text, for then they
are copies, or another host has the paragraph, for then it is a quotation, not a notice of this site. All other lines, in an article or outside of it, are decided by differencing. A page without a neighbour
has nothing to be compared with: there, lines outside an article go if the article has more text. Where markup leaves no
article, an element named like boilerplate that holds most of the page's prose is its wrapper, not boilerplate.

Scale: pages are shuffled by nothing but hashes of lines; pairing is a sort by ranges of (host, path) and an equi-join
on the row number, so that a host may have any number of pages. Only the numbers of deleted lines come back to pages.
Tags are read in one pass without going back, and lines are aligned in linear memory, so that hostile pages take no
longer than their length asks for.

Edge cases: null or empty html gives an empty text; a null or unparsable url has the empty host and path; pages of a
host with the same lines are one page when pairing, and each gets its result; where deletion would leave nothing of a
page, it is a copy of its neighbour and is kept; a tag or comment that never ends hides the rest, as in browsers; an
element of media or controls that is never closed hides nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import html as _html
import os.path
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved

# Fixed values of HTML: elements by what they do to lines.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_HIDDEN = frozenset("noscript template svg math object select datalist canvas video audio".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that no page lies in, whatever they hold; the place of what they and comments hold.
_NEVER_WRAPS, COMMENTS = frozenset("nav footer aside menu noscript template svg math object select datalist canvas video audio".split()), -2
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_BOILERPLATE = frozenset("nav footer aside form button menu dialog fieldset".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
_CLOSED_BY = {"p": None, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
#: Words of class, id and role that name boilerplate; words that may stand beside them without changing that.
_BAD_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar header footer sidebar aside widget widgets ad ads adsense advert adverts advertisement advertising sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social follow related "
    "recommended recommendations comment comments commentlist respond reply replies disqus pagination pager toolbar search searchform copyright disclaimer hidden contentinfo complementary form dialog".split()
)
_NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons center col column container content global group icons info inner items left line link links list main message outer page panel posts primary right row secondary "
    "section site slot top unit wrap wrapper the of and to".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist commenter commentary respond reply replies disqus".split())
#: Words that make a name with a comment word say something of the page, not of its comments.
_OF_PAGE = frozenset("open closed enabled disabled has no with without allow allowed off on count status link number".split())
_GOOD = re.compile(r"(?:^|\s)(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)(?:\s|$)|(?:^|\s)(?:articlebody|main|content|article|post|entry|story)(?:\s|$)", re.I)
_OF_ARTICLE = frozenset("article post entry story".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,};?")

#: What markup says of a line: it goes, it stays, or differencing decides, inside an article or outside of it, or of a short paragraph in an article.
DROP, KEEP, ASK, OUTSIDE, PARAGRAPH = range(5)
#: Most characters of a paragraph that may be a notice; words from which on a line is prose; wrappers that a page may have around each other.
NOTICE, PROSE_WORDS, WRAPPERS = 200, 10, 4


class _Ahead:
    """The next place of an end tag; every part of the page is searched once for a name, since places only grow."""

    def __init__(self, page: str):
        self.page, self.places = page, {}

    def __call__(self, name: str, at: int) -> int:
        """Where the next end tag of that name begins, or the page's end."""
        if self.places.get(name, -1) < at:
            found = _end_tag(name).search(self.page, at)
            self.places[name] = found.start() if found else len(self.page)
        return self.places[name]


@functools.lru_cache(maxsize=1000)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I)


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of tags; comments and the like have no name.

    A tag ends at the first ">" outside a quoted value, a comment at "-->"; without that, at the page's end.
    """
    at, end, ahead, quotes = 0, len(page), _Ahead(page), {"'", '"'}
    while (start := page.find("<", at)) >= 0:
        if not (m := _NAME.match(page, start + 1)):
            if not page.startswith(("<!", "</", "<?"), start):
                at = start + 1  # a sign, which stays text
                continue
            mark = "-->" if page.startswith("<!--", start) else ">"
            over = page.find(mark, start + 2)
            at = over + len(mark) if over >= 0 else end
            yield start, at, "", False, ""
            continue
        name, at = m[2].lower(), m.end()
        over = end
        while stop := _STOP.search(page, at):
            if not stop[1]:
                over = at = stop.end()
                break
            close = page.find(stop[1], stop.end()) if stop[1] in quotes else -1
            if close < 0:
                quotes.discard(stop[1])  # none is left in the page
            at = close + 1 if close >= 0 else stop.end()
        closed = stop is not None
        raw = page[m.end() : over - 1] if closed else ""
        at = over
        if closed and name in _RAW and not m[1] and not raw.endswith("/"):
            body = ahead(name, at)
            at = (page.find(">", body) + 1 or end) if body < end else end
        yield start, at, name, bool(m[1]), raw


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _unescape(text: str) -> str:
    """Character references resolved; numbers beyond all characters are the replacement character."""
    return _html.unescape(_LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def _says_boilerplate(named: str, but: frozenset[str]) -> bool:
    """Whether some name of a class, id or role consists of words for boilerplate and neutral words only."""
    for token in named.split()[:50]:
        parts = set(_PART.findall(_CAMEL.sub(" ", token).lower()))
        bad = parts & _BAD_WORDS
        if bad - but and all(p in _BAD_WORDS or p in _NEUTRAL or p.isdigit() for p in parts):
            return True
    return False


def _says_comments(named: str) -> bool:
    """Whether some name of a class, id or role is that of readers' comments."""
    for token in named.split()[:50]:
        parts = set(_PART.findall(_CAMEL.sub(" ", token).lower()))
        if parts & _COMMENT_WORDS and not parts & _OF_PAGE:
            return True
    return False


def _kind(name: str, raw: str, in_article: bool) -> str:
    """What an element's tag says: "bad", "comments", "article" or nothing."""
    if name in _BOILERPLATE or (name == "header" and not in_article):
        return "bad"
    if name in ("html", "body"):
        return ""
    if not raw or raw.isspace():
        return "article" if name in ("article", "main") else ""
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return "bad"
    named = " ".join(filter(None, (a.get("class"), a.get("id"), a.get("role"))))
    if _says_comments(named):
        return "comments"
    if name in ("article", "main") or a.get("role") == "main" or a.get("itemprop", "").lower() == "articlebody" or _GOOD.search(named):
        return "article"
    parts = set(_PART.findall(named.lower()))
    return "bad" if _says_boilerplate(named, frozenset(["header"]) if in_article or parts & _OF_ARTICLE else frozenset()) else ""


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(line, DROP | KEEP | ASK | OUTSIDE | PARAGRAPH) of a page, in order."""
    page, wrappers = page or "", frozenset()
    for _ in range(WRAPPERS):
        lines, held = _lines(page, wrappers)
        if not held or any(k in (KEEP, ASK, PARAGRAPH) for _, k in lines):
            break
        # No article: the outermost element named like boilerplate that holds most prose is what the page lies in.
        n, at = max((n, at) for at, n in held.items())
        if at < 0 or 2 * n <= sum(held.values()):
            break
        wrappers |= {at}
    return lines


def _lines(page: str, wrappers: frozenset[int]) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """A page's lines, with elements that begin at one of wrappers taken as plain ones; and the letters of prose by the
    beginning of the outermost element like boilerplate around them, -1 for none, comments and menus left out."""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, str]] = []
    open_: Counter = Counter()
    text: list[str] = []
    linked = links = bad = article = prose = 0
    held: dict[int, int] = {}
    outermost = -1
    ahead = _Ahead(page)

    def end_line() -> None:
        nonlocal linked
        if text:
            line = " ".join(_unescape("".join(text)).split())
            if line:
                # Outside an article, a line that is mostly links is a menu.
                top = stack[-1][0] if stack else ""
                kept = PARAGRAPH if top == "p" and len(line) <= NOTICE else KEEP
                kind = DROP if bad or not article and 2 * linked > len(line) else kept if article and prose else ASK if article or top == "h1" else OUTSIDE
                lines.append((line, kind))
                if 2 * linked <= len(line) and line.count(" ") + 1 >= PROSE_WORDS and outermost != COMMENTS:
                    held[outermost] = held.get(outermost, 0) + len(line)
            text.clear()
        linked = 0

    def push(name: str, kind: str, start: int) -> None:
        nonlocal bad, article, prose, outermost
        if kind == "bad" and start in wrappers:
            kind = ""
        if kind in ("bad", "comments") and not bad:
            outermost = COMMENTS if kind == "comments" or name in _NEVER_WRAPS else start
        stack.append((name, kind))
        open_[name] += 1
        bad += kind in ("bad", "comments")
        article += kind == "article"
        prose += name in _PROSE

    def pop() -> str:
        nonlocal bad, article, prose, outermost
        name, kind = stack.pop()
        open_[name] -= 1
        bad -= kind in ("bad", "comments")
        if not bad:
            outermost = -1
        article -= kind == "article"
        prose -= name in _PROSE
        return name

    at = 0
    for start, end, name, closing, raw in _tags(page):
        if start > at:
            text.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if not name:
            continue
        if name in _RAW:
            end_line()
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name == "br":
            text.append(" ")
            continue
        if name in _INLINE:
            if closing and any(x[0] == name for x in stack[-3:]):
                end_line()
                while pop() != name:
                    pass
            elif not closing and raw and name not in _VOID and name != "a" and (kind := _kind(name, raw, article > 0)) in ("bad", "comments"):
                end_line()
                push(name, kind, start)
            continue
        if name not in ("svg", "math"):
            end_line()
        if closing:
            if open_[name]:
                while pop() != name:
                    pass
            continue
        if stack and stack[-1][0] in _CLOSED_BY and name not in _HIDDEN and ((by := _CLOSED_BY[stack[-1][0]]) is None or name in by):
            pop()
        if name in _VOID or raw.endswith("/"):
            continue
        if name in _HIDDEN:
            # Never closed, or not before its article is: it hides nothing.
            over = ahead(name, end)
            if over < len(page) and not any(open_[x] and ahead(x, end) < over for x in ("article", "main")):
                push(name, "bad", start)
            continue
        push(name, "" if name == "head" else _kind(name, raw, article > 0), start)
    text.append(page[at:])
    end_line()
    return lines, held


def main_text(page: str | None, deleted: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's text without boilerplate and without the open lines whose numbers are in deleted."""
    lines = lines_of(page)
    kept = [line for i, (line, k) in enumerate(lines) if k == KEEP or k != DROP and i not in deleted]
    return " ".join(kept or [line for line, k in lines if k != DROP])


def _row(a: list[int], b: list[int]) -> int:
    """After all of a: bit j is 0 where the longest common subsequence with b[:j + 1] is longer than with b[:j]; bit-parallel."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with every beginning of b."""
    bits = np.unpackbits(np.frombuffer(_row(a, b).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b, by divide and conquer over a, so that memory stays linear."""
    found: list[int] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, k, j, n = parts.pop()
        while i < k and j < n and a[i] == b[j]:
            found.append(i)
            i, j = i + 1, j + 1
        while i < k and j < n and a[k - 1] == b[n - 1]:
            k, n = k - 1, n - 1
            found.append(k)
        if i >= k or j >= n:
            continue
        if k - i == 1:
            if a[i] in b[j:n]:
                found.append(i)
            continue
        half = (i + k) // 2
        cut = j + int(np.argmax(_lengths(a[i:half], b[j:n]) + _lengths(a[half:k][::-1], b[j:n][::-1])[::-1]))
        parts += [(i, half, j, cut), (half, k, cut, n)]
    return sorted(found)


def nearest(path: str, before: str | None, after: str | None) -> int:
    """0 if the neighbour before has the longer common beginning with path, else 1; by path segments, then characters."""

    def near(other: str | None) -> tuple[int, int]:
        if other is None:
            return (-1, -1)
        common = os.path.commonprefix([path, other])
        return (common.count("/"), len(common))

    return int(near(after) > near(before))


def _line_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for pdf in batches:
        rows = []
        for h in pdf["html"]:
            lines = lines_of(h)
            hashes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x, _ in lines], "<u8")
            kinds = np.array([k for _, k in lines], "u1")
            name = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes() + kinds.tobytes())).view(np.int64)
            rows.append((int(name), hashes.view("<i8"), kinds.tobytes(), np.array([len(x) for x, _ in lines], "<i4")))
        yield pd.concat([pdf[["key", "host", "path"]], pd.DataFrame(rows, columns=["same", "lines", "kinds", "sizes"], index=pdf.index)], axis=1)


def deleted_lines(lines: list[int], kinds: bytes, sizes: list[int], other: list[int] | None) -> list[int]:
    """Numbers of the open lines that a page loses: those that its nearest page has too, short paragraphs only if the
    articles aren't copies; without a nearest page, those outside of a longer article."""
    if other is not None:
        shared = common_lines(lines, other)
        of_article = [i for i, k in enumerate(kinds) if k in (KEEP, PARAGRAPH)]
        copy = 2 * sum(sizes[i] for i in shared if kinds[i] in (KEEP, PARAGRAPH)) > sum(sizes[i] for i in of_article)
        return [i for i in shared if kinds[i] in (ASK, OUTSIDE) or kinds[i] == PARAGRAPH and not copy]
    outside = [i for i, k in enumerate(kinds) if k == OUTSIDE]
    return outside if sum(n for n, k in zip(sizes, kinds, strict=True) if k in (KEEP, ASK, PARAGRAPH)) > sum(sizes[i] for i in outside) else []


def _deleted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            other = (r.before, r.after)[nearest(r.path, r.before_path, r.after_path)]
            lost = deleted_lines(r.lines.tolist(), r.kinds, r.sizes.tolist(), None if other is None else other.tolist())
            notices = [{"at": i, "line": int(r.lines[i])} for i in lost if r.kinds[i] == PARAGRAPH]
            rows.append((r.host, r.same, [i for i in lost if r.kinds[i] != PARAGRAPH], notices))
        yield pd.DataFrame([x for x in rows if x[2] or x[3]], columns=["host", "same", "deleted", "notices"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [main_text(h, frozenset() if s is None else set(s.tolist())) for h, s in zip(pdf["html"], pdf["deleted"], strict=True)]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def _address(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: lower case, without "www.", query and fragment."""
    parts = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)[^/?#]*([^?#]*)", k)
    return F.lower(parts(1)), parts(2)


def differences(pages: DataFrame) -> DataFrame:
    """pages (key, host, path, html) -> (key, deleted): the numbers of open lines that pages lose, pages without any left out."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = saved(pages.mapInPandas(_line_hashes, "key long, host string, path string, same long, lines array<long>, kinds binary, sizes array<int>"), "lines")
    # Pages of a host with the same lines are one; all their columns but the path are equal.
    narrow = read.groupBy("host", "same").agg(F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("lines", "kinds", "sizes")))
    ranged = narrow.repartitionByRange(n, "host", "path", "same").sortWithinPartitions("host", "path", "same")
    ranged = saved(ranged.withColumn("at", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}), "sorted")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    # One row per range.
    numbered = ranged.join(F.broadcast(starts), F.col("part") == F.col("of")).withColumn("row", F.col("start") + F.col("at")).drop("part", "of", "start", "at")
    numbered = saved(numbered, "numbered")

    def neighbour(name: str, step: int) -> DataFrame:
        return numbered.select((F.col("row") + step).alias("row"), F.col("host").alias(name + "_host"), F.col("path").alias(name + "_path"), F.col("lines").alias(name))

    # A page without open lines loses none.
    open_lines = F.hex("kinds").rlike(f"^(..)*0[{ASK}{OUTSIDE}{PARAGRAPH}]")
    pairs = numbered.filter(open_lines).join(neighbour("before", 1), "row", "left").join(neighbour("after", -1), "row", "left")
    for name in ("before", "after"):
        same = F.col(name + "_host") == F.col("host")
        pairs = pairs.withColumns({name: F.when(same, F.col(name)), name + "_path": F.when(same, F.col(name + "_path"))})
    columns = ("host", "same", "path", "lines", "kinds", "sizes", "before", "before_path", "after", "after_path")
    lost = saved(pairs.select(*columns).mapInPandas(_deleted, "host string, same long, deleted array<int>, notices array<struct<at int, line long>>"), "lost")
    notices = lost.select("host", "same", F.explode("notices").alias("x")).select("host", "same", "x.at", "x.line")
    # Of those lines alone: whether any other host has one.
    seen = read.select(F.col("host").alias("of"), F.explode("lines").alias("line")).join(notices.select("line").distinct(), "line", "left_semi")
    local = seen.groupBy("line").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low = high").select("line")
    # At most a row for each line of a page.
    gone = notices.join(local, "line", "left_semi").groupBy("host", "same").agg(F.collect_list("at").alias("more"))
    lost = lost.join(gone, ["host", "same"], "left").select("host", "same", F.concat("deleted", F.coalesce("more", F.array().cast("array<int>"))).alias("deleted")).filter(F.size("deleted") > 0)
    return read.select("key", "host", "same").dropDuplicates(["key"]).join(lost, ["host", "same"]).select("key", "deleted")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    own = pages.select(F.col(f"`{page_id}`").cast("string").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    host, path = _address(F.col("url"))
    own = own.withColumns({"key": F.xxhash64("page_id", "url", "html"), "host": host, "path": path})
    deleted = saved(differences(own), "deleted")
    found = own.join(deleted, "key", "left").select("page_id", "url", "html", "deleted").mapInPandas(_texts, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", F.col("page_id").cast("long"))
