"""Main text of web pages, by consensus paths of each host.

1. Each page's containers are scored by the text they hold outside of links and boilerplate; the page
   votes for the generalised path (tags, and first classes without digits) of its best one.
2. Spark sums the votes by host and path. Sites are built from few templates, so the path that wins on a
   host is right also for a page that, alone, would have been misread.
3. Each page is read again by its host's winning path; a page that has no such container, or has unlinked text
   outside of it, keeps its own best.

Inside the container, boilerplate by tag or class (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) is left out. The rest is cut in blocks at block-level tags;
character references are decoded, white space in a block becomes one space, and blocks are joined by an empty line.

An element that only its class or id names as boilerplate stays if it holds most of the page's unlinked text and has
an h1, main or article of its own, as wrappers do; if nothing else is left of a page, classes and ids don't count.

Votes combine before they are shuffled. The hosts with most votes meet their path by a broadcast of at
most `hot_hosts` rows and `HOT_BYTES` each, so pages of a hot host stay where they were read; every other
host has less than a share of 1 / `hot_hosts` of all votes, and its pages meet the path by an ordinary join.

A page costs time and memory in proportion to its length, whatever its markup: see `tokens` and `Page`.

Defined cases: a null or empty page, or one without any text, gives an empty text; a page without a url
is of the host ''; ties between paths go to the one that sorts first; repeated rows vote as often as they
stand there and get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.session import ship, written

# Tags and words in classes, as the HTML standard and common site templates have them.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|math|textarea|select|button|title|object|canvas|audio|video"
DROP = frozenset("nav header footer aside form head menu dialog fieldset".split())
CONTAINER = frozenset("article main section div body td blockquote".split())
NOISE = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar header masthead footer sidebar aside cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist reply replies disqus share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager toolbar widget copyright legal skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# End tags that HTML lets authors leave out: a tag closes an open one of its set.
HOLDS = ("ul", "ol", "dl", "table", "tbody", "menu", "div", "article", "section", "select")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW.split("|")}
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag, quoted values whole. Nothing here is tried twice, so a tag costs no more than its length.
REST = re.compile(r"(?>[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+>")
ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NAMES = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
#: Classes that say what an element has or lacks, not what it is.
WITH = re.compile(r"(?:has|with|without|no)[-_]", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _named(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """(step of a generalised path, whether the element is boilerplate, whether its class or id says so)."""
    drop, noisy = tag in DROP, False
    if "=" not in attrs and "hidden" not in attrs:
        return tag, drop, False
    step = tag
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in NAMES:
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true":
            drop = True
        elif name == "role":
            drop |= value.lower() in ROLES
        elif value:
            parts = [p for x in value.split() if not WITH.match(x) for p in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x))]
            noisy |= any(p.lower() in NOISE for p in parts)
            if name == "class" and value.split():
                step = f"{tag}.{re.sub(r'[0-9]+', '', value.split()[0].lower())}"
    return step, drop and tag not in ("html", "body", "article", "main"), noisy


def tokens(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, tag, whether it is an end tag, attributes) of each piece of markup; tag is empty for what is to be skipped, "![" for CDATA.

    Linear in the page: a quote that is not closed, so that its tag never ends, is read as a plain character from
    there on, and what is not found once is not looked for again.
    """
    at, strict, cdata, n = 0, True, True, len(source)
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", False, ""
        elif cdata and source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            if end < 0:
                cdata = False
                continue
            end += 3
            yield at, end, "![", False, ""
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
            if not end:
                return
            yield at, end, "", False, ""
        elif (m := TAG.match(source, at)) is not None:
            rest = REST.match(source, m.end()) if strict else None
            if rest is None:
                strict = False
                end = source.find(">", m.end()) + 1
                if not end:
                    return
            else:
                end = rest.end()
            tag, closes = m[1].lower(), source[at + 1] == "/"
            if tag in RAW_END and not closes:
                stop = RAW_END[tag].search(source, end)
                end = stop.end() if stop else n
                tag = ""
            yield at, end, tag, closes, source[m.end() : end - 1] if tag else ""
        else:
            at += 1
            continue
        at = end


class Page:
    """Blocks of text in page order, each with the innermost container around it.

    A container knows its parent and the number of its path; paths are a tree of steps, so that a page of any
    depth takes memory in proportion to its length.
    """

    def __init__(self, source: str):
        self.parent: list[int] = []  # of each container
        self.path: list[int] = []
        self.steps: list[tuple[int, str]] = [(-1, "")]  # of each path: the path above it, and its last step
        self.known: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, container, named
        places: dict[str, list[int]] = {}  # of each open tag
        blocks: list[int] = []  # places of open blocks
        around: list[int] = []  # open containers
        names: list[int] = []  # open elements with a class or id of boilerplate
        wraps: list[bool] = []  # of each of those, whether it has an h1, main or article of its own
        above: list[int] = []  # of each of those, the one around it
        found: list[tuple[str, int, int, int]] = []
        text: list[str] = []
        linked = at = 0
        link = drop = 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                if joined and not drop:
                    found.append((joined, min(linked, len(joined)), around[-1] if around else -1, names[-1] if names else -1))
                text.clear()
            linked = 0

        def say(s: str) -> None:
            nonlocal linked
            if s and not drop:
                s = entities.unescape(s) if "&" in s else s
                text.append(s)
                if link:
                    linked += len(s.strip())

        def close(k: int) -> None:
            """Ends all elements from place k of the stack on."""
            nonlocal link, drop
            while len(stack) > k:
                tag, dropped, container, named = stack.pop()
                places[tag].pop()
                if tag in BLOCK:
                    blocks.pop()
                link -= tag == "a"
                drop -= dropped
                if container:
                    around.pop()
                if named:
                    names.pop()

        last = lambda tag: places[tag][-1] if places.get(tag) else -1
        for begin, end, tag, closes, attrs in tokens(source):
            say(source[at:begin])
            at = end
            if not tag:
                continue
            if tag == "![":
                say(entities.escape(source[begin + 9 : end - 3]))
                continue
            block = tag in BLOCK
            if block:
                flush()
            elif tag == "br":
                text.append(" ")
            if closes:
                # an inline end tag but </a> closes nothing beyond the block it stands in
                k = last(tag)
                if k >= 0 and (block or tag == "a" or not blocks or k > blocks[-1]):
                    close(k)
                continue
            if tag in VOID or attrs.endswith("/") and not block:
                continue
            if block:  # a new block ends an open paragraph, and open items of its kind
                if blocks and stack[blocks[-1]][0] == "p":
                    close(blocks[-1])
                if tag in CLOSES:
                    k = max(last(x) for x in CLOSES[tag])
                    if k > max(last(x) for x in HOLDS):
                        close(k)
            step, noise, noisy = _named(tag, attrs)
            container = tag in CONTAINER and not noise and not drop
            if container:
                over = self.path[around[-1]] if around else 0
                if (over, step) not in self.known:
                    self.known[over, step] = len(self.steps)
                    self.steps.append((over, step))
                self.parent.append(around[-1] if around else -1)
                self.path.append(self.known[over, step])
                around.append(len(self.parent) - 1)
            named = noisy and tag not in ("html", "body", "article", "main")
            if named:
                above.append(names[-1] if names else -1)
                names.append(len(wraps))
                wraps.append(False)
            elif tag in ("h1", "main", "article") and not noisy and not noise and not drop:
                k = names[-1] if names else -1
                while k >= 0 and not wraps[k]:  # those around one that has it have it already
                    wraps[k] = True
                    k = above[k]
            places.setdefault(tag, []).append(len(stack))
            if block:
                blocks.append(len(stack))
            stack.append((tag, noise, container, named))
            link += tag == "a"
            drop += noise
        say(source[at:])
        flush()
        total, held = 0, [0] * len(wraps)
        for s, n, _, k in found:
            worth = max(0, len(s) - 2 * n)
            total += worth
            if k >= 0:
                held[k] += worth
        for k in range(len(held) - 1, -1, -1):
            if above[k] >= 0:
                held[above[k]] += held[k]
        gone = []  # whether an element or one around it is boilerplate; the outer ones stand first
        for k, wrap in enumerate(wraps):
            gone.append(not (wrap and 2 * held[k] > total) or above[k] >= 0 and gone[above[k]])
        #: (text, how much of it is linked, innermost container) of each block that stays
        self.blocks = [x[:3] for x in found if x[3] < 0 or not gone[x[3]]] or [x[:3] for x in found]

    def scores(self) -> tuple[int, dict[int, int]]:
        """The unlinked text of the page, and of all containers of each path."""
        held = [0] * len(self.parent)
        total = 0
        for s, linked, c in self.blocks:
            worth = max(0, len(s) - 2 * linked)
            total += worth
            if c >= 0:
                held[c] += worth
        by_path: dict[int, int] = {}
        for c in range(len(held) - 1, -1, -1):
            if self.parent[c] >= 0:
                held[self.parent[c]] += held[c]
            by_path[self.path[c]] = by_path.get(self.path[c], 0) + held[c]
        return total, by_path

    def best(self) -> tuple[str, int]:
        """(path, score) of the container to read: the innermost one with all the unlinked text of the page."""
        total, by_path = self.scores()
        # a path stands after the one above it, so the last one is the innermost
        path = max((p for p, v in by_path.items() if total and v >= total), default=0)
        return self.written(path), by_path.get(path, 0)

    def written(self, path: int) -> str:
        out = []
        while path > 0:
            path, step = self.steps[path]
            out.append("/" + step)
        return "".join(reversed(out))

    def number(self, path: str) -> int:
        """The number of a written path on this page, -1 if no container has it."""
        at = 0
        for step in path.split("/")[1:]:
            at = self.known.get((at, step), -1)
            if at < 0:
                return -1
        return at if at > 0 else -1

    def text(self, path: int) -> str | None:
        """The text under the containers of that path; None if the page has none with text."""
        inside: list[bool] = []
        for c, up in enumerate(self.parent):
            inside.append(self.path[c] == path or up >= 0 and inside[up])
        found = [s for s, _, c in self.blocks if c >= 0 and inside[c]]
        return "\n\n".join(found) if found else None

    def read(self, path: str | None) -> str:
        own, score = self.best()
        text = None
        if path and (number := self.number(path)) > 0:
            text = self.text(number) if self.scores()[1].get(number, 0) >= score else None
        if text is None and own:
            text = self.text(self.number(own))
        return text if text is not None else "\n\n".join(s for s, _, _ in self.blocks)


#: A longer host and path together are never broadcast; with `hot_hosts` this bounds the broadcast.
HOT_BYTES = 4096


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes: the path that wins on each host, and all votes given there; a page's vote weighs 1000, and up to 1000 more for how much text it gives."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], int] = {}
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path, score = Page(source or "").best()
                if path:
                    votes[host_of(url), path] = votes.get((host_of(url), path), 0) + 1000 + min(1000, int(score))
            yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in votes], pa.string()), "path": pa.array([p for _, p in votes], pa.string()), "votes": pa.array(votes.values(), pa.int64())})

    votes = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"), F.sum("votes").alias("votes"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hot_hosts: int = 1000) -> DataFrame:
    """page_id, url, text, path of each row. hot_hosts: how many hosts with most votes are broadcast; results do not depend on it."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), HOST.pattern, 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    winners = written(host_paths(pages, url_col, html_col), "host-paths")
    hot = winners.where(F.octet_length("host") + F.octet_length("path") <= HOT_BYTES).orderBy(F.desc("votes"), "host").limit(hot_hosts)
    hot = written(hot.select("host", "path").coalesce(1), "hot-hosts")
    there = rows.join(F.broadcast(hot), "host").select("page_id", "url", "html", "path")
    cold = rows.join(F.broadcast(hot.select("host")), "host", "left_anti")
    cold = cold.join(winners.select("host", "path").join(F.broadcast(hot.select("host")), "host", "left_anti"), "host", "left").select("page_id", "url", "html", "path")
    joined = there.unionAll(cold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [Page(s or "").read(p) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), batch.column(3)], names=["page_id", "url", "text", "path"])

    return joined.mapInArrow(run, "page_id long, url string, text string, path string")
