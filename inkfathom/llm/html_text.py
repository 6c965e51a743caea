"""Main text of web pages: markup decides what it can, a suffix array per host what it cannot.

Every page is read into blocks of text in page order. Markup that names boilerplate (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments of readers) drops its blocks; text in an article or main element is
kept. What lies in neither, on pages with such an element as on others, is decided by repetition: the token streams of a host's
pages are concatenated, their suffixes sorted (prefix doubling to the depth of the shortest substring that counts), and
every substring of at least `min_tokens` tokens that stands on `min_pages` distinct pages is boilerplate; covered tokens
go, the unique runs between them stay; a page of nothing else has no text. Beside an article or main element, a whole
shorter block on as many pages goes as well. Pages with the same source are copies, not repetition: they count as one.

Only hosts with such pages are brought together; the pages of other hosts are done where they are read. A host's pages are dealt into groups of a bounded number of characters, so that a host with a third of all pages is as
many groups, each with a suffix array of its own. Where a host of several groups has pages that repetition decides, the
windows of `min_tokens` tokens are counted over all of its pages as well, so the groups do not show in the result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .near_dedup import Words, windows

MIN_TOKENS, MIN_PAGES = 12, 3
GROUP_CHARS = 400_000
#: Up to so many hosts (rows of about 60 bytes) are broadcast; beyond, joined by shuffle.
BROADCAST_HOSTS = 20_000
#: Elements, and words in class, id and role, that name what is no main text.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg math canvas object button select textarea dialog menu head title datalist audio video".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars menu menus nav navbar navigation navlinks breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond replies discussion share sharing social related recommended recommendations widget widgets toolbar "
    "pagination pager login search skiplink complementary contentinfo alert dialog".split()
)
NAMED_OUTSIDE = frozenset("header site-header topbar".split())
#: Inside an article only these elements are named, by whole class tokens or one of NAMED with a word for a holder.
NAMED_INSIDE = frozenset("div aside section ul ol".split())
HOLDERS = frozenset("box bar block wrapper wrap container holder inner outer area section list links link buttons button widget slot unit panel form items icons".split())
#: Readers' comments are no main text though they are articles, as an id inside an article too.
READERS = frozenset("comment comments commentlist disqus respond replies".split())
MODIFIERS = ("has-", "no-", "not-", "with-", "without-")
STATES = ("-open", "-closed", "-enabled", "-disabled")
NAMED_PAIRS = frozenset("side-bar sign-up skip-link site-header page-header top-bar".split())
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")

Block = tuple[str, bool]


def _named(attributes: str, inside: bool, tag: str = "div") -> tuple[bool, bool, bool, bool]:
    """(hidden, boilerplate by its names, main by its role, named by a part of a word only)"""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False, False, False, False
    named = main = whole = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False, False, False
        if name not in ("class", "id", "role"):
            continue
        main = main or name == "role" and value == "main"
        tokens = [x for x in value.replace("_", "-").split() if not x.startswith(MODIFIERS) and not x.endswith(STATES)]
        if tag in ("article", "main") and name != "role":  # by whole words only
            named = named or not READERS.isdisjoint(tokens)
        elif not inside:
            words = _NAME.findall(" ".join(tokens))
            named = named or not NAMED.isdisjoint(words) or not NAMED_PAIRS.isdisjoint(tokens) or not NAMED_OUTSIDE.isdisjoint(words)
            whole = whole or any(x in NAMED or x in NAMED_PAIRS or x in NAMED_OUTSIDE for x in tokens)
        elif name == "role":
            named = named or not NAMED.isdisjoint(tokens)
        elif tag in NAMED_INSIDE and name == "class":
            named = named or any(x in NAMED or x in NAMED_PAIRS or x.partition("-")[0] in NAMED and x.rpartition("-")[2] in HOLDERS for x in tokens)
        elif tag in NAMED_INSIDE and tag != "section":
            named = named or not READERS.isdisjoint(_NAME.findall(" ".join(tokens)))
    return False, named, main, named and not whole


def blocks(page: str) -> list[Block]:
    """The page's text blocks outside markup that names boilerplate, in order, each with whether an article or main element holds it.

    A name does not drop an element around the page's article or main element: one that holds more words than all that
    is left without it. Where there is no such element, part of a word (sidebar-layout) drops none that holds most words."""
    out, holders, parts = _blocks(page, frozenset())
    count = lambda found: sum(len(s.split()) for s, _ in found)
    if any(m for _, m in out):
        return out
    if holders:
        more = _blocks(page, frozenset(holders))[0]
        if count(x for x in more if x[1]) > count(out):
            return more
    elif parts:
        most = max(parts, key=parts.get)
        if 2 * parts[most] > count(out) + sum(parts.values()):
            return _blocks(page, frozenset([most]))[0]
    return out


def _blocks(page: str, exempt: frozenset[int]) -> tuple[list[Block], set[int], Counter[int]]:
    """(blocks, where the elements start that only their names drop and that hold an article or main element, the words in
    outermost elements that only a part of a word drops, by their starts). exempt: starts of elements that no name drops."""
    holders: set[int] = set()
    parts: Counter[int] = Counter()
    partial: set[int] = set()
    owner = -1
    out: list[Block] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, dropped, main, start if its name may be overruled, -1 if only inherited, -2 if not
    dropped = main = False
    at, n = 0, len(page)

    def close() -> None:
        if text:
            s = " ".join(entities.unescape("".join(text)).split())
            if s:
                out.append((s, main))
            text.clear()

    while at < n:
        m = _TAG.search(page, at)
        if not dropped:
            text.append(page[at : m.start() if m else n])
        elif owner in partial:
            parts[owner] += len(page[at : m.start() if m else n].split())
        if not m:
            break
        at = m.end()
        ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or tag in ("td", "th"):
            text.append(" ") if not dropped else None
        if tag in VOID and tag != "hr":
            continue
        block = tag in BLOCKS and tag not in ("td", "th")
        if block:
            close()
        if tag == "hr":
            continue
        if ending:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
        else:
            if tag in RAW and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
                continue
            if block:  # an open paragraph ends where a block begins
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), None)
                if depth is not None and (stack[depth][0] == "p" or stack[depth][0] == tag in CLOSES_ITSELF):
                    del stack[depth:]
            if tag in ("article", "main"):  # page-level boilerplate left open ends here
                while stack and stack[-1][1] and stack[-1][0] in ("nav", "header", "footer"):
                    stack.pop()
            was_dropped, was_main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            hidden, by_name, role, by_part = _named(attributes, was_main, tag)
            by_tag = hidden and tag not in ("html", "body") or tag in DROPPED and not (tag == "header" and was_main)
            if tag in ("html", "body", "main") or m.start() in exempt:
                by_name = False
            is_main = tag in ("article", "main") or role
            if not attributes.rstrip().endswith("/"):
                readers = by_name and not READERS.isdisjoint(_NAME.findall(attributes.lower()))
                if by_part and not readers:
                    partial.add(m.start())
                stack.append((tag, was_dropped or by_tag or by_name, was_main or is_main, -2 if by_tag or readers else m.start() if by_name else -1))
                if is_main and stack[-1][1] and all(x[3] > -2 for x in stack):
                    holders.update(x[3] for x in stack if x[3] >= 0)
        dropped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        owner = next((x[3] for x in stack if x[3] >= 0), -1) if dropped and all(x[3] > -2 for x in stack) else -1
    close()
    return out, holders, parts


def repeated(tokens: np.ndarray, pages: np.ndarray, length: int, min_pages: int) -> np.ndarray:
    """Which tokens lie in a substring of `length` tokens that stands on at least min_pages distinct pages.

    tokens: the pages' streams one after another (identifiers >= 0), pages: each token's page. The suffix array is built
    by prefix doubling; the last step overlaps, so that suffixes are sorted to exactly `length` tokens.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < length:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        ahead = np.zeros(n, np.int64)
        same = np.flatnonzero(pages[: n - step] == pages[step:])  # a stream ends with its page
        ahead[same] = rank[same + step]
        ahead[rank == 0] = 0
        alive = (ahead > 0) & (rank > 0)
        code = rank * (int(rank.max()) + 1) + ahead
        new = np.zeros(n, np.int64)
        new[alive] = np.unique(code[alive], return_inverse=True)[1] + 1
        rank, depth = new, depth + step
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[rank[suffixes] > 0]
    if not len(suffixes):
        return covered
    r, p = rank[suffixes], pages[suffixes]
    first = np.append(True, r[1:] != r[:-1])
    distinct = np.add.reduceat((first | np.append(True, p[1:] != p[:-1])).astype(np.int64), np.flatnonzero(first))
    starts = suffixes[distinct[np.cumsum(first) - 1] >= min_pages]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:n]) > 0


def _unique(words: list[str], gone: np.ndarray, min_tokens: int) -> list[str]:
    """A block's words without its covered runs. A run counts where it is the whole block or long enough by itself: a
    repeated substring that starts or ends in a neighbouring block takes no few words of this one with it."""
    if gone.all() or not gone.any():
        return [] if gone.any() else words
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= min_tokens:
            out += words[at:a]
            at = b
    return out + words[at:]


def window_keys(page: list[Block], host: str, length: int, words: Words) -> np.ndarray:
    """A key of every `length` tokens of the page's stream, in order, alike only on the same host."""
    h = np.array([words[w.encode()] for s, _ in page for w in s.split()], np.uint64)
    return windows(h, length, xxhash.xxh3_64_intdigest(host.encode())).view(np.int64)


def block_key(text: str, host: str) -> int:
    """A key of a whole block, alike only on the same host."""
    key = xxhash.xxh3_64_intdigest(f"{host}\n{text}".encode(), 1)
    return key - (1 << 64) if key >> 63 else key


def repeat_keys(page: list[Block], host: str, length: int, words: Words) -> np.ndarray:
    """The distinct keys by which the page's repeats are counted: its windows, and its blocks too short for one."""
    short = np.array([block_key(s, host) for s, _ in page if s.count(" ") + 1 < length], np.int64)
    return np.unique(np.concatenate([window_keys(page, host, length, words), short]))


def main_texts(pages: list[list[Block]], min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, host: str = "", repeats: np.ndarray | None = None) -> list[str]:
    """The main text of each of one host's pages. repeats: keys of windows known to be boilerplate from pages not given."""
    numbers: dict[tuple, int] = {}
    which = [numbers.setdefault(tuple(page), len(numbers)) for page in pages]
    pages = [list(page) for page in numbers]
    vocabulary: dict[str, int] = {}
    words = [[b[0].split() for b in page] for page in pages]
    streams = [[vocabulary.setdefault(w, len(vocabulary)) for ws in page for w in ws] for page in words]
    sizes = [len(s) for s in streams]
    tokens = np.array([t for s in streams for t in s], np.int64)
    covered = repeated(tokens, np.repeat(np.arange(len(pages)), sizes), min_tokens, min_pages)
    out, at, hashes = [], 0, Words()
    short = Counter(s for page in pages for s in {s for s, _ in page if s.count(" ") + 1 < min_tokens})
    known = frozenset() if repeats is None else frozenset(repeats.tolist())
    for page, page_words, size in zip(pages, words, sizes):
        gone, at = covered[at : at + size], at + size
        decided = any(in_main for _, in_main in page)
        if all(in_main for _, in_main in page):
            out.append("\n\n".join(s for s, _ in page))
            continue
        if repeats is not None and len(repeats):
            for i in np.flatnonzero(np.isin(window_keys(page, host, min_tokens, hashes), repeats)):
                gone[i : i + min_tokens] = True
        kept, i = [], 0
        for (s, in_main), ws in zip(page, page_words):
            run, i = ws if in_main else _unique(ws, gone[i : i + len(ws)], min_tokens), i + len(ws)
            if decided and not in_main and len(ws) < min_tokens and (short[s] >= min_pages or block_key(s, host) in known):
                continue
            if run:
                kept.append(" ".join(run))
        out.append("\n\n".join(kept))
    return [out[i] for i in which]


def _host_repeats(docs: DataFrame, min_tokens: int, min_pages: int) -> DataFrame:
    """(host, group, key) of windows on min_pages pages of a host or more, for the pages of docs (number, host, group,
    html) that repetition decides. Each page counts a window once, and pages with the same source count as one."""

    def keys(undecided: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words()
            for b in batches:
                for host, group, html in zip(*(c.to_pylist() for c in b.columns)):
                    page = blocks(html)
                    if undecided and all(m for _, m in page):
                        continue
                    k = repeat_keys(page, host, min_tokens, words)
                    if len(k):
                        yield pa.RecordBatch.from_arrays([pa.array([host] * len(k)), pa.array([group] * len(k), pa.int64()), pa.array(k)], names=["host", "group", "key"])

        return run

    kinds = "host string, group bigint, key bigint"
    targets = written(docs.select("host", "group", "html").mapInArrow(keys(True), kinds).distinct(), "windows")
    firsts = docs.groupBy("host", F.xxhash64("html").alias("_hash"), F.length("html").alias("_length")).agg(F.min("number").alias("number")).select("number")
    once = docs.join(firsts, "number", "left_semi").select("host", "group", "html")
    counts = once.mapInArrow(keys(False), kinds).groupBy("key").count().filter(F.col("count") >= min_pages)
    return targets.join(counts.select("key"), "key").select("host", "group", "key")


def _open_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts with a page that markup does not decide as a whole."""
    for b in batches:
        hosts, found = b.column(0).to_pylist(), set()
        for host, page in zip(hosts, b.column(1)):
            if host not in found and not all(m for _, m in blocks(page.as_py())):
                found.add(host)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["host"])


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null and empty html give empty text, as does a page of boilerplate only; a null url is a host of its own; null
    page_ids stay null; repeated rows get equal texts and are dealt out one by one. No pages give no rows. Other columns
    are not read.
    """
    bounded_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    docs = pages.select(F.monotonically_increasing_id().alias("number"), "page_id", "url", host.alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    kind = docs.schema["page_id"].dataType.simpleString()
    result = f"page_id {kind}, url string, text string, n_chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n\n".join(s for s, _ in blocks(x.as_py())) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    open_hosts = written(docs.select("host", "html").mapInArrow(_open_hosts, "host string").distinct(), "hosts")
    few = open_hosts.count()
    if not few:
        return docs.select("page_id", "url", "html").mapInArrow(read, result)
    small = lambda df: F.broadcast(df) if few <= BROADCAST_HOSTS else df
    done = docs.join(small(open_hosts), "host", "left_anti").select("page_id", "url", "html").mapInArrow(read, result)
    docs = docs.join(small(open_hosts), "host", "left_semi")
    sizes = docs.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / group_chars).alias("groups")).filter("groups > 1").withColumnRenamed("host", "_host")
    docs = docs.join(small(written(sizes, "sizes")), F.col("host") == F.col("_host"), "left")
    group = F.pmod(F.xxhash64("number"), F.coalesce(F.col("groups"), F.lit(1)))
    many = F.col("groups").isNotNull().alias("many")
    docs = docs.select("number", "page_id", "url", "host", group.alias("group"), "html", many)
    repeats = _host_repeats(docs.filter("many").select("number", "host", "group", "html"), min_tokens, min_pages)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(x.as_py()) for x in b.column(4)]
            texts = pa.array([[s for s, _ in x] for x in found], pa.list_(pa.string()))
            mains = pa.array([[m for _, m in x] for x in found], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], texts, mains], names=["page_id", "url", "host", "group", "texts", "mains"])

    def decide(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in (table.schema.field("page_id"), table.schema.field("url"), pa.field("text", pa.string()), pa.field("n_chars", pa.int64()))})
        table = table.combine_chunks()
        found = [list(zip(t, m)) for t, m in zip(table["texts"].to_pylist(), table["mains"].to_pylist())]
        texts = main_texts(found, min_tokens, min_pages, table["host"][0].as_py(), np.array(known["key"], np.int64))
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    parsed = docs.select("page_id", "url", "host", "group", "html").mapInArrow(parse, f"page_id {kind}, url string, host string, group bigint, texts array<string>, mains array<boolean>")
    return done.unionByName(parsed.groupBy("host", "group").cogroup(repeats.groupBy("host", "group")).applyInArrow(decide, result))
