"""Main text of web pages: suffix arrays over each host's pages, then a check by markup.

Blocks: a page is read tag by tag into blocks of text.  Blocks in menus, footers,
asides, forms, adverts, notices and reader comments (by element, role, class or
id) are marked; the others in an article (or, without one, in a main element) are
its article.  A page has one stream of tokens: its article's, or without one all.

Host suffix arrays run over the streams of all pages: arrays over some pages each,
sorted to a depth of LONG tokens, bring equal substrings together, and shuffles by
(host, substring) merge them for the whole host, whatever its size.  What repeats goes,
with everything longer that it covers, and the unique runs are left:

* on pages without an article, substrings on two distinct pages of the host;
* in articles, substrings of more than half of the host's articles, both of its rows
  and of its distinct articles, and of SEVERAL distinct ones at least.  Fewer pages
  would not do, since passages and articles are copied between pages of a host.

The check follows: marked blocks go, as the words of a menu or footer may be each
page's own; so does what lies beside an article.  An article of which more than
half would go shares its own text with the others, as near copies do, and stays whole.

Scale: pages are parsed where they are read and kept as blocks in the shared folder.
A substring of more than half of a host's articles is one of more than half of those
in some array, so only such substrings are candidates.  Each has a piece of PIECE
tokens, the same wherever it stands, which some neighbours share; pieces are dealt into
CELLS cells.  Pieces in candidates' cells are counted, then substrings in the cells of
pieces of SEVERAL rows, and nothing else is shuffled.  Where no array has many articles
of a host, nearly all substrings are candidates, and where more pieces repeat than there
are cells, nearly all substrings are shuffled.  Of hosts with a page without an article, each task sends every distinct substring outside of
articles once, with the least and the greatest page; those pages also send where each
of theirs stands.  Keys are hashes of host and substring, so a host of a third of
all pages is spread over all tasks.  There is no limit of pages or bytes to a host.

Edge cases: null and empty html give an empty text; a null url is a host of its
own; markup that is never closed ends with the page; repeated rows are pages of
one page_id and one article and don't count as distinct, and no substring goes on from
row to row; an empty table gives an empty result; a page of any length is read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens of a repeated substring at least.
LONG = 8

#: Distinct articles that share a substring at least, for it to be their host's and not copied.
SEVERAL = 8

#: Tokens of the piece that stands for a substring while candidates are sought.
PIECE = 4

#: Cells that tell substrings apart before they are shuffled (a power of two).
CELLS = 1 << 20

#: Elements by what they do (fixed values).
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("nav footer aside form menu dialog button fieldset head".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
SIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|paywall"
    r"|comments?|commentlist|disqus|repl(?:y|ies)|respond|menu|menus|nav|navbar|navigation|topnav|breadcrumbs?|sidebar|aside|widgets?|footer|toolbar|pagination|pager|login|signup|disclaimer)(?:$|[\s_-])",
    re.I,
)
TOP = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|page-?head|site-?head)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--|<!|<\?|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Substrings of most articles that are sent to all tasks (8 bytes each); where there are more, they are joined.
SENT = 500_000

#: What a block is, the first character of its line.
REST, MARKED, ARTICLE = "012"

#: Blocks' words are parted by single spaces, texts by line feeds.
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True

OTHER, SIDED, OWN = 0, 1, 2


def _marked(name: str, attributes: str, in_own: bool) -> bool:
    """Whether an element starts something beside the text."""
    if name in APART or (name == "header" and not in_own):
        return True
    for m in _ATTRIBUTE.finditer(attributes) if "=" in attributes or "hidden" in attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value.lower() in SIDE_ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main") and (SIDE.search(value) or (not in_own and TOP.search(value))):
            return True
    return False


class _Ends:
    """Where tags end, in one pass over a page: what isn't there any more isn't looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.gone, self.broken = page, set(), False

    def of(self, at: int) -> int:
        """The > that ends a tag whose name ends here, quoted ones aside; -1 without one.

        A quote that is never closed is a character like others; once no > outside of
        quotes is left, any > will do.
        """
        k = at
        while not self.broken:
            m = _STOP.search(self.page, k)
            if not m:
                self.broken = True
                break
            k = m.end()
            if m[0] == ">":
                return m.start()
            if m[0] not in self.gone:
                close = self.page.find(m[0], k)
                if close < 0:
                    self.gone.add(m[0])
                else:
                    k = close + 1
        if ">" in self.gone:
            return -1
        k = self.page.find(">", at)
        if k < 0:
            self.gone.add(">")
        return k


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, marked, in an article, in a main element) of all non-empty blocks in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]  # name, marked, article, main
    text: list[str] = []
    at, n = 0, len(page)
    ends, closes, opened = _Ends(page), {}, Counter()

    def flush() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            text.clear()
            if words:
                _, side, article, main = stack[-1]
                out.append((" ".join(words), side, article, main))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        if m[2] is not None:
            end = ends.of(m.end())
            if end < 0:
                text.append(page[lt:])
                break
        if m[2] is None:
            close = "-->" if m[0] == "<!--" else ">"
            end = page.find(close, m.end())
            at = n if end < 0 else end + len(close)
            continue
        at, name, attributes = end + 1, m[2].lower(), page[m.end() : end]
        if not m[1]:
            if name in RAW:
                close = closes.setdefault(name, re.compile(rf"</{name}\b[^>]*>", re.I)).search(page, at)
                at = close.end() if close else n
                continue
            if name in VOID:
                text.append(" ")  # br and the like part words
                if name == "hr":
                    flush()
                continue
            if name in BLOCKS:
                flush()
                if stack[-1][0] == "p" or (name == "li" == stack[-1][0]):
                    opened[stack.pop()[0]] -= 1
            elif name not in ("button", "label", "span", "a"):
                continue  # inline markup
            _, side, article, main = stack[-1]
            mark = side or _marked(name, attributes, article or main)
            if name in BLOCKS or (mark and not side):
                if name not in BLOCKS:
                    flush()
                article = article or (name == "article" and not mark)
                main = main or name == "main" or ("main" in attributes and bool(re.search(r"""role\s*=\s*["']?main\b""", attributes)))
                if not attributes.endswith("/"):
                    stack.append((name, mark, article, main))
                    opened[name] += 1
        else:
            if name in BLOCKS:
                flush()
            if opened[name] > 0:
                flush()
                while stack[-1][0] != name:
                    opened[stack.pop()[0]] -= 1
                opened[stack.pop()[0]] -= 1
    flush()
    return out


def parts(page: str) -> list[tuple[str, str]]:
    """(what it is, text) of all blocks of a page."""
    found = blocks(page)
    where = 2 if any(b[2] and not b[1] for b in found) else 3 if any(b[3] and not b[1] for b in found) else 0
    return [(MARKED if b[1] else ARTICLE if where and b[where] else REST, b[0]) for b in found]


def stream(lines: list[str], article: bool) -> str:
    """The text of a page's article, or of all blocks outside of one."""
    return "\n".join(line[1:] for line in lines if (line[0] == ARTICLE) == article)


def suffix_order(tokens: np.ndarray, depth: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first depth tokens (doubled step by step), and each suffix's rank."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width, n = 1, len(tokens)
    while width < depth:
        step = min(width, depth - width)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    return np.argsort(rank, kind="stable"), rank


def covered(tokens: np.ndarray, page: np.ndarray, long: int = LONG) -> np.ndarray:
    """Which tokens lie in a substring of long tokens that two distinct pages have."""
    n = len(tokens)
    if n < long:
        return np.zeros(n, bool)
    order, rank = suffix_order(tokens, long)
    whole = order[order + long <= n]
    whole = whole[page[whole] == page[whole + long - 1]]
    begins = np.flatnonzero(np.concatenate([[True], rank[whole][1:] != rank[whole][:-1]])) if len(whole) else np.zeros(0, int)
    if not len(begins):
        return np.zeros(n, bool)
    low, high = np.minimum.reduceat(page[whole], begins), np.maximum.reduceat(page[whole], begins)
    repeated = np.repeat(low != high, np.diff(np.append(begins, len(whole))))
    return common.covered(n, whole[repeated], long)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page_id, url, article (a hash of its text, null without one), blocks (a line each, first what it is)."""
    for b in batches:
        articles, pages = [], []
        for page in b.column(3).to_pylist():
            lines = [kind + text for kind, text in parts(page)]
            own = stream(lines, True)
            articles.append(int.from_bytes(blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if own else None)
            pages.append("\n".join(lines))
        yield pa.record_batch([*b.columns[:3], pa.array(articles, pa.int64()), pa.array(pages, pa.string())], names=["host", "page_id", "url", "article", "blocks"])


def windows(hosts: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all streams (hashed with the host), and of all windows of LONG of them within one stream: first token, stream, hash."""
    words, counts = common.word_hashes([t.encode() for t in texts], _BLANK)
    page = np.repeat(np.arange(len(texts)), counts)
    tokens = common.mix(words + common.mix(np.array(hosts, np.int64).view(np.uint64)[page]))
    runs = common.gram_hashes(tokens, LONG)
    begin = np.flatnonzero(page[: len(runs)] == page[LONG - 1 :][: len(runs)])
    return tokens, begin, page[begin], runs[begin].view(np.int64)


def _streams(b: pa.RecordBatch, article: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Some pages at a time, by host: hosts, the second column, streams (of the last one)."""
    hosts, second = (np.array(b.column(k).to_pylist(), np.int64) for k in (0, 1))
    order = np.argsort(hosts, kind="stable")
    hosts, second = hosts[order], second[order]
    texts = [stream(t.split("\n") if t else [], article) for t in b.column(2).take(pa.array(order)).to_pylist()]
    for part in common.groups(texts):
        yield hosts[part], second[part], texts[part]


def pieces(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each window that begins here the least hash of its pieces, which neighbours mostly share."""
    runs = common.gram_hashes(tokens, PIECE)
    least = np.full(len(begin), np.iinfo(np.uint64).max, np.uint64)
    for k in range(LONG - PIECE + 1):
        np.minimum(least, runs[begin + k], out=least)
    return least.view(np.int64)


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run, low, high: from (host, page, blocks), each distinct substring outside of articles with its least and greatest page."""
    for b in batches:
        for hosts, pages, texts in _streams(b, False):
            tokens, begin, k, run = windows(hosts, texts)
            if len(begin):
                rank = suffix_order(tokens)[1][begin]
                order = np.argsort(rank, kind="stable")
                rank, run, page = rank[order], run[order], pages[k[order]]
                first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
                yield pa.record_batch([pa.array(x) for x in (run[first], np.minimum.reduceat(page, first), np.maximum.reduceat(page, first))], names=["run", "low", "high"])


def _once(order: np.ndarray, groups: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The first of each distinct pair of a group and a page, of an order by both."""
    g, k = groups[order], k[order]
    return order[np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])]


def candidates(hosts: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Substrings of more than half of a host's articles among these, and their pieces."""
    tokens, begin, k, run = windows(hosts, texts)
    if not len(begin):
        return run, run
    order, rank = suffix_order(tokens)
    place = np.full(len(tokens), -1)
    place[begin] = np.arange(len(begin))
    order, rank = place[order], rank[begin]
    once = _once(order[order >= 0], rank, k)
    first = np.flatnonzero(np.concatenate([[True], np.diff(rank[once]) != 0]))
    n = np.diff(np.append(first, len(once)))
    _, of, rows = np.unique(hosts, return_inverse=True, return_counts=True)
    most = once[first][2 * n > rows[of[k[once[first]]]]]
    return run[most], pieces(tokens, begin[most])


def _candidates(cells: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cell: from (host, article, blocks), of hosts in these cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = within(cells)
        for b in batches:
            b = b.filter(pa.array(inside(np.array(b.column(0).to_pylist(), np.int64)), pa.bool_()))
            for hosts, _, texts in _streams(b, True):
                yield pa.record_batch([pa.array(np.unique(candidates(hosts, texts)[1] & (CELLS - 1)))], names=["cell"])

    return run


def _pieces(cells: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """piece: from (host, article, blocks), the pieces in these cells, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = within(cells)
        for b in batches:
            for hosts, _, texts in _streams(b, True):
                tokens, begin, k, _ = windows(hosts, texts)
                piece = pieces(tokens, begin)
                keep = inside(piece)
                k, piece = k[keep], piece[keep]
                if len(piece):
                    yield pa.record_batch([pa.array(piece[_once(np.argsort(piece, kind="stable"), piece, k)])], names=["piece"])

    return run


def _counts(cells: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, h, article: from (host, article, blocks), the substrings with pieces in these cells, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = within(cells)
        for b in batches:
            for hosts, articles, texts in _streams(b, True):
                tokens, begin, k, runs = windows(hosts, texts)
                keep = inside(pieces(tokens, begin))
                k, runs = k[keep], runs[keep]
                if len(runs):
                    once = _once(np.argsort(runs, kind="stable"), runs, k)
                    yield pa.record_batch([pa.array(x) for x in (runs[once], hosts[k[once]], articles[k[once]])], names=["run", "h", "article"])

    return run


def _places(article: bool, cells: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, key, at: from (host, key, blocks), where each substring in these cells stands on the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = within(cells)
        for b in batches:
            for hosts, keys, texts in _streams(b, article):
                _, _, k, runs = windows(hosts, texts)
                at = np.arange(len(k)) - np.searchsorted(k, k)  # a page's windows are consecutive
                keep = inside(runs)
                yield pa.record_batch([pa.array(runs[keep]), pa.array(keys[k[keep]]), pa.array(at[keep], pa.int64())], names=["run", "key", "at"])

    return run


def within(cells: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Tells which numbers lie in one of these cells."""
    mask = np.zeros(CELLS, bool)
    mask[cells] = True
    return lambda x: mask[x & (CELLS - 1)]


def cells_of(frame: DataFrame, column: str) -> np.ndarray:
    """The cells of a column's numbers, CELLS at most."""
    return frame.select(F.col(column).bitwiseAND(CELLS - 1).alias("cell")).distinct().toArrow().column("cell").to_numpy()


def text_of(page: str, at: list[int]) -> str:
    """The unique runs of a page whose repeated windows begin at these tokens of its stream, as far as the markup lets them be text."""
    lines = page.split("\n") if page else []
    article = any(line[0] == ARTICLE for line in lines)
    blocks_ = [(line[0], line[1:].split(" ")) for line in lines if (line[0] == ARTICLE) == article]
    gone = common.covered(sum(len(w) for _, w in blocks_), np.array(at, np.int64), LONG)
    if article and 2 * gone.sum() > len(gone):
        gone[:] = False
    kept, n = [], 0
    for kind, words in blocks_:
        left = [] if kind == MARKED else [w for w, g in zip(words, gone[n : n + len(words)], strict=True) if not g]
        n += len(words)
        if left:
            kept.append(" ".join(left))
    return "\n".join(kept)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [text_of(page, at or []) for page, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _without(gone: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """page_id, url, text: from (page_id, url, blocks, h), where these (sorted) substrings of articles go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages, hosts, texts = b.column(2).to_pylist(), b.column(3).to_pylist(), []
            streams = [stream(page.split("\n"), True) for page in pages]
            for part in common.groups(streams):
                _, _, k, runs = windows(hosts[part], streams[part])
                at = np.arange(len(k)) - np.searchsorted(k, k)
                keep = gone[np.minimum(np.searchsorted(gone, runs), len(gone) - 1)] == runs
                k, at = k[keep], at[keep]
                cut = np.searchsorted(k, np.arange(len(streams[part]) + 1))
                texts += [text_of(page, at[low:high]) for page, low, high in zip(pages[part], cut, cut[1:])]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _in_articles(spark: SparkSession, articles: DataFrame) -> DataFrame | None:
    """run: the substrings of most of a host's articles; None if there are none."""
    sizes = articles.groupBy("h", "article").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("all_rows"), F.count("*").alias("all_articles"))
    hosts = cells_of(sizes.filter(F.col("all_articles") >= SEVERAL), "h")
    rows = articles.select("h", "article", "blocks")
    cells = cells_of(rows.mapInArrow(_candidates(hosts), "cell long"), "cell") if len(hosts) else hosts
    if len(cells):
        cells = cells_of(rows.mapInArrow(_pieces(cells), "piece long").groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") >= SEVERAL), "piece")
    if not len(cells):
        return None
    counts = rows.mapInArrow(_counts(cells), "run long, h long, article long").groupBy("run", "h", "article").agg(F.count("*").alias("n"))
    counts = counts.groupBy("run", "h").agg(F.sum("n").alias("rows"), F.count("*").alias("articles")).filter(F.col("articles") >= SEVERAL)
    most = (2 * F.col("rows") > F.col("all_rows")) & (2 * F.col("articles") > F.col("all_articles"))
    repeated = common.cut(counts.join(sizes, "h").filter(most).select("run"))
    return None if repeated.isEmpty() else repeated


def _where(pages: DataFrame, article: bool, repeated: DataFrame) -> DataFrame:
    """page_id, url, blocks, at: where these substrings stand on each page."""
    cells = cells_of(repeated, "run") if article else np.arange(CELLS)
    places = pages.select("h", "key", "blocks").mapInArrow(_places(article, cells), "run long, key long, at long")
    found = places.join(repeated, "run").groupBy("key").agg(F.collect_set("at").alias("at"))
    return pages.join(found, "key", "left").select("page_id", "url", "blocks", "at")


def _outside(parsed: DataFrame, bare: DataFrame) -> DataFrame:
    """run: the substrings that two distinct pages of a host have outside of articles, of hosts with a page without one."""
    streams = parsed.join(bare.select("h").distinct(), "h", "left_semi").select("h", F.xxhash64("page_id").alias("page"), "blocks")
    runs = streams.mapInArrow(_substrings, "run long, low long, high long").groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return runs.filter("low <> high").select("run")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    rows = pages.select(host_of(url_col).alias("host"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    kept = common.scratch(spark, "pages")
    rows.mapInArrow(_parse, f"host string, page_id {kind}, url string, article long, blocks string").write.parquet(kept, compression="zstd")
    parsed = spark.read.parquet(kept).withColumn("h", F.xxhash64("host")).withColumn("key", F.xxhash64("host", "blocks"))
    articles, bare = parsed.filter("article IS NOT NULL"), parsed.filter("article IS NULL")
    schema = f"page_id {kind}, url string, text string"
    gone = _in_articles(spark, articles)
    if gone is None:
        texts = articles.select("page_id", "url", "blocks", F.lit(None).cast("array<bigint>").alias("at")).mapInArrow(_texts, schema)
    elif gone.count() <= SENT:
        texts = articles.select("page_id", "url", "blocks", "h").mapInArrow(_without(np.sort(gone.toArrow().column("run").to_numpy())), schema)
    else:
        texts = _where(articles, True, gone).mapInArrow(_texts, schema)
    if not bare.isEmpty():
        texts = texts.unionByName(_where(bare, False, _outside(parsed, bare)).mapInArrow(_texts, schema))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
