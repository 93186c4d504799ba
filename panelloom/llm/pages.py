"""Main text of web pages by differencing each page with its nearest neighbours in URL order.

A page becomes a list of text lines, one for each block element. Pages of a host are ordered by
path; each is aligned with the nearest page before and after it that is no copy by a longest common
subsequence of lines, and shared lines are deleted. Scripts, menus, adverts and the like, which the markup
names, never give lines. An article element is evidence only: as two articles may quote the same passage, its
shared lines go only where they frame the articles of both neighbours and of half of the host's pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import stored, with_rank

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
NAME = re.compile(r"[A-Za-z0-9]+")
NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = set(
    "head nav footer aside form button select dialog template svg math menu object audio video canvas "
    "fieldset datalist".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp "
    "small span strike strong sub sup time tt u var wbr br img td th".split()
)
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay sidebar rail nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer footers masthead topbar toolbar comment comments "
    "commentlist discussion respond disqus reply replies share sharing social related recommended newsletter "
    "subscribe subscription signup login pagination pager widget widgets copyright".split()
)
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split()
)
#: Start tags that end an open element of the named kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
MARKED, PLAIN, ARTICLE = 0, 1, 2  # kinds of lines
TABLE_BITS = 1 << 24  # of an alignment's table; a larger one is halved
FREQUENT = 64  # places of a line from which their bits are kept
HOST_SHARE = 0.5  # of a host's pages with an article that a line must frame to go
COPY = 0.8  # pages that share this much of the longer one's unmarked text are copies of one page
BUCKETS = 1024  # that pages with the same lines are dealt to
PIECE = 64  # pages of a run that ask for their neighbours together


def _names(value: str) -> set[str]:
    """The words that class names, ids and element names are made of: ``adBanner``, ``side-bar``, ``sideBar``."""
    whole = NAME.findall(value)
    return {x.lower() for w in whole for x in (w, *NAME_PART.findall(w))}


def _marked(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED or name == "header" and not inside or "-" in name and _names(name) & BOILERPLATE:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            parts = _names(value)
            if parts & BOILERPLATE or "header" in parts and not inside:
                return True
        elif (
            key == "role" and value.lower() in ROLES
            or key == "hidden"
            or key == "aria-hidden" and value.lower() == "true"
            or key == "style" and HIDDEN.search(value)
        ):
            return True
    return False


OUTSIDE = (False, "", False)  # marked (or within such), article or main, marked by an inline element


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(line, kind) of each block with text, in page order; kind MARKED for menus and the like.

    References are decoded, runs of white space become one space. Unclosed elements
    end with the element around them. A marked element inside a line is a line of its own and does not
    cut that line. Of nested ``main`` and ``article`` the article counts, if there is one.
    """
    page = page or ""
    found: list[tuple[str, int, str]] = []
    stack: list[tuple[str, bool, str, bool]] = []
    line: list[str] = []
    inset: list[str] = []
    marked, within, soft = OUTSIDE

    def flush(pieces: list[str], kind: int) -> None:
        if pieces:
            if text := " ".join("".join(pieces).split()):
                found.append((text, kind, within))
            pieces.clear()

    def close() -> None:
        flush(inset, MARKED)
        flush(line, MARKED if marked and not soft else PLAIN)

    def enter(state: tuple[bool, str, bool]) -> None:
        nonlocal marked, within, soft
        if state != (marked, within, soft):
            if soft and not state[2]:
                flush(inset, MARKED)
            elif not state[2]:
                close()
            marked, within, soft = state

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.match(page, at)
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            piece = token[0]
            if piece[0] != "<" or piece == "<":
                (inset if soft else line).append(html.unescape(piece) if "&" in piece else piece)
            continue
        name, closing = name.lower(), bool(token[1] or token[4])
        if name not in INLINE:
            close()
        elif name in ("br", "td", "th"):
            line.append(" ")
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0 and not (name in INLINE and any(x[0] not in INLINE for x in stack[depth:])):
                del stack[depth:]
        else:
            attributes = token[3] or token[6] or ""
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = page.find(">", stop.start()) + 1 or end if stop else end
                continue
            ends = CLOSES.get(name) or (set() if name in INLINE else {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ("p", "li", "dt", "dd", "td", "th"):
                    break
            before = stack[-1][1:] if stack else OUTSIDE
            if name not in VOID and not attributes.endswith("/"):
                here = before[0] or _marked(name, attributes, bool(before[1]))
                inner = "article" if name == "article" else before[1] or ("main" if name == "main" else "")
                inline = name in INLINE and (before[2] or here and not before[0])
                stack.append((name, here, inner, inline))
        enter(stack[-1][1:] if stack else OUTSIDE)
    close()
    kind = {w for _, k, w in found if k == PLAIN}
    best = "article" if "article" in kind else "main" if "main" in kind else None
    return [(t, ARTICLE if k == PLAIN and w == best else k) for t, k, w in found]


def _masks(values: list[int]) -> Callable[[int], int]:
    """The places of a value as bits of one number. Only those of frequent values are kept, so memory grows with the lines."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(values):
        places.setdefault(x, []).append(j)
    frequent = {}
    for x, found in places.items():
        if len(found) > FREQUENT:
            bits = np.zeros(len(values), np.uint8)
            bits[found] = 1
            frequent[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return lambda x: frequent[x] if x in frequent else sum(1 << j for j in places.get(x, ()))


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each beginning of ``a`` a number whose bit j is 0 where b[j] makes its longest common subsequence longer."""
    mask, all_ones = _masks(b), (1 << len(b)) - 1
    row = all_ones
    for x in a:
        hits = row & mask(x)
        row = ((row + hits) | (row - hits)) & all_ones
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with each beginning of ``b``."""
    row = 0
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits[: len(b)].astype(np.int64))))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Lines that the other page has not are left out first. Small tables are walked back row by row, with the columns as bits
    of one number; larger ones are halved where the two halves' lengths add up to the most, so that memory
    grows with the lines and not with their square.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [*range(head), *range(len(a) - tail, len(a))]
    mine, theirs = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(mine) & set(theirs)
    places = [i for i, x in enumerate(mine, head) if x in both]
    rest, other = [a[i] for i in places], [x for x in theirs if x in both]
    if len(rest) > 1 and len(rest) * len(other) > TABLE_BITS:
        half = len(rest) // 2
        before, after = _lengths(rest[:half], other), _lengths(rest[half:][::-1], other[::-1])
        cut = int(np.argmax(before + after[::-1]))
        found += [places[i] for i in common_lines(rest[:half], other[:cut])]
        return found + [places[half + i] for i in common_lines(rest[half:], other[cut:])]
    rows = list(_rows(rest, other))
    i, j = len(rest), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.append(places[i])
                j -= 1
    return found


Lines = tuple[list[int], list[int], list[int]]  # hashes, sizes and kinds of a page's lines


def is_copy(page: Lines, other: Lines) -> bool:
    """If the unmarked text that both share is nearly all of the longer one."""
    (a, sizes, kinds), (b, other_sizes, other_kinds) = page, other
    own = [i for i, k in enumerate(kinds) if k != MARKED]
    least = COPY * max(
        sum(sizes[i] for i in own), sum(n for n, k in zip(other_sizes, other_kinds, strict=True) if k != MARKED)
    )
    there = set(b)
    if sum(sizes[i] for i in own if a[i] in there) < least:
        return False
    return sum(sizes[i] for i in common_lines(a, b) if kinds[i] != MARKED) >= least


def _alike(a: list[int], b: list[int]) -> int:
    """Length of the common beginning."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


STAYS, GOES, FRAME = 0, 1, 2  # what becomes of a line


def deleted(page: Lines, neighbours: list[Lines]) -> list[int]:
    """What becomes of the lines: marked ones go, plain ones that a neighbour shares too; the frame inside an article may.

    A neighbour that is a copy tells nothing. A shared line of an article may be a quotation; it is a frame if it
    belongs to lines that begin, or end, the article of both neighbours as well, which are no copies of each other.
    """
    hashes, _, kinds = page
    gone = [GOES if k == MARKED else STAYS for k in kinds]
    plain = {h for h, k in zip(hashes, kinds, strict=True) if k == PLAIN}
    neighbours = [o for o in neighbours if not is_copy(page, o)]
    for other in neighbours:
        if not plain.isdisjoint(other[0]):
            for i in common_lines(hashes, other[0]):
                if kinds[i] == PLAIN:
                    gone[i] = GOES
    inner = [i for i, k in enumerate(kinds) if k == ARTICLE]
    if inner and len(neighbours) == 2 and not is_copy(*neighbours):
        own = [hashes[i] for i in inner]
        others = [[h for h, k in zip(o[0], o[2], strict=True) if k == ARTICLE] for o in neighbours]
        head = min(_alike(own, o) for o in others)
        tail = min(_alike(own[::-1], o[::-1]) for o in others)
        for i in inner[:head] + inner[len(inner) - tail :]:
            gone[i] = FRAME
    return gone


def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        pages = [lines_of(x.as_py()) for x in batch]
        yield pa.StructArray.from_arrays(
            [
                pa.array([[t for t, _ in p] for p in pages], pa.list_(pa.string())),
                pa.array([[k for _, k in p] for p in pages], pa.list_(pa.int32())),
            ],
            ["lines", "kinds"],
        )


def _decide(
    batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]],
) -> Iterator[pa.Array]:
    for columns in batches:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        found = [deleted((h, s, k), [tuple(x.values()) for x in o or []]) for h, s, k, o in rows]
        yield pa.array(found, pa.list_(pa.int32()))


def _copies(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        yield pa.array([is_copy(tuple(a.values()), tuple(b.values())) if b else False for a, b in rows], pa.bool_())


def _runs(ranked: DataFrame) -> DataFrame:
    """(rank, first, last): the run of neighbouring copies that each page belongs to.

    Runs are found in blocks; only the first and last start of a run in each block reach the driver, a
    number that grows with the root of the pages.
    """
    copies = F.arrow_udf(_copies, "boolean")
    before = ranked.select((F.col("rank") + 1).alias("rank"), "host", F.col("lines").alias("before")).hint("merge")
    starts = ranked.join(before, ["rank", "host"], "left")
    starts = stored(starts.select("rank", (~copies("lines", "before")).alias("starts")), "pages-copies")
    n = starts.count()
    wide = max(128, int(n**0.5))
    block = F.floor(F.col("rank") / wide)
    starts = starts.select("rank", block.alias("block"), F.when(F.col("starts"), F.col("rank")).alias("start"))
    ends = {r[0]: (r[1], r[2]) for r in starts.groupBy("block").agg(F.min("start"), F.max("start")).collect()}
    blocks = max(ends, default=-1) + 1
    earlier, later = [0] * (blocks + 1), [n] * (blocks + 1)
    for b in range(blocks):
        earlier[b + 1] = earlier[b] if ends[b][1] is None else ends[b][1]
    for b in range(blocks - 2, -1, -1):
        later[b] = later[b + 1] if ends[b + 1][0] is None else ends[b + 1][0]
    of_block = lambda values: F.get(F.array(*[F.lit(x).cast("long") for x in values]), F.col("block").cast("int"))
    rows = Window.partitionBy("block").orderBy("rank")
    first = F.max("start").over(rows.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min("start").over(rows.rowsBetween(1, Window.unboundedFollowing))
    found = starts.select("rank", "block", first.alias("first"), after.alias("after"))
    return found.select(
        "rank",
        F.coalesce("first", of_block(earlier)).alias("first"),
        (F.coalesce("after", of_block(later)) - 1).alias("last"),
    )


def _with_host_frames(choice: DataFrame) -> DataFrame:
    """(same, gone): which lines of a page go; a frame only if it frames half of its host's pages with an article.

    Only lines that frame a page are counted, not all lines of the host.
    """
    framed = choice.where(F.exists("gone", lambda x: x == FRAME))
    lines = F.array_distinct(F.filter("hashes", lambda x, i: F.get("gone", i) == FRAME))
    framed = framed.select("same", "host", F.explode(lines).alias("line"))
    amount = choice.where("inside").groupBy("host").agg(F.count("*").alias("pages"))
    wide = framed.groupBy("host", "line").agg(F.count("*").alias("n")).join(amount, "host")
    wide = wide.where(F.col("n") >= F.col("pages") * HOST_SHARE).select("host", "line")
    wide = framed.join(wide, ["host", "line"]).groupBy("same").agg(F.collect_list("line").alias("frame"))
    is_frame = lambda i: F.coalesce(F.array_contains("frame", F.get("hashes", i)), F.lit(False))
    gone = F.transform("gone", lambda x, i: (x == GOES) | ((x == FRAME) & is_frame(i)))
    return choice.join(wide.hint("merge"), "same", "left").select("same", gone.alias("gone"))


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of each row: the lines kept, joined by a newline.

    Pages without text give an empty string. A null url is a host of its own. Pages of a host with the same lines
    count as one page in the order, each with its own result, and copies in a row are compared with the pages before and
    after all of them. Only hashes of lines meet in the order; the lines themselves are shuffled
    once, to meet the decision on their page.
    """
    parse = F.arrow_udf(_parse, "lines array<string>, kinds array<int>")
    decide = F.arrow_udf(_decide, "array<int>")
    place = r"^(?:[a-zA-Z][^:/?#]*:)?(?://)?([^/?#]*)([^?#]*)"
    part = lambda i: F.regexp_extract(F.coalesce("url", F.lit("")), place, i)
    parsed = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("id"),
        parse(F.col(page)).alias("p"),
    )
    parsed = parsed.withColumn("host", F.lower(part(1)))
    parsed = parsed.withColumn("hashes", F.transform("p.lines", lambda x: F.xxhash64(x)))
    same = F.xxhash64("host", "hashes", "p.kinds").alias("same")
    bucket = F.pmod(F.xxhash64("id", "url"), F.lit(BUCKETS)).cast("int").alias("bucket")
    light = parsed.select(
        same,
        bucket,
        "host",
        F.struct(part(2).alias("path"), "id").alias("at"),
        F.struct(
            "hashes",
            F.transform("p.lines", lambda x: F.char_length(x)).alias("sizes"),
            F.col("p.kinds").alias("kinds"),
        ).alias("lines"),
    )
    # Pages of a host with the same lines have one place, that of the first of them.
    some = light.groupBy("same", "bucket").agg(F.first("host").alias("host"), F.min("at").alias("at"), F.first("lines").alias("lines"))
    some = stored(some, "pages-light")
    groups = some.groupBy("same").agg(F.first("host").alias("host"), F.min("at").alias("at"), F.first("lines").alias("lines"))
    order = [F.col(c) for c in ("host", "at.path", "at.id", "same")]
    ranked = with_rank(groups, order, "rank", "pages-order")
    runs = _runs(ranked).hint("merge")
    # Rows of a run ask for the pages before and after it in pieces, however long it is.
    piece = F.floor(F.col("rank") / PIECE).alias("piece")
    asks = runs.select("first", "last", piece).distinct()  # a row for each run at least: no broadcast either
    asks = asks.select("first", "piece", F.explode(F.array(F.col("first") - 1, F.col("last") + 1)).alias("rank")).hint("merge")
    beside = asks.join(ranked.select("rank", F.col("host").alias("other_host"), F.col("lines").alias("other")), "rank")
    beside = beside.groupBy("first", "piece", "other_host").agg(F.collect_list("other").alias("others"))
    mine = ranked.join(runs, "rank").select("same", "host", "lines", "first", piece)
    choice = mine.join(
        beside.withColumnRenamed("other_host", "host"), ["first", "piece", "host"], "left"
    )
    inside = F.exists("lines.kinds", lambda k: k == ARTICLE)
    choice = choice.select(
        "same", "host", "lines.hashes", inside.alias("inside"),
        decide("lines.hashes", "lines.sizes", "lines.kinds", "others").alias("gone"),
    )
    choice = _with_host_frames(stored(choice, "pages-decided"))
    choice = some.select("same", "bucket").join(stored(choice, "pages-choice").hint("merge"), "same")
    choice = choice.hint("merge")  # a row for each page: never a broadcast
    # Lines that the markup alone rules out do not travel; their places stay.
    out = lambda i: F.get(F.col("p.kinds"), i) == MARKED
    lines = F.transform("p.lines", lambda x, i: F.when(out(i), "").otherwise(x))
    heavy = parsed.select("page_id", "url", same, bucket, lines.alias("lines"))
    kept = F.filter("lines", lambda x, i: ~F.get(F.col("gone"), i))
    text = F.array_join(kept, "\n")
    found = heavy.join(choice, ["same", "bucket"]).select("page_id", "url", text.alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
