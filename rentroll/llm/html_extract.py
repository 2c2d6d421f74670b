"""Main text of web pages.

A page's own marks are a prior: elements and class, id and role words that name menus, headers, footers, sidebars, notices,
adverts, forms or comments make their text a frame; article and main elements make it the article; names that say it only
in part (``related-work``, ``notice-period``) make it doubtful inside an article. What the host repeats is the evidence:
the token streams of all text outside the articles of a host are taken together, and its suffixes, cut at ``run`` tokens,
are sorted into groups of equal beginnings - the intervals of the host's suffix array whose common prefix is at least that
long. A group that occurs on ``least`` pages or more that aren't all the same is a repeated run. Every page is decided by both:

* article blocks stay, also where a frame of the host says the same: an advert may quote a line of the articles;
* doubtful blocks stay, unless a token of theirs lies in a repeated run;
* unmarked blocks beside an article or doubtful block that stays are kept if they hold ``run`` tokens or more, none of them
  in a repeated run, and the page's frame is known (some repeated run lies on it);
* unmarked blocks of other pages lose the tokens in repeated runs; a page whose unmarked text is repeated whole is a copy
  of other pages, not their frame, and keeps it;
* frame blocks go. Where a page would be left empty and its frame is known, frame blocks that only have the name of a form
  or layout (not firm ones: menus, footers, comments, adverts, hidden text) stay under the rule of unmarked ones.

The array of a host is never in one place: a suffix is a hash of host and tokens, a group is a sum that is made partly
before the shuffle. Only text outside articles is hashed and shuffled; the blocks of it that stay are stored, and join the
articles again by a broadcast while Spark knows them to be small.
"""

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from rentroll.llm.shared import save

RUN, PAGES = 10, 3

# Elements by what they do to the text inside.
RAW = "script style noscript template textarea title svg math iframe object canvas audio video xmp noembed noframes".split()
FIRM_FRAME = "nav footer aside menu dialog head".split()
FRAME = "header form button select label fieldset".split()
ARTICLE = ["article", "main"]
BLOCK = """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr
ul head caption""".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()

# Words in class, id and role that name a frame, those of them that also hold for an article inside, and
# those that name an article.
FRAME_WORDS = """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe signup sidebar aside nav navbar navigation menu toc
breadcrumb breadcrumbs header masthead topbar footer copyright comment comments disqus replies respond related recommended share
sharing social widget toolbar pagination pager login search contentinfo complementary dialog form""".split()
FIRM_WORDS = """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus replies
respond related recommended""".split()
ARTICLE_WORDS = ["articlebody"]

# Words beside a frame word that say how a page is set up, words for a place or kind of box, and words that
# make a header the title of an article.
STATE_WORDS = "has with without no not is open closed enabled disabled".split()
PART_WORDS = """list area box wrapper wrap container section block slot unit zone item items body text inner outer thread author
user reader content post posts article articles story stories news link links reading topics products top bottom left right inline
site page main global primary secondary mobile desktop small large row col column group count meta title icon button layout bar
holder panel message policy info by google""".split()
TITLE_WORDS = "entry post article story content".split()

_ENDLESS = {"li", "dt", "dd", "td", "th", "tr", "option"}
_FRAMES, _FIRM_FRAMES, _BLOCKS, _VOIDS = set(FRAME), set(FIRM_FRAME), set(BLOCK), set(VOID)
_FRAME_WORDS, _FIRM_WORDS, _ARTICLE_WORDS = set(FRAME_WORDS), set(FIRM_WORDS), set(ARTICLE_WORDS)
_STATES, _PARTS, _TITLES = set(STATE_WORDS), set(PART_WORDS), set(TITLE_WORDS)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^<>]*+(?:>|(?=<)|\Z)",  # a tag that breaks off
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

OPEN, FRAMED, MAIN, FIRM, DOUBT = range(5)
PARSED = "page_id bigint, url string, marks binary, article binary, around binary, runs array<bigint>, stream bigint"


def named(name):
    """What one class, id or role says: None, FRAMED, FIRM or DOUBT."""
    whole = name.lower()
    if whole in _FIRM_WORDS:
        return FIRM
    if whole in _FRAME_WORDS:
        return FRAMED
    words = {w.lower() for w in NAME_WORD.findall(name)}
    found = words & _FRAME_WORDS
    if not found or words & _STATES:  # "has-ad-banner" is said of all the page
        return None
    if "header" in words and words & _TITLES:
        return None
    if words - found - _PARTS:
        return DOUBT
    return FIRM if found & _FIRM_WORDS else FRAMED


def marked(name, rest):
    """What an element's name and attributes say about its text; None if nothing.

    A firm frame also covers an article inside it (a comment, a teaser); any other doesn't: pages wrap all they hold in a
    form or in a box named after its layout.
    """
    if name in _FIRM_FRAMES:
        return FIRM
    said = MAIN if name in ARTICLE else FRAMED if name in _FRAMES else None
    if rest and not rest.isspace():
        for attribute, value in ATTRIBUTE.findall(rest):
            attribute, value = attribute.lower(), value.strip("\"'")
            if attribute == "style":
                if HIDDEN.search(value):
                    return FIRM
            elif attribute == "hidden" or attribute == "aria-hidden":
                if attribute == "hidden" or value.lower() == "true":
                    return FIRM
            elif name not in ("html", "body"):
                whole = {w.lower() for w in value.split()}
                if name in ARTICLE:  # an article may be named "with-comments"
                    found = {FIRM if whole & _FIRM_WORDS else FRAMED if whole & _FRAME_WORDS else None}
                else:
                    found = {named(w) for w in value.split()}
                if FIRM in found:
                    return FIRM
                if FRAMED in found:
                    said = FRAMED
                elif DOUBT in found and said is None:
                    said = DOUBT
                elif whole & _ARTICLE_WORDS or attribute == "role" and value.lower() == "main":
                    said = MAIN
    return said


def inside_of(mark, said, name):
    """Mark of the text inside an element, from that around it."""
    if FIRM in (mark, said):
        return FIRM
    if said == MAIN or mark == MAIN and (said is None or name == "header"):  # the header of an article holds its title
        return MAIN
    if mark in (MAIN, DOUBT) and said in (None, DOUBT):
        return DOUBT
    return FRAMED if {FRAMED, DOUBT} & {mark, said} else OPEN


def blocks_of(page):
    """(mark, text) of every block with text, in page order."""
    out, piece = [], []
    stack = []  # (element, mark of the text inside)
    inner = Counter()  # elements of the stack by name
    mark, at = OPEN, 0

    def close():
        text = "".join(piece)
        piece.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append((mark, text))

    quiet = None  # depth at which an inline frame began: its text is left out of the block around it

    for found in TAG.finditer(page):
        if quiet is None:
            piece.append(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCKS and quiet is None:
            close()
        elif name == "br":
            piece.append(" ")
        if found["end"]:
            if not inner[name]:
                continue
            i = len(stack) - 1
            while stack[i][0] != name:
                i -= 1
            if quiet is not None and i < quiet and name in _BLOCKS:
                close()
            inner.subtract(n for n, _ in stack[i:])
            del stack[i:]
            mark = stack[-1][1] if stack else OPEN
            quiet = quiet if quiet is not None and len(stack) > quiet else None
        elif name not in _VOIDS and not found["rest"].endswith("/"):
            if stack and (stack[-1][0] == "p" and name in _BLOCKS or stack[-1][0] == name and name in _ENDLESS):
                inner[stack.pop()[0]] -= 1  # ends where the next one begins
                mark = stack[-1][1] if stack else OPEN
            said = marked(name, found["rest"])
            if said == DOUBT and name not in _BLOCKS:
                said = None
            if said is not None or name in _BLOCKS:
                inside = inside_of(mark, said, name)
                if inside != mark and name not in _BLOCKS and quiet is None:
                    if inside in (FRAMED, FIRM):
                        quiet = len(stack)
                    else:
                        close()
                stack.append((name, inside))
                inner[name] += 1
                mark = inside if quiet is None else mark
    if quiet is None:
        piece.append(page[at:])
    close()
    return out


def host_of(url):
    return (url or "").partition("://")[2].lower().replace("?", "/").replace("#", "/").partition("/")[0]


def suffixes(host, tokens, run):
    """Hashes of the suffixes of a token stream, cut at ``run`` tokens."""
    return [signed(f"{host}\0{' '.join(tokens[i : i + run])}") for i in range(len(tokens) - run + 1)]


def parse(pages, run=RUN):
    """One row per page: its blocks, the suffixes of the text outside its article, a digest of all its text.

    ``marks`` has a byte for each block; ``article`` has a line for each block of it, ``around`` for each other one,
    compressed (white space in a block is spaces).
    """

    def one(packer, page_id, url, page):
        blocks = blocks_of(page or "")
        article, around = ("\n".join(t for m, t in blocks if (m == MAIN) == side) for side in (True, False))
        packed = (packer.compress(t.encode()) for t in (article, around))
        runs = suffixes(host_of(url), around.split(), run)
        return page_id, url, bytes(m for m, _ in blocks), *packed, runs, signed(f"{article}\0{around}")

    def work(*columns):
        packer = zstandard.ZstdCompressor()
        rows = [one(packer, *x) for x in zip(*columns)]
        return zip(*rows)

    numbers, packed = pa.list_(pa.int64()), pa.binary()
    kinds = {"page_id": pa.int64(), "url": pa.string(), "marks": packed, "article": packed, "around": packed, "runs": numbers, "stream": pa.int64()}
    plain = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInArrow(in_batches(work, plain.columns, kinds), PARSED)


def signed(text):
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def repeated(parsed, pages=PAGES):
    """Hashes of the runs that occur on enough pages of one host, not all of them the same."""
    each = parsed.select("stream", F.explode(F.array_distinct("runs")).alias("run"))
    seen = each.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("stream").alias("a"), F.max("stream").alias("b"))
    return seen.filter((F.col("n") >= pages) & (F.col("a") != F.col("b"))).select("run")


def decide(marks, around, at, run=RUN):
    """{block: text} of the blocks outside the article that stay.

    ``around``: their tokens, in page order; ``at``: places of the repeated runs in all of them.
    """
    places = [i for i, m in enumerate(marks) if m != MAIN]
    starts, ends, place = set(at), 0, 0
    left = {}  # tokens outside the repeated runs
    for i, tokens in zip(places, around):
        left[i] = []
        for place, token in enumerate(tokens, place):
            ends = place + run if place in starts else ends
            if place >= ends:
                left[i].append(token)
        place += 1
    whole = {i: tokens for i, tokens in zip(places, around) if len(left[i]) == len(tokens)}

    def long(mark):
        return {i: t for i, t in whole.items() if marks[i] == mark and starts and len(t) >= run}

    out = {i: t for i, t in whole.items() if marks[i] == DOUBT}
    if out or MAIN in marks:
        out |= long(OPEN)
    else:
        out = {i: t for i, t in left.items() if marks[i] == OPEN and t}
        out = out or {i: t for i, t in zip(places, around) if marks[i] == OPEN} or long(FRAMED)
    return {i: " ".join(t) for i, t in out.items()}


def in_batches(work, names, kinds, size=500):
    """A function for mapInArrow that calls ``work`` with the columns ``names`` of ``size`` rows, as lists; it gives columns."""

    def mapped(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, size):
                some = batch.slice(row, size)
                columns = work(*(some.column(c).to_pylist() for c in names))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return mapped


def lines_of(unpacker, packed):
    text = unpacker.decompress(packed).decode()
    return text.split("\n") if text else []


def kept_around(rows, run=RUN):
    """(row, kept) of the pages on which text outside the article stays."""

    def work(ids, marks, around, at):
        unpacker, out = zstandard.ZstdDecompressor(), {}
        for i, m, packed, places in zip(ids, marks, around, at):
            kept = decide(m, [t.split() for t in lines_of(unpacker, packed)], places or [], run)
            if kept:
                out[i] = [{"block": b, "text": t} for b, t in kept.items()]
        return list(out), list(out.values())

    kinds = {"row": pa.int64(), "kept": pa.list_(pa.struct([("block", pa.int32()), ("text", pa.string())]))}
    names = ["row", "marks", "around", "at"]
    return rows.select(*names).mapInArrow(in_batches(work, names, kinds), "row bigint, kept array<struct<block:int,text:string>>")


def main_text(rows):
    """Text of every page: its article and what else stays, in page order."""

    def work(ids, urls, marks, articles, kept):
        unpacker, texts = zstandard.ZstdDecompressor(), []
        for m, packed, more in zip(marks, articles, kept):
            article = [i for i, mark in enumerate(m) if mark == MAIN]
            blocks = dict(zip(article, lines_of(unpacker, packed))) | {k["block"]: k["text"] for k in more or []}
            texts.append("\n\n".join(blocks[i] for i in sorted(blocks)))
        return ids, urls, texts

    kinds = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string()}
    names = ["page_id", "url", "marks", "article", "kept"]
    return rows.select(*names).mapInArrow(in_batches(work, names, kinds), "page_id bigint, url string, text string")


def extract(pages, run=RUN, least=PAGES):
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Character references are decoded, white space inside a block is one space, blocks are trimmed and joined by an empty
    line in page order. Null or empty html, and pages of frames alone, give an empty text. Pages with a null url share
    the empty host. Repeated rows are pages of their own; an empty table gives an empty result; further columns are ignored.
    """
    parsed = save(parse(pages, run).withColumn("row", F.monotonically_increasing_id()), "parsed")
    places = (
        parsed.select("row", F.posexplode("runs").alias("place", "run"))
        .join(repeated(parsed, least), "run")
        .groupBy("row")
        .agg(F.collect_list("place").alias("at"))
    )
    around = parsed.select("row", "marks", "around")
    kept = save(kept_around(around.join(places, "row", "left"), run), "kept")
    return main_text(parsed.join(kept, "row", "left")).withColumn("n_chars", F.length("text").cast("bigint"))
