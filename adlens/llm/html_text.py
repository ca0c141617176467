"""Main text of a web page by the distribution of its line blocks.

A page becomes lines, one per block element, without markup. Parts that are never the
article (scripts, menus, forms, sidebars, notices, adverts, reader comments; known by
element, role or class) leave empty lines. The text lengths are summed over a sliding
window of lines: where a sum rises from nothing the text surges, where it falls back to
nothing it dives, and the lines between are one stretch of text.

A page that marks its article keeps the stretches inside the mark; else those between
the first and the last stretch that is long enough and not made of links.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: a stretch counts without an article mark if it has so many characters, or this share of the longest
STRETCH_CHARS = 80
STRETCH_SHARE = 0.2
LINK_SHARE = 0.5
#: a line with so many characters outside its links is text, whatever its links
SENTENCE = 25

# ---- fixed values: elements, roles and class words
RAW = "script style noscript template svg math iframe object canvas textarea title xmp".split()
LEFT_OUT = "head nav footer aside form menu dialog select button datalist audio video".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section summary table tbody td tfoot th thead tr ul"
).split()
ARTICLE = "article main".split()
ROLES = "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
CLASS_WORDS = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo related respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget"
).split()

#: a class or id that starts so says what stands around or inside an element, not what it is
AROUND = "has with without no not elementor".split()
#: noise only as the first part of a class or id
FIRST_ONLY = ["widget"]
#: raw elements that end at the next block if they are never closed
LOOSE = "svg math noscript object canvas iframe template".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()

_RAW, _LEFT_OUT, _VOID, _BLOCK, _ARTICLE = set(RAW), set(LEFT_OUT), set(VOID), set(BLOCK), set(ARTICLE)
_ROLES, _WORDS = set(ROLES), set(CLASS_WORDS)
# quoted values may hold a closing angle bracket; possessive, so a broken tag costs one pass
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _is_noise(name: str, attributes: str, in_article: bool) -> bool:
    if name in _LEFT_OUT or (name == "header" and not in_article):
        return True
    if not attributes.strip() or name in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.strip().lower() in _ROLES:
            return True
        if key in ("class", "id"):
            words = set()
            for token in value.split():
                parts = _PART.findall(_CAMEL.sub(" ", token).lower())
                if parts and parts[0] not in AROUND:
                    words.update(parts[:1], (x for x in parts[1:] if x not in FIRST_ONLY))
            if name in _ARTICLE and not in_article:
                # an article that is about adverts is still the article
                words &= {"comment", "comments"}
            if words & _WORDS:
                return True
    return False


def _tokens(page: str):
    """(text before, slash, name, attributes) of every tag; the last one has no name."""
    at, unclosed = 0, set()
    while (m := _TAG.search(page, at)) is not None:
        name = (m[2] or "").lower()
        yield page[at : m.start()], m[1] or "", name, m[3] or ""
        at = m.end()
        if name in _RAW and not m[1] and not (m[3] or "").endswith("/"):
            # what stands inside is no markup; without an end tag it is the rest of the page, or of the block
            end = None if name in unclosed else _RAW_END[name].search(page, at)
            if end is None and name in LOOSE:
                unclosed.add(name)
            else:
                at = end.start() if end else len(page)
    yield page[at:], "", "", ""


def _closed(tokens: list) -> list[int]:
    """For each token the index of the end tag that closes it, or 0."""
    ends, open_tags, counts = [0] * len(tokens), [], {}
    for i, (_, slash, name, attributes) in enumerate(tokens):
        if not name or name in _VOID:
            continue
        if not slash:
            open_tags.append((name, i))
            counts[name] = counts.get(name, 0) + 1
        elif counts.get(name):
            while True:
                top, start = open_tags.pop()
                counts[top] -= 1
                if top == name:
                    ends[start] = i
                    break
    return ends


def _holding(tokens: list, ends: list[int]) -> set[int]:
    """Elements that hold an article, but not those that are left out by their name."""
    found, open_ends = set(), []
    for i, (_, slash, name, attributes) in enumerate(tokens):
        while open_ends and open_ends[-1][1] <= i:
            open_ends.pop()
        if slash or not name or not ends[i]:
            continue
        if name in _ARTICLE and not _is_noise(name, attributes, False):
            # a named part is no wrapper, and neither is what stands in it
            named = [k for k, (at, _) in enumerate(open_ends) if tokens[at][2] in _LEFT_OUT and tokens[at][2] != "form"]
            if not named:
                found.update(at for at, _ in open_ends)
        open_ends.append((i, ends[i]))
    return found


def lines_of(page: str, open_wrappers: bool = False) -> list[tuple[str, bool, int, bool]]:
    """(text, inside an article, characters in links, heading) per line; left-out parts are empty lines.

    With ``open_wrappers`` elements that hold an article are not left out.
    """
    tokens = list(_tokens(page))
    ends = _closed(tokens)
    wrappers = _holding(tokens, ends) if open_wrappers else set()
    lines: list[tuple[str, bool, int, bool]] = []
    heading = False
    parts: list[str] = []
    linked = 0
    article_end = skip_end = link_end = -1
    until_block = False

    def flush(inside: bool) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, inside, min(linked, len(text)), heading))
        parts.clear()
        linked = 0

    for i, (text, slash, name, attributes) in enumerate(tokens):
        inside = i <= article_end
        if i > skip_end and not until_block and text:
            parts.append(text)
            if i <= link_end:
                linked += len(text.strip())
        if not name or i <= skip_end:
            continue
        if name in _BLOCK:
            flush(inside)
            until_block = False
            heading = name in HEADINGS and not slash
        if slash:
            continue
        if name in LOOSE and not ends[i] and not attributes.endswith("/"):
            until_block = True
            continue
        if name in _ARTICLE and not inside and ends[i] != 0 and not _is_noise(name, attributes, False):
            article_end = ends[i]
            lines.extend([("", False, 0, False)] * WINDOW)
        elif name in _ARTICLE and not inside and not _is_noise(name, attributes, False):
            article_end = len(tokens)
            lines.extend([("", False, 0, False)] * WINDOW)
        elif name not in _VOID and i not in wrappers and _is_noise(name, attributes, inside):
            flush(inside)
            lines.extend([("", False, 0, False)] * WINDOW)
            if ends[i]:
                skip_end = ends[i]
            else:
                # never closed: leave out what stands before the next block only
                until_block = True
        elif name == "a" and ends[i]:
            link_end = ends[i]
        if i == article_end:
            lines.extend([("", False, 0, False)] * WINDOW)
    flush(article_end >= len(tokens))
    return lines


def stretches(lengths: list[int]) -> list[tuple[int, int]]:
    """Lines between surge and dive: where the sum over the window leaves nothing and returns to it."""
    found, start, total = [], None, 0
    for i in range(len(lengths) + WINDOW):
        total += lengths[i] if i < len(lengths) else 0
        total -= lengths[i - WINDOW] if i >= WINDOW else 0
        if total and start is None:
            start = i
        elif not total and start is not None:
            found.append((start, i - WINDOW + 1))
            start = None
    return found


def main_text(page: str | None) -> str:
    """Text of the article, blocks joined by one blank; empty for NULL and for pages without text."""
    lines = lines_of(page or "")
    marked = any(line[1] for line in lines)
    if not marked:
        # the article may stand in an element that looks like noise
        opened = lines_of(page or "", True)
        marked = any(line[1] for line in opened)
        lines = opened if marked else lines
    if marked:
        lengths = [len(text) if inside else 0 for text, inside, _, _ in lines]
    else:
        # lines of links are menus
        menu = lambda text, links: links >= LINK_SHARE * len(text) and len(text) - links < SENTENCE
        lengths = [0 if menu(text, links) else len(text) for text, _, links, _ in lines]
    runs = stretches(lengths)
    if not marked and runs:
        chars = [sum(lengths[a:b]) for a, b in runs]
        strong = [i for i, n in enumerate(chars) if n >= STRETCH_CHARS or n >= STRETCH_SHARE * max(chars)]
        first = strong[0]
        # a heading belongs to what follows it
        while first and any(lines[k][3] and lengths[k] for k in range(*runs[first - 1])):
            first -= 1
        runs = runs[first : strong[-1] + 1]
    return " ".join(lines[k][0] for a, b in runs for k in range(a, b) if lengths[k])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``text`` and ``n_chars`` of every row.

    NULL or empty pages, and pages without text, have an empty text. Broken markup never
    fails: an element that is not closed leaves out no more than its own block. Repeated
    rows stay repeated; an empty table gives an empty table.
    """
    kept = [c for c in keep if c.lower() not in ("text", "n_chars")]
    rows = pages.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(kept)], F.col(html_col).alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text", "n_chars"])

    found = rows.mapInArrow(run, f"{schema}, text string, n_chars bigint")
    return found.select(F.col("id").alias(id_col), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)], "text", "n_chars")
