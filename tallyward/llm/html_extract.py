"""Main text of web pages, by the maximum-scoring contiguous run of tokens.

Elements that are boilerplate by name, role or class are left out first, unless
they wrap the story; words under weak marks, such as widget or share, score less. Of the
remaining tokens words score positive (but for those in blocks of links, or beside marked
main text) and tags negative, with log odds learned from labelled pages as weights; one
linear scan finds the run with the greatest sum. The blocks that the run touches are the
text: the scan cuts the boilerplate that no name tells.

Defined cases: a null or empty page has an empty text; a page cut off anywhere is
read as far as it goes, without the broken tag; unbalanced tags close what
they opened or nothing; repeated rows give equal rows; an empty table gives an
empty result; of runs with equal sums the one that ends first is taken; columns
other than those named are never read. Pages take
time linear in their length.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import require

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
LEFT_OUT = frozenset("aside audio button canvas datalist dialog footer head header menu nav object option select svg video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
ROLES_LEFT_OUT = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class names and ids that mark boilerplate.
MARKS = frozenset(
    "ad adbox adbanner ads adsbygoogle adslot advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended recommendations related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar topbar widget widgets".split()
)
#: A header or aside of these is part of the text's own layout, as are wrappers named for having or lacking a sidebar.
_OF_TEXT = frozenset("article content entry post story section".split())
_NEGATED = frozenset("has no with without".split())

#: Marks that text of the page bears as well: they lower its score, unless their element holds the story itself.
WEAK_MARKS = frozenset("related recommended recommendations search share sharing social widget widgets".split())
#: Marks of what readers write. Their elements may hold articles of their own and most of a page's words.
_TALK = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words, less those of links, that an element with a weak mark needs to be read; a mere widget is read with one.
_WEAK_LEAST = 8
#: Attributes that are looked at.
_READ = frozenset("aria-hidden class hidden id role style".split())

_MARKUP = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_NEXT = re.compile(r"[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:([\"'])|([^\s>]*+)))?+)")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def read_attributes(page: str, at: int) -> tuple[tuple[tuple[str, str], ...], int]:
    """Attributes that are looked at, from a place behind a tag's name, and the place behind the tag.

    A quote opens a value only behind an equals sign, and the value ends at the next such quote, however
    far; without one the tag ends at the next ``>``. A tag that is cut off ends with the page. Of attributes
    with the same name the first counts.
    """
    found: dict[str, str] = {}
    end = len(page)
    while at < end:
        m = _NEXT.match(page, at)
        at = m.end()
        if m[1]:
            return tuple(found.items()), at
        value = m[4] or ""
        if m[3]:
            stop = page.find(m[3], at)
            if stop < 0:
                stop = page.find(">", at)
                if stop < 0:
                    break
                value, at = page[at:stop], stop
            else:
                value, at = page[at:stop] if len(m[2]) <= 11 else "", stop + 1
        if len(m[2]) <= 11 and (name := m[2].lower()) in _READ:
            found.setdefault(name, value)
    return tuple(found.items()), end + 1


@lru_cache(maxsize=4096)
def mark(name: str, attributes: tuple[tuple[str, str], ...]) -> str:
    """How an element is marked by its name, role, class or id.

    ``out``: never part of the text; ``strong`` and ``talk``: boilerplate, unless it wraps the story; ``weak`` and
    ``widget``: text of a lower score; empty: not at all.
    """
    if name in LEFT_OUT:
        return "out"
    kinds = {"strong"} if name == "form" else set()  # pages made by servers stand in one form
    if name in ("html", "body", "main") or not attributes:
        return "strong" if kinds else ""
    own = dict(attributes)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" and name != "article":
        return "out"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.IGNORECASE):
        return "out"
    if own.get("role", "").strip().lower() in ROLES_LEFT_OUT:
        return "out"
    for key in ("class", "id"):
        for one in own.get(key, "").split():
            parts = {p.lower() for p in _PARTS.findall(one)} | {one.lower()}
            if parts & _NEGATED:
                continue
            hits = parts & MARKS
            if key == "id" or one.lower() != "hidden":
                hits -= {"hidden"}  # of overflow-hidden and the like
            if not hits or hits == {"header"} and parts & _OF_TEXT:
                continue
            firm = hits - WEAK_MARKS
            kinds.add("talk" if firm & _TALK else "strong" if firm else "weak" if hits - {"widget", "widgets"} else "widget")
    return next((k for k in ("strong", "talk", "weak", "widget") if k in kinds), "")


def tokens(page: str) -> Iterator[tuple[str, str, tuple[tuple[str, str], ...], str]]:
    """(kind, name, attributes, text): kind is text, open, close or raw (an element whose content is no markup)."""
    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            yield "text", "", (), page[at:]
            return
        if m.start() > at:
            yield "text", "", (), page[at : m.start()]
        at = m.end()
        if not m[3]:
            stop = page.find("-->" if m[1] else ">", at)
            at = end if stop < 0 else stop + (3 if m[1] else 1)
            continue
        name = m[3].lower()
        attributes, at = read_attributes(page, at)
        if at > end:
            return
        if m[2]:
            yield "close", name, (), ""
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            yield "raw", name, (), ""
            at = stop.end() if stop else end
            continue
        yield "open", name, attributes, ""
        if page[at - 2] == "/" and name not in VOID and name not in BLOCKS:
            yield "close", name, (), ""


def judge(parts: list[tuple[str, str, tuple[tuple[str, str], ...], str]]) -> tuple[dict[int, str], bool]:
    """What is left out ("out") or read at a lower score ("weak"), by the place of its opening tag; whether an article or main is read.

    A mark by class or id is void where the element holds ``main`` or most words (a firm one: with all articles,
    or nearly all words). Weakly marked elements of few words or mostly links are left out, but never all articles.
    """
    n_words = n_links = n_main = n_articles = 0
    stack: list[tuple[str, str, int, tuple[int, int, int, int]]] = []
    held: Counter = Counter()  # names and marks
    verdict: dict[int, str] = {}
    marked: list[tuple[str, int, int, list[int]]] = []  # mark, first and last token, words, links, mains and articles within
    mains: list[int] = []

    def leave(at: int) -> str:
        name, kind, first, before = stack.pop()
        held[name] -= 1
        held["=" + kind] -= 1
        if kind and kind != "out":
            marked.append((kind, first, at, [x - y for x, y in zip((n_words, n_links, n_main, n_articles), before)]))
        elif kind:
            marked.append((kind, first, at, []))
        return name

    for i, (kind, name, attributes, text) in enumerate(parts):
        if kind == "text":
            if not held["=out"]:
                n = len(text.split())
                n_words += n
                n_links += n if held["a"] else 0
        elif kind == "open" and name not in VOID:
            own = mark(name, attributes) if sum(len(v) for _, v in attributes) < 1000 else mark.__wrapped__(name, attributes)
            stack.append((name, own, i, (n_words, n_links, n_main, n_articles)))
            held[name] += 1
            held["=" + own] += 1
            if name in MAIN:
                mains.append(i)
                if not held["=out"]:
                    n_main += name == "main"
                    n_articles += name == "article" and not held["=talk"]
        elif kind == "close" and held[name] > 0:
            while leave(i) != name:
                pass
    while stack:
        leave(len(parts))
    cover = [0] * (len(parts) + 1)
    for kind, first, last, inside in marked:
        if kind != "out":
            words, links, main, articles = inside
            wraps = articles > 0 and articles == n_articles
            if main:
                continue
            if kind in ("weak", "widget"):
                if 2 * words > n_words:
                    continue
                kind = "weak" if wraps or words - 2 * links >= (_WEAK_LEAST if kind == "weak" else 1) else "out"
            elif kind == "strong" and (wraps and 2 * words > n_words or 10 * words > 9 * n_words):
                continue
            else:
                kind = "out"
        verdict[first] = kind
        cover[first] += 1
        cover[last] -= 1
    deep, at, has_main = 0, 0, False
    for i in mains:
        deep += sum(cover[at : i + 1])
        at = i + 1
        if not deep:
            has_main = True
            break
    return verdict, has_main


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) of what is left in: words with their place, tags, and breaks between blocks.

    Kinds: ``words`` (name: main, outside or plain, with a suffix for links and weakly marked elements), ``tag``, ``break``
    and ``space``, these with the text main within main text as marked.
    """
    parts = list(tokens(page))
    verdict, has_main = judge(parts)
    stack: list[tuple[str, str, bool]] = []
    held: Counter = Counter()
    out_depth = weak_depth = main_depth = 0  # an article in a weakly marked element is no main text as such
    for i, (kind, name, _, text) in enumerate(parts):
        if kind == "text":
            if not out_depth:
                place = "plain" if not has_main else "main" if main_depth else "outside"
                yield "words", place + (" link" if held["a"] else " weak" if weak_depth and place != "outside" else ""), text
            continue
        if kind == "open" and name not in VOID:
            own = verdict.get(i, "")
            weak_depth += own == "weak"
            main = name in MAIN and not weak_depth
            main_depth += main
            stack.append((name, own, main))
            held[name] += 1
            if own == "out":
                out_depth += 1
                if out_depth == 1:
                    yield "break" if name in BLOCKS else "space", name, "main" if has_main and main_depth else ""
            elif not out_depth:
                yield "break" if name in BLOCKS else "tag", name, "main" if has_main and main_depth else ""
        elif kind == "close" and held[name]:
            inside = not out_depth
            while True:
                top, own, main = stack.pop()
                held[top] -= 1
                main_depth -= main
                out_depth -= own == "out"
                weak_depth -= own == "weak"
                if top == name:
                    break
            if inside:
                yield "break" if name in BLOCKS else "tag", name, "main" if has_main and main_depth else ""
        elif not out_depth:
            yield "break" if name in BLOCKS else "space" if name == "br" else "tag", name, "main" if has_main and main_depth else ""


# Labelled pages: a story in some wrapper, with unnamed boilerplate before and after it.
_PROSE = "The river rose slowly over the week and the people of the old town moved what they could to higher ground. Nobody spoke of leaving, though the water stood in the market square by evening."
_LINKS = [f'<a href="/{w}">{w}</a>' for w in ("Home", "World", "Politics", "Sport", "Science", "Contact")]
_MENU = "<ul>" + "".join(f"<li>{a}</li>" for a in _LINKS) + "</ul>"
_WRAPPERS = ("<div>{}</div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>", "<div><div>{}</div></div>", "<main>{}</main>", "<article>{}</article>")
_BEFORE = ("", f"<div>{_MENU}</div>", f"<div><span>{'</span> <span>'.join(_LINKS)}</span></div>", f"<table><tr><td>{'</td><td>'.join(_LINKS)}</td></tr></table>", f"<div><div><a href='/n'>New: a bridge</a></div><div>3 May</div>{_MENU}</div>")
_AFTER = ("", f"<div>{_MENU}{_MENU}</div>", "<p>Copyright example</p><div><a href='/l'>Legal</a></div>", "<div><h3>More</h3><p><a href='/1'>A flood in spring, told by those who were there</a></p><p><a href='/2'>Bridges</a></p></div>", f"<div>{' | '.join(_LINKS)}</div><div>Example Ltd</div>")
_STORIES = (
    f"<h1>A flood in spring</h1><p>{_PROSE}</p><p><b>Note</b> {_PROSE}<br>{_PROSE}</p><p>End.</p>",
    f"<h2>A flood in spring</h2><p>{_PROSE}</p><ul><li>{_PROSE}</li><li>One</li></ul><p>{_PROSE} <a href='/x'>and more</a></p><ul><li>One</li><li>Two things</li><li>A third one</li></ul>",
    f"<p>{_PROSE}</p><blockquote><p>{_PROSE}</p></blockquote><table><tr><td>1</td><td>two</td></tr></table><p>{_PROSE}</p><ol><li>First</li><li>Then this</li></ol><p>Under the list.</p>",
    f"<h1>Notes</h1><p><em>{_PROSE}</em></p><h2>Part</h2><pre>{_PROSE}</pre><div>{_PROSE}</div>",
)


def labelled_pages() -> list[list[tuple[bool, str]]]:
    """Pages as lists of (is main text, html): every combination of the pieces above."""
    found = []
    for wrapper, before, after, story in product(_WRAPPERS, _BEFORE, _AFTER, _STORIES):
        start, stop = wrapper.split("{}")
        found.append([(False, f"<html><body>{before}{start}"), (True, story), (False, f"{stop}{after}</body></html>")])
    return found


#: Fewest words of a block of some and of many words.
_SOME, _MANY = 4, 12
_HEADINGS = frozenset(("h1", "h2", "h3"))


def read_page(page: str) -> tuple[list[tuple[str, int]], list[tuple[str, int, int]]]:
    """Tokens as (kind, how many) and blocks as (text, first token, token after the last).

    Words are told apart by their place and by their block: a heading, mostly links, or of few, some or many words;
    tags by their name and whether they lead to or lie in a block of links, or lie in marked main text.
    """
    steps: list[tuple[str, int]] = []
    blocks: list[tuple[str, int, int]] = []
    pieces: list[str] = []  # of the block that is being read
    waiting: list[int] = []  # its words among the steps
    first, opened, told = 0, "", 0

    def close(closing: str) -> None:
        nonlocal first, told
        text = " ".join(html_lib.unescape("".join(pieces)).split())
        if text:
            n = sum(steps[i][1] for i in waiting)
            links = sum(steps[i][1] for i in waiting if steps[i][0].endswith(" link"))
            kind = "links" if 2 * links > n and not steps[waiting[0]][0].startswith("main") else "head" if opened == closing and opened in _HEADINGS else "many" if n >= _MANY else "some" if n >= _SOME else "few"
            for i in waiting:
                place, _, suffix = steps[i][0].partition(" ")
                steps[i] = f"words {place} {kind}" + (" weak" if suffix == "weak" else ""), steps[i][1]
            if kind == "links":
                for i in range(told, len(steps)):
                    if steps[i][0].startswith("tag ") and not steps[i][0].endswith(" main"):
                        steps[i] = steps[i][0] + " links", 1
            blocks.append((text, first, len(steps)))
            told = len(steps)
        pieces.clear()
        waiting.clear()
        first = len(steps)

    for kind, name, text in events(page):
        if kind == "words":
            pieces.append(text)
            if n := len(text.split()):
                waiting.append(len(steps))
                steps.append((name, n))
            continue
        if kind == "break":
            close(name)
            opened = name
        elif kind == "space":
            pieces.append(" ")
        steps.append((f"tag {name} {text}".rstrip(), 1))
    close("")
    return steps, blocks


def fit_weights(pages: Iterable[list[tuple[bool, str]]]) -> dict[str, float]:
    """Scores of token kinds: log odds of lying in main text, kept negative for tags and positive for words other than links.

    A word's least score is above that of two tags of the text, so that a last block of one word is read.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        here = False
        for kind, n in read_page("".join(f"<in-main></in-main>{part}<off-main></off-main>" if main else part for main, part in page))[0]:
            if kind.split()[1] in ("in-main", "off-main"):
                here = "in-main" in kind
            else:
                (inside if here else outside)[kind] += n
    weights = {}
    for kind in inside.keys() | outside.keys():
        odds = math.log((inside[kind] + 1) / (outside[kind] + 1))
        if kind.startswith("tag"):
            least, most = -4.0, -0.02
        elif " outside" in kind:
            least, most = -4.0, -1.0
        elif " links" in kind:
            least, most = -4.0, 4.0
        else:
            least, most = 0.05, 4.0
        weights[kind] = max(least, min(most, odds))
    return weights


#: Score of tags that labelled pages lack, and of words.
_OTHER_TAG, _OTHER_WORD = -0.05, 1.0
#: The most that a stretch without words of the text, such as a list of links, can cost: what 15 words of a story outweigh.
_GAP = 60.0
#: Share of its score that a word keeps in a weakly marked element.
_WEAK_SHARE = 0.5


@lru_cache(maxsize=1)
def default_weights() -> dict[str, float]:
    return fit_weights(labelled_pages())


def score(kind: str, n: int, weights: dict[str, float]) -> float:
    if kind.startswith("tag"):
        return n * weights.get(kind, _OTHER_TAG)
    plain = kind.removesuffix(" weak")
    return n * weights.get(plain, _OTHER_WORD) * (_WEAK_SHARE if plain != kind else 1.0)


def bounded_gaps(scores: Iterable[float]) -> tuple[list[float], list[bool]]:
    """The scores, with each stretch of none above 0 scaled to a sum of at most _GAP below, so that a story goes on behind it; and which were scaled."""
    out: list[float] = []
    gap: list[bool] = []
    begin, total = 0, 0.0
    for one in [*scores, 1.0]:
        if one > 0:
            if total < -_GAP:
                out[begin:] = [x * _GAP / -total for x in out[begin:]]
                gap[begin:] = [True] * (len(out) - begin)
            begin, total = len(out) + 1, 0.0
        else:
            total += one
        out.append(one)
        gap.append(False)
    return out[:-1], gap[:-1]


def best_run(scores: Iterable[float]) -> tuple[int, int]:
    """First and end of the run with the greatest sum; (0, 0) where no sum is above 0. Of ties the one that ends first, and of those the shortest."""
    best = total = 0.0
    begin = start = stop = 0
    for i, one in enumerate(scores):
        total += one
        if total > best:
            best, start, stop = total, begin, i + 1
        if total <= 0:
            total, begin = 0.0, i + 1
    return start, stop


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text: blocks in page order, one to a line. A page without a run above 0, such as one of links alone, is read as it is."""
    if not page:
        return ""
    weights = default_weights() if weights is None else weights
    steps, blocks = read_page(page)
    scores = [score(kind, n, weights) for kind, n in steps]
    bounded, gap = bounded_gaps(scores)
    whole, (start, stop) = best_run(scores), best_run(bounded)
    # What lies in a gap is read only if the run goes across it at its full cost.
    inside = lambda a, b: a < whole[1] and b > whole[0] or a < stop and b > start and not all(gap[a:b])
    return "\n".join(text for text, a, b in blocks if start == stop or inside(a, b))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    require(pages, id_col, url_col, html_col)
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
