"""Main text of HTML pages by two-pass block rules.

The page is cut into blocks at block-level tags. First pass: each block is judged by its length, its
share of stop words and its share of linked characters: good, bad or, if short or doubtful, open.
Where markup says that a block is a menu, footer, advert and the like it is bad, and where it says
that a block is inside an article fewer stop words will do. Second pass: an open block takes the
label of its nearest decided neighbour on the same side of the article's border.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ratelens.llm.classifier import STOP_WORDS
from ratelens.llm.common import append, fields, slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element names and name words of web pages.
RAW = frozenset("script style title textarea noscript template iframe select".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
KEPT_OPEN = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6 li dt dd tr td th body html caption figcaption label legend summary".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button head fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "menu menus nav navbar navigation sidebar sidebars breadcrumb breadcrumbs comment comments reply replies respond discussion disqus footer masthead "
    "share sharing social related recommended newsletter subscribe signup login popup modal overlay widget widgets toolbar pagination pager copyright "
    "legal disclaimer alert skip topbar adsense adbox adslot subnav topnav mainnav commentlist".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies".split())
#: Names that begin so tell a state ("no-sidebar"), not what the element is.
STATE_WORDS = frozenset("has no with without hide show is not".split())
HEADER_WORDS = frozenset(["header", "head"])
ARTICLE_WORDS = frozenset("article content post entry story".split())

#: Characters of a short and a long block, stop words among a block's words, linked characters among its characters.
SHORT, LONG, FEW_STOPS, MANY_STOPS, SOME_LINKS, MANY_LINKS = 70, 200, 0.1, 0.17, 0.2, 0.5


class _Block:
    __slots__ = ("text", "link", "boiler", "inside", "heading", "label")

    def __init__(self, text: str, link: float, boiler: bool, inside: bool, heading: bool):
        self.text, self.link, self.boiler, self.inside, self.heading, self.label = text, link, boiler, inside, heading, 0


def _place(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it holds the article."""
    article = name in ("article", "main")
    if name in BOILERPLATE_TAGS or name == "header" and not inside:
        return True, False
    if not rest or rest.isspace():
        return False, article
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True, False
        if key == "role":
            if value.lower() in BOILERPLATE_ROLES:
                return True, False
            article |= value.lower() == "main"
        if key in ("class", "id") and name not in ("body", "html"):
            words, first = set(), set()
            for token in value.split():
                found = [w.lower() for w in _NAME_WORD.findall(token)]
                if found and found[0] not in STATE_WORDS:
                    words.update(found)
                    first.add(found[0])
            if name in ("article", "main"):
                # An article says little by its classes, unless it stands in another or is a comment.
                if first & COMMENT_WORDS or inside and words & BOILERPLATE_WORDS:
                    return True, False
                continue
            if words & BOILERPLATE_WORDS or not inside and words & HEADER_WORDS:
                return True, False
            article |= name in ("div", "section", "td") and bool(words & ARTICLE_WORDS)
    return False, article


def blocks(page: str) -> list[_Block]:
    out: list[_Block] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    parts: list[str] = []
    linked, in_link, own_boiler, heading = 0, False, False, False
    at, end = 0, len(page)

    def put(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = entities.unescape(raw)
        parts.append(raw)
        if in_link:
            linked += sum(map(len, raw.split()))

    def flush() -> None:
        nonlocal linked, own_boiler, heading
        words = "".join(parts).split()
        if words:
            _, boiler, inside = stack[-1]
            out.append(_Block(" ".join(words), linked / sum(map(len, words)), boiler or own_boiler, inside, heading))
        parts.clear()
        linked, own_boiler, heading = 0, False, False

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if not m:
            put(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            put(page[at:lt])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, closing, rest = name.lower(), bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        if name in RAW:
            if not closing and not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name == "a":
            in_link = not closing
        elif name in ("br", "img", "wbr") and name != "wbr":
            parts.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if name in ("body", "html"):
            in_link = False
            if name == "body":
                stack[1:] = []
            continue
        if closing:
            if name in KEPT_OPEN:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        in_link = False
                        break
            continue
        boiler, article = _place(name, rest, stack[-1][2])
        if name in KEPT_OPEN:
            if name in ("article", "main") and stack[-1][0] == "head":
                stack[1:] = []
            stack.append((name, stack[-1][1] or boiler, stack[-1][2] or article))
        else:
            own_boiler, heading = boiler, name[0] == "h" and name[1:].isdigit()
    flush()
    return out


def _stops(text: str) -> float:
    words = text.split(" ")
    return sum(w.lower().strip(".,;:!?\"'()%&#$*") in STOP_WORDS for w in words) / len(words)


def _first_pass(b: _Block) -> int:
    """1 good, -1 bad, 0 open. Length, stop words and links decide; a block inside an article needs
    only half the stop words, and one without any is open there, not bad."""
    if b.boiler or b.link > MANY_LINKS or b.text[0] == "\u00a9":
        return -1
    if len(b.text) < SHORT:
        return -1 if b.link > SOME_LINKS and not b.inside else 0
    stops = _stops(b.text) * (2 if b.inside else 1)
    if stops >= MANY_STOPS or stops >= FEW_STOPS and len(b.text) >= LONG:
        return 1
    return -1 if stops < FEW_STOPS / 2 and not b.inside else 0


def _second_pass(found: list[_Block]) -> None:
    """Open blocks take the label of the nearest decided block; if two are equally near and differ,
    a heading follows the later one and other text is bad. Inside an article, boilerplate isn't
    asked, and without any decided block the text is good."""
    for inside in (True, False):
        side = [b for b in found if b.inside == inside and not (inside and b.boiler)]
        decided = [i for i, b in enumerate(side) if b.label]
        new = {}
        before, j = None, 0
        for i, b in enumerate(side):
            while j < len(decided) and decided[j] <= i:
                before = decided[j]
                j += 1
            if b.label:
                continue
            after = decided[j] if j < len(decided) else None
            if before is None and after is None:
                new[i] = 1 if inside else -1
            elif after is None or before is not None and i - before < after - i:
                new[i] = side[before].label
            elif before is None or after - i < i - before or b.heading or side[before].label == side[after].label:
                new[i] = side[after].label
            else:
                new[i] = 1 if inside else -1
        for i, label in new.items():
            side[i].label = label


def main_text(page: str | None) -> str:
    """The good blocks in page order, two newlines between them. If an article is marked and has
    good text, only that counts."""
    found = blocks(page or "")
    for b in found:
        b.label = _first_pass(b)
    _second_pass(found)
    good = [b for b in found if b.label > 0]
    marked = [b.text for b in good if b.inside]
    return "\n\n".join(marked or [b.text for b in good])


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """pages' columns `keep` (all but the html by default), text (empty if none) and n_chars (code
    points). Null and empty pages give an empty text; broken and truncated markup is read as far
    as it goes; columns of the outputs' names are replaced."""
    keep = [c for c in ([c for c in pages.columns if c != html] if keep is None else keep) if c not in (out, "n_chars")]

    def run(batches):
        for b in slices(batches):
            texts = [main_text(p) for p in b.column(b.schema.get_field_index(html)).to_pylist()]
            yield append(b, keep, {out: pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    need = list(dict.fromkeys([*keep, html]))
    return pages.select(*need).mapInArrow(run, T.StructType([*fields(pages, keep), T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())]))
