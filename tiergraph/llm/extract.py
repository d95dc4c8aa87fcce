"""HTML main-text extraction by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass classifies each block by stop-word density,
length and link density, with the container it stands in: blocks of menus, adverts, forms and the like are
boilerplate, blocks that are mostly links too, long blocks with ordinary function words are content, and
short or odd ones stay ambiguous.  Where no block of a page has the function words of a language known here,
long blocks of sentences with few links are content.  A class or id marks a container only if it says nothing
but that ("cookie-notice", not "notice-period").  In the second pass every ambiguous block takes the label of its nearest
decided neighbours: both alike, or else the nearer, among blocks of the same article if it stands in one.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by a blank line in page order; nothing else is dropped and nothing is cut.

Defined cases: null or empty html gives an empty text; a page without any content block gives an empty
text; unclosed tags and comments run to where HTML lets them; repeated pages get the same text each; input
columns named like the operator's own are replaced; pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tiergraph.llm.quality import FUNCTION_WORDS
from tiergraph.llm.tables import map_text

#: Elements that end a block, that hold no text of the page, and that are never main text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript noframes noembed iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav header footer aside form menu dialog button select head svg template object audio video canvas map search".split())
#: Words of class, id and role attributes that mark boilerplate.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead header footer foot copyright legal "
    "comment comments commentlist disqus reply replies respond discussion related recommended share sharing social newsletter subscribe subscription signup login search widget pagination pager skip "
    "complementary contentinfo alertdialog".split()
)
#: Words that such names hold beside those, and that change nothing.
AROUND_WORDS = frozenset(
    "area bar block body box bottom btn button buttons card column container content desktop fixed footer global group head header holder inner item items left link links list main mobile "
    "outer page panel placeholder post posts primary right row secondary section site slot sticky text title top unit widget widgets wrap wrapper form feed thread article articles stories icons us".split()
)
HOME = frozenset(["article", "main"])
_CLOSES_P = BLOCK - frozenset("html head body title option caption tbody td tfoot th thead tr legend dd dt li summary".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_PIECES = re.compile(r"[A-Za-z]+")
_STRIP = "\"'.,;:!?()[]{}*#$%&<>|«»„“”…-"
#: Function words of more languages, and function characters of Chinese.
MORE_FUNCTION_WORDS = (
    "di che non per il gli della sono ma anche come nel dei si "
    "um uma os não mais ao das seu sua dos mas foi "
    "het een van niet dat op te zijn voor met aan ook maar "
    "och att det som på är av för inte till om men jag "
    "i w na z się nie jest to że do jak po ale "
    "и в не на что он с как это по но из у за так же "
    "και το να του η της με σε που για δεν είναι "
    "ve bir bu için ile da de çok ama gibi "
    "من في على إلى أن هذا التي الذي ما لا هو "
    "של את על לא הוא זה עם גם כי אל "
    "है के में की और से का को नहीं यह पर "
    "yang dan di dari untuk dengan ini itu tidak pada "
    "và của là có không trong được cho với một"
).split()
CHINESE_FUNCTION_CHARACTERS = frozenset("的了是在不和有这我他们就也都到说要会可对为与其之而但")
_STOP = frozenset(FUNCTION_WORDS) | frozenset(MORE_FUNCTION_WORDS)
#: Characters written without spaces between words: hiragana, katakana, Chinese characters, Thai.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0e7f]")
_HIRAGANA = re.compile(r"[\u3040-\u309f]")
_SENTENCE = re.compile(r"[.!?…:;。！？।؟։።]['\"”»)\]」』]*$|[\u0e00-\u0e7f]$")

GOOD, BAD, UNSURE = 1, -1, 0

#: Words of a block from which it can be decided, and the shares that decide it.
LONG, STOP_SHARE, LINK_SHARE = 10, 0.1, 0.5
#: The share of links that a block of an unknown language may have, and characters that stand for a word where
#: no spaces do.
FEW_LINKS, DENSE_WORD = 0.2, 2


class _Block:
    __slots__ = ("parts", "linked", "apart", "home", "heading")

    def __init__(self, apart: bool, home: int, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.apart, self.home, self.heading = apart, home, heading


def _marked(attributes: str) -> bool:
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            pieces = [x.lower() for x in _PIECES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
            if any(x in APART_WORDS for x in pieces) and all(x in APART_WORDS or x in AROUND_WORDS for x in pieces):
                return True
    return bool(_HIDDEN.search(attributes))


def blocks(page: str) -> list[_Block]:
    """The page's blocks in order, with their text, linked characters, container and article number."""
    out: list[_Block] = []
    open_tags: list[tuple[str, bool, int]] = []  # name, apart, article
    links = homes = at = 0
    now: _Block | None = None

    def text(piece: str) -> None:
        nonlocal now
        if not piece:
            return
        if now is None:
            name, apart, home = open_tags[-1] if open_tags else ("", False, 0)
            now = _Block(apart, home, len(name) == 2 and name[0] == "h" and name[1].isdigit())
            out.append(now)
        piece = entities.unescape(piece)
        now.parts.append(piece)
        if links:
            now.linked += len(piece.strip())

    while True:
        m = _TAG.search(page, at)
        text(page[at : m.start()] if m else page[at:])
        if not m:
            return [b for b in out if "".join(b.parts).strip()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if name in BLOCK:
                now = None
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == name:
                    links -= sum(t[0] == "a" for t in open_tags[k:])
                    del open_tags[k:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|</{name}\Z", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            if name in BLOCK:
                now = None
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            now = None
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in _CLOSES_P or name == "li" or name in ("dd", "dt", "td", "th", "tr", "option"):
            # An open paragraph (or item of the same kind) ends here, with what is open inside it.
            ends = "p" if name in _CLOSES_P else name
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == ends:
                    links -= sum(t[0] == "a" for t in open_tags[k:])
                    del open_tags[k:]
                    break
                if open_tags[k][0] in BLOCK:
                    break
        _, apart, home = open_tags[-1] if open_tags else ("", False, 0)
        if name in HOME and not apart:
            homes += 1
            home = home or homes
        # A header inside an article holds its headline, not the page's masthead.
        apart = apart or (name in APART and not (name == "header" and home)) or (name not in HOME and name != "body" and name != "html" and bool(attributes) and _marked(attributes))
        if name == "a":
            links += 1
        open_tags.append((name, apart, home))


def _measures(body: str) -> tuple[float, bool]:
    """Words of a block, and whether function words (or characters) have their usual share of it."""
    words = body.split()
    stops = sum(w.strip(_STRIP).lower() in _STOP for w in words)
    dense = _DENSE.findall(body)
    if len(dense) <= len(words):
        return len(words), stops >= STOP_SHARE * len(words)
    usual = sum(c in CHINESE_FUNCTION_CHARACTERS for c in dense) >= STOP_SHARE / 2 * len(dense) or len(_HIRAGANA.findall(body)) >= STOP_SHARE * len(dense)
    return len(words) + len(dense) / DENSE_WORD, usual


def classify(found: list[_Block]) -> list[int]:
    """Labels of the blocks after both passes."""
    labels = []
    any_home = any(b.home and not b.apart for b in found)
    bodies = ["".join(b.parts).strip() for b in found]
    measures = [_measures(body) for body in bodies]
    known = any(n >= LONG and usual and not b.apart for b, (n, usual) in zip(found, measures, strict=True))
    for b, body, (n, usual) in zip(found, bodies, measures, strict=True):
        chars = len(body)
        if b.apart or chars and b.linked > LINK_SHARE * chars and not (b.home and b.heading):
            labels.append(BAD)
        elif any_home and not b.home:
            labels.append(BAD)  # the page says where its article is
        elif n >= LONG and (usual or not known and b.linked <= FEW_LINKS * chars and _SENTENCE.search(body)):
            labels.append(GOOD)
        else:
            labels.append(UNSURE)
    # Nearest decided blocks on either side, among those of the same article (0: outside of any).
    final = list(labels)
    near: list[list[int | None]] = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, int] = {}
        seen: list[int | None] = [None] * len(found)
        for j in order:
            seen[j] = last.get(found[j].home)
            if labels[j] != UNSURE and not (found[j].home and found[j].apart):
                last[found[j].home] = j
        near.append(seen)
    for i, label in enumerate(labels):
        if label != UNSURE:
            continue
        before, after = near[0][i], near[1][i]
        if before is None and after is None:
            final[i] = GOOD if found[i].home else BAD
        elif before is None or after is None:
            final[i] = labels[before if after is None else after]
        elif labels[before] == labels[after]:
            final[i] = labels[before]
        else:
            final[i] = labels[before if i - before < after - i else after]
    return final


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    kept = (" ".join("".join(b.parts).split()) for b, label in zip(found, classify(found), strict=True) if label == GOOD)
    return "\n\n".join(x for x in kept if x)


def extract_main(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Pages with text and n_chars (code points); see the module's text for odd cases."""

    def fn(column: pa.Array) -> list[list]:
        texts = [main_text(p) for p in column.to_pylist()]
        return [texts, [len(t) for t in texts]]

    return map_text(pages, html, fn, [("text", T.StringType()), ("n_chars", T.LongType())], keep)
