"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by where it stands (menus, forms, notices,
comments ... are out), link density, length and stop-word density; short blocks, and long ones with few stop words,
stay undecided. In pass two an undecided block takes the label of the nearest decided neighbours of its region. Where a
page has an article (or main) element, what is outside of it is not content, and inside of it a block with nobody to
inherit from is. A class or id puts an element out only if all words of one of its names say so (`cookie-banner`, not
`has-sidebar`), and an article inside such an element counts where the page has no other.

Cases: a null or empty page has empty text; unclosed and stray tags are mended as browsers do (a tag closes what is
open inside it); very long pages are read whole, in batches of few pages; a repeated row is extracted alike (there are
no ties); an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linenet.llm.common import lean, quoted, sliced

# HTML element names, class-name words of page furniture, and common short words of four languages.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|svg|math|iframe|object|textarea|title|noframes|canvas|audio|video|select|button"
OUT_TAGS = frozenset("head nav footer aside form menu dialog fieldset label option datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar sidebars side aside widget widgets menu nav navbar navigation navi breadcrumb breadcrumbs footer foot header masthead topbar toolbar "
    "comment comments reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager tags copyright legal skip hidden".split()
)
# Words that may stand beside those in a name without changing what it says.
BESIDE_WORDS = frozenset("site page post box block wrapper wrap container inner outer list item items section area bar button buttons link links left right top bottom primary secondary global js posts form row col column columns first last".split())
IN_TAGS = frozenset(["article", "main"])
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so "
    "der die das und in zu den mit von ist des sich ein eine nicht auf für dem im auch es an als er hat aus bei sie nach wie war wird einer um am sind noch über einen so zum kann haben oder "
    "le la les de des et un une du en que est dans qui pour pas au sur par il elle ce avec plus ne se sont ou son sa mais "
    "el los las que y en un una es por con no para su al lo como más pero sus se del o ha me si sin sobre".split()
)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][\w:.-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:.-]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>|([^<]++|<)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[^\W\d_]+")

SHORT, LONG, LIST = 70, 200, 3
LINKS_MOST = 0.4
STOPS_SOME, STOPS_MANY = 0.08, 0.16


def _furniture(name: str) -> bool:
    """Whether a class name or id says that its element is page furniture."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in OUT_WORDS for w in words) and all(w in OUT_WORDS or w in BESIDE_WORDS for w in words)


def _out(tag: str, attributes: str, inside: bool) -> int:
    """2 if the element is out for what it is, 1 if only its class or id says so, else 0."""
    if tag in OUT_TAGS or (tag == "header" and not inside):
        return 2
    by_name = 0
    for name, a, b, c in NAMES.findall(attributes or ""):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if tag not in ("body", "html", "article", "main") and any(map(_furniture, value.split())):
                by_name = 1
        elif name == "role":
            if value.strip() in OUT_ROLES:
                return 2
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 2
        elif name == "hidden" or value == "true":
            return 2
    return 2 * by_name if inside else by_name


def blocks_of(page: str) -> list[tuple[str, float, int, int]]:
    """(text, link density, out by its place, region) in page order; region 0 is outside of any article."""
    found, parts, linked, regions = [], [], 0, 0
    stack: list[tuple[str, int, int]] = []  # tag, out, region
    out, region, links = 0, 0, 0

    def close():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, min(1.0, linked / len(text)), out, region))
        parts.clear()
        linked = 0

    def state():
        nonlocal out, region
        out, region = (stack[-1][1], stack[-1][2]) if stack else (0, 0)

    for m in TOKEN.finditer(page):
        text = m[8]
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        tag = m[3] or m[6]
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        closing, attributes, tag = m[2] or m[5], m[4] or m[7] or "", tag.lower()
        if tag in BLOCK_TAGS:
            close()
        elif tag == "br":
            parts.append(" ")
        if tag == "a":
            links = 0 if closing else 1
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                if any(s[1] != out or s[2] != region for s in stack[max(0, depth - 1) : depth]) or depth == 0:
                    close()
                del stack[depth:]
                state()
        elif tag not in VOID_TAGS and not attributes.endswith("/"):
            if tag in BLOCK_TAGS and stack and stack[-1][0] == "p":
                stack.pop()
                state()
            now = max(out, _out(tag, attributes, region > 0))
            if now != out and tag not in BLOCK_TAGS:
                close()
            if tag in IN_TAGS and not region:
                regions += 1
                stack.append((tag, now, regions))
            else:
                stack.append((tag, now, region))
            state()
    close()
    return found


def decide(text: str, links: float, out: int, region: int, listed: bool) -> int:
    """Pass one: 1 content, 0 not, -1 undecided. listed: whether the block stands among links alone."""
    if out or listed:
        return 0
    if links > LINKS_MOST:
        return -1 if region else 0
    if len(text) < SHORT:
        return -1
    words = WORDS.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOPS_MANY:
        return 1
    if stops >= STOPS_SOME:
        return 1 if len(text) >= LONG else -1
    return -1 if region else 0


def _listed(found: list) -> list[bool]:
    """Which blocks stand in a run of LIST or more that are nothing but links."""
    out, begin = [False] * len(found), 0
    for i in range(len(found) + 1):
        if i == len(found) or found[i][1] < 0.9 or found[i][3] != found[begin][3]:
            if i - begin >= LIST:
                out[begin:i] = [True] * (i - begin)
            begin = i if i < len(found) and found[i][1] >= 0.9 else i + 1
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks_of(page)
    for most in (0, 1):  # the page says where its article is, if need be inside an element with an unlucky name
        if any(region and out <= most for _, _, out, region in found):
            found = [(text, links, out > most, region) for text, links, out, region in found if region]
            break
    labels = [decide(*b, listed) for b, listed in zip(found, _listed(found), strict=True)]
    before, after, kept = {}, {}, []
    nearest_before, nearest_after = [None] * len(found), [None] * len(found)
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        nearest_before[i] = before.get(b[3])
        if label >= 0 and not b[2]:
            before[b[3]] = (i, label)
    for i in range(len(found) - 1, -1, -1):
        nearest_after[i] = after.get(found[i][3])
        if labels[i] >= 0 and not found[i][2]:
            after[found[i][3]] = (i, labels[i])
    for i, (text, links, _, region) in enumerate(found):
        label = labels[i]
        if label < 0:
            near = [(abs(i - x[0]), -x[1]) for x in (nearest_before[i], nearest_after[i]) if x is not None]
            label = -min(near)[1] if near else int(bool(region) or links <= LINKS_MOST)
            label = label or int(bool(region) and links <= LINKS_MOST)  # an article's text stays beside a list of links
        if label:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, ident: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, 100):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(quoted(ident).cast("long").alias("page_id"), quoted(url).cast("string").alias("url"), quoted(page).cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
