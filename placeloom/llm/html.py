"""Main text of HTML pages by two-pass block rules.

The page is cut into blocks at block-level tags.  Pass one classifies each
block by its length, stop-word density and link density: long running text is
good, link lists and text that doesn't run are bad, short and middling blocks
stay ambiguous.  Where the stop words don't know the page's language (they
hardly occur in it), sentence punctuation stands in for them.  Menus, headers,
footers, sidebars, notices, adverts, forms, comments and the like are
boilerplate whatever they hold; what only a name or a ``form`` tag says is
evidence, and yields where the element holds an article or most of the text.
An ``article`` or ``main`` is evidence too: it counts if at least half of the
page's running text lies in such elements, or there is next to none outside (an article next to a much larger one
that is short and links elsewhere is a teaser); then text outside is
boilerplate, and inside link-dense or sparse text is ambiguous instead of bad.
Otherwise all blocks are judged alike.  Pass two gives an ambiguous block the
label of its nearest decided neighbours on either side: where both agree it
takes theirs, where they differ a middling block is good and a short one is
not, unless it heads good text.  The page's ends count as bad, an article's own
ends as good.

Defined cases: a null or empty page, or one without text, gives the empty
text; broken markup (unclosed tags, stray ends, cut entities, unclosed
comments) is read as far as it goes; repeated pages give repeated rows; very
long pages are parsed in one sweep over their tags, in time proportional to
their length however tags are nested; extra columns pass through ``extract``
unless they are called like its outputs.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, schema_of

#: Function words of a few languages; the density of these marks running text.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on was as with be by this from or are at an which not have has had he she they we you his her their its
    der die das und ist in zu den von mit sich auf für nicht ein eine als auch es an dem werden aus er hat dass sie nach bei
    le la les de des et un une est que qui dans pour par sur pas au aux du il elle ne se ce plus avec sont ou
    el los las y en un una que es por con para del se no su al lo como más o pero sus le ha""".split()
)
_BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math object select canvas audio video xmp noembed noframes".split())
_DROPPED = frozenset("nav footer aside button select option menu dialog head label fieldset search".split())
_CLOSES_P = _BLOCK - {"option", "optgroup", "button"}
_WORDY = (
    "ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    "signup|login|sidebar|rail|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|footer|masthead|topbar|toolbar|comment|comments|commentlist|disqus|respond|reply|replies|"
    "share|sharing|social|related|recommended|recommendations|widget|widgets|form|search|tags|tagcloud|copyright|legal|disclaimer|skip|complementary|contentinfo|toc"
)
#: Whole class tokens: these words, with words of place before and words of layout after them; not has-sidebar, form-page or category-legal.
_BEFORE = "site|page|main|top|bottom|left|right|primary|secondary|global"
_AFTER = "list|area|box|bar|container|wrapper|wrap|block|item|items|link|links|icons|buttons|posts|articles|section|slot|unit|inner|left|right|top|bottom|primary|secondary|\\d+"
_BAD_NAME = re.compile(rf"(?:^|\s)(?:(?:{_BEFORE})[_\-]+)*(?:{_WORDY}|site[_\-]?header|page[_\-]?header|side[_\-]?bar)(?:[_\-]+(?:{_WORDY}|{_AFTER}))*\d*(?!\S)", re.I)
_COMMENT_NAME = re.compile(r"comment|disqus|respond|repl(?:y|ies)", re.I)
#: Inside an article these name a subject as often as boilerplate.
_SUBJECT = re.compile(r"(?<![\w\-])(?:legal|copyright|disclaimer|notice|alert|consent|gdpr|cookies?|advertising|promotion|subscription|form|search|skip)(?![\w\-])", re.I)
_MOST_ZONES = 8
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_TOKEN = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>?""")
_WHITE = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?…](?=[\s\"'»”)]|$)|[。！？।؟۔]")

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.12, 0.22
LINKS_MAX = 0.33
#: Share of stop words below which a page's language counts as unknown to the list, and characters that a sentence has at most.
STOPS_KNOWN, SENTENCE_MOST = 0.08, 300


class Block:
    __slots__ = ("text", "linked", "bad", "core", "heading", "label", "zones")

    def __init__(self, text: str, linked: int, bad: bool, core: int, heading: bool, zones: tuple[int, ...] = ()):
        self.text, self.linked, self.bad, self.core, self.heading, self.label, self.zones = text, linked, bad, core, heading, "", zones


def _dropped(tag: str, attributes: str, in_core: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not in_core):
        return True
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _bad_name(tag: str, attributes: str, in_core: bool) -> str:
    """The name that marks an element as boilerplate, if it has one."""
    if not attributes or tag in ("html", "body", "main"):
        return ""
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value.strip("\"'"))
            if _BAD_NAME.search(_SUBJECT.sub(" ", value) if in_core else value):
                return value
    return ""


def _drop_zones(out: list[Block], names: list[str], with_core: set[int]) -> None:
    """Marks the blocks of badly named elements, outer elements first, but for those that hold the page's text.

    An element that is or holds an article, or has most of the text, stays when
    the articles outside such elements have next to no text; with most of the
    text it stays anyhow, unless it is a thread of comments.
    """
    members: list[list[Block]] = [[] for _ in names]
    for b in out:
        for z in b.zones:
            members[z].append(b)
    around = {id(b): len(b.zones) for b in out}
    total = sum(len(b.text) for b in out if not b.bad)
    outside = sum(len(b.text) for b in out if b.core and not b.bad and not b.zones)
    for z, name in enumerate(names):
        own = sum(len(b.text) for b in members[z] if not b.bad)
        most = 2 * own > total
        if own and (z in with_core or most) and (outside < LENGTH_HIGH or (most and not _COMMENT_NAME.search(name))):
            for b in members[z]:
                around[id(b)] -= 1
                if b.core and not b.bad and not around[id(b)]:
                    outside += len(b.text)
    for b in out:
        b.bad = b.bad or around[id(b)] > 0


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with the characters inside links and the context of each."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, starts a dropped zone, starts an article
    zones: list[tuple[int, int]] = []  # open elements with a bad name: place in the stack, number
    names: list[str] = []
    with_core: set[int] = set()
    bad = links = 0
    core: list[int] = []
    cores = heading = 0
    at, low = 0, None
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    depth = [0]  # block elements among the first so many of the stack

    def flush():
        nonlocal heading
        text = _WHITE.sub(" ", unescape("".join(parts))).strip()
        if text:
            own = len(_WHITE.sub(" ", unescape("".join(linked))).strip())
            out.append(Block(text, own, bad > 0, core[-1] if core else 0, heading > 0, tuple(z for _, z in zones)))
        parts.clear()
        linked.clear()

    def pop():
        nonlocal bad, links, heading
        tag, drops, is_core = stack.pop()
        places[tag].pop()
        depth.pop()
        if zones and zones[-1][0] == len(stack):
            zones.pop()
        bad -= drops
        links -= tag == "a"
        heading -= tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if is_core:
            core.pop()

    def close(place: int):
        while len(stack) > place:
            pop()

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked.append(page[at : m.start()])
        at = m.end()
        if m.group(0).startswith("<!--"):
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        if m.group(1) or m.group(4):
            if tag in _BLOCK:
                flush()
            k = places.get(tag)
            if k and (tag in _BLOCK or depth[-1] == depth[k[-1] + 1]):  # an inline end across a block closes nothing
                close(k[-1])
            continue
        attributes = m.group(3) or ""
        if tag in _BLOCK:
            flush()
            if tag in _CLOSES_P and (k := places.get("p")) and depth[-1] == depth[k[-1] + 1]:
                close(k[-1])
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                pop()
        elif tag == "br":
            parts.append(" ")
        if tag in _RAW:
            if attributes.endswith("/") and tag not in ("script", "style", "textarea", "title"):
                continue
            if low is None:
                low = page.lower()
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag == "a" and (k := places.get("a")) and depth[-1] == depth[k[-1] + 1]:  # links don't nest
            close(k[-1])
        drops = _dropped(tag, attributes, bool(core))
        is_core = tag in ("article", "main") or (tag in ("div", "section") and bool(re.search(r"""itemprop\s*=\s*["']?articleBody|role\s*=\s*["']?(?:main|article)\b""", attributes)))
        named = "" if drops else "form" if tag == "form" else _bad_name(tag, attributes, bool(core))
        if named and len(zones) < _MOST_ZONES:
            zones.append((len(stack), len(names)))
            names.append(named)
        elif named:
            drops = True
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, drops, is_core))
        depth.append(depth[-1] + (tag in _BLOCK))
        bad += drops
        links += tag == "a"
        heading += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if is_core:
            cores += 1
            with_core.update(z for _, z in zones)
            core.append(core[-1] if core else cores)
    if at < len(page):
        parts.append(page[at:])
        if links:
            linked.append(page[at:])
    flush()
    _drop_zones(out, names, with_core)
    return out


def _label(b: Block, density: float, running: bool, known: bool) -> str:
    n, link_density = len(b.text), b.linked / len(b.text)
    if b.bad:
        return "bad"
    if link_density > LINKS_MAX:
        return "near" if b.core and (b.heading or running) else "bad"
    if n < LENGTH_LOW:
        return "short" if b.core or not b.linked else "bad"
    if b.core:
        return "good" if running else "near"
    if not known:
        return ("good" if n > LENGTH_HIGH else "near") if running else "bad"
    if density >= STOPS_HIGH:
        return "good" if n > LENGTH_HIGH else "near"
    return "near" if density >= STOPS_LOW else "bad"


def classify(found: list[Block]) -> None:
    """Pass one: good, bad, near (leaning good) or short."""
    counts = []
    for b in found:
        words = _WORDS.findall(b.text.lower())
        counts.append((sum(w in STOP_WORDS for w in words), len(words)))
    plain = [c for b, c in zip(found, counts, strict=True) if not b.bad and b.linked <= LINKS_MAX * len(b.text)]
    known = sum(s for s, _ in plain) >= STOPS_KNOWN * sum(n for _, n in plain)
    evidence = []
    for b, (stops, words) in zip(found, counts, strict=True):
        density = stops / words if words else 0.0
        sentences = len(_SENTENCE.findall(b.text)) * SENTENCE_MOST >= len(b.text)
        evidence.append((density, len(b.text) >= LENGTH_LOW and (density >= STOPS_LOW if known else sentences)))
    # Running text, read without regard to articles, says which elements are the page's own.
    inside: dict[int, int] = {}
    linked: dict[int, int] = {}
    outside = 0
    for b, (_, running) in zip(found, evidence, strict=True):
        if not b.bad and b.linked <= LINKS_MAX * len(b.text):
            if b.core:
                inside[b.core] = inside.get(b.core, 0) + len(b.text) * running
            else:
                outside += len(b.text) * running
        if b.core:
            linked[b.core] = linked.get(b.core, 0) + b.linked
    most = max(inside.values(), default=0)
    for b in found:
        if b.core and inside.get(b.core, 0) < min(most / 5, 2 * LENGTH_HIGH) and linked[b.core]:
            b.bad = True  # a teaser
    own = bool(inside) and (outside < LENGTH_HIGH or sum(inside.values()) >= outside)
    for b, (density, running) in zip(found, evidence, strict=True):
        if not own:
            b.core = 0
        b.label = "bad" if own and not b.core else _label(b, density, running, known)


def settle(found: list[Block]) -> list[str]:
    """Pass two: ambiguous blocks take the label of the nearest decided neighbours; returns the good texts."""
    n = len(found)
    before, after = ["bad"] * n, ["bad"] * n
    for order, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last, zone = "bad", 0
        for i in order:
            b = found[i]
            if b.core and b.core != zone and not b.bad:  # an article's own edge
                last = "good"
            zone = b.core
            into[i] = last
            if b.label in ("good", "bad") and not (b.core and b.label == "bad"):
                last = b.label
    out = []
    for b, p, q in zip(found, before, after, strict=True):
        label = b.label
        if label in ("near", "short"):
            if p == q:
                label = p
            elif label == "near":
                label = "good"
            else:
                label = "good" if b.heading and q == "good" else "bad"
        if label == "good":
            out.append(b.text)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n\n".join(settle(found))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text, n_chars`` to every row of ``pages``."""
    out = schema_of("text string, n_chars long")

    @F.pandas_udf(out)
    def run(html):
        import pandas as pd

        texts = [main_text(h) for h in html]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in out.names]
    return pages.withColumn("_main", run(F.col(html))).select(*kept, "_main.*")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
