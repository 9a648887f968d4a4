"""Main text of HTML pages by composite text density.

A page becomes a tree (optional end tags closed as browsers do). Parts that are
never main text go first: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments, by element, role, or class and id words
(which don't count against a wrapper of the article or, where none is marked, of most text). For every node that is left, characters and tags below it give its density,
adjusted by how much of both is links. The density sum of a node adds up its
children's densities (loose text counts as a child). The node with the largest
sum leads to the threshold, the smallest density on its path from the body. If it
stands in an article, or in a main element without one, that is the text as a whole.
Otherwise every block below the body (or the main element around the article) is tested against the
threshold itself: only what stands below the node with the largest sum (if that is a part of the
page, not its wrapper) or in the article goes with it; so are other articles. Where that node holds all text left, its headings, paragraphs
and lists stay and only boxes among them are tested. Short blocks between dense ones, headings before and paragraphs after them
belong to them; boxes made of links are dropped.

Text is built per block: character references decoded, white space collapsed,
trimmed, blocks joined by one blank.

The work is per page, so it scales with the pages and shuffles nothing. Trees hold
a page's elements; there is no recursion and no limit on size or depth.

Defined results: null and empty html, and pages without text, give an empty
string; broken, cut or nested markup is read as far as it goes; rows that repeat
are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from docflow.llm.arrow import lean
from docflow.llm.text import pick

#: Elements by role (fixed values from the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav noframes noscript ol optgroup option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An element closes the open ones named, but none beyond the fences.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])), "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])), "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset(["html"])),
}
P_FENCE = frozenset("button table td th caption object applet marquee template".split())
#: Parts that are never main text.
DROPPED = frozenset("nav footer header aside form script style noscript template iframe object embed button select textarea input dialog head title svg math canvas audio video map menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|submenu|breadcrumbs?|sidebar|side-?bar|aside|footer|foot|header|masthead|topbar|banner|ads?|adv|advert|adverts|advertisements?|advertising|adsbygoogle|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|notices?|popup|modal|overlay|alert|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comments?|disqus|respond|replies|pagination|pager|toolbar|widget|skip-?link|copyright)(?:$|[^a-z])"
)
#: Whether a page or post takes comments: says nothing of the element's own text.
COMMENT_STATE = re.compile(r"(?:^|(?<=[^a-z]))(?:(?:no|has|with|without)-comments?|comments?-(?:open|closed|enabled|disabled|on|off))(?=$|[^a-z])")
#: Never dropped by class or id.
KEPT = frozenset("html body main".split())
LISTS, BOXES, HEADINGS = frozenset("ul ol dl".split()), frozenset("div section table tr td".split()), frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What holds running text of its own.
PROSE = HEADINGS | frozenset("p blockquote pre ul ol dl figure".split())
COMMENT_NAME = re.compile(r"(?:^|[^a-z])(?:comments?|reply|replies)(?:$|[^a-z])")
MARKUP = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?P<shut>>)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Share of the page's text above which a class or id word doesn't condemn an element (a wrapper named for its sidebar).
MOST = 0.5


def _unwanted(tag: str, rest: str) -> str:
    """Why an element is left out: ``always``, ``comments`` or ``name`` (unless it is a wrapper of the article), or empty."""
    if tag in DROPPED:
        return "always"
    if tag in KEPT or not rest or rest == "/":
        return ""
    found = ""
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = (a or b or c).lower().replace("_", "-")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return "always"
        if name in ("class", "id"):
            if COMMENT_NAME.search(COMMENT_STATE.sub("", value)):
                found = "comments"
            elif tag != "article" and not found and NAMES.search(value):
                found = "name"
    return found


class Page:
    """Elements of a page in order of their start, and its texts with the element they stand in."""

    def __init__(self, html: str):
        self.tag, self.parent, self.tags, self.chars, self.link_tags, self.link_chars = ["html"], [-1], [0], [0], [0], [0]
        #: (element, text) in page order; a null text is a block border.
        self.texts: list[tuple[int, str | None]] = []
        #: Elements that their names speak against.
        self.named: list[int] = []
        #: Those among them that are named for comments.
        self.comments: set[int] = set()
        self._read(html)
        self.left_out = [False] * len(self.tag)
        self._leave_out()
        for k in range(len(self.tag) - 1, 0, -1):
            p = self.parent[k]
            if self.left_out[k]:
                continue
            for sums in (self.chars, self.link_chars, self.link_tags):
                sums[p] += sums[k]
            self.tags[p] += self.tags[k] + 1
            self.link_tags[p] += self.tag[k] == "a"

    def _leave_out(self) -> None:
        """Mark elements by name, with all below, unless one holds the article or, on a page that marks none, most of the text.

        An article named for comments is one of the page's own if it stands in no other article or comments and is
        the only article or most of the text. Other elements so named must hold an article or, where none is marked, the page's h1 as well.
        """
        if not self.named:
            return
        n = len(self.tag)
        below, title, within = self.chars[:], [t == "h1" for t in self.tag], [False] * n
        for k in range(n - 1, 0, -1):
            below[self.parent[k]] += below[k]
            title[self.parent[k]] = title[self.parent[k]] or title[k]
        for k in range(1, n):
            p = self.parent[k]
            within[k] = within[p] or self.tag[p] == "article" or (p in self.comments and not title[p])
        marked = [t in ("article", "main") and k not in self.comments for k, t in enumerate(self.tag)]
        posts = [k for k in self.named if k in self.comments and self.tag[k] == "article" and not within[k]]
        alone = len(posts) == 1 and not any(marked)
        for k in posts:
            marked[k] = alone or below[k] > MOST * below[0]
        for k in range(n - 1, 0, -1):
            marked[self.parent[k]] = marked[self.parent[k]] or marked[k]
        for k in self.named:
            if marked[0]:
                self.left_out[k] = not marked[k]
            else:
                self.left_out[k] = below[k] <= MOST * below[0] or (k in self.comments and not title[k])
        for k in range(1, n):
            self.left_out[k] = self.left_out[k] or self.left_out[self.parent[k]]

    def _read(self, html: str) -> None:
        stack, dropped_at, linked, at = [0], 0, 0, 0
        tag_of, texts = self.tag, self.texts
        open_names = ["html"]

        def pop_to(depth: int) -> None:
            nonlocal dropped_at, linked
            while len(stack) > depth:
                stack.pop()
                name = open_names.pop()
                linked -= name == "a"
                if name in BLOCK:
                    texts.append((stack[-1] if stack else 0, None))
            if dropped_at >= depth:
                dropped_at = 0

        def close(names: frozenset, fences: frozenset) -> None:
            for depth in range(len(open_names) - 1, 0, -1):
                if open_names[depth] in names:
                    pop_to(depth)
                    return
                if open_names[depth] in fences:
                    return

        def text(piece: str) -> None:
            if dropped_at or not piece:
                return
            if "&" in piece:
                piece = entities.unescape(piece)
            k = stack[-1]
            texts.append((k, piece))
            n = len(" ".join(piece.split()))
            self.chars[k] += n
            if linked:
                self.link_chars[k] += n

        while at < len(html):
            found = MARKUP.search(html, at)
            if not found:
                text(html[at:])
                break
            if found.start() > at:
                text(html[at : found.start()])
            at = found.end()
            tag = found["tag"] or found["tag2"]
            if not tag:
                continue
            tag, rest = tag.lower(), found["rest"] or found["rest2"] or ""
            if found["end"] or found["end2"]:
                if tag == "br":
                    texts.append((stack[-1], None))
                    continue
                inline = tag not in BLOCK
                for depth in range(len(open_names) - 1, 0, -1):
                    if open_names[depth] == tag:
                        pop_to(depth)
                        break
                    if (inline or tag == "p") and open_names[depth] in P_FENCE or inline and open_names[depth] in BLOCK and open_names[depth] != "p":
                        break
                continue
            if tag in ("html", "body") and tag in open_names:
                continue
            if tag in CLOSES_P:
                close(frozenset(["p"]), P_FENCE)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in BLOCK:
                texts.append((stack[-1], None))
            if tag in VOID:
                if not dropped_at:
                    self.tags[stack[-1]] += 1
                continue
            shut = rest.endswith("/") and tag in ("svg", "math", "path")
            why = "" if dropped_at else _unwanted(tag, rest)
            if not dropped_at and why != "always":
                if why:
                    self.named.append(len(tag_of))
                if why == "comments":
                    self.comments.add(len(tag_of))
                tag_of.append(tag)
                self.parent.append(stack[-1])
                for sums in (self.tags, self.chars, self.link_tags, self.link_chars):
                    sums.append(0)
                stack.append(len(tag_of) - 1)
            else:
                # A part that is left out is followed only as far as its end.
                stack.append(stack[-1])
                dropped_at = dropped_at or len(open_names)
            open_names.append(tag)
            linked += tag == "a"
            if shut:
                pop_to(len(open_names) - 1)
            elif tag in RAW:
                ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                inner, at = (html[at : ended.start()], ended.start()) if ended else (html[at:], len(html))
                if tag in ("title", "textarea"):
                    text(inner)

    def densities(self) -> list[float]:
        """Composite text density of every element."""
        body = next((k for k, t in enumerate(self.tag) if t == "body"), 0)
        of_body = self.link_chars[body] / max(self.chars[body], 1)
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            if not c:
                out.append(0.0)
                continue
            t, plain = max(t, 1), max(c - lc, 1)
            base = math.log(c / plain * lc + of_body * c + math.e)
            ratio = c / max(lc, 1) * t / max(lt, 1)
            out.append(c / t * max(math.log(max(ratio, 1.0)) / base, 0.0))
        return out

    def own_chars(self) -> list[int]:
        """Characters that stand in an element itself, in none below it."""
        own = self.chars[:]
        for k in range(len(own) - 1, 0, -1):
            if not self.left_out[k]:
                own[self.parent[k]] -= self.chars[k]
        return [max(x, 0) for x in own]

    def chosen(self) -> list[bool]:
        """Whether an element's text belongs to the main text."""
        n, density = len(self.tag), self.densities()
        sums = [0.0] * n
        own = self.own_chars()
        for k in range(n - 1, 0, -1):
            if not self.left_out[k]:
                sums[self.parent[k]] += density[k]
        for k in range(n):
            sums[k] += own[k]
        body = next((k for k, t in enumerate(self.tag) if t == "body"), 0)
        best = max((k for k in range(body, n) if not self.left_out[k]), key=lambda k: (sums[k], -k))
        threshold, k, article, main = density[best], best, None, None
        while k > 0:
            threshold = min(threshold, density[k])
            if self.tag[k] == "article":
                article = k
            elif self.tag[k] == "main":
                main = k
            k = self.parent[k] if k != body else 0
        if body == 0:
            threshold = min(threshold, density[0])
        inside, dense, whole = [False] * n, [False] * n, [False] * n
        children: list[list[int]] = [[] for _ in range(n)]
        loose_links = [0] * n
        # An article with the largest sum is text as a whole; in a main element around it the rest is tested.
        top = main if main is not None and (article is None or main < article) else article if article is not None else body
        for k in range(n):
            p = self.parent[k]
            inside[k] = not self.left_out[k] and (k == top or (p >= 0 and inside[p]))
            if inside[k] and k != top:
                if self.tag[k] in BLOCK:
                    children[p].append(k)
                elif self.tag[k] == "a":
                    loose_links[p] += self.chars[k]
        if top != body and (article is None or top == article):
            return inside
        part = article is None and best != body and self.chars[best] < self.chars[body]
        # Where the largest sum is that of all text left, its headings and paragraphs stay; boxes among them are tested.
        all_left = article is None and not part
        for k in range(n):
            p = self.parent[k]
            if not inside[k]:
                continue
            if k == top or dense[p] and whole[p] or k == article or part and k == best:
                dense[k], whole[k] = True, k != top
            elif self.tag[k] in ("article", "main"):
                dense[k] = whole[k] = density[k] >= threshold
            elif whole[k] or all_left and p == best and self.tag[k] in PROSE and not self._links(k):
                dense[k] = whole[k] = True
            elif self.tag[k] not in BLOCK:
                # Text in a line goes with its block, but for links that stand loose among blocks.
                dense[k] = dense[p] and not (self.tag[k] == "a" and children[p] and loose_links[p] > own[p])
            elif self.tag[k] in ("li", "dt", "dd") and self.tag[p] in LISTS:
                dense[k] = dense[p]
            else:
                dense[k] = density[k] >= threshold and not self._links(k)
            if part and k == best:
                # Menus before the first dense block of the chosen part are none of its text.
                for c in children[k]:
                    if density[c] >= threshold and not self._links(c):
                        break
                    inside[c] = not self._links(c)
                for c in range(k + 1, n):
                    inside[c] = inside[c] and inside[self.parent[c]]
            elif dense[k] and not whole[k]:
                for c in self._short(children[k], [density[c] >= threshold and not self._links(c) for c in children[k]]):
                    whole[c] = True
        return dense

    def _links(self, k: int) -> bool:
        """Whether an element is a box of links."""
        return self.tag[k] in ("ul", "ol", "div", "section", "table", "tr", "td", "p") and self.link_tags[k] >= 3 and self.link_chars[k] > 0.8 * self.chars[k]

    def _short(self, blocks: list[int], dense: list[bool]) -> list[int]:
        """Short blocks that belong to the dense ones beside them: those between two, headings before one, a paragraph after one."""
        first = next((i for i, x in enumerate(dense) if x), len(dense))
        last = next((i for i in range(len(dense) - 1, -1, -1) if dense[i]), -1)
        if last < 0:
            return []
        out = [k for i, k in enumerate(blocks) if first < i < last and not dense[i] and not self._links(k) and (self.tag[k] not in BOXES or 2 * self.link_chars[k] <= self.chars[k])]
        for i in range(first - 1, -1, -1):
            if self.tag[blocks[i]] not in HEADINGS:
                break
            out.append(blocks[i])
        for k in blocks[last + 1 :]:
            if self.tag[k] != "p" or self.link_tags[k]:
                break
            out.append(k)
        return out


def main_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    page = Page(html)
    use = page.chosen()
    blocks, block = [], []
    for k, piece in page.texts:
        if piece is None:
            if block:
                blocks.append("".join(block))
                block = []
        elif use[k]:
            block.append(piece)
    blocks.append("".join(block))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` for every page."""
    own = pick(pages, _id=id_col, _url=url_col, _html=html_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(lean(run), f"_id {kind}, _url string, text string, n_chars bigint").withColumnsRenamed({"_id": id_col, "_url": url_col})
