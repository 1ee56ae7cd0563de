"""Main text of web pages by a vote of each host's pages on where the text is.

Each page is cut into blocks, each with the path of elements around it. A path is generalised to tags with their first
class, without positions and ids, and known by a hash. A page scores its containers by the text in them less the text of links, and gives its
best one, and every container near it, a vote. Spark sums the votes by host and path; the winning path of the host then
says, on every page of it, which blocks are the text. A page of which that path holds clearly less
than its own best container uses that one.

Parts that are never text (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles,
comments of readers) are left out by tag, role, class or id, inside the winning container too. Outside the article a class or id counts by its
first or last part ("ad-box", "site-footer", but not "has-sidebar" or "page-header-fixed"); inside it only as a whole, if it is one of a
few ("comments", "ad-box", "cookie-banner"), so a section "related-work" or "share-price" of an article stays. An element that holds the page's article or
main part, or on a page without these most of its text, is never left out by such a name.

A null html counts as empty; a page without text gives an empty string. A null or odd url belongs to the host "". Pages
are never cut or capped, and the time is in proportion to their length. Ties between paths go to the deeper, then the smaller
hash. Repeated rows are handled one by one, further columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlift.llm.common import arrow_map, sized, stage

#: Elements whose inside isn't markup: passed over to their closing tag, or to the end of the page.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript template textarea svg iframe title".split()}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: One attribute's name and the beginning of its value, or the sign that ends the tag.
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*([\"']|[^\s>\"'][^\s>]*)?)?)")
ASKED = frozenset("class id role hidden aria-hidden style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block; all others end the block before them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br ruby rt rp".split())
NEVER = frozenset("nav footer aside button select menu dialog head".split())
#: Left out too, unless they hold the page's article.
UNLESS_TEXT = frozenset("form fieldset header".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
NAME = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|nav|navbar|navigation"
    r"|menu|breadcrumbs?|sidebar|widget|footer|foot|masthead|header|share|sharing|social|related|recommended|login|signup|search|toolbar|pager"
    r"|pagination|skip|(comments?|commentlist|disqus|replies|reply|respond)"
)
#: A class that begins so says something about an element that is around or beside the part.
ABOUT = frozenset("has no with without not is hide show".split())
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Within the article a class or id counts only as a whole, and only if it is one of these.
INSIDE = re.compile(
    r"ads?|advert|advertisement|ad-?(?:box|slot|banner|container|wrapper|unit)|sponsored|promo|cookie-?(?:banner|notice|bar|consent)|newsletter(?:-signup)?|related(?:-(?:posts|articles|links))?"
    r"|share(?:-buttons|-bar|-links)?|social-share|breadcrumbs?|pagination|pager|sidebar|navbar|nav|menu|(comments?|comment-?list|comments-area|disqus(?:_thread)?|replies|respond)"
)
PARTS = re.compile(r"[-_]+")
#: Closing one of these in the page closes what is still open inside it.
CLOSES_SELF = frozenset("p li dt dd tr td th option".split())
#: Containers are above these.
TEXT_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr blockquote pre dd dt".split())


def named(names: list[str], inside: bool) -> str:
    """"comment", "other" or "" for an element with these classes and ids; inside: within the article."""
    for token in names:
        if inside:
            m = INSIDE.fullmatch(token.lower())
            if m:
                return "comment" if m[1] else "other"
            continue
        parts = [x for x in PARTS.split(token.lower()) if x]
        if not parts or parts[0] in ABOUT:
            continue
        for x in (parts[0], parts[-1]):
            m = NAME.fullmatch(x)
            if m:
                return "comment" if m[1] else "other"
    return ""


def tags(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str], bool]]:
    """Comments, declarations and tags in order: begin, end, tag ("" if it is none), closing, attributes asked for, closed in itself.

    An attribute's value is in quotes only if a quote follows its equals sign, and a quote that is never closed ends with the
    tag. Each sign is read once, and where something has no end on the page, that is known from its last place, so the
    time is in proportion to the page. A tag without an end is text."""
    last = {c: page.rfind(c) for c in (">", '"', "'")}
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, {}, False
        elif at > last[">"]:
            return
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            yield at, end, "", False, {}, False
        elif m := TAG.match(page, at):
            end, given, own = m.end(), {}, False
            while True:
                x = ATTRIBUTE.match(page, end)
                if not x:  # the page ends inside the tag
                    return
                if x[1]:
                    own = page[x.end() - 2] == "/"
                    end = x.end()
                    break
                name, value, end = x[2].lower(), x[3] or "", x.end()
                if value in ('"', "'"):
                    if last[value] >= end:
                        close = page.find(value, end)
                        value, end = page[end:close], close + 1
                    else:
                        close = page.find(">", end)
                        if close < 0:
                            return
                        value, end = page[end:close], close
                if name in ASKED:
                    given.setdefault(name, value)
            tag = m[2].lower()
            raw = RAW.get(tag) if not m[1] and not (own and tag == "svg") else None
            if raw:
                close = raw.search(page, end)
                end = page.find(">", close.end()) + 1 if close else len(page)
                end = end or len(page)
                tag = ""
            yield at, end, tag, bool(m[1]), given, own
        else:
            end = at + 1
        at = page.find("<", end)


@dataclass
class Page:
    """Blocks as (node, text, characters in links); nodes are generalised paths, a parent before its children."""

    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    hash: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    #: The innermost container around the node, itself included.
    container: list[int] = field(default_factory=lambda: [0])

    def scores(self) -> dict[int, float]:
        """Score of each container: its text that is not in links."""
        own: dict[int, float] = defaultdict(float)
        for node, text, link in self.blocks:
            own[self.container[node]] += max(0.0, len(text) - 3.0 * link)
        for node in range(len(self.parent) - 1, 0, -1):
            if node in own and self.parent[node]:
                own[self.parent[node]] += own[node]
        own.pop(0, None)
        return dict(own)

    def best(self, scores: dict[int, float]) -> int:
        """The narrowest of the containers that hold most: one that leaves out scored text never wins. 0: no container."""
        return min(scores, key=lambda n: (-scores[n], -self.depth[n], self.hash[n]), default=0)

    def score_under(self, want: int, scores: dict[int, float]) -> float:
        """The scores of all containers with that path."""
        return sum(s for n, s in scores.items() if self.hash[n] == want)

    def text_under(self, want: int) -> str:
        """The blocks under the path with that hash, 0 for all."""
        under = [want == 0] * len(self.parent)
        for node in range(1, len(self.parent)):
            under[node] = under[self.parent[node]] or self.hash[node] == want
        return "\n\n".join(text for node, text, _ in self.blocks if under[node])

    def path(self, node: int) -> str:
        out = []
        while node:
            out.append(self.name[node])
            node = self.parent[node]
        return "/".join(reversed(out))


def read_page(page: str | None) -> Page:
    """The page's blocks in order, without the parts that are never text."""
    page, out = page or "", Page()
    child: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, bool, int, bool]] = []  # tag, node, left out, element that may be left out, inside the article
    open_: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open
    # elements that are left out unless they hold the article: the one around, comments or not, characters, article inside
    soft: list[list] = [[0, "", 0, False]]
    found: list[tuple[int, int, str, int]] = []
    text: list[str] = []
    state = {"link": 0, "any": False, "where": (0, 0), "links": 0, "main": False, "block": -1}
    at = 0

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split()) if text else ""
        if joined:
            found.append((*state["where"], joined, state["link"]))
            soft[state["where"][1]][2] += len(joined)
        text.clear()
        state["link"], state["any"] = 0, False

    def add(piece: str) -> None:
        if stack and stack[-1][2]:
            return
        if not state["any"]:
            state["where"] = (stack[-1][1], stack[-1][3]) if stack else (0, 0)
            state["any"] = not piece.isspace()
        text.append(piece)
        if state["links"]:
            state["link"] += len(piece.strip())

    def pop() -> None:
        tag = stack.pop()[0]
        if tag:
            open_[tag].pop()
            state["links"] -= tag == "a"

    for begin, end, tag, closing, given, own in tags(page):
        if begin > at:
            add(page[at:begin])
        at = end
        if not tag:
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        elif tag in ("br", "wbr", "img"):
            if tag == "br":
                add(" ")
            continue
        if closing:
            if open_[tag]:
                i = open_[tag][-1]
                if inline and state["block"] > i:  # closed late: no longer a link, say
                    stack[i] = ("", *stack[i][1:])
                    open_[tag].pop()
                    state["links"] -= tag == "a"
                else:
                    while len(stack) > i:
                        pop()
                    state["block"] = _last_block(stack)
            continue
        if tag in VOID:
            continue
        if not inline:
            while stack and (not stack[-1][0] or stack[-1][0] in INLINE):  # inline elements left open end with their block
                pop()
            top = stack[-1][0] if stack else ""
            if tag in CLOSES_SELF or top == "p":
                same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag} if tag in CLOSES_SELF and tag != "p" else {"p"}
                if top in same:
                    pop()
        _, node, gone, around, inside = stack[-1] if stack else ("", 0, False, 0, False)
        classes = given.get("class", "").split()
        if not gone and tag not in ("html", "body", "main", "h1"):
            gone = tag in NEVER or given.get("role", "").lower() in NEVER_ROLES or given.get("aria-hidden", "").lower() == "true" or "hidden" in given or bool(UNSEEN.search(given.get("style", "")))
            names = [*classes, *given.get("id", "").split()]
            kind = named(names, inside) if names and not gone and not (inside and tag == "header") else ""
            if tag in UNLESS_TEXT and not (inside and tag == "header"):
                kind = kind or "other"
            if kind and not gone and not (tag == "article" and kind == "other"):
                soft.append([around, kind, 0, False])
                around = len(soft) - 1
            elif tag == "article" and not gone:
                inside = state["main"] = soft[around][3] = True
        elif tag == "main" and not gone:
            inside = state["main"] = soft[around][3] = True
        if not inline:
            name = tag + ("." + re.sub(r"\d+", "0", classes[0]).lower() if classes else "")
            key, above = (node, name), node
            node = child.get(key, 0)
            if not node:
                node = child[key] = len(out.parent)
                out.parent.append(above)
                out.name.append(name)
                out.hash.append(_hash(out.hash[above], name))
                out.depth.append(out.depth[above] + 1)
                out.container.append(node if out.container[above] == above and tag not in TEXT_TAGS else out.container[above])
        open_[tag].append(len(stack))
        stack.append((tag, node, gone, around, inside))
        state["links"] += tag == "a"
        if not inline:
            state["block"] = len(stack) - 1
        if not inline and own:
            pop()
            state["block"] = _last_block(stack)
    if at < len(page):
        add(page[at:])
    flush()
    total = sum(x[2] for x in soft)
    for x in reversed(soft[1:]):
        soft[x[0]][2] += x[2]
        soft[x[0]][3] |= x[3]
    left_out = [False]
    for around, kind, size, holds in soft[1:]:
        kept = holds or not state["main"] and kind != "comment" and 2 * size > total
        left_out.append(left_out[around] or not kept)
    out.blocks = [(node, said, link) for node, s, said, link in found if not left_out[s]]
    return out


def _last_block(stack: list[tuple]) -> int:
    """Where in the stack the last element stands that isn't inline; -1 without one."""
    i = len(stack) - 1
    while i >= 0 and (not stack[i][0] or stack[i][0] in INLINE):
        i -= 1
    return i


def _hash(above: int, name: str) -> int:
    h = xxhash.xxh3_64_intdigest(name, seed=above & (1 << 64) - 1)
    return (h or 1) - (1 << 64) if h >= 1 << 63 else h or 1


#: A page's full vote; so fine that leaving out one character of a page shows.
VOTE = 10**9
#: A page whose text under its host's path scores less than this share of its best container uses its own.
COVERED = 0.9


def host_key(url: Column) -> Column:
    """A hash of the url's host, in lower case and without a dot at its end; of "" where there is none."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return F.xxhash64(F.regexp_replace(host, r"\.+$", ""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path (both as hashes): the container path with the most votes. Votes are summed before and after the shuffle."""

    def make():
        def step(batch):
            sums: dict[tuple[int, int, int], int] = defaultdict(int)
            for host, html in zip(batch["host"], batch["html"]):
                page = read_page(html)
                scores = page.scores()
                top = max(scores.values(), default=0)
                if top > 0:
                    for n, s in scores.items():
                        if s >= 0.5 * top:
                            sums[host, page.hash[n], page.depth[n]] += int(VOTE * s / top)
            keys = sorted(sums)
            return {"host": [k[0] for k in keys], "path": [k[1] for k in keys], "depth": [k[2] for k in keys], "votes": [sums[k] for k in keys]}

        return step

    votes = arrow_map(pages.select(host_key(pages[url_col]).alias("host"), pages[html_col].alias("html")), make, "host long, path long, depth int, votes long")
    total = votes.groupBy("host", "path", "depth").agg(F.sum("votes").alias("votes"))
    # the largest vote wins; ties go to the deeper path, then to the smaller hash
    return total.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("depth"), F.col("path"))).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: its id, url, text, n_chars, and the path that was used. Pages are read twice; only votes are
    shuffled, unless there are more hosts than a table of hashes may have to be sent to each task."""
    winners = stage(host_paths(pages, url_col, html_col), "host_paths")
    id_kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host_key(pages[url_col]).alias("host"))
    joined = own.join(sized(winners), "host", "left").select("id", "url", "html", "path")

    def make():
        def step(batch):
            texts, used = [], []
            for html, path in zip(batch["html"], batch["path"]):
                page = read_page(html)
                scores = page.scores()
                top = page.best(scores)
                text = page.text_under(path) if path else ""
                if text and page.score_under(path, scores) >= COVERED * scores.get(top, 0.0):
                    top = page.hash.index(path)
                else:
                    text = page.text_under(page.hash[top])
                texts.append(text)
                used.append(page.path(top))
            return {"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "path": used}

        return step

    return arrow_map(joined, make, f"id {id_kind}, url string, text string, n_chars long, path string").withColumnRenamed("id", id_col)
