"""Main text of web pages by consensus host paths.

Each page is read into its containers and blocks. Containers are scored by the text of their blocks, less that of
links, and the best one grows to the wrappers that hold more such text, up to an article, and to the body only where
that holds a block of PROSE characters itself. Its generalised path (tags and classes, digits as #) is the page's vote.
Votes are added up by host in Spark, with map-side partials, and each page is read again along its host's winning path.
A page without that path uses its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out by tag, role, class and id,
of containers, blocks and inline elements. A header inside an article belongs to the article. No class word decides
alone: each page votes about what bears it, the votes are added up by host beside those for paths, and text is left out
only on hosts where most votes say so. There are three kinds of votes. A class of WORDS and plain additions (NEUTRAL)
stays if it holds most of the prose of the page, as the wrapper of all text does. A class with other words beside them
(`social-sciences`) votes as a whole, and stays if it holds prose. So do the words that articles use too (MAYBE). Classes
like `with-sidebar` (MODIFIERS) name what is elsewhere and count for nothing. Ids of headings, of sections that have a
heading, and of sections in articles are names of the text itself; other ids in articles count for adverts and reader
comments alone. A page that would be empty keeps what only class words leave out, if that is prose.
White space and <br> inside a block become one space; blocks stand in page order, joined by one line feed.

Reading takes time linear in the page: markup is scanned without going back, the path of a container is kept as its last
step, and paths are compared on the way down.

The winning paths are broadcast while they stay under BROADCAST_BYTES, which is checked; beyond that, pages are joined
to them by host, salted, so a host that holds a third of the pages is spread over tasks.

Defined results: null or empty html gives an empty text. A null url is a host of its own. Repeated rows vote and are
read like others; an empty table gives an empty result. Broken markup is read as far as it goes: unclosed elements end
with their parents, an unclosed comment or script ends with the page, an unclosed quote ends with its tag, and a tag
that is cut off is dropped. Other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, small_batches

BROADCAST_BYTES = 16 << 20
SALTS = 16
#: A block of so many characters right in the body is no stray line of the site.
PROSE = 70
#: What only class words leave out must hold so many characters of prose to be the text of a page.
TEXT = 3 * PROSE

CONTAINERS = frozenset("html body main article section div table tbody td ul ol dl header footer nav aside form fieldset center details dialog menu search".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th pre blockquote figure figcaption caption address hr summary thead tfoot title legend optgroup option hgroup".split())
#: Blocks that end where the next of these, or their list or table, begins or ends; the others end at any block.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "th": ("th", "td", "tr")}
WRAPPERS = frozenset("blockquote figure address thead tfoot hgroup".split())
LISTS = frozenset("ul ol dl table".split())
LEFT_OUT = frozenset("nav header footer aside form menu search dialog fieldset".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template iframe svg object head button select textarea canvas audio video map datalist noembed noframes title".split())
#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense banner banners sponsor sponsored sponsors promo promos outbrain taboola "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot copyright "
    "sidebar sidebars aside cookie cookies consent gdpr notice notices notification notifications popup modal overlay paywall "
    "newsletter subscribe subscription signup login signin searchbox share sharing social".split()
)
#: Parts of a class that say nothing about what it holds.
NEUTRAL = frozenset(
    "site page main top bottom left right upper lower box list bar container wrapper wrap inner outer block area item items slot slots unit units button buttons btn link links icon icons "
    "primary secondary global mobile desktop sticky fixed floating inline strip panel row col column group label text title heading body image img frame embed placeholder js module component "
    "message small large wide full default first last new my post entry article blog web widget section holder count thread user reader author meta".split()
)
#: A class that begins with one of these says what stands beside its element, or does not.
MODIFIERS = frozenset("with without has have no show hide".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adslot adsense outbrain taboola".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words that stand for things beside the text on some hosts and for parts of it on others.
MAYBE = frozenset("alert disclaimer discussion follow form popular promoted promotion rail recommended recommendations related search trending widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset("article post entry story".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag; possessive, so that nothing is scanned twice. Quotes count after = alone, where they close, and
#: where what they hold is no text between tags (`>` before `<`).
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"<>]*+(?:<[^"]*+|>[^"<]*+)?+"|'[^'<>]*+(?:<[^']*+|>[^'<]*+)?+'|))*+)>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def markup(source: str):
    """(text, closes, tag, attributes) of each tag and the text before it, in order; the last one has no tag."""
    at = begin = 0
    parts: list[str] = []
    quotes = True
    while (lt := source.find("<", at)) >= 0:
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            parts.append(source[begin:lt])
            begin = at = len(source) if end < 0 else end + 3
            continue
        if source.startswith("<![CDATA[", lt):
            end = source.find("]]>", lt)
            end = len(source) if end < 0 else end
            parts += [source[begin:lt], html_lib.escape(source[lt + 9 : end], False)]
            begin = at = min(len(source), end + 3)
            continue
        if source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            parts.append(source[begin:lt])
            begin = at = len(source) if end < 0 else end + 1
            continue
        m = _NAME.match(source, lt + 1)
        if m is None:
            at = lt + 1
            continue
        rest = _REST.match(source, m.end()) if quotes else None
        if rest is None:  # from here on, a tag ends at the first >
            quotes, end = False, source.find(">", m.end())
            if end < 0:
                parts.append(source[begin:lt])
                begin = len(source)
                break
            attrs = source[m.end() : end]
        else:
            attrs, end = rest[1], rest.end() - 1
        parts.append(source[begin:lt])
        begin = at = end + 1
        tag = m[2].lower()
        yield "".join(parts), bool(m[1]), tag, attrs
        parts = []
        if tag in RAW and not m[1]:
            close = _END[tag].search(source, at)
            begin = at = close.start() if close else len(source)
    parts.append(source[begin:])
    yield "".join(parts), False, "", ""


class Page:
    """Containers, in page order, and the blocks of text in them. Blocks that are left out count as containers."""

    def __init__(self, source: str | None):
        self.tags, self.steps, self.parents, self.marks, self.inside = ["#"], [""], [0], [0], [False]
        self.keys: list[tuple[str, ...]] = [()]  # what the host votes about, of each container
        self.sections: set[int] = set()  # open to lose the keys of their ids to a heading
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self._read(source or "")
        self._keep_whole_articles()
        self.out = self._left_out(self.words())

    def _read(self, source: str) -> None:
        stack, parts, linked, in_link = [0], [], 0, False
        opened: Counter = Counter()  # of each tag, how many are on the stack
        silent: list[str] = []  # open elements without text
        muted, mute_depth, mute_at = "", 0, 0  # an inline element that is left out

        def flush() -> None:
            nonlocal linked
            if parts:
                if line := " ".join(html_lib.unescape("".join(parts)).split()):
                    self.blocks.append((stack[-1], line, min(linked, len(line))))
                parts.clear()
            linked = 0

        def push(node: int) -> None:
            stack.append(node)
            opened[self.tags[node]] += 1

        def pop_to(k: int) -> None:
            nonlocal muted
            for node in stack[k:]:
                opened[self.tags[node]] -= 1
            del stack[k:]
            if len(stack) < mute_at:
                muted = ""

        def close(tag: str, until: frozenset = frozenset()) -> None:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        pop_to(k)
                        break
                    if self.tags[stack[k]] in until:
                        break

        for text, closes, tag, attrs in markup(source):
            if text and not silent and not muted:
                parts.append(text)
                if in_link:
                    linked += len(text)
            if tag in SILENT:
                if not closes and not attrs.endswith("/"):
                    silent.append(tag)
                elif closes and tag in silent[-8:]:  # elements without text are not nested deeper
                    while silent.pop() != tag:
                        pass
                continue
            if silent:
                if tag != "body":
                    continue
                silent.clear()  # a head that was not closed
            if tag in CONTAINERS or tag in BLOCKS:
                if tag in BLOCKS or closes:
                    muted = ""
                flush()
                in_link &= tag in BLOCKS
                if closes:
                    close(tag)
                    continue
                if stack[-1] and self.tags[stack[-1]] in BLOCKS and self.tags[stack[-1]] not in ITEMS and self.tags[stack[-1]] not in WRAPPERS:
                    pop_to(len(stack) - 1)
                for other in ITEMS.get(tag, ()):
                    if other in BLOCKS:
                        close(other, LISTS)
                node = self._open(tag, attrs, stack[-1], bool(muted))
                if node and tag not in VOID:
                    push(node)
            elif tag == "br":
                parts.append(" ")
            elif tag == "a" and not muted:
                in_link = not closes
            if tag and tag not in CONTAINERS and tag not in BLOCKS and tag not in VOID:
                if muted:
                    mute_depth += (tag == muted) * (-1 if closes else 1)
                    if not mute_depth:
                        muted, in_link = "", in_link and tag != "a"
                elif not closes and attrs and not attrs.endswith("/") and not opened["pre"]:
                    _, out, keys, _ = self._read_marks(tag, attrs, stack[-1])
                    if out == 1 or any(k[0] == "!" for k in keys):
                        muted, mute_depth, mute_at = tag, 1, len(stack)
        flush()

    def _read_marks(self, tag: str, attrs: str, parent: int) -> tuple[str, int, tuple[str, ...], bool]:
        """The generalised classes; 1 if the attributes leave the element out, 2 if as comments, else 0; what the host votes about; whether that is of the id alone."""
        classes, ident, out = "", "", 0
        for name, a, b, c in _ATTR.findall(attrs) if attrs.strip() else ():
            name, value = name.lower(), a or b or c
            if name == "class":
                classes = value
            elif name == "id":
                ident = value
            elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                out = 1
        keys: set[str] = set()
        by_id = False
        tokens = classes.split()
        if tag not in ("html", "body", "main"):
            for token in tokens:
                out = self._read_token(token, parent, keys) or out
            if ident and tag not in HEADINGS:
                inside, section = self.inside[parent], tag == "section" or "section" in tokens
                words = {x.lower() for x in _PARTS.findall(ident)}
                if not (inside and (section or not words & (ADVERTS | COMMENTS))):
                    of_id: set[str] = set()
                    mark = self._read_token(ident, parent, of_id)
                    by_id = section and not keys and not out and (bool(of_id) or mark == 2)
                    out = mark or out
                    keys |= {k for k in of_id if k[0] == "!" or k in MAYBE}  # ids with other words are names
        return ".".join(sorted({_DIGITS.sub("#", x) for x in tokens})), out, tuple(sorted(keys)), by_id

    def _read_token(self, token: str, parent: int, keys: set[str]) -> int:
        """2 if the token stands for comments, else 0; adds to the keys: `!` and its words if it is plain, a word of MAYBE, or else the token."""
        words = [x.lower() for x in _PARTS.findall(token)]
        if not words or words[0] in MODIFIERS:
            return 0
        known = set(words)
        if known & COMMENTS:
            return 2
        keys |= known & MAYBE
        hit = known & WORDS
        if hit and not (hit == {"header"} and (self.inside[parent] or known & _ARTICLE)):
            plain = known <= WORDS | NEUTRAL | MAYBE
            keys.add("!" + "-".join(words) if plain else _DIGITS.sub("#", token.lower()))
        return 0

    def _open(self, tag: str, attrs: str, parent: int, muted: bool) -> int:
        """A new container; 0 for a block that needs none."""
        if tag in HEADINGS and parent in self.sections:
            self.sections.discard(parent)
            self.keys[parent], self.marks[parent] = (), 0
        classes, out, keys, by_id = self._read_marks(tag, attrs, parent)
        if tag in LEFT_OUT and not (tag == "header" and self.inside[parent]) or muted:
            out = out or 1
        if tag in BLOCKS and not out and not keys:
            return 0
        self.tags.append(tag)
        self.steps.append(f"{tag}.{classes}" if classes else tag)
        self.parents.append(parent)
        self.marks.append(out)
        self.keys.append(keys)
        if by_id:
            self.sections.add(len(self.tags) - 1)
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        return len(self.tags) - 1

    def _keep_whole_articles(self) -> None:
        """A class like `with-sidebar` around the article says nothing about the article, one like `comments` does."""
        known = [1] + [0] * (len(self.tags) - 1)  # 1: holds an article and is not inside comments, 2: inside comments
        for i in range(1, len(self.tags)):
            if self.tags[i] in ("article", "main") and not self.marks[i]:
                at, around = self.parents[i], []
                while not known[at] and self.marks[at] != 2:
                    around.append(at)
                    at = self.parents[at]
                state = known[at] or 2
                for at in around:
                    known[at] = state
                    if state == 1 and self.tags[at] not in LEFT_OUT:
                        self.marks[at], self.keys[at] = 0, ()

    def _left_out(self, kept: frozenset | None) -> list[bool]:
        """For each container whether its text is left out, where the keys in kept do not leave it out; None keeps all of them."""
        out = [False] * len(self.tags)
        for i in range(1, len(self.tags)):  # parents come first
            out[i] = bool(self.marks[i]) or kept is not None and any(k not in kept for k in self.keys[i]) or out[self.parents[i]]
        return out

    def words(self) -> frozenset:
        """The keys that stand for parts of the text on this page: what bears them holds more prose than other text, or, for plain classes, most of the prose."""
        if not any(self.keys):
            return frozenset()
        gone = self._left_out(None)
        own, solid = Counter(), Counter()
        for node, line, linked in self.blocks:
            value = len(line) - 2 * linked
            own[node] += value if value >= PROSE else -len(line)
            if value >= PROSE and not gone[node]:
                solid[node] += value
        votes: Counter = Counter()
        for i in range(len(self.tags) - 1, 0, -1):
            own[self.parents[i]] += own[i]
            solid[self.parents[i]] += solid[i]
        for i, keys in enumerate(self.keys):
            for key in keys:
                if key[0] == "!":
                    votes[key] += 2 * solid[i] > solid[0] and solid[i] >= TEXT
                else:
                    votes[key] += own[i]
        return frozenset(k for k, value in votes.items() if value > 0)

    def word_votes(self) -> list[tuple[str, int]]:
        """For each key that the page has, 1 if it stands for text and else -1."""
        kept = self.words()
        return [(k, 1 if k in kept else -1) for k in sorted({k for keys in self.keys for k in keys})]

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.steps[node])
            node = self.parents[node]
        return ">".join(steps[::-1])

    def on_path(self, path: str) -> set[int]:
        """The containers with this path that are not left out; compared on the way down."""
        done = [0] + [-1] * (len(self.tags) - 1)  # characters of the path that end with this container's step
        found = set()
        for i in range(1, len(self.tags)):
            at, step = done[self.parents[i]], self.steps[i]
            if at >= 0 and path.startswith(step, at):
                end = at + len(step)
                if end == len(path):
                    if not self.out[i]:
                        found.add(i)
                elif path[end] == ">":
                    done[i] = end + 1
        return found

    def best(self) -> int:
        """The container with the most text; 0 if there is none."""
        score = Counter()
        for node, line, linked in self.blocks:
            if not self.out[node]:
                value = len(line) - 2 * linked
                score[node] += value
                if node:
                    score[self.parents[node]] += value / 2
        for node in score:
            score[node] *= 1.5 if self.tags[node] in ("article", "main") else 1
        if not score:
            return 0
        node = max(score, key=lambda n: (score[n], -n))
        return self._whole(node)

    def _whole(self, node: int) -> int:
        """The wrapper of what belongs to one text with this container: sections, lists and tables beside it."""
        total, prose = Counter(), set()
        for at, line, linked in self.blocks:
            if not self.out[at]:
                total[at] += len(line) - 2 * linked
                if len(line) - 2 * linked >= PROSE:
                    prose.add(at)
        for i in range(len(self.tags) - 1, 0, -1):  # parents come first
            total[self.parents[i]] += total[i]
        alike = Counter((self.parents[i], self.steps[i]) for i in range(1, len(self.tags)))
        kept = node
        while node:
            parent = self.parents[node]
            if self.tags[parent] in ("#", "html", "body"):
                if self.tags[node] not in ("article", "main", "body") and parent in prose:
                    kept = parent
                break
            whole = self.tags[parent] in ("article", "main")
            if self.tags[node] == "article" and not whole:
                break
            several = alike[parent, self.steps[node]] > 1
            if self.tags[node] == "main" and not (whole or several):
                break
            if whole or several or total[parent] > total[node]:
                kept = parent
            node = parent
        return kept

    def text(self, path: str | None = None, kept: frozenset | None = None) -> str:
        """The blocks in all containers on this path, or else in the best one; kept: the keys that stand for text on the host."""
        if kept is not None:
            self.out = self._left_out(kept)
        roots = self.on_path(path) if path else set()
        lines = (self._lines(roots) if roots else []) or self._lines({self.best()})
        if not lines and any(self.keys):
            self.out = self._left_out(None)
            lines = self._lines({self.best()})
            if sum(len(x) for x in lines if len(x) >= PROSE) < TEXT:
                lines = []
        return "\n".join(lines)

    def _lines(self, roots: set[int]) -> list[str]:
        inside = [0 in roots]
        for i in range(1, len(self.tags)):
            inside.append(i in roots or bool(self.parents[i]) and inside[self.parents[i]])
        return [line for node, line, _ in self.blocks if not self.out[node] and inside[node]]


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, kind, path, n: how many pages of a host have their main text there; of kind `word`, the votes for a key less those against."""

    def vote(batches):
        for batch in batches:
            found: Counter = Counter()
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page, host = Page(source), host_of(url)
                if best := page.best():
                    found[host, "path", page.path(best)] += 1
                for word, n in page.word_votes():
                    found[host, "word", word] += n
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(found.values()), pa.int64())], ["host", "kind", "path", "n"])

    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(vote, "host string, kind string, path string, n long")
    return rows.groupBy("host", "kind", "path").agg(F.sum("n").alias("n"))


def winners(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, kept: one row per host; the first path in order among those with most votes, and the keys that stand for text."""
    found = votes(pages, url_col, html_col)
    path = F.min(F.when(F.col("kind") == "path", F.struct((-F.col("n")).alias("n"), "path")))["path"]
    kept = F.collect_set(F.when((F.col("kind") == "word") & (F.col("n") > 0), F.col("path")))
    return found.groupBy("host").agg(path.alias("path"), kept.alias("kept"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    won = checkpointed(winners(pages, url_col, html_col))
    size = won.agg(F.coalesce(F.sum(F.length("host") + F.coalesce(F.length("path"), F.lit(0)) + F.length(F.array_join("kept", "")) + 200), F.lit(0))).first()[0]
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()

    def reader(path_of):
        def read(batches):
            look = path_of()
            for batch in batches:
                texts = [Page(h).text(path, None if kept is None else frozenset(kept)) for h, (path, kept) in zip(batch.column("html").to_pylist(), look(batch))]
                made = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["page_id", "url", "text", "n_chars"])

        return read

    if size <= broadcast_bytes:
        known = spark.sparkContext.broadcast({r.host: (r.path, r.kept) for r in won.collect()})
        path_of = lambda: lambda batch: [known.value.get(host_of(u), (None, None)) for u in batch.column("url").to_pylist()]
        dealt = source
    else:
        host = F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit(""))
        salted = won.select(F.col("host").alias("__host"), "path", "kept", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"))
        dealt = source.withColumns({"__h": host, "__s": F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")})
        dealt = dealt.join(salted, (F.col("__h") == F.col("__host")) & (F.col("__s") == F.col("__salt")), "left").select("page_id", "url", "html", "path", "kept")
        path_of = lambda: lambda batch: zip(batch.column("path").to_pylist(), batch.column("kept").to_pylist())
    return dealt.mapInArrow(reader(path_of), f"page_id {kind}, url string, text string, n_chars long")
