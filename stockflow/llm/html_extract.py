"""Operator 2, HTML extraction by consensus host paths.

First pass: every page's containers are scored by the text of their blocks,
less the share in links, for the container and half for the one around it; the
best ``BALLOT`` containers vote with their share of the page's score on their
generalised tag-class path (classes in order without digits, or the id); body gets
votes only of pages where it is the best, as half of every template's text is its. Spark
sums the votes of each host; the paths with at least ``HELD`` of a host's votes
win, however many they are. Second pass: each page is extracted again with the first
winning path of its host that gives a fair share (``FAIR``) of the text that its own
best container gives, or, where none does, with its own best container.

The container of a path is widened before: to its nearest article or main (from
an article on to a main around it that holds no other article), or else to all
containers around it below html. The text of a container is that of its blocks in
page order, without menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments:

* Tags, roles, and classes or ids made of nothing but such words are left out. A
  header inside an article that holds its h1 stays.
* A class or id that names more besides (cookie-recipe), or may name a part of an
  article (discussion), is open: left out unless it lies beside prose, is prose
  itself, and the host's pages don't repeat its text.
* Siblings of one path below prose, each with an author, a date or a name in bold and
  without headings, are reader comments where a second sign agrees (a form beside
  them, or words for comments); what holds nothing else goes with them.
* Of the boxes beside the path's container (no article or main around it) those go
  that are links for the greater part, a label (no paragraph, no sentence, fewer than
  ``LABEL`` words), or whose text the host's pages repeat.

A host repeats the text of a path where at least ``REPEATED`` different pages, and
half of those with that path, hold one same text there. Spark counts this in the
first pass, by hashes; copies of one page count once.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by one space. Memory and time grow with the length of a page at
any depth: elements keep their parent and the number of their path, and path
texts are made for votes only.

The winners are stored and joined by host; Spark broadcasts them only below its
size threshold and else splits the join of a host that has many pages.

Defined cases: null or empty html gives the empty text; a null url, or one
without a host, belongs to the host of no name; tags that a page never closes
end with their container; a tag cut off at the end of the page is dropped; rows
that repeat a page_id are extracted each; equal votes go to the path first by
name, equal scores of a page to the path that it opens first; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.llm.common import stored, table

BALLOT = 3
HELD = 0.005
FAIR = 0.5
LABEL = 8
REPEATED = 3
SCALE = 1_000_000  # votes are whole numbers, so their sums don't depend on the order

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in "script style textarea title noscript iframe xmp".split()}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                      "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
           "th": {"tr", "table"}, "option": {"select"}, "p": {"td", "th", "li", "dd", "div", "article", "section", "body"}}
_LEFT_OUT = frozenset("nav footer aside form button select option dialog menu head template svg canvas object".split()) | set(_RAW)
_HEADER = frozenset("header masthead".split())
#: Words of class, id or role that mark what isn't the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets "
    "footer comment comments respond replies disqus discussion reactions responses share sharing social related recommended "
    "newsletter subscribe signup login pagination pager toolbar copyright complementary contentinfo search".split())
#: Marks that hold whatever stands beside them.
_PAID = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
#: Marks that may also name a part of an article.
_PARTS = frozenset("discussion reactions responses".split())
#: Words that add nothing to a mark.
_NOUNS = frozenset("area bar block body bottom box button buttons card container content footer form fixed group header "
                   "holder inner item items left link links list main outer panel post posts primary right row secondary "
                   "section sticky tab text title top unit wrap wrapper zone site page the us".split())
_THREAD = frozenset("comment comments reply replies reaction reactions response responses respond opinions discussion".split())
_AUTHOR = frozenset("author user username byline avatar commenter nickname nick".split())
_DATE = frozenset("date time datetime timestamp posted published ago".split())
_WHEN = re.compile(r"\b\d{1,2}[:.]\d\d\b|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\bago\b"
                   r"|\b\d{1,2}\.? [A-Z][a-z]{2,8}\b|\b[A-Z][a-z]{2,8} \d{1,2}\b")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTROLS = frozenset("form input textarea button select".split())
_PROSE = frozenset("p pre blockquote li dd td".split()) | _HEADINGS
_SENTENCE = re.compile(r"[.!?\u2026\u3002][\"')\]\u201d\u2019\u00bb]*$")
_NEVER = frozenset("html body article main".split())
#: Children of body that are text of the page at any length.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header pre blockquote ul ol dl figure figcaption table".split())
#: Layout classes such as with-sidebar: beside these words the marks of _LAYOUT mean nothing.
_AROUND = frozenset("with has no without content main page layout wrapper container".split())
_LAYOUT = frozenset("ad ads banner menu nav navbar sidebar toolbar header".split())


class Page:
    """Elements (tag, number of path, parent, left out) and blocks (text, element, letters in links) of a page.

    ``repeated``: hashes of the paths whose text the host's pages repeat.
    """

    def __init__(self, source: str, repeated=frozenset()):
        self.tags, self.path_of, self.parents, self.out, self.open = [""], [0], [-1], [False], [False]
        self.steps, self.hashes, self._known = [(-1, "")], [0], {}
        self.words: dict[int, frozenset] = {}
        self.controls: set[int] = set()
        self.blocks: list[tuple[str, int, int]] = []
        self._headers: set[int] = set()
        self._owner = [0]
        stack, held, buffer, links, link_depth, owner = [0], {}, [], 0, 0, 0
        pos, n = 0, len(source)

        def flush():
            nonlocal links
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((text, owner, links))
                buffer.clear()
            links = 0

        def say(chunk):
            nonlocal links
            if chunk:
                chunk = html.unescape(chunk) if "&" in chunk else chunk
                buffer.append(chunk)
                if link_depth:
                    links += len(chunk)

        def leave(depth):
            nonlocal link_depth
            while len(stack) > depth:
                tag = self.tags[stack.pop()]
                held[tag] -= 1
                if tag == "a":
                    link_depth -= 1

        def end(names, bounds):
            if not any(held.get(t) for t in names):
                return
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[depth]]
                if tag in names:
                    leave(depth)
                    return
                if tag in bounds:
                    return

        while pos < n:
            at = source.find("<", pos)
            if at < 0:
                say(source[pos:])
                break
            m = _TAG.match(source, at)
            if m is None:
                say(source[pos:at + 1])
                pos = at + 1
                continue
            say(source[pos:at])
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            cut = not m[0].endswith(">")
            name, closing, attrs = name.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
            if cut:  # the page ends inside this tag
                break
            if name == "br" or name == "hr":
                buffer.append("\n")
                if name == "br":
                    continue
            if name not in _INLINE:
                flush()
            if closing:
                if held.get(name):
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[depth]] == name:
                            leave(depth)
                            break
                        if name in _INLINE and self.tags[stack[depth]] not in _INLINE:
                            break
            else:
                if name in _CLOSES_P:
                    end(("p",), _BOUNDS["p"])
                elif name in _SIBLINGS:
                    end(_SIBLINGS[name], _BOUNDS[name])
                if name in _CONTROLS:
                    self.controls.add(stack[-1])
                if name in _VOID:
                    continue
                stack.append(self._open(name, attrs, stack[-1]))
                held[name] = held.get(name, 0) + 1
                if name == "a":
                    link_depth += 1
                if name in _RAW:
                    found = _RAW[name].search(source, pos)
                    pos = found.start() if found else n
            if name not in _INLINE:
                owner = self._owner[stack[-1]]
        flush()
        self._decide(repeated)

    def _open(self, name: str, attrs: str, parent: int) -> int:
        got = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if attrs else {}
        step = name
        if got.get("class", "").split():
            step += "".join("." + re.sub(r"\d+", "", c) for c in got["class"].split())
        elif got.get("id"):
            step += "#" + re.sub(r"\d+", "", got["id"])
        out, maybe = name in _LEFT_OUT or name in _HEADER, False
        header = name == "header"
        me = len(self.tags)
        if got:
            tokens = [{w.lower() for w in _WORD.findall(t)} for k, v in got.items()
                      for t in (v.split() if k != "id" else [v])]
            words = frozenset().union(*tokens)
            self.words[me] = words
            header = header or "header" in words
            ignored = _LAYOUT if not _AROUND.isdisjoint(words) else frozenset()
            for token in tokens:
                marks = (token & _MARKS) - ignored
                if not (token & _HEADER - ignored or marks):
                    continue
                if token & _HEADER - ignored and not marks or marks & _PAID or "role" in got and got["role"].lower() in token:
                    out = True
                elif token <= _MARKS | _NOUNS | _HEADER and not token <= _PARTS:
                    out = True
                else:
                    maybe = True
        if name in _NEVER:
            out = maybe = False
        path = self._known.get((self.path_of[parent], step))
        if path is None:
            path = self._known[self.path_of[parent], step] = len(self.steps)
            self.steps.append((self.path_of[parent], step))
            self.hashes.append(_hash(f"{self.hashes[self.path_of[parent]]}>{step}"))
        self.tags.append(name)
        self.path_of.append(path)
        self.parents.append(parent)
        self.out.append(out)
        self.open.append(maybe and not out)
        self._owner.append(self._owner[parent] if name in _INLINE else me)
        if header and out:
            self._headers.add(me)
        return me

    def path(self, number: int) -> str:
        steps = []
        while number > 0:
            number, step = self.steps[number]
            steps.append(step.replace(">", ""))
        return ">".join(reversed(steps))

    def find(self, path: str) -> int | None:
        """The number of a path, or None if the page doesn't have it."""
        number = 0
        for step in path.split(">"):
            number = self._known.get((number, step))
            if number is None:
                return None
        return number

    def _decide(self, repeated) -> None:
        """What is left out: titles' headers stay, open marks and comment threads are settled."""
        tags, parents, n = self.tags, self.parents, len(self.tags)
        top = [0] * n  # the nearest article or main, itself included
        for e in range(1, n):
            top[e] = e if tags[e] in ("article", "main") else top[parents[e]]
        seen = set()
        for e in range(1, n):
            if tags[e] == "h1" and top[e]:
                up = parents[e]
                while up > 0 and up != top[e] and up not in seen:  # a header that holds the title of an article is part of it
                    seen.add(up)
                    if up in self._headers:
                        self.out[up] = False
                    up = parents[up]
        self.length, self.linked, prose = [0] * n, [0] * n, [0] * n
        first, heading, control = [-1] * n, [False] * n, [False] * n
        for i, (text, e, links) in enumerate(self.blocks):
            self.length[e] += len(text)
            self.linked[e] += links
            if tags[e] in _PROSE and 2 * links <= len(text):
                prose[e] += len(text)
            if first[e] < 0:
                first[e] = i
        for e in self.controls:
            control[e] = True
        for e in range(n - 1, 0, -1):
            up = parents[e]
            self.length[up] += self.length[e]
            self.linked[up] += self.linked[e]
            prose[up] += prose[e]
            heading[up] = heading[up] or heading[e] or tags[e] in _HEADINGS
            control[up] = control[up] or control[e]
            if first[e] >= 0 and (first[up] < 0 or first[e] < first[up]):
                first[up] = first[e]
        beside = [False] * n  # an element whose parent below body holds prose of its own
        direct = [0] * n
        for e in range(1, n):
            if tags[e] in _PROSE and not self.out[e] and not self.open[e]:
                direct[parents[e]] += prose[e]
        hidden = self._hidden()
        for e in range(1, n):
            if self.open[e] and not hidden[e]:
                up = parents[e]
                beside[e] = bool(top[up]) or tags[up] not in ("", "html", "body") and direct[up] > 0
        whole = sum(len(t) for t, e, _ in self.blocks if not hidden[e])
        for e in range(1, n):
            if self.open[e]:
                most = 2 * prose[e] >= whole and not self.words.get(e, frozenset()) <= _PARTS
                reads = (prose[e] > 0 and 2 * self.linked[e] <= self.length[e] and not control[e]
                         and self.hashes[self.path_of[e]] not in repeated)
                if not (reads and (beside[e] or most)):
                    self.out[e] = True
        self._leave_out_threads(first, heading, control, prose)
        self.repeated = repeated
        self.hidden = self._hidden()
        self._frames(top)

    def _hidden(self) -> list[bool]:
        hidden = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            hidden[e] = self.out[e] or hidden[self.parents[e]]
        return hidden

    def _signs(self) -> list[int]:
        """Bits of each element and all in it: 1 an author, 2 a date; 4 a name in bold leads it."""
        n = len(self.tags)
        signs, lead = [0] * n, [0] * n
        for e, words in self.words.items():
            signs[e] |= (not _AUTHOR.isdisjoint(words)) | 2 * (not _DATE.isdisjoint(words))
        for text, e, _ in self.blocks:
            if len(text) <= 60 and _WHEN.search(text):
                signs[e] |= 2
        for e in range(n - 1, 0, -1):
            signs[e] |= {"cite": 1, "time": 2}.get(self.tags[e], 0)
            signs[self.parents[e]] |= signs[e] & 3
            lead[self.parents[e]] = e  # in the end the first child
        for e in range(n - 1, 0, -1):
            child = lead[e]
            if child and (self.tags[child] in ("b", "strong") or signs[child] & 4):
                signs[e] |= 4
        return signs

    def _leave_out_threads(self, first, heading, control, prose) -> None:
        tags, parents = self.tags, self.parents
        hidden, groups, after = self._hidden(), {}, None
        for i, (text, e, links) in enumerate(self.blocks):
            if not hidden[e] and tags[e] in ("p", "pre", "blockquote") and 2 * links <= len(text):
                after = i
                break
        if after is None:
            return
        signs = self._signs()
        for e in range(1, len(tags)):
            if not hidden[e] and tags[e] not in _INLINE and tags[e] not in _NEVER and signs[e] and not heading[e] and first[e] > after:
                groups.setdefault((parents[e], self.path_of[e]), []).append(e)
        rest: dict[int, int] = {}
        for (up, _), units in sorted(groups.items()):
            if len(units) < 2 or hidden[up]:
                continue
            bits = 0
            for e in units:
                bits |= signs[e]
            named = not _THREAD.isdisjoint(self.words.get(up, frozenset()) | self.words.get(units[0], frozenset()))
            talk = named or tags[up] not in ("body", "article", "main") and control[up]
            if not (talk or bits & 1 and bits & 6):
                continue
            for e in units:
                self.out[e] = True
            gone = sum(prose[e] for e in units)
            while up > 0 and tags[up] not in _NEVER:  # what holds only headings and forms besides goes too
                rest[up] = rest.get(up, prose[up]) - gone
                titles = sum(len(t) for t, e, _ in self.blocks[first[up]:first[units[0]]] if tags[e] in _HEADINGS) if first[up] >= 0 else 0
                if rest[up] > titles or first[up] <= after:
                    break
                self.out[up] = True
                gone, up = prose[up], parents[up]

    def _frames(self, top) -> None:
        """``frame``: the article or main around each element, if no part up to it is left out."""
        n = len(self.tags)
        shown, inside = [0] * n, [0] * n
        for e in range(1, n):
            shown[e] = int(self.tags[e] == "article" and not self.hidden[e])
            inside[e] = inside[self.parents[e]] + shown[e]
        for e in range(n - 1, 0, -1):
            shown[self.parents[e]] += shown[e]
        self.frame: list[int | None] = [None] * n
        main = [0] * n
        for e in range(1, n):
            main[e] = e if self.tags[e] == "main" else main[self.parents[e]]
            found = top[e]
            if not found or self.hidden[e]:
                continue
            around = main[found]
            if self.tags[found] == "article" and around:
                others = shown[around] - shown[found] - (inside[found] - 1 - inside[around])
                found = found if others else around
            self.frame[e] = found

    def scores(self) -> dict[int, float]:
        """Containers that aren't left out, by score."""
        got: dict[int, float] = {}
        for text, element, links in self.blocks:
            if self.hidden[element] or element == 0:
                continue
            worth = max(0, len(text) - 2 * links)
            if self.tags[element] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "td"):
                element = self.parents[element]
            for part in (1.0, 0.5):
                if element > 0:
                    bonus = 1.25 if self.tags[element] in ("article", "main") else 1.0
                    got[element] = got.get(element, 0) + worth * part * bonus
                    element = self.parents[element]
        return got

    def ballot(self) -> list[tuple[str, int]]:
        """The best paths and their whole-number votes."""
        by: dict[int, float] = {}
        for e, s in self.scores().items():
            by[self.path_of[e]] = by.get(self.path_of[e], 0) + s
        total = sum(by.values())
        best = sorted((x for x in by.items() if x[1] > 0), key=lambda x: (-x[1], x[0]))[:BALLOT]
        whole = {self.path_of[e] for e in range(1, len(self.tags)) if self.tags[e] in ("html", "body")}
        return [(self.path(p), int(SCALE * s / total)) for i, (p, s) in enumerate(best) if i == 0 or p not in whole]

    def _spans(self, path: str):
        """Containers of a path, widened; those around them; and the boxes beside with their text."""
        number, core, around = self.find(path), set(), set()
        if number is None:
            return core, around, {}
        for e in range(1, len(self.tags)):
            if self.path_of[e] != number:
                continue
            frame = self.frame[e]
            core.add(e if frame is None else frame)
            if frame is None and not self.hidden[e]:
                up = self.parents[e]
                while up > 0 and up not in around and self.tags[up] != "html":
                    around.add(up)
                    up = self.parents[up]
        around -= core
        boxes: dict[int, list[int]] = {}
        if around:
            child = [0] * len(self.tags)  # the box beside that an element is in
            for e in range(1, len(self.tags)):
                if e not in core and e not in around and not self.hidden[e]:
                    child[e] = child[self.parents[e]] or (e if self.parents[e] in around else 0)
            for i, (_, e, _) in enumerate(self.blocks):
                if child[e]:
                    boxes.setdefault(child[e], []).append(i)
        return core, around, boxes

    def text(self, path: str) -> str:
        """The text in the containers of ``path``, widened."""
        core, around, boxes = self._spans(path)
        if not core:
            return ""
        skipped = {e for e, held in boxes.items() if self._no_text(e, held)}
        inside = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            inside[e] = e in core or e in around or (inside[self.parents[e]] and not self.out[e] and e not in skipped)
        return " ".join(t for t, e, _ in self.blocks if inside[e])

    def _no_text(self, box: int, held: list[int]) -> bool:
        """Whether a box beside the container is links, a label, or repeated by the host."""
        tag, texts = self.tags[box], [self.blocks[i] for i in held]
        if self.hashes[self.path_of[box]] in self.repeated and tag not in _PROSE:
            return True
        if tag in ("p", "blockquote", "pre") or tag in _HEADINGS:
            return False
        if 2 * sum(links for _, _, links in texts) > sum(len(t) for t, _, _ in texts):
            return True
        return tag not in _PLAIN and self.tags[self.parents[box]] == "body" and not any(
            self.tags[e] in _PROSE or _SENTENCE.search(t) or len(t.split()) >= LABEL for t, e, _ in texts)

    def claims(self, path: str) -> list[tuple[int, int]]:
        """Hashes of path and text of what the host's pages may overrule: open marks, and boxes beside ``path``."""
        texts: dict[int, list[int]] = {}
        if any(self.open):
            claim = [0] * len(self.tags)
            for e in range(1, len(self.tags)):
                claim[e] = claim[self.parents[e]] or (e if self.open[e] else 0)
            for i, (_, e, _) in enumerate(self.blocks):
                if claim[e]:
                    texts.setdefault(claim[e], []).append(i)
        texts.update(self._spans(path)[2])
        return [(self.hashes[self.path_of[e]], _hash(" ".join(self.blocks[i][0] for i in held))) for e, held in texts.items()]

    def best(self, paths) -> tuple[str, str | None]:
        """Text and path: of the first of ``paths`` with a fair share of what the page's own best gives, or of that."""
        own = None
        for path in paths:
            if not (text := self.text(path)):
                continue
            if own is None:
                if len(text) >= FAIR * sum(len(t) + 1 for t, e, _ in self.blocks if e and not self.hidden[e]):
                    return text, path  # no container gives more than all
                won = self.ballot()
                own = (self.text(won[0][0]), won[0][0]) if won else ("", None)
            if len(text) >= FAIR * len(own[0]):
                return text, path
        if own is None:
            won = self.ballot()
            own = (self.text(won[0][0]), won[0][0]) if won else ("", None)
        return own


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def host(url):
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths, repeated: each host's winning paths, best first, and the hashes of the
    paths whose text its pages repeat, from rows (url, html)."""
    kinds = "host string, path string, votes long, place long, said long, page long"

    def vote(batches):
        for batch in batches:
            rows = []
            for h, source in zip(batch.column(0), batch.column(1)):
                h, source = h.as_py(), source.as_py() or ""
                page = Page(source)
                won = page.ballot()
                rows += [(h, path, n, None, None, None) for path, n in won]
                claims = set(page.claims(won[0][0])) if won else ()
                copy = _hash(source) if claims else None
                rows += [(h, None, None, place, said, copy) for place, said in claims]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)],
                                             names=["host", "path", "votes", "place", "said", "page"])
    cast = stored(pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(vote, kinds), "votes")
    sums = cast.filter("path IS NOT NULL").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    total = sums.groupBy("host").agg(F.sum("votes").alias("total"))
    won = (sums.join(total, "host").filter(F.col("votes") >= HELD * F.col("total")).groupBy("host")
           .agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path"))).alias("won"))
           .select("host", F.col("won.path").alias("paths")))
    again = (cast.filter("path IS NULL").select("host", "place", "said", "page").distinct()
             .groupBy("host", "place", "said").agg(F.count("*").alias("n"))
             .groupBy("host", "place").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
             .filter(f"most >= {REPEATED} AND 2 * most >= all")
             .groupBy("host").agg(F.collect_list("place").alias("repeated")))
    return won.join(again, "host", "left").select("host", "paths", "repeated")


def extract(pages: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, path for every row of ``pages`` (page_id, url, html)."""
    won = stored(host_paths(pages), "paths") if paths is None else paths
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(won, "host", "left").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), "paths", "repeated")

    def again(batches):
        for batch in batches:
            texts, used = [], []
            for source, paths, repeated in zip(batch.column(2), batch.column(3), batch.column(4)):
                text, path = Page(source.as_py() or "", frozenset(repeated.as_py() or ())).best(paths.as_py() or [])
                texts.append(text)
                used.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array(used, pa.string())], names=["page_id", "url", "text", "path"])
    return rows.mapInArrow(again, "page_id long, url string, text string, path string")


def op2_consensus_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


QUERIES = {"op2_consensus_host_paths": (op2_consensus_host_paths, None)}
