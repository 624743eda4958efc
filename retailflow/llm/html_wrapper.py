"""HTML main text by wrapper induction over the pages of a host.

Each page becomes a small tree of its block elements. The distinct pages of a host are
aligned with the host's reference page by simple tree matching, equal texts preferred.
Every text-bearing element gets a place: the reference node it matched, or, where the
reference lacks it, where it would be inserted there (matched parent, matched sibling
before it, signature, ordinal), so what only other layouts of the host carry is counted
too. Per place it is counted on how many pages each text stands. A text is frequent if it
stands on ``min_pages`` pages and on a ``1 - share`` part of those that have the place; if
frequent texts make up a ``share`` of the place's pages, it is template and holds one text
per layout, otherwise a varying slot. Template texts go from every page, what fills the
varying slots is content.

Two things are known beforehand, as priors.
* Roles. Texts in elements whose tag or ARIA role says navigation, header, footer and the
  like are never content. A class, id or form says so too, unless its element holds most
  of the page's (or the marked slot's) varying text: over half where the word is part of a
  name or the element is a form, over nine tenths where it is the whole name. Names like
  ``no-sidebar`` and ``post-header`` are no role, nor is a header inside an article.
* The marked slot (``article``, ``main``). Text outside it is no content, unless on a host
  with a wrapper the varying text outside outweighs that inside (teaser cards). Inside it a
  template text goes only if its place is found on half of the host's pages, of which there
  are ``slot_pages``, and only while at most half of the page's slot would go: a paragraph
  that some articles share, and near copies of one article, stay.

Everything but the final alignment is counted with map-side combining: a hot host is
never gathered. A host's wrapper is one small row.

Defined results
* null or empty html: empty text; null url: the host ``''``; repeated rows are answered
  one by one and count once as evidence;
* a host with fewer than ``min_pages`` distinct pages has no template: only the priors
  decide; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import staged

#: Fixed names: HTML elements by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 "
    "h6 hgroup html li main ol p pre section summary table tbody tfoot thead tr ul".split()
)
ROLE_TAGS = frozenset("aside dialog footer form head header menu nav search title".split())
#: Elements that vanish from the line they stand in and end no block.
UNSEEN = frozenset("audio button canvas iframe noscript object script select style svg template textarea video".split())
SPACED = frozenset("br td th hr img wbr".split())
CLOSES_P = BLOCKS | frozenset("aside footer form header hr menu nav".split())
ARIA_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
#: Words in a class or id that name a part other than the article.
ROLE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar "
    "widget".split()
)
#: First parts of a name that tell the state of a page, and words that make a header part of the article.
STATES = frozenset("has have hide hides is no not show shows with without".split())
STORY_WORDS = frozenset("article content entry post story".split())
SLOT_TAGS = ("article", "main")
#: Kinds of role; the first two only hold for elements up to this share of the varying text.
PART, WHOLE, FIXED = 1, 2, 3
SPARED_ABOVE = {PART: 0.5, WHOLE: 0.9}
CELLS = 4_000_000  # of an alignment table that is held whole
DEEPEST = 60  # elements nested deeper are aligned as part of their ancestor


class PageParser(HTMLParser):
    """Block elements in page order and the texts of their blocks, white space folded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.signs, self.roles, self.parents = ["#"], ["#"], [0], [-1]
        self.stack = [0]
        self.texts: list[str] = []
        self.owners: list[int] = []  # element of each text
        self.buffer: list[str] = []
        self.unseen: list[str] = []  # an element that vanishes and what is open inside it

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.texts.append(text)
            self.owners.append(self.stack[-1])

    def _close(self, depth: int) -> None:
        self.flush()
        del self.stack[depth:]

    def _close_implied(self, tag: str) -> None:
        """A new block ends an open paragraph, a new item the item before it."""
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tags[self.stack[depth]]
            if open_tag == "p" or (tag == open_tag == "li") or (tag in ("dt", "dd") and open_tag in ("dt", "dd")):
                self._close(depth)
                return
            if open_tag in BLOCKS or open_tag in ROLE_TAGS:
                return

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN or self.unseen:
            if tag not in VOID:
                self.unseen.append(tag)
            return
        if tag in VOID:
            if tag in SPACED:
                self.buffer.append(" ")
            if tag == "hr":
                self._close_implied(tag)
                self.flush()
            return
        if tag in CLOSES_P:
            self._close_implied(tag)
        sign, role = tag, (PART if tag == "form" else FIXED) if tag in ROLE_TAGS else 0
        if attrs:
            sign, role = _described(tag, attrs, role)
        if role or tag in BLOCKS:
            self.flush()
            self.stack.append(len(self.tags))
            self.parents.append(self.stack[-2])
            self.tags.append(tag)
            self.signs.append(sign)
            self.roles.append(role)
        elif tag in SPACED:
            self.buffer.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag in SPACED:
            self.buffer.append(" ")

    def handle_endtag(self, tag):
        if tag in self.unseen:
            while self.unseen.pop() != tag:
                pass
            return
        if tag in UNSEEN:
            return
        if tag in SPACED:
            self.buffer.append(" ")
        inline = tag not in BLOCKS and tag not in ROLE_TAGS
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tags[self.stack[depth]]
            if open_tag == tag:
                self.unseen.clear()  # one that was never closed ends with its block
                self._close(depth)
                return
            if inline and open_tag in BLOCKS:
                return  # the end of an inline element closes no block

    def handle_data(self, data):
        if not self.unseen:
            self.buffer.append(data)


def _described(tag: str, attrs: list, role: int) -> tuple[str, int]:
    """Signature of an element, and the kind of role its tag, ARIA role, class or id give it.

    Negative where header is the only role word: an article's header is none.
    """
    import re

    found = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
    classes = found.get("class", "")
    sign = ".".join([tag, *sorted(classes.lower().split())])
    aria = found.get("role", "").strip().lower()
    if role < FIXED and aria in ARIA_ROLES:
        role = max(role, PART if aria == "form" else FIXED)
    if not role and tag not in ("html", "body", *SLOT_TAGS):
        words = set()
        for name in f"{classes} {found.get('id', '')}".split():
            if name.lower() in ROLE_WORDS:
                role = WHOLE
                words.add(name.lower())
                continue
            parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
            if parts and parts[0] not in STATES:
                own = ROLE_WORDS.intersection(parts)
                words |= own - {"header"} if STORY_WORDS.intersection(parts) else own
        role = role or (PART if words else 0)
        if words == {"header"}:
            role = -role
    return sign, role


def _digest(parts) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) >> 1


def described(html: str) -> tuple[list, list[str], list[list[int]], int]:
    """(tree, texts, about, hash) of a page.

    ``texts`` are the blocks outside parts with a fixed role; ``about`` holds for each of
    them whether it stands in a marked slot, and the elements around it that may have a
    role, as 4 * element + kind. A tree node is [signature, hash of its own text, numbers
    of its texts, kids]; the hash is of all texts of the page.
    """
    page = PageParser()
    page.feed(html)
    page.close()
    page.flush()
    tags, parents, n = page.tags, page.parents, len(page.tags)
    holds = [False] * n  # a slot stands inside
    for k in range(n - 1, 0, -1):
        if holds[k] or (tags[k] in SLOT_TAGS and not page.roles[k]):
            holds[parents[k]] = True
    gone, within, slot, depth, anchor = [False] * n, [False] * n, [False] * n, [0] * n, list(range(n))
    around: list[list[int]] = [[]] * n
    for k in range(1, n):
        up = parents[k]
        within[k] = within[up] or tags[k] == "article"
        role = 0 if holds[k] or (within[up] and (page.roles[k] < 0 or tags[k] == "header")) else abs(page.roles[k])
        gone[k] = gone[up] or role == FIXED
        around[k] = [*around[up], 4 * k + role] if 0 < role < FIXED else around[up]
        slot[k] = (slot[up] or tags[k] in SLOT_TAGS) and not gone[k]
        depth[k] = depth[up] + 1
        if depth[k] > DEEPEST:
            anchor[k] = anchor[up]
    texts: list[str] = []
    about: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(n)]
    own: list[list[str]] = [[] for _ in range(n)]
    for text, k in zip(page.texts, page.owners):
        own[anchor[k]].append(text)
        if not gone[k]:
            free[anchor[k]].append(len(texts))
            texts.append(text)
            about.append([int(slot[k]), *around[k]])
    nodes = [[page.signs[k], _digest(own[k]) if own[k] else 0, free[k], []] for k in range(n)]
    for k in range(1, n):
        if anchor[k] == k:
            nodes[parents[k]][3].append(nodes[k])
    return nodes[0], texts, about, _digest(page.texts)


def is_marked(about: list) -> bool:
    """Some text stands in a marked slot, outside of parts that may have a role."""
    return any(x[0] and len(x) == 1 for x in about)


def chosen(texts: list[str], about: list, template: set, wide: set, known: bool) -> list[int]:
    """Numbers of the texts that are content; ``template`` texts go, in a slot those that are ``wide``.

    ``known``: the host has a wrapper, so that the text outside a slot is known to vary.
    """
    marked = is_marked(about)
    size = [len(t) for t in texts]
    inside = [bool(marked and x[0]) for x in about]
    lost = sum(size[k] for k in wide if inside[k])
    copies = 2 * lost > sum(n for n, x in zip(size, inside) if x)
    left = [k for k in range(len(texts)) if not ((k in wide and not copies) if inside[k] else k in template)]
    # roles: small parts of what varies, on marked pages of what varies in the slot
    counted = [k for k in left if inside[k] or not marked]
    total = sum(size[k] for k in counted)
    held: dict = {}
    for k in counted:
        for element in about[k][1:]:
            held[element] = held.get(element, 0) + size[k]
    spared = {e for e, n in held.items() if n > SPARED_ABOVE[e % 4] * total}
    left = [k for k in left if spared.issuperset(about[k][1:])]
    if not marked:
        return left
    slot = [k for k in left if inside[k]]
    if known and 2 * sum(size[k] for k in slot) < sum(size[k] for k in left):
        return left
    return slot


def outline(html: str) -> tuple[list, list[str], bool, int]:
    """(tree, texts, marked, hash) of a page on its own: the texts the priors leave."""
    tree, texts, about, total = described(html)
    return tree, [texts[k] for k in chosen(texts, about, set(), set(), False)], is_marked(about), total


def matching(a: list, b: list) -> list[tuple[list, list]]:
    """Node pairs of the largest order-preserving match (simple tree matching).

    A pair with the same text counts twice. Tables of more than ``CELLS`` cells are not
    held: the pairs are then found by halves, with the same total.
    """
    import numpy as np

    sizes: dict = {}

    def size(x, y) -> int:
        own = 2 if x[1] and x[1] == y[1] else 1
        if not x[3] or not y[3]:
            return own
        key = id(x), id(y)
        found = sizes.get(key)
        if found is None:
            found = own + int(last_row(x[3], y[3])[-1])
            if len(sizes) < CELLS // 4:
                sizes[key] = found
        return found

    def rows_of(xs, ys):
        """Rows of the alignment table of two lists, first to last."""
        if len(xs) * len(ys) < 400:
            last = [0] * (len(ys) + 1)
            yield last
            for p in xs:
                row, best, sign, leaf, text = [0], 0, p[0], not p[3], p[1]
                for j, q in enumerate(ys):
                    if last[j + 1] > best:
                        best = last[j + 1]
                    if q[0] == sign:
                        own = (2 if text and text == q[1] else 1) if leaf or not q[3] else size(p, q)
                        if last[j] + own > best:
                            best = last[j] + own
                    row.append(best)
                yield row
                last = row
            return
        code: dict = {}
        signs = np.array([code.setdefault(q[0], len(code)) for q in ys])
        texts = np.array([q[1] for q in ys], np.int64)
        inner = np.array([bool(q[3]) for q in ys])
        last = np.zeros(len(ys) + 1, np.int32)
        yield last
        for p in xs:
            alike = signs == code.get(p[0], -1)
            own = alike.astype(np.int32)
            if p[1]:
                own += alike & (texts == p[1])
            if p[3]:
                for j in np.flatnonzero(alike & inner):
                    own[j] = size(p, ys[j])
            row = np.zeros_like(last)
            np.maximum.accumulate(np.maximum(last[1:], np.where(alike, last[:-1] + own, 0)), out=row[1:])
            yield row
            last = row

    def last_row(xs, ys):
        for row in rows_of(xs, ys):
            pass
        return row

    def align(xs, ys):
        if len(xs) * len(ys) > CELLS and len(xs) > 1:
            half = len(xs) // 2
            ahead = np.asarray(last_row(xs[:half], ys))
            # a subtree counts the same from both ends, so only the lists are turned round
            behind = np.asarray(last_row(xs[half:][::-1], ys[::-1]))[::-1]
            cut = int(np.argmax(ahead + behind))
            return align(xs[:half], ys[:cut]) + align(xs[half:], ys[cut:])
        rows = list(rows_of(xs, ys))
        out = []
        i, j = len(xs), len(ys)
        while i and j:
            p, q = xs[i - 1], ys[j - 1]
            if p[0] == q[0] and rows[i][j] == rows[i - 1][j - 1] + size(p, q):
                out.append((p, q))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    pairs, work = [], [(a, b)]
    if a[0] != b[0]:
        return pairs
    while work:
        x, y = work.pop()
        pairs.append((x, y))
        if x[3] and y[3]:
            work.extend(align(x[3], y[3]))
    return pairs


def _numbered(tree: list) -> dict:
    """id of each node object -> its number in page order."""
    out, stack = {}, [tree]
    while stack:
        node = stack.pop()
        out[id(node)] = len(out)
        stack.extend(reversed(node[3]))
    return out


def places(reference: list, page: list) -> list[tuple[int, list]]:
    """(place, node) for the nodes of a page that hold text.

    The place is that of the matched reference node, or for nodes the reference lacks the
    one between its nodes where they stand.
    """
    number = _numbered(reference)
    matched = {id(y): f"={number[id(x)]}" for x, y in matching(reference, page)}
    out, work = [], [(page, matched.get(id(page), "#"))]
    while work:
        node, place = work.pop()
        if node[1]:
            out.append((_digest([place]), node))
        before, nth = "", {}
        for kid in node[3]:
            own = matched.get(id(kid))
            if own is None:
                nth[kid[0]] = nth.get(kid[0], 0) + 1
                own = f"+{_digest([place, before, kid[0], str(nth[kid[0]])])}"
            else:
                before, nth = own, {}
            work.append((kid, own))
    return out


def content(page: list, texts: list[str], about: list, reference: list | None, template: dict) -> str:
    """Content of a page: ``template`` has the (place, text hash) pairs that go, and whether in a slot too."""
    gone: set = set()
    wide: set = set()
    if reference is not None and template:
        for place, node in places(reference, page):
            found = template.get((place, node[1]))
            if found is not None:
                gone.update(node[2])
                if found:
                    wide.update(node[2])
    return "\n\n".join(texts[k] for k in chosen(texts, about, gone, wide, reference is not None))


def extract(pages: DataFrame, min_pages: int = 3, share: float = 0.8, slot_pages: int = 10) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html"))

    def read(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            found = [described(x.as_py() or "") for x in batch.column("html")]
            columns = [batch.column(c) for c in ("page_id", "url", "host")]
            columns.append(pa.array([json.dumps(f[0], separators=(",", ":")) for f in found], pa.string()))
            columns.append(pa.array([f[1] for f in found], pa.list_(pa.string())))
            columns.append(pa.array([json.dumps(f[2], separators=(",", ":")) for f in found], pa.string()))
            columns.append(pa.array([f[3] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "tree", "texts", "about", "hash"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    known = f"page_id {kinds['page_id']}, url {kinds['url']}"
    schema = f"{known}, host string, tree string, texts array<string>, about string, hash long"
    parsed = staged(spark, rows.mapInArrow(read, schema), "pages-parsed")

    # evidence: places of all distinct pages of a host by the host's reference page
    distinct = staged(spark, parsed.groupBy("host", "hash").agg(F.min("tree").alias("tree")), "pages-distinct")
    references = distinct.groupBy("host").agg(F.min_by("tree", "hash").alias("reference"), F.count(F.lit(1)).alias("n"))
    references = staged(spark, references.where(F.col("n") >= min_pages), "pages-references")

    def align(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            hosts, at, texts = [], [], []
            last, reference = None, None
            for name, ref, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "reference", "tree"))):
                if ref != last:
                    last, reference = ref, json.loads(ref)
                for place, node in places(reference, json.loads(tree)):
                    hosts.append(name)
                    at.append(place)
                    texts.append(node[1])
            columns = [pa.array(hosts, pa.string()), pa.array(at, pa.int64()), pa.array(texts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "place", "own"])

    seen = distinct.join(references, "host").select("host", "reference", "tree")
    seen = seen.mapInArrow(align, "host string, place long, own long")
    counts = seen.groupBy("host", "place", "own").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(spark, counts, "pages-places")
    # at most 1 / (1 - share) texts of a place are frequent
    found = counts.groupBy("host", "place").agg(F.sum("n").alias("found"), F.max("n").alias("most"))
    found = found.where(F.col("most") >= min_pages).drop("most")
    frequent = counts.where(F.col("n") >= min_pages).join(found, ["host", "place"])
    frequent = frequent.where(F.col("n") >= (1 - share - 1e-9) * F.col("found"))
    template = frequent.groupBy("host", "place", "found").agg(F.sum("n").alias("same"), F.collect_list("own").alias("owns"))
    template = template.where(F.col("same") >= share * F.col("found")).select("host", "place", "found", F.explode("owns").alias("own"))
    template = template.join(references.select("host", "n"), "host")
    wide = (2 * F.col("found") >= F.col("n")) & (F.col("n") >= slot_pages)
    entry = F.array("place", "own", wide.cast("long"))
    template = template.groupBy("host").agg(F.to_json(F.collect_list(entry)).alias("template"))
    wrappers = staged(spark, references.drop("n").join(template, "host", "left"), "pages-wrappers")

    def apply(batches):
        import json

        import pyarrow as pa

        last, reference, template = (None, None), None, {}
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("tree", "texts", "about", "reference", "template")]
            for k in range(batch.num_rows):
                tree, texts, about, ref, known = (c[k].as_py() for c in columns)
                if (ref, known) != last:
                    last, reference = (ref, known), json.loads(ref) if ref else None
                    template = {(p, o): bool(w) for p, o, w in json.loads(known)} if known else {}
                out.append(content(json.loads(tree), texts, json.loads(about), reference, template))
            sizes = pa.array([len(x) for x in out], pa.int64())
            columns = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    joined = parsed.drop("hash").join(wrappers, "host", "left")
    return joined.mapInArrow(apply, f"{known}, text string, n_chars long")
