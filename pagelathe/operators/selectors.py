"""Selectors over HTML: a small DOM on the standard parser, run once for each page in Arrow batches.

CSS: tag, #id, .class, attributes with = *= ^= $= ~= |=, :first-, :last-, :only-, :nth- and :nth-last- of children and types,
:not(), :empty, the combinators > + ~ and descendants, commas. XPath: //tag, /tag, .., positions, last(), attribute and text
tests, contains(), text(), @attr, unions. A selector that can't be read matches nothing. Void elements close themselves; p, li, td, tr, option and the like are closed by what can't stand in
them. Unlike libxml2, no html or body is added and misplaced head elements stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.extraction import DATE, RELATIVE_DATE

# Default rules as (field, kind, selector, attribute), site rules stand before the generic ones.
GENERIC = [
    ("title", "css", "h1", None),
    ("title", "xpath", "//h1//text()", None),
    ("title", "css", "meta[property='og:title']", "content"),
    ("description", "css", "meta[name='description']", "content"),
    ("description", "css", "meta[property='og:description']", "content"),
    ("price", "css", "[class*='price']", None),
    ("price", "css", "meta[property='product:price:amount']", "content"),
    ("currency", "css", "meta[property='product:price:currency']", "content"),
    ("image", "css", "meta[property='og:image']", "content"),
    ("sku", "css", "[data-sku], [itemprop='sku']", None),
    ("brand", "css", "[itemprop='brand']", None),
    ("brand", "css", "meta[property='product:brand']", "content"),
    ("availability", "css", "[itemprop='availability']", "content"),
    ("category", "css", "[class*='breadcrumb'] a:last-child", None),
]
SITES = {
    "amazon": [
        ("title", "css", "#productTitle", None),
        ("price", "css", ".a-price .a-offscreen", None),
        ("price", "css", "#priceblock_dealprice, #priceblock_ourprice", None),
        ("rating", "css", "#acrPopover [data-hook='rating-out-of-text']", None),
        ("rating", "css", "span[data-hook='rating-out-of-text']", None),
        ("review_count", "css", "#acrCustomerReviewText", None),
        ("brand", "css", "#bylineInfo", None),
        ("image", "css", "#landingImage, #imgTagWrapperId img", "src"),
    ]
}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SIGNATURE_CHARS, FALLBACK_CHARS = 50_000, 10_000


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "order")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.order = tag, attrs, parent, [], -1

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        todo = [iter(self.children)]
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
            elif isinstance(x, Node):
                yield x
                todo.append(iter(x.children))

    def texts(self) -> Iterator[str]:
        todo = [iter(self.children)]
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
            elif isinstance(x, Node):
                todo.append(iter(x.children))
            else:
                yield x

    def text(self) -> str:
        return "".join(self.texts())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag, attrs) -> None:
        closed = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        if self.at.tag in closed or (tag in CLOSES and self.at.parent is not None and self.at.parent.tag in closed and self.at.tag in ("p", "b", "i", "span")):
            while self.at.tag not in closed:
                self.at = self.at.parent
            self.at = self.at.parent
        elif "p" in closed:
            x = self.at
            while x is not None and x.tag not in BLOCKS:
                x = x.parent
            if x is not None and x.tag == "p":
                self.at = x.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag) -> None:
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Document:
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):  # what has been read so far is the document
        pass
    return Document(builder.root)


class Document:
    """A parsed page with its elements in document order, by tag and by attribute."""

    def __init__(self, root: Node) -> None:
        self.root, self.nodes = root, list(root.walk())
        self.by_tag: dict[str, list[Node]] = {}
        self.by_attr: dict[str, list[Node]] = {}
        for at, n in enumerate(self.nodes):
            n.order = at
            self.by_tag.setdefault(n.tag, []).append(n)
            for a in n.attrs:
                self.by_attr.setdefault(a, []).append(n)


def siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if isinstance(c, Node)]


_PART = re.compile(
    r"""(?P<tag>[\w-]+|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?P<q>['"]?)(?P<val>[^'"\]]*)(?P=q)\s*)?\]|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\))?[^()]*)\))?"""
)
_COMPARE = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith, "~=": lambda have, v: v in have.split(), "|=": lambda have, v: have == v or have.startswith(f"{v}-")}


def _nth(text: str):
    """A test of a position (from 1) for the argument of nth-child: a number, odd, even, or an+b."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip(), text.replace(" ", ""))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not m or not text:
        raise ValueError(f"position not supported: {text}")
    step = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    begin = int(m[2] or 0)
    return lambda i: i == begin if not step else (i - begin) % step == 0 and (i - begin) // step >= 0


def _pseudo(name: str, arg: str | None):
    if name == "not":
        inner = _compound(arg.strip())[0]
        return lambda n: not inner(n)
    if name == "empty":
        return lambda n: not n.children
    of_type = name.endswith("-of-type")
    family = lambda n: [c for c in siblings(n) if c.tag == n.tag] if of_type else siblings(n)
    base = name.removesuffix("-of-type").removesuffix("-child")
    if base == "first":
        return lambda n: family(n)[0] is n
    if base == "last":
        return lambda n: family(n)[-1] is n
    if base == "only":
        return lambda n: len(family(n)) == 1
    if base in ("nth", "nth-last"):
        test, back = _nth(arg or ""), base == "nth-last"
        return lambda n: test(next(i for i, c in enumerate(reversed(family(n)) if back else family(n), 1) if c is n))
    raise ValueError(f"pseudo-class not supported: {name}")


def _compound(text: str):
    """(test of a node, index lookup that yields every node it can hold for, or None) of a selector without combinators."""
    tests, at, tag, attr = [], 0, None, None
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at or (m["tag"] and at):
            raise ValueError(f"selector not supported: {text}")
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                tag = m["tag"].lower()
                tests.append(lambda n, t=tag: n.tag == t)
        elif m["id"]:
            attr = "id"
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            attr = attr or "class"
            tests.append(lambda n, v=m["cls"]: v in n.classes())
        elif m["attr"]:
            attr = attr or m["attr"]
            if not m["op"]:
                tests.append(lambda n, a=m["attr"]: a in n.attrs)
            else:
                tests.append(lambda n, a=m["attr"], v=m["val"], f=_COMPARE[m["op"]]: a in n.attrs and f(n.attrs[a], v))
        else:
            tests.append(_pseudo(m["pseudo"], m["arg"]))
    if not tests and text != "*":
        raise ValueError(f"selector not supported: {text}")
    where = (lambda d: d.by_attr.get(attr, [])) if attr else (lambda d: d.by_tag.get(tag, [])) if tag else None
    return (lambda n: all(t(n) for t in tests)), where


_SPLIT = re.compile(r"""\s*([>+~])\s*|(\s+)|(,)|((?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|[^\s>+~,\[(])+)""")


def _chains(selector: str) -> list[list[tuple]]:
    """Alternatives as lists of (combinator before, test, lookup)."""
    out, chain, joint, at, text = [], [], None, 0, selector.strip()
    while at < len(text):
        m = _SPLIT.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"selector not supported: {selector}")
        at = m.end()
        if m[4]:
            if chain and joint is None:
                raise ValueError(f"selector not supported: {selector}")
            chain.append((joint, *_compound(m[4])))
            joint = None
        elif m[3]:
            if not chain or joint not in (None, " "):
                raise ValueError(f"selector not supported: {selector}")
            out.append(chain)
            chain, joint = [], None
        elif m[1]:
            joint = m[1]
        elif chain and joint is None:
            joint = " "
    if not chain or joint not in (None, " "):
        raise ValueError(f"selector not supported: {selector}")
    return [*out, chain]


def _holds(n: Node, chain: list, at: int) -> bool:
    joint, test, _ = chain[at]
    if not test(n):
        return False
    if at == 0:
        return joint is None
    if joint == " ":
        up = n.parent
        while up is not None and up.parent is not None:
            if _holds(up, chain, at - 1):
                return True
            up = up.parent
        return False
    if joint == ">":
        return n.parent is not None and n.parent.parent is not None and _holds(n.parent, chain, at - 1)
    own = siblings(n)
    before = own[: next(i for i, c in enumerate(own) if c is n)]
    return any(_holds(c, chain, at - 1) for c in (before[-1:] if joint == "+" else before))


def compile_css(selector: str):
    """A function of a document that yields the matching nodes in document order."""
    chains = _chains(selector)

    def run(doc: Document) -> Iterator[Node]:
        if len(chains) == 1:
            where = chains[0][-1][2]
            return (n for n in (where(doc) if where else doc.nodes) if _holds(n, chains[0], len(chains[0]) - 1))
        found = {}
        for chain in chains:
            where = chain[-1][2]
            found |= {n.order: n for n in (where(doc) if where else doc.nodes) if n.order not in found and _holds(n, chain, len(chain) - 1)}
        return (found[k] for k in sorted(found))

    return run


_STEP = re.compile(r"(//|/)(text\(\)|@[\w:-]+|\.\.|\.|[\w*-]+)((?:\[[^\]]*\])*)")
_TEST = re.compile(r"""\[\s*(?:@(?P<has>[\w:-]+)|@(?P<is>[\w:-]+)\s*=\s*(?P<q>['"])(?P<v>[^'"]*)(?P=q)|contains\(\s*(?:@(?P<in>[\w:-]+)|(?P<txt>text\(\)|\.))\s*,\s*(?P<r>['"])(?P<w>[^'"]*)(?P=r)\s*\)|(?P<n>\d+)|(?P<last>last\(\))|text\(\)\s*=\s*(?P<s>['"])(?P<t>[^'"]*)(?P=s))\s*\]""")


def _predicates(text: str) -> list:
    """Filters of a list of siblings, in order."""
    out, at = [], 0
    while at < len(text):
        m = _TEST.match(text, at)
        if not m:
            raise ValueError(f"predicate not supported: {text}")
        at = m.end()
        if m["has"]:
            out.append(lambda found, a=m["has"]: [x for x in found if a in x.attrs])
        elif m["is"]:
            out.append(lambda found, a=m["is"], v=m["v"]: [x for x in found if x.attrs.get(a) == v])
        elif m["in"]:
            out.append(lambda found, a=m["in"], v=m["w"]: [x for x in found if v in x.attrs.get(a, "")])
        elif m["txt"]:
            out.append(lambda found, v=m["w"], own=m["txt"] != ".": [x for x in found if (any(v in c for c in x.children if isinstance(c, str)) if own else v in x.text())])
        elif m["n"]:
            out.append(lambda found, i=int(m["n"]): found[i - 1 : i] if i else [])
        elif m["last"]:
            out.append(lambda found: found[-1:])
        else:
            out.append(lambda found, v=m["t"]: [x for x in found if v in [c for c in x.children if isinstance(c, str)]])
    return out


def _path(path: str):
    steps, at, text = [], 0, path.strip().removeprefix(".")
    for m in _STEP.finditer(text):
        if m.start() != at:
            raise ValueError(f"path not supported: {path}")
        at = m.end()
        steps.append((m[1] == "//", m[2], _predicates(m[3])))
    if at != len(text) or not steps:
        raise ValueError(f"path not supported: {path}")

    def run(doc: Document) -> list:
        now: list = [doc.root]
        for deep, name, tests in steps:
            after: list = []
            for n in now:
                if isinstance(n, str):
                    continue
                if name == "text()":
                    after += n.texts() if deep else [c for c in n.children if isinstance(c, str)]
                elif name[0] == "@":
                    after += [x.attrs[name[1:]] for x in ([n, *n.walk()] if deep else [n]) if name[1:] in x.attrs]
                elif name in (".", ".."):
                    after += [x for x in ([n] if name == "." else [n.parent]) if x is not None]
                else:
                    # a position counts among the children of one parent
                    for parent in [n, *n.walk()] if deep else [n]:
                        found = [c for c in parent.children if isinstance(c, Node) and name in ("*", c.tag)]
                        for t in tests:
                            found = t(found)
                        after += found
            seen: set[int] = set()
            now = [x for x in after if isinstance(x, str) or not (id(x) in seen or seen.add(id(x)))]
            if deep and now and isinstance(now[0], Node):
                now.sort(key=lambda x: x.order)
        return now

    return run


def compile_xpath(path: str):
    """A function of a document that yields nodes or strings; alternatives are separated by |."""
    paths = [_path(p) for p in re.split(r"\|(?=(?:[^'\"]*['\"][^'\"]*['\"])*[^'\"]*$)", path)]
    return lambda doc: (x for p in paths for x in p(doc))


@lru_cache(maxsize=4096)
def compiled(kind: str, selector: str):
    """A rule's function of a document. Other kinds, and selectors that can't be read, match nothing: a rule is data."""
    try:
        return {"css": compile_css, "xpath": compile_xpath}.get(kind, lambda _: lambda doc: ())(selector)
    except (ValueError, AttributeError, TypeError):
        return lambda doc: ()


def _value(found, attribute: str | None) -> str | None:
    if attribute:
        v = found.attrs.get(attribute) if isinstance(found, Node) else None
        return v.strip() if v else None
    return " ".join((found.text() if isinstance(found, Node) else found).split())


def _defaults(doc: Document, host: str, out: dict[str, tuple[str, str, float]]) -> None:
    """Adds to out (field: value, selector, confidence) the first element of each default rule; fields that stand are skipped."""
    site = next((rules for name, rules in SITES.items() if name in host), [])
    for field, kind, selector, attribute in site + GENERIC:
        if field not in out:
            found = next(iter(compiled(kind, selector)(doc)), None)
            value = _value(found, attribute) if found is not None else None
            if value:
                out[field] = (value, selector, 0.7)


def fields_of(html: str | None, host: str | None, rules: list[dict] | None = None) -> list[tuple[str, str, str, float]]:
    """(field, value, selector, confidence): own rules first, at 0.95, then the default ones for fields still lacking."""
    if not html:
        return []
    doc, out = parse(html), {}
    for rule in rules or ():
        field = rule["field"]
        if field not in out:
            value = next((v for x in compiled(rule["kind"], rule["selector"])(doc) if (v := _value(x, rule.get("attribute")))), None)
            if value:
                out[field] = (value, rule["selector"], 0.95)
    _defaults(doc, host or "", out)
    return [(f, *v) for f, v in out.items()]


FIELDS = "array<struct<name:string,value:string,confidence:double,selector:string>>"
RULES = "array<struct<field:string,kind:string,selector:string,attribute:string>>"
_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("confidence", pa.float64()), ("selector", pa.string())]))


def selected(html: Column, host: Column, rules: Column | None = None) -> Column:
    """The fields that rules (of type RULES) and the default selectors find in each page, in one parse: of type FIELDS.

    A null or empty page gives an empty array, so a caller that needs no selectors for a page passes null.
    """

    def run(pages: pa.Array, hosts: pa.Array, own: pa.Array) -> pa.Array:
        rows = zip(pages.to_pylist(), hosts.to_pylist(), own.to_pylist(), strict=True)
        return pa.array([[{"name": f, "value": v, "confidence": c, "selector": s} for f, v, s, c in fields_of(*r)] for r in rows], _FIELDS)

    return F.arrow_udf(run, FIELDS)(html, host, F.lit(None).cast(RULES) if rules is None else rules)


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def default_fields(pages: DataFrame, id_col: str, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Per field found by the default rules: id, pos, name, value, selector, confidence 0.7. Null pages give nothing."""
    found = pages.select(id_col, F.posexplode(selected(F.col(html_col), host_of(F.col(url_col)))).alias("pos", "f"))
    return found.select(id_col, "pos", "f.name", "f.value", "f.selector", "f.confidence")


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str, str | None]], id_col: str, html_col: str = "html") -> DataFrame:
    """Per match of rules (field, kind, selector, attribute): id, pos, name, value, selector, confidence 0.95, first.

    Every match with a value is a row; first marks the first of its field in a page. Kinds other than css and xpath are
    accepted and match nothing, as do selectors that can't be read. All rules are applied in one parse of a page.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, html in enumerate(batch.column(1).to_pylist()):
                doc, seen, pos = parse(html), set(), 0
                for field, how, selector, attribute in rules:
                    for found in compiled(how, selector)(doc):
                        if value := _value(found, attribute):
                            rows.append((i, pos, field, value, selector, field not in seen))
                            seen.add(field)
                            pos += 1
            at, pos, name, value, selector, first = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(name, pa.string()), pa.array(value, pa.string()), pa.array(selector, pa.string()), pa.array([0.95] * len(rows), pa.float64()), pa.array(first, pa.bool_())], [id_col, "pos", "name", "value", "selector", "confidence", "first"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, pos int, name string, value string, selector string, confidence double, first boolean")


def _body(doc: Document) -> Node:
    return next(iter(doc.by_tag.get("body", ())), doc.root)


def _per_page(pages: DataFrame, id_col: str, html_col: str, columns: dict[str, str], make) -> DataFrame:
    """A row for each page of strings made from its document and HTML."""
    kind = pages.schema[id_col].dataType.simpleString()
    types = {"string": pa.string(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(html) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], types[t]) for c, t in columns.items())], [id_col, *columns])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def text_content(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, content, text): all text below the body, scripts and styles included, as it stands and with white space collapsed."""

    def make(html: str | None) -> dict:
        content = _body(parse(html)).text()
        return {"content": content, "text": " ".join(content.split())}

    return _per_page(pages, id_col, html_col, {"content": "string", "text": "string"}, make)


def dom_signatures(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, signature): hash of the sorted distinct tag[classes] of a page's beginning; without tags, of its characters."""

    def tags(html: str | None) -> dict:
        doc = parse((html or "")[:SIGNATURE_CHARS])
        return {"tags": sorted({n.tag + (f"[{'.'.join(sorted(n.classes()))}]" if n.classes() else "") for n in doc.nodes})}

    found = _per_page(pages, id_col, html_col, {"tags": "array<string>"}, tags)
    head = pages.select(F.col(id_col), F.sha2(F.substring(F.coalesce(F.col(html_col), F.lit("")), 1, FALLBACK_CHARS), 256).alias("head"))
    bare = found.where(F.size("tags") == 0).select(id_col).join(head, id_col).select(id_col, F.substring("head", 1, 20).alias("signature"))
    signed = found.where(F.size("tags") > 0).select(id_col, F.substring(F.sha2(F.array_join("tags", "|"), 256), 1, 20).alias("signature"))
    return signed.unionByName(bare)


# Selectors tried in order for an article's parts.
ARTICLE = {
    "title": ["meta[property='og:title']", "h1", "title"],
    "author": ["meta[property='article:author']", "meta[name='author']", "a[class*='author']", "span[class*='author']"],
    "date": ["meta[property='article:published_time']", "time[datetime]", "[class*='publish-time']", "span[class*='date']"],
    "description": ["meta[name='description']", "meta[property='og:description']"],
}
# Patterns of a byline and of a sentence that can stand as description.
_BYLINE = re.compile(r"(?:作者|文[/／]|来源)[：:]\s*([^\s\n]{2,20})")
_SENTENCE = re.compile(r"[。！？\n](.{30,200})[。！？]")
_DATES = [re.compile(DATE), re.compile(RELATIVE_DATE)]


def article(html: str | None) -> dict[str, str | None]:
    """Title, author, date, description and content of a page; what isn't found is null."""
    doc = parse(html)
    body = " ".join(_body(doc).text().split())
    out: dict[str, str | None] = dict.fromkeys(("title", "author", "date", "description", "content"))
    for name, own in ARTICLE.items():
        for selector in own:
            n = next(iter(compiled("css", selector)(doc)), None)
            if n is not None:
                if name == "date":
                    value = n.attrs.get("content") or n.attrs.get("datetime") or n.text()
                else:
                    value = n.attrs.get("content", "") if selector.startswith("meta") else n.text()
                if value and value.strip():
                    out[name] = " ".join(value.split()) if name == "title" else value[:500] if name == "description" else value.strip()
                    break
    if not out["title"] and len(body) >= 10:
        out["title"] = body[:150]
    for name, patterns in (("author", [_BYLINE]), ("date", _DATES), ("description", [_SENTENCE])):
        for p in patterns:
            if not out[name] and (m := p.search(body)):
                out[name] = m[1].strip()
    if len(body) > 30:
        out["content"] = body[:3000]
    return out


def articles(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """A row of article fields for each page."""
    return _per_page(pages, id_col, html_col, dict.fromkeys(("title", "author", "date", "description", "content"), "string"), article)
