"""Landed web pages: text, links, contacts and declared extraction of listings."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache, partial
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import codes, web
from quarrymill.functions.similarity import partial_ratio
from quarrymill.functions.text import let, name_key
from quarrymill.storage import stored

#: Mailboxes of a company rather than a person, and what marks links to contact pages.
GENERIC_MAILBOXES = ("info", "contact", "hello", "hallo", "welkom", "office", "mail", "admin", "sales", "reservatie", "reservaties", "reservations", "booking")
CONTACT_WORDS = (
    r"contact|contacteer|kontakt|over[\s-]*ons|about|wie[\s-]*zijn[\s-]*we|impressum|colofon|legal|mentions[\s-]*l[ée]gales|"
    r"algemene[\s-]*voorwaarden|privacy|team|bereikbaarheid|info|reserv|praktisch"
)
#: Patterns of addresses, of what only looks like one, and of company numbers in context.
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}"
HIDDEN = r"(?i)([A-Za-z0-9._%+\-]+)\s*(?:\[at\]|\(at\)|\{at\}|\s@\s|&#64;)\s*([A-Za-z0-9.\-]+)\s*(?:\[dot\]|\(dot\)|\.)\s*([A-Za-z]{2,24})"
#: What any match of HIDDEN holds.
HIDDEN_SIGN = r"(?i)[\[({]at[\])}]|\s@\s|&#64;"
JUNK = (
    r"(?i)\.(png|jpe?g|gif|svg|webp|css|js|pdf)$|example\.|@sentry|wixpress|@2x|@3x|^\d+x\d*@|noreply|no-reply|"
    r"@(domain|email|mail|yourdomain|company|site)\.(com|be|nl)$|@[0-9.]+$|^(email|mail|name|user|info)@(domain|example|email)\b"
)
COMPANY_NUMBER = (
    r"(?iu)(\bBE\s?[01]\d{3}[.\s]?\d{3}[.\s]?\d{3}\b)|"
    r"(?:BTW|TVA|VAT|KBO|BCE|RPR|RPM|ondernemingsnummer|ondernemingsnr|enterprise\s+number|company\s+number|"
    r"num[ée]ro\s+d.entreprise|btw[\s-]*nummer|btw[\s-]*nr|vat[\s-]*number)\W{0,25}(?:BE\s?)?([01]\d{3}[.\s]?\d{3}[.\s]?\d{3})\b"
)
PHONE_IN_TEXT = r"(?:\+|00|\(?0)[\d][\d\s().\-/]{6,18}\d"
SHARE_LINK = r"(?i)sharer|/share|intent/|/dialog/|plugins/|/tr\?"
SILENT = ("script", "style", "noscript", "svg", "template")
#: Elements whose start ends an open one of these, as its end may be left out.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All nodes below, in the order of the page; pages of any depth."""
        todo = self.children[::-1]
        while todo:
            at = todo.pop()
            if isinstance(at, Node):
                yield at
                todo += at.children[::-1]

    def release(self) -> None:
        """Takes the tree apart. Nodes name their parents, so that trees would otherwise stay until the next collection."""
        todo = [self]
        while todo:
            at = todo.pop()
            todo += (c for c in at.children if isinstance(c, Node))
            at.children, at.parent = [], None

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                if at.strip():
                    parts.append(at.strip())
            elif at.tag not in SILENT:
                todo += reversed(at.children)
        return " ".join(parts)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in ENDS.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\]|:nth-of-type\(\d+\)|:first-of-type)*)")


def _fits(node: Node, step: str) -> bool:
    tag, rest = _STEP.fullmatch(step).groups()
    if tag and tag not in ("*", node.tag):
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]|:[\w-]+(?:\(\d+\))?", rest):
        if part[0] == "." and part[1:] not in node.attrs.get("class", "").split():
            return False
        if part[0] == "#" and node.attrs.get("id") != part[1:]:
            return False
        if part[0] == "[":
            key, _, want = part[1:-1].partition("=")
            have = node.attrs.get(key.rstrip("^$*~"))
            want = want.strip("\"'")
            tests = {"^": have is not None and have.startswith(want), "$": have is not None and have.endswith(want), "*": have is not None and want in have, "~": have is not None and want in have.split()}
            if not (tests[key[-1]] if key[-1] in tests else have is not None if "=" not in part else have == want):
                return False
        if part[0] == ":":
            place = int(re.search(r"\d+", part)[0]) if "(" in part else 1
            same = (c for c in node.parent.children if isinstance(c, Node) and c.tag == node.tag)
            if next(islice(same, place - 1, None), None) is not node:
                return False
    return True


@lru_cache(maxsize=256)
def _steps(selector: str) -> list[list[str]]:
    """Steps and combinators of each part of a selector; ValueError for what isn't supported."""
    out = []
    for one in selector.split(","):
        steps = [x for x in re.findall(r"[>+~]|[^\s>+~\[]*(?:\[[^\]]*\][^\s>+~\[]*)*", one.strip()) if x]
        whole = re.sub(r"\s", "", one) == re.sub(r"\s", "", "".join(steps))
        if not whole or not steps or steps[-1] in ">+~" or any(x not in ">+~" and not _STEP.fullmatch(x) for x in steps):
            raise ValueError(f"selector {selector!r}: only tags, classes, ids, attributes, :nth-of-type(), descendants, >, + and ~ are read")
        out.append(steps)
    return out


def select(root: Node, selector: str) -> list[Node]:
    """Nodes below ``root`` for tags, classes, ids, attributes, :nth-of-type(), descendants, ``>``, ``+``, ``~`` and commas."""
    out: dict[int, Node] = {}
    for steps in _steps(selector):
        found, how = [root], " "
        for step in steps:
            if step in ">+~":
                how = step
                continue
            seen: dict[int, Node] = {}
            for n in found:
                around = [c for c in n.parent.children if isinstance(c, Node)] if how in "+~" and n.parent else []
                after = around[around.index(n) + 1 :] if around else []
                pool = {" ": n.walk, ">": lambda n=n: (c for c in n.children if isinstance(c, Node)), "+": lambda a=after: a[:1], "~": lambda a=after: a}[how]()
                seen |= {id(c): c for c in pool if _fits(c, step)}
            found, how = list(seen.values()), " "
        out |= {id(n): n for n in found}
    if len(out) < 2:
        return list(out.values())
    return [n for n in root.walk() if id(n) in out] if root.parent is None else sorted(out.values(), key={id(n): k for k, n in enumerate(_top(root).walk())}.get)


def _top(node: Node) -> Node:
    while node.parent is not None:
        node = node.parent
    return node


def raw_field(node: Node, spec: Mapping, base: str) -> str | None:
    """What a field's selector, attribute and absolute option give; regex, map and default are applied as columns."""
    found = select(node, spec["selector"])[:1] if spec.get("selector") else [node]
    if not found:
        return None
    got = found[0].attrs.get(spec["attr"]) if spec.get("attr") else found[0].text()
    return urljoin(base, got) if got and spec.get("absolute") else got or None


#: Bytes of pages, and pages, that a task parses at a time.
PARSED_BYTES, PARSED_PAGES = 2_000_000, 500


def _bounded(pages: DataFrame) -> DataFrame:
    """Pages reach tasks PARSED_PAGES at a time where the session leaves Spark's 10,000 rows: long ones would not fit otherwise."""
    conf, key = pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(PARSED_PAGES))
    return pages


def _few(batches: Iterator[pa.RecordBatch], html: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of PARSED_BYTES or PARSED_PAGES, at most, or of one page that is larger: what is made of a run is given out before the
    next is parsed, so that memory does not grow with the rows of a batch."""
    for batch in batches:
        first = size = 0
        for k, page in enumerate(batch.column(html)):
            own = len(page.as_buffer()) if page.is_valid else 0
            if k > first and (size + own > PARSED_BYTES or k - first >= PARSED_PAGES):
                yield batch.slice(first, k - first)
                first, size = k, 0
            size += own
        if first < batch.num_rows:
            yield batch.slice(first)


def _items(batches: Iterator[pa.RecordBatch], item: str | None, fields: dict) -> Iterator[pa.RecordBatch]:
    names = ["page_url", "item", *fields]
    for batch in _few(batches):
        rows = []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(html.as_py())
            for k, node in enumerate(select(root, item) if item else [root]):
                rows.append((url, k, *[raw_field(node, spec, url or "") for spec in fields.values()]))
            root.release()
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "item" else pa.string()) for n, c in zip(names, cols)], names)


def finished_field(raw: Column, spec: Mapping) -> Column:
    """Regex group, value map, default and trimming of an extracted text."""
    default = F.lit(spec.get("default")).cast("string")
    out = raw
    if spec.get("regex"):
        groups = re.compile(spec["regex"]).groups
        out = F.when(out.rlike(spec["regex"]), F.regexp_extract(out, spec["regex"], min(groups, 1)))
    if spec.get("map"):
        table = F.create_map(*[F.lit(str(x)) for kv in spec["map"].items() for x in kv])
        left = F.lit(spec["default"]).cast("string") if "default" in spec else out
        out = F.when(out.isNotNull(), F.coalesce(table[out], table[F.btrim(out)], left))
    return F.coalesce(F.btrim(out) if spec.get("strip", True) else out, default)


def html_items(pages: DataFrame, item_selector: str | None, fields: Mapping[str, Mapping | str], constants: Mapping[str, str] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per item of every listing page: page_url, item (place on the page) and the declared fields. Without an item selector a page
    is one item. Null pages give no items."""
    specs = {n: {"selector": s} if isinstance(s, str) else dict(s) for n, s in fields.items()}
    for selector in filter(None, [item_selector, *(s.get("selector") for s in specs.values())]):
        _steps(selector)  # an unsupported one fails here, not in a task
    schema = "page_url string, item int, " + ", ".join(f"`{n}` string" for n in specs)
    rows = _bounded(pages).select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).where(F.col(html_col).isNotNull()).mapInArrow(partial(_items, item=item_selector, fields=specs), schema)
    return rows.select("page_url", "item", *[finished_field(F.col(n), s).alias(n) for n, s in specs.items()], *[F.lit(v).alias(k) for k, v in (constants or {}).items()])


def next_links(pages: DataFrame, next_selector: str) -> DataFrame:
    """url and next_url of the pages that have a next link. Stored."""
    links = html_items(pages, None, {"next_url": {"selector": next_selector, "attr": "href", "absolute": True}}).select(F.col("page_url").alias("url"), "next_url")
    return stored(links.dropDuplicates(["url"]), "next-links")


def reached_pages(links: DataFrame, start_url: str, max_pages: int | None = None) -> DataFrame:
    """url and page_no of the pages that a walk along ``links`` meets, ``start_url`` being the first: until there is no next page, one was seen, or
    isn't among the links' pages. Stored.

    Pointers double: after k joins every page knows its 2^k-th successor, and twice as many pages are reached. A cycle gives each of its pages
    the number at which the walk first came there.
    """
    pages = links.select("url").distinct()
    jump = stored(links.where("next_url is not null").join(pages.withColumnRenamed("url", "next_url"), "next_url", "left_semi").select("url", F.col("next_url").alias("to")), "jumps")
    reached = stored(pages.where(F.col("url") == start_url).select("url", F.lit(1).cast("long").alias("page_no")), "reached")
    step, count = 1, reached.count()
    while count and (max_pages is None or step < max_pages):
        more = reached.join(jump, "url").select(F.col("to").alias("url"), (F.col("page_no") + step).alias("page_no"))
        more = more if max_pages is None else more.where(F.col("page_no") <= max_pages)
        reached = stored(reached.unionByName(more).groupBy("url").agg(F.min("page_no").alias("page_no")), "reached")
        if (grown := reached.count()) == count:
            break
        step, count = 2 * step, grown
        jump = stored(jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("on")), "to").select("url", F.col("on").alias("to")), "jumps")
    return reached


def follow_pages(pages: DataFrame, start_url: str, next_selector: str, max_pages: int | None = 10) -> DataFrame:
    """The pages reached from ``start_url`` by next links, with page_no; see reached_pages()."""
    reached = reached_pages(next_links(pages, next_selector), start_url, max_pages)
    return pages.join(reached.select("url", F.col("page_no").cast("int").alias("page_no")), "url")


def detail_join(items: DataFrame, pages: DataFrame, url_field: str, fields: Mapping[str, Mapping | str], root_selector: str | None = None) -> DataFrame:
    """Items with fields of their detail pages; ``detail_error`` where the page isn't there. Pages that no item names are left out before they are
    parsed."""
    wanted = stored(items.select(F.col(url_field).alias("url")).where("url is not null").distinct(), "wanted-urls")
    own = pages.join(wanted, "url", "left_semi")
    details = html_items(own, root_selector, fields).where("item = 0").drop("item").withColumnRenamed("page_url", url_field)
    landed = own.select(F.col("url").alias(url_field), F.lit(True).alias("__landed")).distinct()
    out = items.join(details, url_field, "left").join(landed, url_field, "left")
    return out.withColumn("detail_error", F.when(F.col("__landed").isNull(), "page not landed")).drop("__landed")


def search_results(pages: DataFrame) -> DataFrame:
    """Hits of landed result pages: page_url, place, url, title, snippet. Ads are left out and redirects unwrapped."""
    fields = {
        "class": {"attr": "class", "default": ""}, "href": {"selector": "a.result__a, a.result-link", "attr": "href"}, "title": "a.result__a, a.result-link", "snippet": {"selector": ".result__snippet", "default": ""},
        "own_href": {"attr": "href"}, "own_title": {},
    }
    items = html_items(pages, "div.result, a.result-link", fields)  # both layouts in one parse
    link = F.array_contains(F.split("class", r"\s+"), "result-link")
    order = Window.partitionBy("page_url", "link").orderBy("item")
    own = items.withColumn("link", link).withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    shown = ~F.col("link") & ~F.col("class").contains("result--ad")
    # the second layout counts where the first gives no hit
    first = F.max(shown & F.col("href").isNotNull()).over(Window.partitionBy("page_url"))
    own = own.withColumn("first", first).where(F.when(F.col("link"), ~F.col("first")).otherwise(shown))
    pick = lambda mine, other: F.when(F.col("link"), F.col(mine)).otherwise(F.col(other))
    rows = own.select("page_url", F.col("place").alias("item"), pick("own_href", "href").alias("href"), pick("own_title", "title").alias("title"), F.when(F.col("link"), "").otherwise(F.col("snippet")).alias("snippet"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("https:"), F.col("href"))).otherwise(F.col("href"))
    target = F.try_url_decode(F.nullif(F.regexp_extract(full, r"[?&]uddg=([^&]+)", 1), F.lit("")))
    url = F.when(full.rlike(r"^https?://([^/]*\.)?duckduckgo\.com/l/"), target).otherwise(full)
    return rows.select("page_url", F.col("item").alias("place"), url.alias("url"), F.coalesce("title", F.lit("")).alias("title"), "snippet").where("url <> ''")


# --- contacts


def _contacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))
    for batch in _few(batches):
        rows = []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(html.as_py())
            title = next((n.text() for n in root.walk() if n.tag == "title"), "")
            metas = [n.attrs for n in root.walk() if n.tag == "meta"]
            about = next((m.get("content", "") for m in metas if m.get("name", "").lower() == "description"), "") or next((m.get("content", "") for m in metas if m.get("property") == "og:description"), "")
            own = [{"href": n.attrs["href"].strip(), "label": n.text()} for n in root.walk() if n.tag == "a" and "href" in n.attrs]
            rows.append((root.text(), title[:200], about.strip()[:500], own, [_joined(url, a["href"]) for a in own], [unquote(a["href"]) for a in own if a["href"].lower().startswith(("mailto:", "tel:"))]))
            root.release()
        types = [pa.string(), pa.string(), pa.string(), links, pa.list_(pa.string()), pa.list_(pa.string())]
        cols = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], *cols, *batch.columns[2:]], ["url", "text", "title", "description", "links", "hrefs", "direct", *batch.schema.names[2:]])


def _joined(url: str | None, href: str) -> str:
    try:
        return urljoin(url or "", href)
    except ValueError:
        return href


def page_content(pages: DataFrame, *others: str) -> DataFrame:
    """url, visible text, title, description, links (href and label), hrefs (absolute) and direct (mailto: and tel: links, decoded)."""
    own = _bounded(pages).select("url", "html", *others)
    schema = "url string, text string, title string, description string, links array<struct<href:string,label:string>>, hrefs array<string>, direct array<string>"
    more = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[2:])
    return own.mapInArrow(_contacts, schema + (f", {more}" if more else ""))


def emails(text: Column, direct: Column) -> Column:
    """Addresses of mail links, then plain and spelled-out ones of the text, without junk, first seen first. Texts without a
    sign of an address are not searched."""
    linked = F.flatten(F.transform(F.filter(direct, lambda h: F.lower(h).startswith("mailto:")), lambda h: F.transform(F.split(F.substr(h, F.lit(8)), ","), web.normalize_email)))
    none = F.array().cast("array<string>")
    plain = F.when(text.contains("@"), F.transform(F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), F.lit(1)), F.lower)).otherwise(none)
    part = lambda m, k: F.regexp_extract(m, HIDDEN, k)
    hidden = F.when(text.rlike(HIDDEN_SIGN), F.transform(F.regexp_extract_all(text, F.lit(HIDDEN), F.lit(0)), lambda m: F.lower(F.concat(part(m, 1), F.lit("@"), part(m, 2), F.lit("."), part(m, 3))))).otherwise(none)
    found = F.transform(F.array_compact(F.concat(linked, plain, hidden)), lambda e: F.btrim(e, F.lit(".,;:")))
    return F.array_distinct(F.filter(found, lambda e: web.is_valid_email(e) & ~e.rlike(JUNK)))


def may_hold_email(text: Column | str) -> Column:
    """Does a text hold any sign of an address?"""
    return F.col(text).contains("@") | F.col(text).rlike(HIDDEN_SIGN) if isinstance(text, str) else text.contains("@") | text.rlike(HIDDEN_SIGN)


def phones(text: Column, direct: Column, region: str = "BE") -> Column:
    """Numbers of telephone links, then valid ones of the text."""
    linked = F.transform(F.filter(direct, lambda h: F.lower(h).startswith("tel:")), lambda h: codes.normalize_phone(F.substr(h, F.lit(5)), region))
    told = F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE_IN_TEXT})"), F.lit(1)), lambda t: let(codes.phone_info(t, region), lambda i: F.when(i["valid"], i["e164"])))
    return F.array_distinct(F.array_compact(F.concat(linked, told)))


def vat_numbers(text: Column, country: str = "BE") -> Column:
    both = [F.regexp_extract_all(text, F.lit(COMPANY_NUMBER), F.lit(k)) for k in (1, 2)]
    raw = F.transform(F.arrays_zip(both[0].alias("a"), both[1].alias("b")), lambda z: codes.normalize_vat(F.when(z["b"] != "", z["b"]).otherwise(z["a"]), country))
    return F.array_distinct(F.filter(raw, lambda v: F.coalesce(codes.is_valid_vat(v), F.lit(False))))


def socials(hrefs: Column) -> Column:
    """(network, url) of profile links, in page order; share links are skipped."""
    own = F.filter(hrefs, lambda h: ~h.rlike(SHARE_LINK))
    named = F.transform(own, lambda h: let(web.social_network(h), lambda n: F.when(n.isNotNull(), F.struct(n.alias("network"), web.normalize_social(h, n).alias("url")))))
    return F.array_distinct(F.filter(F.array_compact(named), lambda s: s["url"].isNotNull()))


def contact_links(content: DataFrame, max_pages: int = 3) -> DataFrame:
    """(url, link, score): links of a page to contact pages of the same domain; the best max_pages - 1 of each."""
    rows = content.select("url", F.posexplode(F.arrays_zip("links", "hrefs")).alias("place", "z")).select("url", "place", F.col("z.links.label").alias("label"), F.col("z.links.href").alias("href"), F.col("z.hrefs").alias("full"))
    rows = rows.where(~F.col("href").rlike("(?i)^(#|mailto:|tel:|javascript:|$)") & (web.url_domain("full") == web.url_domain("url")))
    label = F.concat_ws(" ", "label", F.regexp_extract("full", r"^[a-z]+://[^/?#]*([^?#]*)", 1))
    rows = rows.withColumn("link", web.normalize_url("full")).withColumn("label", label).where(F.col("label").rlike(f"(?iu){CONTACT_WORDS}") & (F.col("link") != web.normalize_url("url")))
    best = rows.groupBy("url", "link").agg(F.min_by("label", "place").alias("label"), F.min("place").alias("place"))
    best = best.withColumn("score", F.when(F.col("label").rlike("(?i)contact|kontakt"), 3).otherwise(1))
    order = Window.partitionBy("url").orderBy(F.desc("score"), "place")
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") < max_pages).select("url", "link", "score")


def rank_emails(found: Column, domain: Column) -> Column:
    """Own-domain addresses first, then company mailboxes, then by letter."""

    def place(e: Column) -> Column:
        d = web.email_domain(e)
        own = (d == domain) | d.endswith(F.concat(F.lit("."), domain)) | domain.endswith(F.concat(F.lit("."), d))
        return F.struct(F.when(own, 0).otherwise(1).alias("own"), F.when(F.lower(F.substring_index(e, "@", 1)).isin(*GENERIC_MAILBOXES), 0).otherwise(1).alias("generic"), e.alias("e"))

    return F.transform(F.array_sort(F.transform(F.array_distinct(found), place)), lambda s: s["e"])


def site_contacts(content: DataFrame, region: str = "BE") -> DataFrame:
    """One row per ``site`` of page contents (with site and page_ord): url, title and description of the first page, the length
    of all texts with a space between pages, and emails, phones, VAT numbers and social links of all pages in order, each once.

    Texts stay in their pages' rows; only a site's distinct contacts meet in one.
    """
    found = {"emails": emails(F.col("text"), F.col("direct")), "phones": phones(F.col("text"), F.col("direct"), region), "vat_numbers": vat_numbers(F.col("text"), region), "socials": socials(F.col("hrefs"))}
    rows = stored(content.select("site", "page_ord", "url", "title", "description", F.length("text").cast("long").alias("size"), *[v.alias(k) for k, v in found.items()]), "page-contacts")
    first = lambda c: F.min_by(c, "page_ord").alias(c)
    length = F.greatest(F.coalesce(F.sum("size"), F.lit(0)) + F.count("size") - 1, F.lit(0)).cast("int")
    sites = rows.groupBy("site").agg(first("url"), first("title"), first("description"), length.alias("text_length"))
    told = lambda k: F.transform(k, lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("pos"), (x["network"] if k == "socials" else F.lit(None).cast("string")).alias("network"), (x["url"] if k == "socials" else x).alias("value")))
    each = rows.select("site", "page_ord", F.explode(F.concat(*[told(k) for k in found])).alias("x")).select("site", "page_ord", "x.*")
    once = each.groupBy("site", "kind", "network", "value").agg(F.min(F.struct("page_ord", "pos")).alias("place"))
    item = F.struct("place", "value", "network")
    lists = once.groupBy(F.col("site").alias("__site")).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, item))).alias(k) for k in found])
    out = sites.join(lists, F.col("site").eqNullSafe(F.col("__site")), "left")
    shown = {k: F.transform(k, (lambda x: F.struct(x["network"].alias("network"), x["value"].alias("url"))) if k == "socials" else (lambda x: x["value"])) for k in found}
    empty = lambda k: F.array().cast("array<struct<network:string,url:string>>" if k == "socials" else "array<string>")
    out = out.select("site", "url", "title", "description", "text_length", *[F.coalesce(v, empty(k)).alias(k) for k, v in shown.items()])
    return out.withColumn("emails", rank_emails(F.col("emails"), web.url_domain("url")))


def name_match(name: Column, title: Column, text: Column) -> Column:
    """0 to 100: how well a name is found in a title and the first 5000 characters of a text (a match from 90 on)."""
    key, page = name_key(name), F.substring(name_key(F.concat_ws(" ", title, F.substring(text, 1, 5000))), 1, 20_000)
    return F.when(key == "", 0.0).when(page.contains(key), 100.0).when(F.length(key) >= 4, F.floor(partial_ratio(key, page)).cast("double")).otherwise(0.0)


def pick_social(rows: DataFrame) -> DataFrame:
    """One url per (record, network) of rows (record_id, name, network, place, url): the handle most like the name (60 at least), else the first."""
    key = F.replace(name_key("name"), F.lit(" "), F.lit(""))
    handle = F.regexp_replace(F.lower(F.substring_index(F.rtrim(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/")), "/", -1)), "[^a-z0-9]", "")
    rated = rows.withColumns({"__k": key, "__h": handle})
    rated = rated.withColumn("score", F.when((F.col("__k") == "") | (F.col("__h") == ""), 0.0).otherwise(F.floor(partial_ratio(F.col("__k"), F.col("__h"))).cast("double")))
    good = F.when(F.col("score") >= 60, F.col("score")).otherwise(0.0)
    order = Window.partitionBy("record_id", "network").orderBy(F.desc(good), "place")
    return rated.withColumn("n", F.row_number().over(order)).where("n = 1").select("record_id", "network", "url")


def fetch_outcome() -> Column:
    """live, redirected, blocked, unchecked, dead or unreachable, from a crawl log's columns."""
    challenge = F.col("status").isin(401, 429) | F.substring("body_head", 1, 5000).rlike("(?i)cloudflare|captcha|access denied|just a moment|bot detection|rate limit|too many requests|attention required") | F.lower("server").contains("cloudflare")
    blocked = F.coalesce("robots_blocked", F.lit(False)) | (F.col("status").isin(401, 403, 429, 503) & F.coalesce(challenge, F.lit(False)))
    moved = (F.coalesce("final_url", F.lit("")) != "") & ~web.url_domain("final_url").eqNullSafe(web.url_domain("url"))
    return F.when(F.col("status").between(200, 399), F.when(moved, "redirected").otherwise("live")).when(blocked, "blocked").when(F.coalesce("dns_temporary", F.lit(False)), "unchecked").when(F.col("status").between(400, 599), "dead").otherwise("unreachable")


def is_html_page() -> Column:
    return F.coalesce(F.lower("content_type").contains("html") | F.lower(F.ltrim(F.col("body_head"))).rlike("^(<!doctype html|<html)"), F.lit(False))
