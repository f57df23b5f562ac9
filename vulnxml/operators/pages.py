"""Reference pages: URL routing (J6) and rule-driven text extraction.

Routing is one CASE expression built from a small, ordered rule list (a
parameter, not data), so it stays inside whole-stage codegen and needs no
join. Extraction parses each page once with the standard-library HTML parser
inside ``mapInArrow`` (the page is the unit of work) and
applies the routed rule; a block that isn't there gives ''. The tree is built
and walked without recursion, so nesting has no limit. The result is
whitespace-normalised (P14).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnxml.functions.text import basic_cleaning, url_authority
from vulnxml.operators.text_ops import nouns_only

# Pages whose texts leave a task together.
PAGES_OUT = 64
# Host routing of the reference, flattened into ordered leaf rules.
# (priority, host must contain all of these, URL must contain (or ''), rule)
HOST_RULES = [
    (1, ("bugs.launchpad.net",), "", "launchpad"),
    (2, ("openwall.com",), "", "openwall"),
    (3, ("redhat.com", "bugzilla"), "", "bugzilla_redhat"),
    (4, ("redhat.com", "access"), "", "access_redhat"),
    (5, ("redhat.com",), "", "rhn_redhat"),
    (6, ("debian.org", "lists"), "", "lists_debian"),
    (7, ("debian.org",), "", "debian"),
    (8, ("oracle.com",), "", "oracle"),
    (9, ("lists.opensuse.org",), "", "lists_opensuse"),
    (10, ("fedoraproject.org",), "/pipermail/", "fedora_pipermail"),
    (11, ("fedoraproject.org",), "/archives/list/", "fedora_archives"),
    (12, ("fedoraproject.org",), "", ""),
    (13, ("github",), "", "github"),
    (14, ("gentoo.org",), "security.gentoo.org/glsa/", "gentoo_glsa"),
    (15, ("gentoo.org",), "blogs.gentoo.org/ago", "gentoo_blogs"),
    (16, ("gentoo.org",), "security.gentoo.org", "gentoo_security"),
    (17, ("gentoo.org",), "", ""),
    (18, ("securitytracker",), "", "securitytracker"),
    (19, ("usn.ubuntu",), "", "usn_ubuntu"),
    (20, ("ubuntu",), "", "ubuntu"),
]

# Markers used by the extraction rules.
OPENWALL_CUTS = ("============", "Affected Versions")
DESCRIPTION_WORDS = ("description", "summary")
DEBIAN_MARKER = "More information"
UPDATE_MARKER = "Update: "
OPENSUSE_START, OPENSUSE_END = "Description:", "Patch Instructions:"


def route_urls(pages: DataFrame, rules=HOST_RULES, url_col: str = "url") -> DataFrame:
    """The first rule whose host substrings are all in the URL's authority
    and whose URL substring is in the URL; no hit -> ''."""
    return pages.withColumn("rule", route_expr(url_col, rules))


def route_expr(url_col: str, rules) -> Column:
    host = F.lower(F.coalesce(url_authority(url_col), F.lit("")))
    url = F.coalesce(F.col(url_col), F.lit(""))
    expr = None
    for _, hosts, path, rule in sorted(rules, key=lambda r: r[0]):
        cond = F.lit(True)
        for h in hosts:
            cond = cond & host.contains(h)
        if path:
            cond = cond & url.contains(path)
        expr = F.when(cond, F.lit(rule)) if expr is None else expr.when(cond, F.lit(rule))
    return expr.otherwise(F.lit("")) if expr is not None else F.lit("")


# ------------------------------------------------------------ small DOM
class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator:
        """All nodes and strings below, in page order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                continue
            yield child
            if isinstance(child, _Node):
                stack.append(iter(child.children))

    def strings(self) -> list[str]:
        return [c for c in self.walk() if isinstance(c, str)]

    def text(self) -> str:
        return "".join(self.strings())

    def find_all(self, tag: str, cls: str | None = None, id_: str | None = None) -> list[_Node]:
        return [c for c in self.walk() if isinstance(c, _Node) and c.tag == tag and (cls is None or _has_class(c, cls))
                and (id_ is None or c.attrs.get("id") == id_)]

    def find(self, tag: str, cls: str | None = None, id_: str | None = None, nth: int = 0) -> _Node | None:
        found = self.find_all(tag, cls, id_)
        return found[nth] if len(found) > nth else None


def _has_class(node: _Node, cls: str) -> bool:
    """One class may be any of the element's; several must be the whole attribute."""
    own = node.attrs.get("class", "")
    return own == cls if " " in cls else cls in own.split()


_VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "wbr"}
_SKIP = {"script", "style"}
# Start tags that end an open element of these tags, unless one of the last set is in between.
_CLOSES = {"p": ({"p"}, set()), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.cur = _Node("#root", {}, None)
        self.skip = 0
        self.open: dict[str, int] = {}

    def _leave(self, node: _Node) -> None:
        """Close everything up to and with an open element."""
        while True:
            closed, self.cur = self.cur, self.cur.parent
            self.open[closed.tag] -= 1
            if closed is node:
                return

    def _up(self, tags, stop=frozenset()) -> _Node | None:
        if not any(self.open.get(t) for t in tags):
            return None
        n = self.cur
        while n.parent is not None and n.tag not in tags:
            if n.tag in stop:
                return None
            n = n.parent
        return n if n.parent is not None else None

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
            return
        if tag in _CLOSES:
            n = self._up(*_CLOSES[tag])
            if n is not None:
                self._leave(n)
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in _VOID:
            self.cur = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        n = self._up((tag,))
        if n is not None:
            self._leave(n)

    def handle_data(self, data):
        if not self.skip:
            self.cur.children.append(data)


def parse_html(html: str | None) -> _Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _dismantle(root: _Node) -> None:
    """Cut the links between parents and children, so that a page's memory is
    free at once and doesn't wait for the search for cycles."""
    todo = [root]
    while todo:
        node = todo.pop()
        todo += [c for c in node.children if isinstance(c, _Node)]
        node.parent, node.children = None, []


# ------------------------------------------------------------ rules
def _txt(node: _Node | None) -> str:
    return node.text() if node is not None else ""


def _after(text: str, marker: str) -> str:
    """What follows the marker, up to its next occurrence."""
    parts = text.split(marker)
    return parts[1] if len(parts) > 1 else ""


def _described(lines: list[str]) -> str:
    """The block after each line with "description", and the one after the
    first line with "summary", which is the last; a line with a closing colon
    ends a block."""
    out: list[str] = []

    def block(first: int) -> None:
        for line in lines[first:]:
            if line.endswith(":"):
                return
            out.append(line)

    for i, line in enumerate(lines):
        if DESCRIPTION_WORDS[0] in line.lower():
            block(i + 1)
        if DESCRIPTION_WORDS[1] in line.lower():
            block(i + 1)
            break
    return " ".join(out)


def _paragraph_after(text: str, needle: str) -> str:
    if not needle or needle not in text:
        return ""
    rest = text.split(needle, 1)[1]
    rest = rest.split("\n", 1)[1] if "\n" in rest else ""  # skip the rest of the marker line
    return next((p for p in re.split(r"\n\s*\n", rest) if p.strip()), "")


def _bugzilla(root: _Node, _: str) -> str:
    own = _txt(root.find("div", "uneditable_textarea"))
    if own.strip():
        return own
    first = root.find("div", id_="c0")
    pre = first.find("pre", "bz_comment_text") if first else None
    return _described([line.rstrip() for line in _txt(pre).split("\n")])


def _access(root: _Node, report_id: str) -> str:
    box = root.find("div", id_="description")
    for li in box.find_all("li") if box and report_id else []:
        text = li.text()
        if report_id in text:
            parts = text.split(" ", 2)
            return parts[2].split(report_id)[0] if len(parts) > 2 else ""
    return ""


def _rhn(root: _Node, _: str) -> str:
    return " ".join(p.text() for box in root.find_all("div", id_="description") for p in box.find_all("p"))


def _debian(root: _Node, _: str) -> str:
    box, seen = root.find("div", id_="content"), False
    for node in box.walk() if box else ():
        if isinstance(node, str):
            seen = seen or DEBIAN_MARKER in node
        elif seen and node.tag == "p":
            return node.text()
    return ""


def _oracle(root: _Node, _: str) -> str:
    """Elements after each heading "Description" up to the next heading of its
    level; their strings are stripped and joined as they are."""
    out = []
    for head in root.find_all("h3"):
        if head.text() == "Description":
            siblings = head.parent.children
            at = next(i for i, c in enumerate(siblings) if c is head)
            for node in siblings[at + 1:]:
                if isinstance(node, _Node):
                    if node.tag == "h3":
                        break
                    out += [s.strip() for s in node.strings()]
    return "".join(out)


def _opensuse(root: _Node, report_id: str) -> str:
    """The lines from a bullet that names the report to the next one that
    doesn't, after their first colon."""
    started = taking = False
    taken, result = "", ""
    for line in (x.strip() for x in _txt(root.find("div", "email-body")).split("\n")):
        if not line or not report_id:
            continue
        started = started or OPENSUSE_START in line
        if not started:
            continue
        bullet = line[0] in "-*"
        if bullet and report_id in line:
            taking = True
        elif bullet or OPENSUSE_END in line:
            taking, result = False, taken.partition(":")[2]
        if taking:
            taken += line + " "
    return result


def _github(root: _Node, _: str) -> str:
    box = root.find("div", "flex-auto min-width-0 width-fit mr-3")
    strong = box.find("strong") if box else None
    return _txt(root.find("a", "url fn")) + " " + _txt(strong.find("a") if strong else None)


def _ubuntu(item_class: str | None):
    def rule(root: _Node, _: str) -> str:
        third, first8 = root.find("div", "col-12", nth=2), root.find("div", "col-8")
        first = first8.find("p") if first8 else None
        if third is None or first is None:
            return ""
        return "".join(li.text().strip() + ". " for li in third.find_all("li", item_class)) + first.text()
    return rule


def _gentoo(root: _Node, _: str) -> str:
    box = root.find("div", "col-12 col-md-10")
    return _txt(box.find("p", nth=2) if box else None)


def _openwall(root: _Node, _: str) -> str:
    text = _txt(root.find("pre"))
    for cut in OPENWALL_CUTS:
        text = text.split(cut)[0]
    return text


def _article_p2(root: _Node, _: str) -> str:
    article = root.find("article")
    return _txt(article.find("p", nth=1) if article else None)


EXTRACTORS = {
    "title": lambda root, _: _txt(root.find("title")),
    "h1": lambda root, _: _txt(root.find("h1")),
    "first_p": lambda root, _: _txt(root.find("p")),
    "article_p2": _article_p2,
    "launchpad": lambda root, _: _txt(root.find("span", "yui3-editable_text-text ellipsis")),
    "openwall": _openwall,
    "bugzilla_redhat": _bugzilla,
    "access_redhat": _access,
    "rhn_redhat": _rhn,
    "lists_debian": lambda root, report_id: _paragraph_after(_txt(root.find("pre")), report_id),
    "debian": _debian,
    "oracle": _oracle,
    "lists_opensuse": _opensuse,
    "fedora_pipermail": lambda root, _: _after(_txt(root.find("title")), UPDATE_MARKER),
    "fedora_archives": lambda root, _: _after(_txt(root.find("div", "col-tn-10")), UPDATE_MARKER),
    "github": _github,
    "gentoo_security": _gentoo,
    "gentoo_glsa": _gentoo,
    "gentoo_blogs": lambda root, _: _txt(root.find("h1", "entry-title")),
    "securitytracker": lambda root, _: _txt(root.find("font", nth=24)),
    "usn_ubuntu": _ubuntu("p-list__item"),
    "ubuntu": _ubuntu(None),
}


def extract(rule: str, html: str | None, report_id: str = "") -> str:
    """Apply one extraction rule to one page; '' for no rule, an unknown one or
    a page without the block."""
    found = EXTRACTORS.get(rule)
    if not found:
        return ""
    root = parse_html(html)
    try:
        return found(root, report_id or "")
    finally:
        _dismantle(root)


def _normalize(t: str) -> str:
    return " ".join(t.split())


def extract_page_text(routed: DataFrame, id_col: str = "page_id", report_col: str | None = None) -> DataFrame:
    """X: (page_id, rule, text) - one parse per page inside Arrow batches."""
    report = F.col(report_col).cast("string") if report_col else F.lit("")
    out = _extract_rows(routed.select(F.col(id_col).cast("long").alias("page_id"), "rule", report.alias("report_id"), "html"),
                        "page_id long, rule string")
    return out


def _extract_rows(rows: DataFrame, keys: str) -> DataFrame:
    """The key columns of each row (given as a schema) and its page's text."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches):
        for b in batches:
            # Pages become strings one at a time, and texts leave a few at a time.
            for at in range(0, b.num_rows, PAGES_OUT):
                part = b.slice(at, PAGES_OUT)
                rule, html, report = (part.column(c) for c in ("rule", "html", "report_id"))
                text = [_normalize(extract(rule[i].as_py(), html[i].as_py(), report[i].as_py() or "")) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(text, pa.string())], [*names, "text"])
    return rows.mapInArrow(run, keys + ", text string")


def reference_text(report_urls: DataFrame, pages: DataFrame, rules=HOST_RULES, reports: DataFrame | None = None,
                   tags: DataFrame | None = None) -> DataFrame:
    """Per report its routed pages' texts, cleaned (P1, and P2 if there are
    ``tags``: (word, tag), of which nouns stay), joined by a space in URL order; '' for a report without a saved page. report_urls: (report_id,
    pos, url); pages: (url, html), of which one per URL counts; reports:
    (report_id), if some have no URL at all. Each row carries its report and
    place through the extraction, so nothing is joined back by position."""
    saved = pages.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("html").alias("html"))
    rows = route_urls(report_urls.select("report_id", "pos", "url").join(saved, "url", "left"), rules)
    rows = rows.select(F.col("report_id").cast("string").alias("report_id"), F.col("pos").cast("long").alias("pos"), "rule", "html")
    texts = _extract_rows(rows, "report_id string, pos long").withColumn("text", basic_cleaning("text"))
    joined = texts.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("t"))
    # texts that came out empty leave no gap
    joined = joined.select("report_id", F.trim(F.regexp_replace("t", " +", " ")).alias("reference_text"))
    if tags is not None:
        joined = nouns_only(joined, tags, "reference_text", "report_id").select(F.col("doc_id").alias("report_id"), F.col("text").alias("reference_text"))
    if reports is None:
        return joined
    all_ids = reports.select(F.col("report_id").cast("string").alias("report_id")).distinct()
    return all_ids.join(joined, "report_id", "left").select("report_id", F.coalesce("reference_text", F.lit("")).alias("reference_text"))
