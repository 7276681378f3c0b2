"""Structure of HTML pages and templates: counts by pattern, elements by the standard parser, template tags by a stack."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.nodes import nested

LANDMARKS = "section|article|nav|aside|header|footer|main|form|table|ul|ol"
#: Template tags by dialect: opener, closer, and what opens and closes a block.
DIALECTS = {
    "jinja": re.compile(r"\{%-?\s*(?P<close>end)?(?P<name>[a-z]+)(?P<rest>[^%]*?)-?%\}|\{\{(?P<expr>.*?)\}\}", re.S),
    "blade": re.compile(r"@(?P<close>end)?(?P<name>if|foreach|for|section|while|forelse|auth|guest)\b(?P<rest>\s*\([^)\n]*\))?|\{\{(?P<expr>.*?)\}\}", re.S),
    "svelte": re.compile(r"\{(?P<close>/)?#?(?P<name>if|each|await|key)\b(?P<rest>[^}]*)\}|\{(?P<expr>[^#/:@}][^}]*)\}", re.S),
}
BLOCKS = {"if", "for", "block", "macro", "foreach", "section", "each", "await", "key", "with", "while", "forelse", "auth", "guest", "filter", "call"}


def _counted(files: DataFrame, pattern: str, name: str, lower: bool = False) -> DataFrame:
    found = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias(name))
    return (found.withColumn(name, F.lower(name)) if lower else found).groupBy("path", name).agg(F.count("*").alias("n"))


def headings(files: DataFrame) -> DataFrame:
    return _counted(files, "(?i)<h([1-6])", "level")


def landmarks(files: DataFrame) -> DataFrame:
    return _counted(files, rf"(?i)<({LANDMARKS})[\s>]", "tag", lower=True)


def local_links(files: DataFrame) -> DataFrame:
    """Targets inside the site of anchors (an extension), links, scripts and images."""
    found = _counted(files, r'(?i)<(?:a|link|script|img)[^>]*?(?:href|src)="([^"]*)"', "target")
    return found.where(r"target <> '' and not target rlike '^(?:[a-z]+:)?//'")


def entry_points(files: DataFrame) -> DataFrame:
    marks = files.selectExpr("path", "content rlike '(?i)<!doctype html' as has_doctype", "content rlike '(?i)<meta[^>]*viewport' as has_viewport")
    return marks.where("has_doctype or has_viewport")


def dialect(content: str) -> str | None:
    """The dialect with most tags in the opening part, two at least."""
    counts = {d: sum(1 for m in rx.finditer(content[:4000]) if m["name"]) for d, rx in DIALECTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] >= 2 else None


def template_rows(content: str) -> list[tuple[int, int, str, str, int, int, str]]:
    """(node_id, parent_id, type, name, start_line, end_line, dialect) of a template's blocks and expressions."""
    which = dialect(content)
    if which is None:
        return []
    rows: list[list] = []
    stack: list[int] = []
    for m in DIALECTS[which].finditer(content):
        line = content.count("\n", 0, m.start()) + 1
        end = content.count("\n", 0, m.end()) + 1
        if m["close"]:
            while stack:
                node = stack.pop()
                rows[node][5] = end
                if rows[node][3].split(" ")[0] == m["name"]:
                    break
        else:
            label = f"{m['name']} {(m['rest'] or '').strip()}".strip() if m["name"] else m["expr"].strip()
            rows.append([len(rows), stack[-1] if stack else -1, "block" if m["name"] else "expression", label, line, end, which])
            if m["name"] in BLOCKS:
                stack.append(len(rows) - 1)
    return [tuple(r) for r in rows]


def template_nodes(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, c in zip(b["path"], b["content"], strict=True) for r in template_rows(c or "")], columns=["path", "node_id", "parent_id", "type", "name", "start_line", "end_line", "dialect"])

    return files.select("path", "content").mapInPandas(run, "path string, node_id int, parent_id int, type string, name string, start_line int, end_line int, dialect string")


#: Elements that make a node, by its type; an element with an id makes one too.
ELEMENTS = {
    **dict.fromkeys(("section", "article", "nav", "aside", "header", "footer", "main"), "section"), "form": "form", **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
    **dict.fromkeys(("ul", "ol", "dl"), "list"), "table": "table", "script": "script", "style": "style",
}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def blanked(content: str) -> str:
    """A template with its tags turned to blanks, so that every other character keeps its place."""
    which = dialect(content)
    return content if which is None else DIALECTS[which].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[str, int | None]] = []

    def _node(self, kind: str, name: str) -> int:
        above = [n for _, n in self.open if n is not None]
        line = self.getpos()[0]
        self.rows.append([len(self.rows), above[-1] if above else -1, len(self.rows), len(above), kind, name, line, line])
        return len(self.rows) - 1

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype"):
            self._node("doctype", decl)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = (dict(attrs).get("id") or "").strip()
        kind = ELEMENTS.get(tag) or ("element" if own else None)
        node = self._node(kind, tag + (f"#{own}" if own else "")) if kind else None
        if tag not in VOID:
            self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in (t for t, _ in self.open):
            while self.open:  # elements left open end with the one around them
                t, node = self.open.pop()
                if node is not None:
                    self.rows[node][2], self.rows[node][7] = len(self.rows) - 1, self.getpos()[0]
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        inside = [n for _, n in self.open if n is not None and self.rows[n][4] == "heading"]
        if inside and data.strip():
            row = self.rows[inside[-1]]
            row[5] += (" " if ": " in row[5] else ": ") + " ".join(data.split())


def element_rows(content: str) -> list[tuple]:
    """(node_id, parent_id, last_desc_id, depth, type, name, start_line, end_line) of a page's structural elements in pre-order."""
    parser = _Elements()
    parser.feed(blanked(content))
    parser.close()
    last = content.count("\n") + 1
    for _, node in parser.open:
        if node is not None:
            parser.rows[node][2], parser.rows[node][7] = len(parser.rows) - 1, last
    return [tuple(r) for r in parser.rows]


def elements(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, c in zip(b["path"], b["content"], strict=True) for r in element_rows(c or "")], columns=["path", "node_id", "parent_id", "last_desc_id", "depth", "type", "name", "start_line", "end_line"])

    return files.select("path", "content").mapInPandas(run, "path string, node_id int, parent_id int, last_desc_id int, depth int, type string, name string, start_line int, end_line int")


def with_templates(files: DataFrame) -> DataFrame:
    """(path, source, node_id, type, name, start_line, end_line, parent): elements and template blocks of pages together; an element's
    parent is the smallest block around it, null outside of all."""
    own = elements(files)
    blocks = template_nodes(files)
    inside = nested(own, blocks.where("type = 'block'"))
    rows = own.join(inside, ["path", "node_id"]).selectExpr("path", "'html' as source", "node_id", "type", "name", "start_line", "end_line", "parent")
    return rows.unionByName(blocks.selectExpr("path", "'template' as source", "node_id", "type", "name", "start_line", "end_line", "nullif(parent_id, -1) as parent"))


def samples(spark: SparkSession) -> DataFrame:
    rows = [
        ("a.html", "{% extends 'base.html' %}\n{% block body %}\n<ul>{% for x in xs %}\n<li>{{ x.name }}</li>{% endfor %}</ul>\n{% endblock %}\n"),
        ("b.blade.php", "@section('main')\n@if($a)\n  {{ $b }}\n@endif\n@endsection\n"),
        ("c.svelte", "{#if ok}\n{#each items as i}\n<p>{i}</p>\n{/each}\n{/if}\n"),
        ("plain.html", "<p>nothing</p>"),
    ]
    return spark.createDataFrame(rows, "path string, content string")
