"""Paths over page markup as it is found: unclosed, crossed and nested tags included.

Pages are parsed to small trees within Arrow batches, one page at a time, and paths are
followed there; only the texts found leave the task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, and which open elements a start tag ends (up to a boundary).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
_ENDS = {tag: ({"p"}, {"td", "th", "li", "div", "article", "section", "body"}) for tag in _BLOCKS} | {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}


class Node:
    """An element: its tag, attributes, and children (elements and texts) in order."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[tuple[Node, Node | str]]:
        """Elements and texts below, in document order, each with what holds it."""
        stack = [(self, iter(self.children))]
        while stack:
            parent, kids = stack[-1]
            child = next(kids, None)
            if child is None:
                stack.pop()
                continue
            yield parent, child
            if isinstance(child, Node):
                stack.append((child, iter(child.children)))

    def below(self) -> Iterator[Node]:
        """Elements below, in document order."""
        return (c for _, c in self.walk() if isinstance(c, Node))

    def text(self) -> str:
        return "".join(c for _, c in self.walk() if isinstance(c, str))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends, walls = _ENDS.get(tag, ((), ()))
        ended = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in walls:
                break
            if self.open[i].tag in ends:
                ended = i
        if ended:
            del self.open[ended:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag in ("p", "b", "i", "span", "a") and self.open[i].tag in ("table", "td", "body"):
                return  # an end tag does not reach out of a cell

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    """The tree of a page; what is left open ends with the page, end tags without a start are passed over."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_STEP = re.compile(r"(//|/|^)(\*|text\(\)|@[\w:-]+|[\w:-]+)((?:\[[^\]]*\])*)")
_CLASS = re.compile(r"^contains\(concat\(' ', ?normalize-space\(@([\w:-]+)\), ?' '\), ?' ([^']+) '\)$")
_CALL = re.compile(r"^(contains|starts-with)\(@([\w:-]+), ?(['\"])(.*)\3\)$")
_EQUAL = re.compile(r"^@([\w:-]+)\s*=\s*(['\"])(.*)\2$")


def _condition(text: str) -> int | Callable[[Node], bool]:
    """A predicate: a position, or a condition on an element's attributes."""
    if text.isdigit():
        return int(text)
    if found := _CLASS.match(text):
        name, word = found.groups()
        return lambda n: word in n.attrs.get(name, "").split()
    if found := _CALL.match(text):
        how, name, _, part = found.groups()
        return lambda n: name in n.attrs and (part in n.attrs[name] if how == "contains" else n.attrs[name].startswith(part))
    if found := _EQUAL.match(text):
        name, _, value = found.groups()
        return lambda n: n.attrs.get(name) == value
    if re.fullmatch(r"@[\w:-]+", text):
        return lambda n: text[1:] in n.attrs
    raise ValueError(f"[{text}] is no supported condition")


@cache
def _steps(path: str) -> list[tuple[bool, str, list]]:
    body = path.strip().removeprefix(".")
    steps, at = [], 0
    while at < len(body):
        found = _STEP.match(body, at)
        if not found or (at and not found.group(1)):
            raise ValueError(f"{path} is no supported path")
        steps.append((found.group(1) == "//", found.group(2), [_condition(c) for c in re.findall(r"\[([^\]]*)\]", found.group(3))]))
        at = found.end()
    if not steps or any(name[0] == "@" or name == "text()" for _, name, _ in steps[:-1]):
        raise ValueError(f"{path} is no supported path")
    return steps


def follow(root: Node, path: str) -> list[Node | str]:
    """What a path finds below ``root``, each once, in document order.

    Steps are / and // with a tag, *, and at the end text() or @name; conditions are positions,
    @name, @name='x', contains(@name,'x'), starts-with(@name,'x') and a word of @class as
    contains(concat(' ', normalize-space(@class), ' '), ' x ').
    """
    here: list[Node] = [root]
    for deep, name, conditions in _steps(path):
        among = [m for n in here for m in ([n, *n.below()] if deep else [n])]
        if name == "text()":
            wanted = {id(n) for n in among}
            return [c for parent, c in root.walk() if isinstance(c, str) and id(parent) in wanted]
        if name[0] == "@":
            wanted = {id(n) for n in among}
            return [n.attrs[name[1:]] for n in [root, *root.below()] if id(n) in wanted and name[1:] in n.attrs]
        found: dict[int, Node] = {}
        for parent in among:
            kids = [c for c in parent.children if isinstance(c, Node) and name in ("*", c.tag)]
            for condition in conditions:
                kids = kids[condition - 1 : condition] if isinstance(condition, int) else [k for k in kids if condition(k)]
            found |= {id(k): k for k in kids}
        here = list(found.values())
        if len(here) > 1 and len(among) > 1:
            here = [n for n in root.below() if id(n) in found]
    return here


def _said(found: Node | str) -> str:
    return " ".join((found if isinstance(found, str) else found.text()).split())


def first_text(rows: DataFrame, html: str, paths: list[str], name: str = "text") -> DataFrame:
    """``rows`` with ``name``: the first filled text that ``paths`` find, tried one after the other; null if none does.

    White space within a text is one space. Null and empty pages find nothing.
    """
    for path in paths:
        _steps(path)

    def search(page: str | None) -> str | None:
        if not page:
            return None
        root = tree(page)
        return next((t for p in paths for n in follow(root, p) if (t := _said(n))), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index(html))
            texts = pa.array([search(p.as_py()) for p in pages], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` string")


def found_texts(rows: DataFrame, key: str, html: str, path: str) -> DataFrame:
    """(key, pos, text): all that ``path`` finds in each page, in document order from 0."""
    _steps(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                page = batch.column(1)[i].as_py()
                texts = [_said(n) for n in follow(tree(page), path)] if page else []
                keys = batch.column(0).slice(i, 1).take(pa.array([0] * len(texts), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=[key, "pos", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(html).cast("string").alias("__html")).mapInArrow(run, f"{key} {kind}, pos long, text string")
