"""HTML and Markdown tables as cells, and tree similarity of two tables."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType


_TAG = r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_-]*="[^"<>&]*")*)[ \t\n\r\f]*>'
_TOKEN = re.compile(f"{_TAG}|([^<&]+)")
_PLAIN = re.compile(f"(?>{_TAG}|[^<&]+)*+")
_PAIR = re.compile(r'([a-zA-Z0-9_-]+)="([^"]*)"')
# Tags that plain reading may not take: what follows them is read in other ways.
_APART = re.compile(r"(?i)<(?:script|style|textarea|title|plaintext|xmp|iframe|noembed|noframes|noscript)|</[^>]*=")


@lru_cache(maxsize=10_000)
def _attrs(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((k.lower(), v) for k, v in _PAIR.findall(text))


def _read(parser: HTMLParser, html: str) -> None:
    """What feed and close do; texts of plain tags, quoted attributes and no references
    are split by one expression, which is several times faster."""
    if not _PLAIN.fullmatch(html) or _APART.search(html):
        parser.feed(html)
        parser.close()
        return
    start, end, data = parser.handle_starttag, parser.handle_endtag, parser.handle_data
    for shut, tag, attrs, text in _TOKEN.findall(html):
        if text:
            data(text)
        elif shut:
            end(tag.lower())
        else:
            start(tag.lower(), _attrs(attrs) if attrs else ())


class _Rows(HTMLParser):
    """Rows of (text, rowspan, colspan, head) of the tables of a text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            a = dict(attrs)
            spans = [int(a[k]) if (a.get(k) or "").isdigit() and int(a[k]) > 0 else 1 for k in ("rowspan", "colspan")]
            self.cell = ["", *spans, tag == "th"]
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def rows_of(html: str | None) -> list[list[list]]:
    p = _Rows()
    _read(p, html or "")
    return p.rows


def grid_of(html: str | None, repeat: bool = False) -> list[tuple[int, int, str, bool]]:
    """(row, col, text, origin) with spans spread over the grid; covered places repeat nothing, or the text."""
    out, taken = [], set()
    for r, row in enumerate(rows_of(html)):
        c = 0
        for text, rs, cs, _ in row:
            while (r, c) in taken:
                c += 1
            text = " ".join(text.split())
            for i in range(rs):
                for j in range(cs):
                    taken.add((r + i, c + j))
                    out.append((r + i, c + j, text if repeat or not (i or j) else "", not (i or j)))
            c += cs
    return sorted(out)


def cells(df: DataFrame, doc: str, html: str, repeat: bool = False) -> DataFrame:
    """doc, row, col, text, origin: every place of the grid of a text's tables."""
    kind = dict(df.dtypes)[doc]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(d, *c) for d, h in zip(f[doc], f[html], strict=True) for c in grid_of(h, repeat)]
            yield pd.DataFrame(out, columns=[doc, "row", "col", "text", "origin"])

    return df.select(doc, html).mapInPandas(run, f"{doc} {kind}, row int, col int, text string, origin boolean")


def plain_cells(df: DataFrame, doc: str, html: str) -> DataFrame:
    """doc, row, col, text of tables without spans, with built-in functions alone."""
    rows = df.select(doc, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    c = rows.select(doc, "row", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col", "td"))
    return c.select(doc, "row", "col", F.trim(F.regexp_replace(F.regexp_replace("td", "<[^>]+>", ""), r"\s+", " ")).alias("text"))


@F.pandas_udf(StringType())
def html_to_md(s: pd.Series) -> pd.Series:
    """A Markdown table: rows padded to the widest, spans as blanks, empty rows dropped; null without rows."""

    def one(html):
        grid: dict[int, dict[int, str]] = {}
        for r, c, text, _ in grid_of(html):
            grid.setdefault(r, {})[c] = text.replace("|", "\\|")
        rows = [g for _, g in sorted(grid.items()) if any(g.values())]
        if not rows:
            return None
        width = max(max(g) for g in rows) + 1
        lines = ["| " + " | ".join(g.get(c, "") for c in range(width)) + " |" for g in rows]
        return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])

    return s.map(one)


def md_rows(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, pos, name, qty, amount of lines | name | qty | amount |."""
    lines = df.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    row = r"^\s*\|\s*([^|]+?)\s*\|\s*([0-9,]+)\s*\|\s*([0-9,]+)\s*\|\s*$"
    hit = lines.where(F.col("line").rlike(row))
    return hit.select(
        doc, "pos", F.regexp_extract("line", row, 1).alias("name"), *[F.replace(F.regexp_extract("line", row, i), F.lit(","), F.lit("")).cast("bigint").alias(n) for i, n in ((2, "qty"), (3, "amount"))]
    )


def extract_all(text: Column) -> Column:
    """Every table of a text, as an array."""
    return F.regexp_extract_all(text, F.lit(r"(?is)<table.*?</table>"), F.lit(0))


@lru_cache(maxsize=100_000)
def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


# Tags whose text belongs to the cell around them.
INLINE = ("b", "i", "u", "sup", "sub", "br", "span")
SECTIONS = ("thead", "tbody", "tfoot")
ENDED_BY = {"td": ("td",), "tr": ("td", "tr")} | {s: ("td", "tr", *SECTIONS) for s in SECTIONS}


class _Tree(HTMLParser):
    """Nodes of one table in post-order: (label, leftmost leaf)."""

    def __init__(self, structure_only: bool):
        super().__init__(convert_charrefs=True)
        self.structure_only = structure_only
        self.nodes: list[tuple] = []
        self.open: list[tuple] = []
        self.inner: list[str] = []
        self.text = ""

    def shut(self):
        label, first = self.open.pop()
        if label[0] == "td":
            label, self.text, self.inner = (*label[:3], "" if self.structure_only else " ".join(self.text.split())), "", []
        self.nodes.append((label, first))

    def handle_starttag(self, tag, attrs):
        tag = "td" if tag == "th" else tag
        while self.open and self.open[-1][0][0] in ENDED_BY.get(tag, ()):
            self.shut()
        if self.open and self.open[-1][0][0] == "td":
            if tag not in ("br", "img", "hr", "input"):
                self.inner.append(tag)
            return
        a = dict(attrs)
        spans = [int(a[k]) if tag == "td" and (a.get(k) or "").isdigit() else 1 for k in ("rowspan", "colspan")]
        self.open.append(((tag, *spans, ""), len(self.nodes)))
        if tag in ("col", "br", "img", "hr", "input"):
            self.shut()

    def handle_endtag(self, tag):
        tag = "td" if tag == "th" else tag
        if tag in self.inner:
            del self.inner[len(self.inner) - 1 - self.inner[::-1].index(tag) :]
        elif tag in (label[0] for label, _ in self.open):
            while self.open[-1][0][0] != tag:
                self.shut()
            self.shut()

    def handle_data(self, data):
        if self.open and self.open[-1][0][0] == "td" and all(t in INLINE for t in self.inner):
            self.text += data


def _table_tree(html: str, structure_only: bool = False) -> list[tuple]:
    """Nodes of a table in post-order: (label, leftmost leaf).  Sections and rows are
    nodes; heads are cells; labels of cells carry spans and text."""
    p = _Tree(structure_only)
    _read(p, html)
    while p.open:
        p.shut()
    return p.nodes


def _label_cost(x: tuple, y: tuple) -> float:
    if x == y:
        return 0.0
    if x[:3] != y[:3]:
        return 1.0
    most = max(len(x[3]), len(y[3]))
    return _levenshtein(x[3], y[3]) / most if most else 0.0


def tree_distance(a: list[tuple], b: list[tuple]) -> float:
    """Edit distance of two post-order trees: 1 for a node removed or inserted, up to 1 for a
    changed label.

    Trees of one shape are at most as far as their labels place by place; where no labels
    of a come nearer to b's than that, they are that far."""

    if a == b:
        return 0.0
    if [left for _, left in a] == [left for _, left in b]:
        most = sum(_label_cost(x, y) for (x, _), (y, _) in zip(a, b, strict=True))
        labels = {y for y, _ in b}
        # Each node of a is removed, for 1, or meets a label of b; inserted nodes cost besides.
        least = sum(min(1.0, *(_label_cost(x, y) for y in labels)) for x, _ in a if x not in labels)
        if most <= least:
            return most
    return _zhang_shasha(a, b)


def _zhang_shasha(a: list[tuple], b: list[tuple]) -> float:
    def keyroots(t):
        return sorted({left: i for i, (_, left) in enumerate(t)}.values())

    dist = [[0.0] * len(b) for _ in a]
    for i in keyroots(a):
        for j in keyroots(b):
            la, lb = a[i][1], b[j][1]
            if la == i and lb == j:  # two leaves: no cost is over 1, a removal and an insertion are 2
                dist[i][j] = _label_cost(a[i][0], b[j][0])
                continue
            f = [[0.0] * (j - lb + 2) for _ in range(i - la + 2)]
            for x in range(1, i - la + 2):
                f[x][0] = x
            for y in range(1, j - lb + 2):
                f[0][y] = y
            for x in range(1, i - la + 2):
                for y in range(1, j - lb + 2):
                    p, q = la + x - 1, lb + y - 1
                    whole = a[p][1] == la and b[q][1] == lb
                    join = f[x - 1][y - 1] + _label_cost(a[p][0], b[q][0]) if whole else f[a[p][1] - la][b[q][1] - lb] + dist[p][q]
                    f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, join)
                    if whole:
                        dist[p][q] = f[x][y]
    return dist[-1][-1]


def teds(ref: Column | str, hyp: Column | str, structure_only: bool = False) -> Column:
    """Tree similarity of the first tables of two texts, 1 for equal ones: null
    without a whole table in ref, 0 without one in hyp; one less the edit distance
    over the larger tree.  structure_only: texts of cells do not count.

    Its cost is the product of the two trees' sizes and more; equal trees are settled at once.
    """

    def one(r, h):
        r, h = (re.search(r"(?is)<table\b.*?</table>", x or "") for x in (r, h))
        if not r or not h:
            return 0.0 if r else None
        if r.group() == h.group():
            return 1.0
        a, b = (_table_tree(x.group(), structure_only) for x in (r, h))
        return max(0.0, 1 - tree_distance(a, b) / max(len(a), len(b)))

    @F.pandas_udf(DoubleType())
    def score(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        return pd.Series([one(r, h) for r, h in zip(ref, hyp, strict=True)], dtype="float64")

    return score(ref, hyp)


def _layout(structure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """row, col, is_head, origin and the cell's number (-1: none) of every place of a table."""
    rows, head, n = [], False, 0
    for end, tag, attrs in re.findall(r"<(/?)(thead|tr|td|th)\b([^>]*)>", structure):
        if tag == "thead":
            head = not end
        elif tag == "tr" and not end:
            rows.append([])
        elif tag != "tr" and not end:
            spans = dict(re.findall(r'(rowspan|colspan)="(\d+)"', attrs))
            if rows:
                rows[-1].append((n, head, int(spans.get("rowspan", 1)), int(spans.get("colspan", 1))))
            n += 1
    width = max((sum(cell[3] for cell in row) for row in rows), default=0)
    places = {}
    for r, row in enumerate(rows):
        for cell, in_head, rs, cs in row:
            c = next((c for c in range(width) if (r, c) not in places), None)
            if c is None:
                break
            places |= {(i, j): (-1, in_head, False) for i in range(r, min(r + rs, len(rows))) for j in range(c, min(c + cs, width))}
            places[r, c] = (cell, in_head, True)
    every = [places.get((r, c), (-1, False, True)) for r in range(len(rows)) for c in range(width)]
    at = np.arange(len(every), dtype="int32")
    return at // max(width, 1), at % max(width, 1), np.array([p[1] for p in every], bool), np.array([p[2] for p in every], bool), [p[0] for p in every]


# Many tables have one structure; long ones are not held.
_held_layout = lru_cache(maxsize=256)(_layout)
HELD_STRUCTURE = 10_000


def _placed(structure: str, texts: list[str]) -> tuple[tuple, list[str]]:
    layout = (_held_layout if len(structure) <= HELD_STRUCTURE else _layout)(structure)
    clean = [" ".join((re.sub(r"</?(?:b|i|sup|sub|em|strong|u|small)>", "", t) if "<" in t else t).split()) if t else "" for t in texts]
    n = len(clean)
    return layout, [clean[k] if 0 <= k < n else "" for k in layout[4]]


def token_grid(structure: list[str], texts: list[str]) -> list[tuple[int, int, str, bool, bool]]:
    """(row, col, text, is_head, origin) of every place of a table.  Its width is the widest
    row's sum of column spans; spans end at its edges, and places without a cell are empty origins."""
    (row, col, head, origin, _), placed = _placed("".join(structure), list(texts))
    return list(zip(row.tolist(), col.tolist(), placed, head.tolist(), origin.tolist(), strict=True))


def grid_from_tokens(df: DataFrame, doc: str, structure: str, cells_: str) -> DataFrame:
    """doc, row, col, text, is_head, origin from a table's structure tokens and its cells' texts.
    structure: array of tags and attributes; cells_: array of texts, one for each cell in order.
    A null array is an empty one."""
    kind = dict(df.dtypes)[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            each, texts = [], []
            for s, t in zip(f.column(1).to_pylist(), f.column(2).to_pylist(), strict=True):
                layout, placed = _placed(s or "", t or [])
                each.append(layout)
                texts += placed
            if texts:
                of = np.repeat(np.arange(len(each)), [len(x[0]) for x in each])
                row, col, head, origin = (np.concatenate([x[i] for x in each]) for i in range(4))
                out = [f.column(0).take(pa.array(of)), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(texts, pa.string()), pa.array(head), pa.array(origin)]
                yield pa.RecordBatch.from_arrays(out, [doc, "row", "col", "text", "is_head", "origin"])

    return df.select(doc, F.array_join(structure, ""), cells_).mapInArrow(run, f"{doc} {kind}, row int, col int, text string, is_head boolean, origin boolean")


@F.pandas_udf(ArrayType(StructType().add("gt_row", "integer").add("pred_row", "integer")))
def seq_align(gt: pd.Series, pred: pd.Series) -> pd.Series:
    """Pairs of places by difflib's edit script: equal and replaced runs pair row by
    row; what is deleted, inserted or over in a replaced run has null on the other side."""

    def one(a, b):
        a, b = [list(x) if x is not None else [] for x in (a, b)]
        if a == b:
            return [{"gt_row": k, "pred_row": k} for k in range(len(a))]
        out = []
        for _, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for k in range(max(i2 - i1, j2 - j1)):
                out.append({"gt_row": i1 + k if i1 + k < i2 else None, "pred_row": j1 + k if j1 + k < j2 else None})
        return out

    return pd.Series([one(a, b) for a, b in zip(gt, pred, strict=True)], dtype=object)


def row_alignment(df: DataFrame, doc: str, gt: str, pred: str) -> DataFrame:
    """doc, gt_row, pred_row of every row of both sides: pred_row is null for a
    missing row, gt_row for a spurious one.  gt and pred: arrays with the name of each row."""
    return df.select(doc, F.explode(seq_align(gt, pred)).alias("m")).select(doc, "m.gt_row", "m.pred_row")


def find_labeled(cells_: DataFrame, doc: str, keys: tuple[str, ...], name: str, texts: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc, name: in the first row whose cells hold one of the keys and a whole
    number after the first cell (or in it, if it is the only one), that number; else,
    with texts, the last number of the first line that holds a key and a number.
    cells_: doc, row, col, text; texts: doc and a column of lines."""

    def holds(c: Column) -> Column:
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.replace(c, F.lit(" "), F.lit("")).contains(k)
        return hit

    rows = cells_.groupBy(doc, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("c")).withColumn("t", F.col("c.text"))
    right = F.when(F.size("t") > 1, F.slice("t", F.lit(2), F.size("t"))).otherwise(F.col("t"))
    numbers = F.filter(F.transform(right, lambda x: F.regexp_replace(x, "[, ]", "")), lambda x: x.rlike("^-?[0-9]+$"))
    found = rows.where(holds(F.array_join("t", ""))).select(doc, "row", F.get(numbers, F.lit(0)).cast("bigint").alias("v")).where("v is not null")
    found = found.groupBy(doc).agg(F.min_by("v", "row").alias(name))
    if texts is None:
        return found
    lines = texts.select(doc, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line", "t")).where(holds(F.col("t")))
    last = F.replace(F.element_at(F.regexp_extract_all("t", F.lit("-?[0-9][0-9,]*"), F.lit(0)), -1), F.lit(","), F.lit(""))
    told = lines.where(F.col("t").rlike("[0-9]")).groupBy(doc).agg(F.min_by(last, "line").cast("bigint").alias("told_"))
    return found.join(told, doc, "full_outer").select(doc, F.coalesce(name, "told_").alias(name))
