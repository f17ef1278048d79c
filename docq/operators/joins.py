"""Joins: pairing, anti and semi joins, box matching inside a document.

Joins between boxes are equi-joins on the document with a predicate; a document
is a page, so its boxes are few, and no join crosses documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docq.functions import geom
from docq.operators.lineage import cut


def pair(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, reasons): rows on both sides, and keys of one side with the side that lacks them."""
    pairs = left.join(right, on)
    sides = left.select(on).distinct().withColumn("l", F.lit(True)).join(right.select(on).distinct().withColumn("r", F.lit(True)), on, "full_outer")
    reasons = sides.where("l is null or r is null").select(on, F.when(F.col("l").isNull(), "no_left").otherwise("no_right").alias("reason"))
    return pairs, reasons


def assemble_docs(images: DataFrame, layout: DataFrame, texts: DataFrame, on: str) -> DataFrame:
    """Images with their boxes counted and their fields as a map; images drive.
    texts: on, field, value (of repeated fields the largest value)."""
    boxes = layout.groupBy(on).agg(F.count("*").alias("n_layout"))
    one = texts.groupBy(on, "field").agg(F.max("value").alias("value"))
    fields = one.groupBy(on).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return images.join(boxes, on, "left").join(fields, on, "left").fillna(0, ["n_layout"])


def eval_left(gt: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """gt with its predictions; status tells where there is none."""
    return gt.join(pred.withColumn("found_", F.lit(True)), on, "left").withColumn("status", F.when(F.col("found_"), "ok").otherwise("missing_prediction")).drop("found_")


def unseen(df: DataFrame, seen: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(seen, on, "left_anti")


def restrict(df: DataFrame, allow: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(allow, on, "left_semi")


def lookup(df: DataFrame, dim: DataFrame, on: str | list[str]) -> DataFrame:
    """df with the columns of a dimension table; Spark broadcasts it where it is small."""
    return df.join(dim, on, "left")


def todo(targets: DataFrame, done: DataFrame, on: str, ok: Column) -> DataFrame:
    """Targets without a result that is ok."""
    return targets.join(done.where(ok).select(on).distinct(), on, "left_anti")


def control_group(df: DataFrame, bad: DataFrame, on: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows that are not in `bad`, drawn by a hash of their key."""
    from docq.functions.ids import draw

    return df.join(bad, on, "left_anti").orderBy(draw(seed, *[F.col(c).cast("string") for c in on]), *on).limit(n)


def expand_templates(templates: DataFrame, fields: DataFrame) -> DataFrame:
    """Every template with every field: two lists of fixed size, the larger streamed."""
    return F.broadcast(templates).crossJoin(fields)


def contains(fields: DataFrame, texts: DataFrame, on: str, value: str, text: str) -> DataFrame:
    """fields with found: whether the document's text has the value."""
    return fields.join(texts, on).withColumn("found", F.col(text).contains(F.col(value)))


def _sides(a: DataFrame, b: DataFrame, doc: str, idx: str) -> DataFrame:
    """Pairs of boxes of one document: a_idx, a_x1.., b_idx, b_x1.."""
    cols = ("x1", "y1", "x2", "y2")
    left = a.select(doc, F.col(idx).alias("a_idx"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(doc, F.col(idx).alias("b_idx"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return left.join(right, doc)


def _chebyshev() -> Column:
    return F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in ("x1", "y1", "x2", "y2")])


def box_proximity(blocks: DataFrame, boxes: DataFrame, doc: str, idx: str, tol: float = 6) -> DataFrame:
    """doc, a_idx, b_idx: the first box (by idx) whose coordinates all differ by less than tol."""
    near = _sides(blocks, boxes, doc, idx).where(_chebyshev() < tol)
    return near.groupBy(doc, "a_idx").agg(F.min("b_idx").alias("b_idx"))


def nearest_box(boxes: DataFrame, blocks: DataFrame, doc: str, idx: str, tol: float = 3.0) -> DataFrame:
    """doc, a_idx, b_idx: the nearest block within tol; of equal ones the last."""
    near = _sides(boxes, blocks, doc, idx).withColumn("d", _chebyshev()).where(F.col("d") <= tol)
    return near.groupBy(doc, "a_idx").agg(F.min_by("b_idx", F.struct("d", (-F.col("b_idx")).alias("i"))).alias("b_idx"))


def enclosing_box(boxes: DataFrame, blocks: DataFrame, doc: str, idx: str, slack: float = 4.0) -> DataFrame:
    """doc, a_idx, b_idx: the smallest other block around a box, with slack."""
    p = _sides(boxes, blocks, doc, idx)
    a, b = geom.box("a_"), geom.box("b_")
    around = (b[0] <= a[0] + slack) & (b[1] <= a[1] + slack) & (b[2] >= a[2] - slack) & (b[3] >= a[3] - slack)
    inside = p.where(around & (F.col("a_idx") != F.col("b_idx"))).withColumn("size", geom.area(b))
    return inside.groupBy(doc, "a_idx").agg(F.min_by("b_idx", F.struct("size", "b_idx")).alias("b_idx"))


def iou_match(gt: DataFrame, pred: DataFrame, doc: str, idx: str, thr: float = 0.5) -> DataFrame:
    """doc, a_idx, b_idx, iou, coverage, matched for every gt box.  A gt tries its
    best prediction alone; of the gts that share one, the first by idx has it."""
    p = _sides(gt, pred, doc, idx).withColumn("iou", geom.iou(geom.box("a_"), geom.box("b_"))).withColumn("coverage", geom.coverage(geom.box("a_"), geom.box("b_")))
    best = p.groupBy(doc, "a_idx").agg(
        F.max_by(F.struct("b_idx", "iou"), F.struct("iou", (-F.col("b_idx")).alias("i"))).alias("m"), F.max("coverage").alias("coverage")
    )
    best = best.select(doc, "a_idx", "m.b_idx", "m.iou", "coverage").withColumn("hit", F.col("iou") >= thr)
    nth = F.row_number().over(Window.partitionBy(doc, "b_idx", "hit").orderBy("a_idx"))
    every = gt.select(doc, F.col(idx).alias("a_idx")).join(best.withColumn("nth", nth), [doc, "a_idx"], "left")
    return every.select(
        doc, "a_idx", "b_idx", F.coalesce("iou", F.lit(0.0)).alias("iou"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce(F.col("hit") & (F.col("nth") == 1), F.lit(False)).alias("matched"),
    )


#: Pairs of a document up to which one task folds them; a document with more is matched in rounds.
FOLD_PAIRS = 2000


def _greedy(pairs: DataFrame, doc: str, keys: list, a_keys: list, b_keys: list) -> DataFrame:
    """The pairs (doc, a_idx, b_idx, ...) that are taken when all go by `keys`, least first,
    and each is taken while both its sides are unused.

    a_keys, b_keys: what orders the pairs of one a, of one b, in the same way.
    Documents of at most FOLD_PAIRS pairs are folded as one array.  In a larger
    one, a pair that comes first for both its sides is taken whatever else is, so
    all such pairs are taken at once, those they rule out are dropped, and so on until
    none is left: joins and aggregates on (doc, side), no task holds a document.
    Sides are not null; null docs are one document.
    """
    pairs = cut(pairs)
    names = pairs.columns
    large = pairs.groupBy(F.col(doc).alias("d_")).agg(F.count("*").alias("n")).where(F.col("n") > FOLD_PAIRS).select("d_")
    if large.isEmpty():
        return _folded(pairs, doc, keys)
    # A large document has thousands of pairs; there may still be many, so no hint.
    same = F.col(doc).eqNullSafe(F.col("d_"))
    live, out = cut(pairs.join(large, same, "left_semi")), _folded(pairs.join(large, same, "left_anti"), doc, keys)
    while not live.isEmpty():
        firsts = [
            live.groupBy(F.col(doc).alias("d_"), side).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("p")).select("p.*")
            for side, order in (("a_idx", a_keys), ("b_idx", b_keys))
        ]
        other = firsts[1].select(F.col(doc).alias("d_"), F.col("a_idx").alias("a_"), F.col("b_idx").alias("b_"))
        both = F.col(doc).eqNullSafe(F.col("d_")) & (F.col("a_idx") == F.col("a_")) & (F.col("b_idx") == F.col("b_"))
        taken = cut(firsts[0].join(other, both, "left_semi"))
        out = out.unionByName(taken)
        for side in ("a_idx", "b_idx"):
            used = taken.select(F.col(doc).alias("d_"), F.col(side).alias("s_"))
            live = live.join(used, F.col(doc).eqNullSafe(F.col("d_")) & (F.col(side) == F.col("s_")), "left_anti")
        live = cut(live)
    return out


def _folded(pairs: DataFrame, doc: str, keys: list) -> DataFrame:
    names = pairs.columns
    # Keys come first and are told apart by place, so that they order the array.
    one = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*names).alias("p"))
    kinds = dict(pairs.dtypes)
    rest = ",".join(f"`{n}`:{kinds[n]}" for n in names)
    start = F.expr(f"named_struct('a', cast(array() as array<{kinds['a_idx']}>), 'b', cast(array() as array<{kinds['b_idx']}>), 'out', cast(array() as array<struct<{rest}>>))")

    def step(acc, x):
        free = ~F.array_contains(acc["a"], x["p"]["a_idx"]) & ~F.array_contains(acc["b"], x["p"]["b_idx"])
        more = F.struct(F.array_append(acc["a"], x["p"]["a_idx"]).alias("a"), F.array_append(acc["b"], x["p"]["b_idx"]).alias("b"), F.array_append(acc["out"], x["p"]).alias("out"))
        return F.when(free, more).otherwise(acc)

    folded = F.aggregate(F.sort_array(F.collect_list(one)), start, step, lambda acc: acc["out"])
    return pairs.groupBy(F.col(doc).alias("d_")).agg(folded.alias("out")).select(F.inline("out"))


def _near(a: DataFrame, b: DataFrame, doc: str, idx: str, max_dist: float) -> DataFrame:
    """doc, a_idx, b_idx, d: boxes less than max_dist apart in L1.  Boxes meet by cells of
    that size: a box of b is in its own cell, one of a looks into the nine around it."""
    size = float(max_dist)

    def sided(df: DataFrame, side: str) -> DataFrame:
        names = [F.col(c).cast("double").alias(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2")]
        out = df.select(F.col(doc).alias(f"{side}_doc"), F.col(idx).alias(f"{side}_idx"), *names)
        return out.withColumns({f"{side}_{c}c": F.floor(F.col(f"{side}_{c}") / size) for c in ("x1", "y1")})

    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    looks = sided(a, "a").withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    here = sided(b, "b")
    on = F.col("a_doc").eqNullSafe(F.col("b_doc")) & (F.col("a_x1c") + F.col("dx") == F.col("b_x1c")) & (F.col("a_y1c") + F.col("dy") == F.col("b_y1c"))
    d = sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in ("x1", "y1", "x2", "y2")), F.lit(0.0))
    return looks.join(here, on).withColumn("d", d).where(F.col("d") < size).select(F.col("a_doc").alias(doc), "a_idx", "b_idx", "d")


def matched_l1(a: DataFrame, b: DataFrame, doc: str, idx: str, max_dist: float = 60, docs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """doc, a, b: each box of a in their order with the nearest unused box of b (ties: the smaller idx)
    under max_dist, and the boxes of either left over; a and b are structs of the other columns, null
    where there is none.

    Documents of at most FOLD_PAIRS possible pairs and as many boxes are folded as arrays, in one
    shuffle.  Boxes are counted first, from docs where it is given: frames with the doc of each row of a and
    of b, for inputs that are dear to compute twice.  In a larger document boxes meet by cells (_near) and
    are matched in rounds (_greedy).  Null docs are one document.
    """
    sides = {"a": a, "b": b}
    counted = dict(zip(sides, docs or (a, b), strict=True))
    ones = [df.select(F.col(doc).alias("d_"), *[F.lit(int(n == m)).cast("long").alias(f"{m}_") for m in sides]) for n, df in counted.items()]
    sizes = ones[0].unionByName(ones[1]).groupBy("d_").agg(F.sum("a_").alias("a_"), F.sum("b_").alias("b_"))
    large = cut(sizes.where((F.col("a_") * F.col("b_") > FOLD_PAIRS) | (F.col("a_") + F.col("b_") > FOLD_PAIRS)).select("d_"))
    whole = large.isEmpty()
    if not whole:
        sides = {n: cut(df) for n, df in sides.items()}
    packed = {n: df.select(doc, F.struct(idx, *[c for c in df.columns if c not in (doc, idx)]).alias(n)) for n, df in sides.items()}
    kinds = {n: dict(df.dtypes)[n] for n, df in packed.items()}
    if whole:
        return _matched_folded(packed, kinds, doc, idx, max_dist)
    same = F.col(doc).eqNullSafe(F.col("d_"))
    out = _matched_folded({n: df.join(large, same, "left_anti") for n, df in packed.items()}, kinds, doc, idx, max_dist)
    near = _near(*[df.join(large, same, "left_semi") for df in sides.values()], doc, idx, max_dist)
    pairs = cut(_greedy(near, doc, [F.col("a_idx"), F.col("d"), F.col("b_idx")], ["d", "b_idx"], ["a_idx", "d"]).select(F.col(doc).alias("d_"), "a_idx", "b_idx"))
    left, right = (packed[n].join(large, same, "left_semi") for n in sides)
    left = left.join(pairs, same & (F.col(f"a.{idx}") == F.col("a_idx")), "left").select(doc, "a", "b_idx")
    here = right.select(F.col(doc).alias("d_"), "b")
    out = out.unionByName(left.join(here, same & (F.col("b_idx") == F.col(f"b.{idx}")), "left").select(doc, "a", "b"))
    rest = right.join(pairs, same & (F.col(f"b.{idx}") == F.col("b_idx")), "left_anti")
    return out.unionByName(rest.select(doc, F.lit(None).cast(kinds["a"]).alias("a"), "b"))


def _matched_folded(packed: dict[str, DataFrame], kinds: dict[str, str], doc: str, idx: str, max_dist: float) -> DataFrame:
    """matched_l1 with a document's boxes as two arrays."""
    size = float(max_dist)
    none = {n: F.lit(None).cast(kinds[n]).alias(n) for n in kinds}
    rows = packed["a"].select(doc, "a", none["b"]).unionByName(packed["b"].select(doc, none["a"], "b"))
    each = rows.groupBy(doc).agg(F.sort_array(F.collect_list("a")).alias("a"), F.collect_list("b").alias("b"))
    start = F.struct(F.col("b").alias("left"), F.expr(f"cast(array() as array<struct<a:{kinds['a']},b:{kinds['b']}>>)").alias("out"))

    def far(x, y):
        return sum((F.abs(x[c].cast("double") - y[c].cast("double")) for c in ("x1", "y1", "x2", "y2")), F.lit(0.0))

    def step(acc, x):
        # The struct's order: by distance, then by idx.
        y = F.array_min(F.filter(F.transform(acc["left"], lambda y: F.struct(far(x, y).alias("d"), y.alias("y"))), lambda c: c["d"] < size))["y"]
        # One element, so that the search is made once.
        return F.element_at(F.transform(F.array(y), lambda y: F.struct(
            F.when(y.isNull(), acc["left"]).otherwise(F.filter(acc["left"], lambda o: o[idx] != y[idx])).alias("left"),
            F.array_append(acc["out"], F.struct(x.alias("a"), y.alias("b"))).alias("out"),
        )), 1)

    over = F.aggregate("a", start, step, lambda acc: F.concat(acc["out"], F.transform(acc["left"], lambda y: F.struct(none["a"], y.alias("b")))))
    return each.select(doc, F.inline(over))


_CORNERS = ("x1", "y1", "x2", "y2")


def greedy_l1(a: DataFrame, b: DataFrame, doc: str, idx: str, max_dist: float = 60) -> DataFrame:
    """doc, a_idx, b_idx: in the order of a, the nearest unused box of b (ties: the smaller idx), if under max_dist."""
    return greedy_l1_outer(a, b, doc, idx, max_dist).where("a_idx is not null and b_idx is not null")


def greedy_l1_outer(a: DataFrame, b: DataFrame, doc: str, idx: str, max_dist: float = 60) -> DataFrame:
    """doc, a_idx, b_idx: the pairs of greedy_l1 and the boxes it leaves over, null on the other side."""
    m = matched_l1(*[df.select(doc, idx, *_CORNERS) for df in (a, b)], doc, idx, max_dist)
    return m.select(doc, F.col(f"a.{idx}").alias("a_idx"), F.col(f"b.{idx}").alias("b_idx"))


def greedy_best(pairs: DataFrame, doc: str, score: str) -> DataFrame:
    """doc, a_idx, b_idx, score: pairs by (score, a_idx, b_idx) descending, taken while both are unused.
    Sides are whole numbers; a null score comes last."""
    pairs = pairs.select(doc, "a_idx", "b_idx", score)
    last = F.col(score).isNull()
    down = [last, -F.col(score), -F.col("a_idx"), -F.col("b_idx")]
    return _greedy(pairs, doc, down, [*down[:2], down[3]], down[:3])


def span_overlap(spans: DataFrame, targets: DataFrame, doc: str, value: str) -> DataFrame:
    """targets (doc, start, end) with the least value of the spans that overlap them."""
    s = spans.select(doc, F.col("start").alias("s_"), F.col("end").alias("e_"), F.col(value).alias("v_"))
    hit = targets.join(s, (targets[doc] == s[doc]) & (s["s_"] < targets["end"]) & (s["e_"] > targets["start"]), "left").drop(s[doc])
    return hit.groupBy(*targets.columns).agg(F.min("v_").alias(value))


def reading_inversions(blocks: DataFrame, doc: str, idx: str, slack: float = 8, gap: float = 12) -> DataFrame:
    """doc, inversions: pairs in reading order of which the later ends clearly above the earlier, neither inside the other."""
    p = _sides(blocks, blocks, doc, idx).where("a_idx < b_idx")
    a, b = geom.box("a_"), geom.box("b_")

    def inside(x, y):
        return (x[0] >= y[0] - slack) & (x[1] >= y[1] - slack) & (x[2] <= y[2] + slack) & (x[3] <= y[3] + slack)

    wrong = p.where(~inside(a, b) & ~inside(b, a) & (b[3] + gap < a[1])).groupBy(doc).agg(F.count("*").alias("inversions"))
    return blocks.select(doc).distinct().join(wrong, doc, "left").fillna(0, ["inversions"])


def run_diff(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """on, change: only_a, only_b, filled, emptied or changed; equal rows are left out."""
    left, right = a.select(*on, F.col(value).alias("va")).withColumn("ina", F.lit(True)), b.select(*on, F.col(value).alias("vb")).withColumn("inb", F.lit(True))
    x, y = F.coalesce(F.col("va").cast("string"), F.lit("")), F.coalesce(F.col("vb").cast("string"), F.lit(""))
    change = (
        F.when(F.col("inb").isNull(), "only_a").when(F.col("ina").isNull(), "only_b").when((x == "") & (y != ""), "filled").when((x != "") & (y == ""), "emptied").when(x != y, "changed")
    )
    return left.join(right, on, "full_outer").select(*on, change.alias("change")).where("change is not null")
