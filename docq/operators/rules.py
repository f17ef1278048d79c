"""Quality rules: each adds a flag, count or reason column, or keeps rows.

Rules on lines or tokens work on arrays inside the row, so a text never becomes
rows that have to be gathered again; only rules across rows shuffle, on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases with which a parser describes a page instead of reading it.
META_DOC = (
    "the image displays", "the image shows", "the image appears", "appears to be", "without additional context",
    "for the purpose of this task", "it is challenging to determine", "if this is part of", "i cannot", "unable to read",
    "the extracted text from the image", "further information would be necessary", "possibly forming a pattern",
)
META_BLOCK = (
    "the image displays", "the image shows", "the image appears", "without additional context", "for the purpose of this task",
    "it is challenging to determine", "the extracted text from the image", "further information would be necessary",
    "possibly forming a pattern", "appears to be a single, continuous",
)
RISING = r"(?:[0-9]{3,4}\s*[-–]\s*[0-9]{3,4}\s+)"
PII = (r"[0-9]{3}-[0-9]{2}-[0-9]{5}", r"0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}", r"[0-9]{4}-[0-9*]{4}-[0-9*]{4}-[0-9*]{4}", r"(?:시|군|구|로|길) ?[0-9]+")
PII_LABELS = ("doc_title", "header", "footer")
MONEY_FIELDS = ("subtotal", "tax", "total")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")


def _most(values: Column) -> Column:
    """Largest number of equal entries of an array, by runs of its sorted form."""
    run = F.aggregate(
        F.array_sort(values),
        F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, x: F.struct(
            x.alias("last"),
            F.when(x.eqNullSafe(acc["last"]), acc["run"] + 1).otherwise(1).alias("run"),
            F.greatest(acc["best"], F.when(x.eqNullSafe(acc["last"]), acc["run"] + 1).otherwise(1)).alias("best"),
        ),
        lambda acc: acc["best"],
    )
    return F.coalesce(run, F.lit(0))


def length_flag(df: DataFrame, text: str, lo: int = 30, hi: int = 8000) -> DataFrame:
    n = F.length(text)
    return df.withColumn("length_flag", F.when(n < lo, "short").when(n > hi, "long"))


def repeated_line(df: DataFrame, text: str, min_count: int = 4, min_len: int = 6) -> DataFrame:
    """repeated_line: whether a stripped line of min_len characters or more occurs min_count times."""
    lines = F.filter(_lines(F.col(text)), lambda x: F.length(x) >= min_len)
    return df.withColumn("repeated_line", F.coalesce(_most(lines) >= min_count, F.lit(False)))


def line_surplus(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, surplus: the sum of count - 2 over lines that occur three times or more."""
    lines = df.select(doc, F.explode(_lines(F.col(text))).alias("line")).groupBy(doc, "line").agg(F.count("*").alias("n")).where("n >= 3")
    return df.select(doc).join(lines.groupBy(doc).agg(F.sum(F.col("n") - 2).alias("surplus")), doc, "left").fillna(0, ["surplus"])


def bad_chars(df: DataFrame, text: str) -> DataFrame:
    c = F.col(text)
    return df.withColumns({"replacement_char": c.contains("\ufffd"), "control_char": c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")})


def html_residue(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("html_residue", F.col(text).contains("<td") | F.col(text).contains("<table"))


def fence_residue(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("fence_residue", F.col(text).contains("```"))


def ragged_table(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, ragged: whether a block of consecutive |...| lines has rows of different pipe counts."""
    rows = df.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(r"line rlike '^\\|.*\\|$'")
    island = F.col("pos") - F.row_number().over(Window.partitionBy(doc).orderBy("pos"))
    blocks = rows.withColumn("block", island).groupBy(doc, "block")
    pipes = F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))
    ragged = blocks.agg((F.min(pipes) != F.max(pipes)).alias("r")).groupBy(doc).agg(F.bool_or("r").alias("ragged"))
    return df.select(doc).join(ragged, doc, "left").fillna(False, ["ragged"])


def table_cells(text: Column) -> Column:
    """What stands after each pipe, up to the next pipe or line end."""
    return F.regexp_extract_all(text, F.lit(r"\|([^|\n]*)"), F.lit(1))


def empty_share(text: Column) -> Column:
    cells = table_cells(text)
    return F.size(F.filter(cells, lambda x: F.trim(x).rlike("^-*$"))) / F.size(cells)


def empty_table(df: DataFrame, text: str, min_cells: int = 12, most: float = 0.6) -> DataFrame:
    c = F.col(text)
    return df.withColumn("empty_table", F.coalesce((F.size(table_cells(c)) >= min_cells) & (empty_share(c) > most), F.lit(False)))


def duplicate_text(df: DataFrame, text: str) -> DataFrame:
    """text_hash, n: texts used more than once, by the hash of the text."""
    return df.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("text_hash")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_ref(df: DataFrame, refs: str) -> DataFrame:
    """ref, n: references that more than one record uses."""
    return df.select(F.explode(F.array_distinct(refs)).alias("ref")).groupBy("ref").agg(F.count("*").alias("n")).where("n > 1")


def outside_vocab(df: DataFrame, vocab: DataFrame, on: list[str]) -> DataFrame:
    return df.join(vocab, on, "left_anti")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """missing: names of the columns that are null or blank."""
    parts = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in columns]
    return df.withColumn("missing", F.array_compact(F.array(*parts)))


def meta_phrases(df: DataFrame, text: str, level: str = "doc") -> DataFrame:
    any_of = "(?i)" + "|".join(META_DOC if level == "doc" else META_BLOCK)
    return df.withColumn("meta_phrase", F.coalesce(F.col(text).rlike(any_of), F.lit(False)))


def rising_sequence(df: DataFrame, text: str, min_run: int = 6) -> DataFrame:
    """rising: number of pairs in the first run of min_run or more; 0 without."""
    run = F.regexp_extract(F.col(text), f"{RISING}{{{min_run},}}", 0)
    return df.withColumn("rising", F.coalesce(F.regexp_count(run, F.lit(r"[0-9]{3,4}\s*[-–]\s*[0-9]{3,4}")), F.lit(0)))


def token_shape_loop(df: DataFrame, text: str, level: str = "doc", limit: int = 25) -> DataFrame:
    """shape_loop: most tokens of one shape (digits as #) in a line; shape_flag at limit."""
    least = 8 if level == "doc" else 25
    tokens = F.transform(F.split(text, "\n"), lambda x: F.filter(F.split(F.regexp_replace(x, "[0-9]+", "#"), r"\s+"), lambda t: t != ""))
    counts = F.transform(F.filter(tokens, lambda t: F.size(t) >= least), _most)
    return df.withColumn("shape_loop", F.coalesce(F.array_max(counts), F.lit(0))).withColumn("shape_flag", F.col("shape_loop") >= limit)


def latin_intrusion(df: DataFrame, text: str, label: str | None = None, level: str = "doc") -> DataFrame:
    c = F.col(text)
    words = F.regexp_count(c, F.lit(r"\b[A-Za-z]{4,}\b"))
    if level == "doc":
        flag = (F.regexp_count(c, F.lit("[가-힣]")) > 20) & (words > 40)
    else:
        flag = (F.length(c) > 300) & (words >= 30) & (F.regexp_count(c, F.lit("[a-z]{3,}[.,;] ")) >= 5)
        if label:
            flag = flag & ~F.col(label).eqNullSafe("table")
    return df.withColumn("latin_intrusion", F.coalesce(flag, F.lit(False)))


def ngram_repeat(text: Column, n: int = 12) -> Column:
    """Share of a text that its most frequent character n-gram makes up; 0 for
    texts under 3 n.  The n-grams stay an array inside the row."""
    count = F.length(text) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= 3 * n, _most(grams) * n / F.length(text)).otherwise(0.0)


def field_flags(field: Column, value: Column) -> Column:
    """Why a field's value looks wrong; empty where it does not."""
    v = F.trim(F.coalesce(value, F.lit("")))
    bad_phone = ~v.rlike(r"[0-9]{2,4}[-\s)]?\s?[0-9]{3,4}[-\s]?[0-9]{4}")
    business = v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{5}$")
    no_digit = ~v.rlike("[0-9]")
    money = field.isin(*MONEY_FIELDS)
    parts = [
        F.when(F.length(v) <= 1, "one_char"),
        F.when(v.rlike(r"(?U)[^\w\s가-힣.,\-:()/#*&'\"~+@%]"), "odd_char"),
        F.when((field == "merchant_phone") & business, "business_no_in_phone"),
        F.when((field == "merchant_phone") & ~business & bad_phone, "not_a_phone"),
        F.when(money & no_digit, "money_without_digit"),
        F.when(money & v.rlike("[가-힣]"), "money_with_hangul"),
        F.when((field == "merchant_name") & ~v.rlike(r"\p{L}"), "name_without_letter"),
        F.when(field.startswith("transaction_") & no_digit, "date_without_digit"),
    ]
    return F.when(v == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*parts)))


def pii_safe(df: DataFrame, text: str, label: str) -> DataFrame:
    keep = ~F.col(label).isin(*PII_LABELS)
    for p in PII:
        keep = keep & ~F.col(text).rlike(p)
    return df.where(keep)


def route_labels(df: DataFrame, label: str, routes: DataFrame) -> DataFrame:
    """task of each label from a table (label, task); unknown where it has none."""
    return df.join(routes, label, "left").withColumn("task", F.coalesce("task", F.lit("unknown")))


def looks_like_table(boxes: DataFrame, doc: str, x: str, min_boxes: int = 20, bin_px: int = 15, min_col: int = 5, min_cols: int = 2) -> DataFrame:
    """doc, table_like: enough boxes, and enough bins of x starts that hold a column of them."""
    bins = boxes.groupBy(doc, F.floor(F.col(x) / bin_px).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy(doc).agg(((F.sum("n") >= min_boxes) & (F.count_if(F.col("n") >= min_col) >= min_cols)).alias("table_like"))


def page_drop_reason(boxes: DataFrame, doc: str, x: str, handwritten: str, text: str, min_boxes: int = 5, hand_max: float = 0.10, table_boxes: int = 20) -> DataFrame:
    """doc, reason: the first of few_boxes, handwriting, table, no_text that holds, else null."""
    facts = boxes.groupBy(doc).agg(
        F.count("*").alias("n"), F.avg(F.col(handwritten).cast("double")).alias("hand"), F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").alias("texts")
    )
    facts = facts.join(looks_like_table(boxes, doc, x, min_boxes=table_boxes), doc)
    reason = (
        F.when(F.col("n") < min_boxes, "few_boxes").when(F.col("hand") > hand_max, "handwriting").when(F.col("table_like"), "table").when(F.col("texts") == 0, "no_text")
    )
    return facts.select(doc, reason.alias("reason"))


def apply_exclusions(df: DataFrame, names: DataFrame, on: str, only_drop: bool = False) -> DataFrame:
    """Rows whose name is not on the list; with only_drop, those that are."""
    return df.join(names.select(on).distinct(), on, "left_semi" if only_drop else "left_anti")


def read_names(text: DataFrame, value: str = "value") -> DataFrame:
    """name: the entries of a list with # comments, split on commas and white space."""
    bare = F.regexp_replace(value, "#.*$", "")
    return text.select(F.explode(F.split(bare, r"[,\s]+")).alias("name")).where("name <> ''").distinct()


def missing_refs(df: DataFrame, refs: str, inventory: DataFrame) -> DataFrame:
    """root, n: references without a file, counted by first path segment."""
    used = df.select(F.explode(refs).alias("ref")).distinct()
    gone = used.join(inventory.select("ref").distinct(), "ref", "left_anti")
    return gone.groupBy(F.element_at(F.split("ref", "/"), 1).alias("root")).agg(F.count("*").alias("n"))


def size_reason(df: DataFrame, w: str, h: str, min_side: int = 200, max_wh: float = 1.6) -> DataFrame:
    return df.withColumn("size_reason", F.when(F.least(w, h) < min_side, "small").when(F.col(w) / F.col(h) > max_wh, "wide"))


def license_gate(df: DataFrame, registry: DataFrame, on: str, allowed: tuple[str, ...], status: str = "approved") -> DataFrame:
    """Rows of data sets whose licence and review allow training."""
    ok = registry.where(F.col("license").isin(*allowed) & (F.col("review_status") == status)).select(on).distinct()
    return df.join(ok, on, "left_semi")


def script_share_page(df: DataFrame, doc: str, page: str, text: str, script: str, min_share: float = 0.2, min_len: int = 500, first: int = 4) -> DataFrame:
    """The first page of each document's first few that is long enough and has that share of a script."""
    order = Window.partitionBy(doc).orderBy(page)
    share = F.regexp_count(text, F.lit(script)) / F.length(text)
    few = df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first)
    good = few.where((F.length(text) >= min_len) & (share >= min_share))
    return good.withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("pick", "nth")


def crop_text_reason(df: DataFrame, text: str, max_chars: int = 200) -> DataFrame:
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("crop_reason", F.when(t == "", "no_text").when(F.length(t) > max_chars, "too_long"))


def doc_type(text: Column, hints: dict[str, tuple[str, ...]], least: int = 2) -> Column:
    """The type with most keyword hits (ties: first), unknown under `least`."""
    score = {k: sum((text.contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in hints.items()}
    best = F.greatest(*score.values())
    out = F.lit("unknown")
    for k in reversed(list(score)):
        out = F.when((score[k] == best) & (best >= least), k).otherwise(out)
    return out


def verify_items(df: DataFrame, items: str, subtotal: str, tax: str, total: str) -> DataFrame:
    """issues of a document: amounts against the total, subtotal and tax against
    it, and unit price times quantity of every item (whole numbers)."""
    amounts = F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x["amount"], F.lit(0).cast("bigint")))
    wrong = F.exists(items, lambda x: x["unit_price"] * x["qty"] != x["amount"])
    parts = [
        F.when((F.size(items) > 0) & (amounts != F.col(total)), "items_vs_total"),
        F.when(F.col(subtotal) + F.col(tax) != F.col(total), "subtotal_tax_vs_total"),
        F.when(wrong, "unit_qty_vs_amount"),
    ]
    return df.withColumn("issues", F.array_compact(F.array(*parts)))


def failure_type(gt: Column, pred: Column) -> Column:
    """Why a prediction failed, the first that holds: empty, loop, latex, runaway, language; else null."""
    from docq.functions.text import hangul_ratio

    p, latex = F.trim(F.coalesce(pred, F.lit(""))), r"\\begin\{|\\frac|\$\$"
    return (
        F.when(p == "", "empty")
        .when(ngram_repeat(p) > 0.35, "loop")
        .when(p.rlike(latex + r"|\\hline") & ~gt.rlike(latex), "latex")
        .when(F.length(p) > F.greatest(F.lit(60), F.length(gt) * 3), "runaway")
        .when((hangul_ratio(gt) > 0.5) & (hangul_ratio(p) < 0.2), "language")
    )


def error_kind(gt: Column, pred: Column, share: float = 0.7) -> Column:
    """exact, notation (equal without spaces and case), over_extraction,
    vocabulary (that share of words in common), misread."""
    from docq.functions.text import norm_space

    a, b = norm_space(gt), norm_space(pred)
    key = [F.lower(F.regexp_replace(x, r"[\s\p{Punct}]+", "")) for x in (a, b)]
    words = [F.array_distinct(F.split(F.lower(x), " ")) for x in (a, b)]
    return (
        F.when(a == b, "exact").when(key[0] == key[1], "notation").when((a != "") & b.contains(a), "over_extraction")
        .when(F.size(F.array_intersect(*words)) / F.size(words[0]) >= share, "vocabulary").otherwise("misread")
    )


def root_cause(missing: Column, parse_chars: Column, table_lost: Column, gt_rows: Column, pred_rows: Column, general: Column, table: Column) -> Column:
    """Cause of a low score, the first that holds."""
    return (
        F.when(missing, "missing_prediction").when(parse_chars <= 120, "empty_parse").when(table_lost, "table_lost").when(gt_rows != pred_rows, "row_count")
        .when(table - general > 0.15, "general_fields").when(general - table > 0.15, "table_fields").otherwise("overall")
    )


def sums_up(df: DataFrame, parts: tuple[str, ...], total: str, name: str) -> DataFrame:
    """name: whether the parts add up to the total; null where one is missing."""
    return df.withColumn(name, sum((F.col(p) for p in parts), F.lit(0)) == F.col(total))


def tenth(df: DataFrame, base: str, tax: str, name: str) -> DataFrame:
    """name: whether the tax is a tenth of the base, within 1."""
    return df.withColumn(name, F.abs(F.round(F.col(base) * 0.1) - F.col(tax)) <= 1)


def defect_type(gt: Column, pred: Column) -> Column:
    """The first that holds: formula (made up), symbols (formatting left over),
    cut_table (not closed), missing_rows; else null."""
    formula, rows = r"\\frac|\\begin\{|\$\$", "<tr"
    return (
        F.when(pred.rlike(formula) & ~gt.rlike(formula), "formula").when(pred.rlike(r"\*\*|`{3}|#{2,}") & ~gt.rlike(r"\*\*|`{3}|#{2,}"), "symbols")
        .when(pred.contains("<table") & ~pred.contains("</table>"), "cut_table").when(F.regexp_count(pred, F.lit(rows)) < F.regexp_count(gt, F.lit(rows)), "missing_rows")
    )


def crop_audit(df: DataFrame, w: str, h: str, scaled: tuple[str, str], raw: tuple[str, str]) -> DataFrame:
    """saved_as: whether a saved size is that of the scaled box, of the raw one, or neither."""
    same = lambda s: (F.abs(F.col(w) - F.col(s[0])) <= 1) & (F.abs(F.col(h) - F.col(s[1])) <= 1)
    return df.withColumn("saved_as", F.when(same(scaled), "scaled").when(same(raw), "raw").otherwise("neither"))


def balance_sheet(assets: Column, claims: Column) -> Column:
    """Whether total assets equal total liabilities and equity in every period;
    null where either row is missing.  Both are arrays of whole numbers, one a period."""
    same = F.forall(F.arrays_zip(assets.alias("a"), claims.alias("c")), lambda p: p["a"].eqNullSafe(p["c"]))
    return F.when((F.size(assets) > 0) & (F.size(claims) > 0), same)
