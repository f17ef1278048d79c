"""Personal data, by weak supervision over candidate spans.

Base rules and looser patterns propose candidate spans.  Three labelers vote on
each (1, -1, or 0 to abstain): its form (checks the pattern cannot make), a
gazetteer (entries: names, area codes, countries, endings, ranges) and its context (words before it).
Expectation-maximisation over the counts of vote patterns of the whole corpus
estimates how reliable each labeler is for each kind; its posteriors train a
logistic span classifier.  Spans of base rules stay whatever the classifier
says; other candidates are kept when it accepts them.  Built-in functions only:
what reaches the driver is one row for each pattern of kind, votes, length band
and characters around the span, whose number does not depend on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch
from docq.llm.spans import match_spans

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("ssn", "iban", "local_phone", "name")
KINDS = BASE_KINDS + EXTRA_KINDS

# A match can only begin where a run of the pattern's first class begins or the
# last match ended; saying so keeps long runs linear and changes no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+()-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
}
#: Fixed values, the entries of the gazetteers: endings of mail domains and of files.
DOMAINS = "com org net edu gov io de fr es uk info eu it nl ch at be ca au us".split()
FILES = "png jpg jpeg gif svg webp css js".split()
#: Number of characters of an IBAN, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
#: North American area codes, a part of them; the rest is neither affirmed nor denied.
AREA_CODES = (
    "201 202 203 205 206 207 208 209 210 212 213 214 215 216 217 218 219 224 225 228 229 231 234 239 240 248 251 252 253 254 256 260 262 "
    "267 269 270 276 281 301 302 303 304 305 307 308 309 310 312 313 314 315 316 317 318 319 320 321 323 325 330 334 336 337 347 352 360 "
    "361 386 401 402 404 405 406 407 408 409 410 412 413 414 415 416 417 419 423 424 425 432 434 435 440 443 469 478 480 484 501 502 503 "
    "504 505 507 508 509 510 512 513 514 515 516 517 518 520 530 541 559 561 562 571 573 574 580 585 602 603 604 605 606 607 608 609 610 "
    "612 614 615 616 617 618 619 626 631 646 650 651 661 702 703 704 706 707 713 714 716 717 718 720 727 732 757 760 770 772 773 781 800 "
    "801 802 803 804 805 808 812 813 814 815 816 817 818 828 843 847 858 866 877 888 901 904 907 908 909 914 916 917 918 919 925 937 949"
).split()
#: Frequent first names and surnames, and words that follow a title without being one.
FIRST_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth "
    "George Brian Edward Kevin Peter Henry Jack Adam Simon Martin Stefan Hans Klaus Jürgen Pierre Jean Michel Louis Carlos José Juan Luis Miguel "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Maria Laura Julia "
    "Emma Alice Helen Ruth Rachel Claire Marie Sophie Isabelle Carmen Ana Lucia Sofia Petra Sabine Monika"
).split()
SURNAMES = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson "
    "Martin Lee Perez Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Dubois Durand Moreau Laurent Bernard Petit Fernandez Sanchez Torres Ramirez"
).split()
NO_NAMES = (
    "The This That These And Who No Not Yes With For From Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April "
    "June July August September October November December Street Road Avenue Company Pepper President Chairman"
).split()


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


#: What speaks for (+) or against (-) a kind, built from the entries and from fixed ranges and prefixes.
GAZETTEER = {
    "email": (rf"(?i)\.{_any(DOMAINS)}$", rf"(?i)@(?:localhost|domain)\b|\.{_any(FILES)}$"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0|127|22[4-9]|2[3-5][0-9])\.|^(?:[0-9]\.){3}[0-9]$"),
    "card": (
        r"^(?:(?=(?:[^0-9]*[0-9]){16}$)(?:4|5[1-5]|2[2-7]|6(?:011|5))|(?=(?:[^0-9]*[0-9]){15}$)3[47]|(?=(?:[^0-9]*[0-9]){13}$)4)",
        r"^(?:[01789]|([0-9])(?:[\x20-]?\1){11})",
    ),
    "phone": (r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])", r"^\+0|^\+1[^0-9]*(?:[01]|555)"),
    "ssn": (r"^(?:00[1-9]|0[1-9][0-9]|[1-5][0-9]{2}|6(?!66)[0-9]{2}|7[0-2][0-9]|73[0-3]|7[56][0-9]|77[0-2])-", r"^(?:000|666|9)|^(?:078-05-1120|219-09-9999|123-45-6789)$|^([0-9])\1\1-\1\1-\1{4}$"),
    "iban": ("^" + _any(f"{c}(?=(?:\\x20?[A-Z0-9]){{{n - 2}}}$)" for c, n in IBAN_LENGTHS.items()), f"^(?!{_any(IBAN_LENGTHS)})"),
    "local_phone": (rf"^\(?{_any(AREA_CODES)}(?![0-9])", r"^\(?(?:[01]|[2-9]11|[2-9]9|37|96|555)"),
    "name": (rf"\x20(?:{_any(FIRST_NAMES)}|{_any(SURNAMES)})(?=\x20|$)", rf"\x20{_any(NO_NAMES)}(?=\x20|$)"),
}
#: Words just before a span that speak for or against it.
CONTEXT = {
    "email": (r"(?i)(?:mail|contact|write|send|reach|von|courriel|correo)", r"(?i)(?:example|regex|package|version)"),
    "ip": (r"(?i)(?:ip|address|host|server|from|client)", r"(?i)(?:version|section|release|chapter)"),
    "card": (r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)", r"(?i)(?:isbn|order|serial|tracking|id)"),
    "phone": (r"(?i)(?:phone|tel|call|mobile|fax|sms)", r"(?i)(?:part|model|version)"),
    "ssn": (r"(?i)(?:ssn|social|security)", r"(?i)(?:part|order|model|invoice)"),
    "iban": (r"(?i)(?:iban|account|bank|konto|compte|cuenta)", r"(?i)(?:serial|model|key)"),
    "local_phone": (r"(?i)(?:phone|tel|call|mobile|fax|sms)", r"(?i)(?:part|order|model|version)"),
    "name": (r"(?i)(?:dear|contact|by|with|from|signed|patient)", r"(?i)(?:street|company|brand)"),
}
CANDIDATES = "array<struct<rank:int,start:bigint,end:bigint,form:int,gazetteer:int,context:int,band:int,left:int,right:int>>"
SPANS = "array<struct<rank:int,start:bigint,end:bigint,kind:string,p:double,base:boolean>>"
LABELERS = ("form", "gazetteer", "context")
#: What the classifier sees of the text besides the votes: length band and the characters around the span.
SIGHTS = ("band", "left", "right")
CONTEXT_CHARS = 32
MAX_IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)

    def value(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = v * 2
        return F.when((n - i) % 2 == 0, v).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def base_ok(kind: str, m: Column) -> Column:
    """The check that a base match has to pass."""
    if kind == "ip":
        return m.rlike(rf"^{MAX_IP_PART}(?:\.{MAX_IP_PART}){{3}}$")
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def iban_ok(m: Column) -> Column:
    """Whether an IBAN's check digits are right (remainder 1 by 97)."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return (acc * F.when(code >= 65, 100).otherwise(10) + F.when(code >= 65, code - 55).otherwise(code - 48)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def form_vote(kind: str, m: Column, before: Column, after: Column) -> Column:
    """1, 0 or -1 by checks beyond the pattern; a check that every candidate of the kind
    has passed already is no vote."""
    d = F.length(digits(m))
    if kind == "card":
        return F.when(m.rlike(r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$"), F.when(before.rlike("[0-9A-Za-z]$") | after.rlike("^[0-9A-Za-z]"), -1).otherwise(1)).otherwise(-1)
    if kind == "phone":
        return F.when(m.rlike(r"^[^()]*(?:\([0-9]+\)[^()]*)?$"), F.when(d.between(10, 13), 1).otherwise(0)).otherwise(-1)
    if kind == "local_phone":
        return F.when(m.rlike(r"^(?:\([0-9]{3}\)\x20[2-9][0-9]{2}-|[0-9]{3}([.-])[2-9][0-9]{2}\1)"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(m.rlike(r"(?:^|\.)0[0-9]") | before.rlike(r"(?:[0-9]\.|[vV])$") | after.rlike(r"^(?:\.[0-9]|[A-Za-z])"), -1).otherwise(1)
    if kind == "iban":
        return F.when(iban_ok(m), 1).otherwise(-1)
    if kind == "email":
        return F.when(m.rlike(r"\.\.|^\.|\.@|-\."), -1).otherwise(1)
    if kind == "ssn":
        return F.when(m.rlike(r"-00-|-0000$"), -1).when(before.rlike(r"[A-Za-z#_/]$") | after.rlike(r"^[A-Za-z_/]"), -1).otherwise(1)
    return F.when(m.rlike(r"\x20[A-Z][a-z]+\x20[A-Z][a-z]+$"), 1).when(m.rlike(r"\x20[A-Z][a-z]$"), -1).otherwise(0)


def _class_of(char: Column) -> Column:
    """0: none or white space, 1: letter or digit, 2: what opens, closes or ends a phrase, 3: other."""
    return F.when((char == "") | char.rlike(r"^\s"), 0).when(char.rlike(r"^[\p{L}\p{N}]"), 1).when(char.rlike(r"^[.,;:!?()\"']"), 2).otherwise(3)


def votes(kind: str, m: Column, before: Column, after: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate of a kind, and what the classifier sees besides."""
    return {
        "form": form_vote(kind, m, before, after).cast("int"),
        "gazetteer": F.when(m.rlike(GAZETTEER[kind][1]), -1).when(m.rlike(GAZETTEER[kind][0]), 1).otherwise(0),
        "context": F.when(before.rlike(CONTEXT[kind][1]), -1).when(before.rlike(CONTEXT[kind][0]), 1).otherwise(0),
        "band": F.least(F.floor(F.length(m) / 6), F.lit(7)).cast("int"),
        "left": _class_of(F.right(before, F.lit(1))).cast("int"),
        "right": _class_of(F.substring(after, 1, 1)).cast("int"),
    }


def candidates(text: Column) -> Column:
    """All candidate spans (rank, start, end, votes, sights); base kinds checked."""
    out = []
    for rank, kind in enumerate(KINDS):
        spans = match_spans(text, PATTERNS[kind], (lambda m, k=kind: base_ok(k, m)) if kind in BASE_KINDS else None)
        out.append(F.transform(F.transform(spans, _seen(text)), _voted(rank, kind)))
    return reduce(F.concat, out)


def _seen(text: Column):
    def run(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT_CHARS)).cast("int"))
        return F.struct(s["start"], s["end"], s["text"], before.alias("before"), F.substring(text, (s["end"] + 1).cast("int"), F.lit(2)).alias("after"))

    return run


def _voted(rank: int, kind: str):
    def run(s: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), *[v.alias(n) for n, v in votes(kind, s["text"], s["before"], s["after"]).items()])

    return run


@dataclass(frozen=True)
class Model:
    """reliability: chance that a labeler's vote is right, by (kind, labeler);
    weights of the span classifier, by feature; bias."""

    reliability: dict
    weights: dict
    bias: float


def _features(rank: int, vote: tuple[int, ...], sight: tuple[int, ...]) -> list[str]:
    cast = [f"{n}={v}" for n, v in zip(LABELERS, vote, strict=True) if v]
    return [f"kind={rank}"] + [f"{n}={v}" for n, v in zip(SIGHTS, sight, strict=True)] + cast + [f"{c}&kind={rank}" for c in cast]


def estimate(counts: list[tuple], rounds: int = 50) -> Model:
    """EM and the classifier from (rank, votes, sights, n) rows, at most
    8 kinds x 27 votes x 8 bands x 4 x 4 of them.

    Reliabilities begin at 0.8 and stay within 0.5 and 0.99 (a labeler is never
    trusted to be wrong); each estimate has 2 right votes and 1 wrong one added.
    In the classifier's loss every kind weighs the same, however rare it is.
    Without any rows the classifier accepts what more labelers affirm than deny.
    """
    cells: dict[tuple, int] = {}
    for rank, vote, _, n in counts:
        cells[rank, vote] = cells.get((rank, vote), 0) + n
    rel = {(r, n): 0.8 for r in range(len(KINDS)) for n in LABELERS}
    prior = dict.fromkeys(range(len(KINDS)), 0.5)

    def posterior(rank, vote):
        z = math.log(prior[rank] / (1 - prior[rank]))
        for n, v in zip(LABELERS, vote, strict=True):
            z += v * math.log(rel[rank, n] / (1 - rel[rank, n]))
        return 1 / (1 + math.exp(-z))

    for _ in range(rounds):
        right = {k: 2.0 for k in rel}
        cast = {k: 3.0 for k in rel}
        true, total = dict.fromkeys(prior, 1.0), dict.fromkeys(prior, 2.0)
        for (rank, vote), n in cells.items():
            p = posterior(rank, vote)
            true[rank] += n * p
            total[rank] += n
            for name, v in zip(LABELERS, vote, strict=True):
                if v:
                    right[rank, name] += n * (p if v > 0 else 1 - p)
                    cast[rank, name] += n
        rel = {k: min(0.99, max(0.5, right[k] / cast[k])) for k in rel}
        prior = {k: min(0.95, max(0.05, true[k] / total[k])) for k in prior}
    if not counts:
        return Model(rel, {f"{n}={v}": float(v) for n in LABELERS for v in (-1, 1)}, -0.5)
    names = sorted({f for r, v, b, _ in counts for f in _features(r, v, b)})
    at = {f: i for i, f in enumerate(names)}
    of_kind: dict[int, int] = {}
    for (rank, _), n in cells.items():
        of_kind[rank] = of_kind.get(rank, 0) + n
    rows = [([at[f] for f in _features(r, v, b)], posterior(r, v), n / of_kind[r] / len(of_kind)) for r, v, b, n in counts]
    w, bias = [0.0] * len(names), 0.0
    for _ in range(300):
        grad, gb = [1e-4 * x for x in w], 0.0
        for f, p, n in rows:
            e = (1 / (1 + math.exp(-(bias + sum(w[i] for i in f)))) - p) * n
            gb += e
            for i in f:
                grad[i] += e
        w = [x - 1.5 * g for x, g in zip(w, grad, strict=True)]
        bias -= 1.5 * gb
    return Model(rel, dict(zip(names, w, strict=True)), bias)


def accepted(model: Model, s: Column) -> Column:
    """The classifier's probability for a candidate (rank, votes, sights)."""
    z = F.lit(model.bias)
    for name, w in model.weights.items():
        parts = [p.split("=") for p in name.split("&")]
        test = reduce(lambda a, b: a & b, [s["rank" if k == "kind" else k] == int(v) for k, v in parts])
        z = z + F.when(test, w).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id and spans (rank, start, end, kind, p, base; by kind, then start) of
    every row of docs.

    Null or empty texts have no spans; a null id is kept; repeated rows each get
    a row; other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(candidates(F.col(text_col)), F.expr(f"cast(array() as {CANDIDATES})")).alias("c")), "candidates")
    pattern = ["rank", *LABELERS, *SIGHTS]
    counts = found.select(F.explode("c").alias("s")).select(*[f"s.{p}" for p in pattern]).groupBy(*pattern).agg(F.count("*").alias("n")).collect()
    model = estimate(sorted((r.rank, tuple(r[n] for n in LABELERS), tuple(r[n] for n in SIGHTS), r.n) for r in counts))

    def judged(s: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
        return F.struct(s["rank"], s["start"], s["end"], kind.alias("kind"), accepted(model, s).alias("p"), (s["rank"] < len(BASE_KINDS)).alias("base"))

    kept = F.filter(F.transform("c", judged), lambda s: s["base"] | (s["p"] >= threshold))
    return found.select("doc_id", F.when(F.size("c") == 0, F.array().cast(SPANS)).otherwise(F.sort_array(kept)).alias("spans"))
