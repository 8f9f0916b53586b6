"""Personal data in texts: fixed formats, and candidates that boosted trees accept.

Everything is DataFrame functions. Positions come from two arrays: the matches of
a pattern and the gaps between them, whose lengths add up to code points.

Generators propose number-like and address-like spans, which may overlap each
other. A candidate is confirmed if a fixed format takes its normal form, with "@" and
"." for their spellings, without spaces, and with the "+" that a grouped number lacks.
Trees see only what stands around a candidate, as its own form decides that, and learn
from all texts which candidates are confirmed. What the generators propose beside the
spans of the fixed formats is added where its score is so high that at least
``PRECISION`` of all candidates with that score or more are confirmed, for each
generator by itself. A number that overlaps an added address is not added.

Patterns are possessive and start at the beginning of a run or where the last
match ended, which changes no match, so that long runs take linear time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triflux.llm import boosting

# The base formats in order. (?:\G|(?<!x)) is a run's beginning.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "number", "address")
BASE = 4

NUMBER = r"[+(]?[0-9][0-9 ().\-/]{4,}[0-9]"
ADDRESS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?"
    r"[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)*+"
)
CONTACT = "(?:tel|phone|call|mobile|fax|mail|contact|reach|write)"
ACCOUNT = "(?:card|visa|credit|account|iban|ssn|passport|member|host|server|address)"
#: Code points before a candidate that are its context.
BEFORE = 24
OTHER = "(?:order|invoice|number|id|no|ref|version|date|page|item|year)"
PRECISION = 0.99
N_FEATURES = 7
#: A noncharacter that no generator takes.
MASK = "\uffff"

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _matches(text: str, pattern: str, hint: Column) -> Column:
    """The matches of a pattern; ``hint`` says cheaply where there may be one."""
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _placed(matches: str, gaps: str) -> Column:
    """Matches with their positions, which are sums of lengths."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(a: Column, i: Column) -> Column:
        match = F.get(matches, i)
        begin = a["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(match)
        span = F.struct(begin.alias("start"), end.alias("end"), match.alias("value"))
        return F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out"))

    ids = F.sequence(F.lit(0), F.size(matches) - 1)
    placed = F.aggregate(ids, start, step, lambda a: a["out"])
    return F.when(F.size(matches) > 0, placed).otherwise(F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _good_ip(value: Column) -> Column:
    return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")


def _good_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


def _good_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)


def _passing(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: check(x["value"])


def _masking(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.when(check(v), F.repeat(F.lit(MASK), F.length(v))).otherwise(v)


FORMATS = (
    (EMAIL, lambda value: F.lit(True)),
    (IP, _good_ip),
    (CARD, _good_card),
    (PHONE, _good_phone),
)


def with_base_spans(frame: DataFrame) -> DataFrame:
    """``frame`` with ``_text`` (null: empty) and the spans of each base format, ``_base0`` on."""
    out = frame.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    digit = F.col("_text").rlike("[0-9]")
    hints = (F.instr("_text", "@") > 0, digit, digit, F.instr("_text", "+") > 0)
    for k, (pattern, check) in enumerate(FORMATS):
        out = _with_places(out, "_text", pattern, hints[k], f"_base{k}")
        out = out.withColumn(f"_base{k}", F.filter(f"_base{k}", _passing(check)))
    return out


def _with_rest(frame: DataFrame) -> DataFrame:
    """``frame`` with ``_rest``, the text with ``MASK`` for each code point of a base span."""
    out = frame.withColumn("_rest", F.col("_text"))
    for k, (pattern, check) in enumerate(FORMATS):
        some = F.size(f"_base{k}") > 0
        out = out.withColumn("_m", _matches("_rest", pattern, some))
        out = out.withColumn("_g", F.when(F.size("_m") > 0, F.split("_rest", pattern, -1)))
        masked = F.transform("_m", _masking(check))
        parts = F.transform(
            F.arrays_zip(F.col("_g").alias("g"), masked.alias("m")),
            lambda x: F.concat(x["g"], F.coalesce(x["m"], F.lit(""))),
        )
        rest = F.when(F.size("_m") > 0, F.array_join(parts, "")).otherwise(F.col("_rest"))
        out = out.withColumn("_rest", rest)
    return out.drop("_m", "_g")


def _with_places(
    frame: DataFrame, text: str, pattern: str, hint: Column, name: str
) -> DataFrame:
    found = frame.withColumn("_m", _matches(text, pattern, hint))
    gaps = F.when(F.size("_m") > 0, F.split(text, pattern, -1))
    return found.withColumn("_g", gaps).withColumn(name, _placed("_m", "_g")).drop("_m", "_g")


def _normal_address(value: Column) -> Column:
    at = F.regexp_replace(value, r" ?(?:\[at\]|\(at\)|@) ?", "@")
    return F.regexp_replace(at, r" ?(?:\[dot\]|\(dot\)|\.) ?", ".")


def _confirmed(generator: int, value: Column) -> Column:
    """Whether a format takes the whole of a candidate's normal form."""
    if generator == 1:
        return _normal_address(value).rlike(f"^{EMAIL}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    ip = _good_ip(F.regexp_replace(value, " ", ""))
    card = F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    plus = value.startswith("+") & _good_phone(value)
    # Without "+": as grouped as telephone numbers are, and no date.
    groups = F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)))
    date = value.rlike(r"^(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}")
    bare = n.between(10, 15) & groups.between(3, 6) & ~date
    return ip | card | plus | bare


def _features(generator: int, x: Column) -> Column:
    """What stands around a candidate; nothing of its own."""
    start, end = x["start"], x["end"]
    before = F.substring("_text", F.greatest(F.lit(1), start - BEFORE + 1), F.least(start, F.lit(BEFORE)))
    last = F.substring(before, -1, 1)
    after = F.substring("_text", end + 1, F.lit(BEFORE))
    flag = lambda c: F.when(c, 1).otherwise(0)
    context = (
        F.when(before.rlike(f"(?i){CONTACT}[^a-z]*$"), 1)
        .when(before.rlike(f"(?i){ACCOUNT}[^a-z]*$"), 2)
        .when(before.rlike(f"(?i){OTHER}[^a-z]*$"), 3)
    )
    return F.array(
        F.lit(generator),
        context.otherwise(0),
        flag(before.rlike(f"(?i){CONTACT}")),
        flag(before.rlike("[:=] ?$")),
        flag(last.rlike("[A-Za-z]")),
        flag(after.rlike("^[A-Za-z]")),
        flag(before.rlike(r"(?:^|\n)$")),
    )


def with_candidates(frame: DataFrame, text: str = "_text") -> DataFrame:
    """``frame`` with ``_found``: start, end, generator, features, and whether a format confirms.

    The generators propose from ``text``, which has the places of ``_text``. The
    whole text is for learning; what they add is from the rest of it, so that base
    spans stay and what a base span cuts is still proposed.
    """
    hints = (F.col(text).rlike("[0-9]"), F.col(text).rlike(r"@|\[at\]|\(at\)"))
    out = frame
    for g, pattern in enumerate((NUMBER, ADDRESS)):
        out = _with_places(out, text, pattern, hints[g], f"_c{g}")

    def described(generator: int) -> Column:
        return F.transform(
            f"_c{generator}",
            lambda x: F.struct(
                x["start"].alias("start"),
                x["end"].alias("end"),
                F.lit(generator).alias("generator"),
                _features(generator, x).alias("f"),
                _confirmed(generator, x["value"]).alias("confirmed"),
            ),
        )

    return out.withColumn("_found", F.concat(described(0), described(1))).drop("_c0", "_c1")


def learn(docs: DataFrame) -> tuple[list[boosting.Node], dict[int, float]]:
    """The trees, and for each generator the score from which candidates are taken.

    All candidates of all documents count. What the driver gathers is a row per
    cell, at most 256 by the features' values.
    """
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    # An outer explode: for an inner one Spark pushes a filter through all of the projections.
    rows = with_candidates(texts).select(F.explode_outer("_found").alias("x")).where("x is not null")
    rows = rows.select("x.f", "x.confirmed")
    counted = rows.groupBy("f").agg(
        F.count("*").alias("n"), F.count_if("confirmed").alias("positive")
    )
    cells = counted.orderBy("f").collect()
    features = np.array([r["f"] for r in cells], np.int64).reshape(-1, N_FEATURES)
    total = np.array([r["n"] for r in cells], np.float64)
    positive = np.array([r["positive"] for r in cells], np.float64)
    trees = boosting.boost(features, total, positive)
    scored = boosting.scores(trees, features)
    least: dict[int, float] = {}
    for generator in (0, 1):
        own = features[:, 0] == generator
        at = boosting.threshold(scored[own], total[own], positive[own], PRECISION)
        if at is not None:
            least[generator] = at
    return trees, least


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)`` its counts, digest and spans; null texts are empty.

    Spans are ``kind:start:end`` by kind, then start, in code points, ends exclusive.
    Rows are independent; the only shuffle is that of the cells.
    """
    trees, least = learn(docs)
    rest = _with_rest(with_base_spans(docs.select("doc_id", "text")))
    found = with_candidates(rest, "_rest")

    def named(name: str, kind: str) -> Column:
        return F.transform(
            name, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])
        )

    def accepted(generator: int) -> Column:
        if generator not in least:
            return F.filter("_found", lambda x: F.lit(False))

        def good(x: Column) -> Column:
            own = x["generator"] == generator
            score = boosting.score_column(trees, lambda i: F.get(x["f"], F.lit(i)))
            return F.when(own, score >= least[generator]).otherwise(False)

        return F.filter("_found", good)

    def apart(x: Column) -> Column:
        overlaps = lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])
        return ~F.exists(f"_base{BASE + 1}", overlaps)

    found = found.withColumn(f"_base{BASE + 1}", accepted(1))
    found = found.withColumn(f"_base{BASE}", F.filter(accepted(0), apart))
    parts = [named(f"_base{k}", kind) for k, kind in enumerate(KINDS)]
    base = F.array_join(F.concat(*parts[:BASE]), ",")
    return found.select(
        "doc_id",
        *[F.size(f"_base{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*parts), ",").alias("spans"),
    )
