"""Quantities in text: dates, amounts, shares, years, durations and counts, with what bounds and describes them.

A pattern's matches in a text become spans, an array of structs; what bounds, measures and describes a quantity are column
expressions over the text around its span, and everything that compares quantities works on the arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_engine.functions import text as words_of
from evidence_engine.functions.text import let

# Number words, months, units, patterns and their precedence.
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
#: Ends of words that name a unit of time, and the units.
TIME = {"days?": "day", "weeks?": "week", "months?": "month", "years?": "year", "hours?|hrs?": "hour", "minutes?|mins?": "minute", "seconds?|secs?": "second"}
SCALES = {"million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "thousand": 1e3, "k": 1e3}
COMMON = frozenset("the a an is are was were to of and in that it for on with all must be their by as at this per".split())
GENERIC = ("employee", "employe", "user", "company", "customer", "person", "client", "worker", "staff", "member", "party", "parties", "individual", "policy", "rule", "system", "organization", "organ", "document", "section", "item")
NOT_UNITS = frozenset("full-time part-time consecutive temporary annual monthly daily hourly weekly calendar total new active eligible standard mandatory maximum minimum regular business working paid unpaid per".split())
BEFORE = (
    ("AT_MOST", r"\b(?:up\s+to|at\s+most|maximum\s+of|max(?:imum)?|limit\s+of|capped\s+at|ceiling\s+of|no\s+more\s+than|not\s+(?:to\s+)?exceed(?:ing)?|within)\b"),
    ("AT_LEAST", r"\b(?:at\s+least|minimum\s+of|min(?:imum)?|no\s+less\s+than|not\s+below|not\s+under)\b"),
    ("GREATER_THAN", r"\b(?:more\s+than|greater\s+than|in\s+excess\s+of|exceeding|above|over)\b"),
    ("LESS_THAN", r"\b(?:less\s+than|fewer\s+than|under|below|strictly\s+under)\b"),
)
AFTER = (("AT_MOST", r"\b(?:or\s+less|or\s+fewer|maximum|max)\b"), ("AT_LEAST", r"\b(?:or\s+more|minimum|min)\b"))
OUTLINE = r"\b(?:claim|fact|assertion|statement|point|case|exhibit|section|rule|clause|article|item|heading|paragraph|step|part)\s*$"
MONTH = r"\b(" + "|".join(MONTHS) + r")\b"
MONTH_DAY = MONTH + r"\s+(\d{1,2})(?:st|nd|rd|th)?\b"
DAY_MONTH = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?" + MONTH
AMOUNT = (
    r"(?<currency>\$|USD|EUR|€|GBP|£)?\s*(?<number>\b\d+(?:\.\d+)?\b|\b(?:" + "|".join(NUMBERS) + r")\b)"
    r"(?:\s*\b(?<scale>million|billion|thousand|k|m|b)\b)?(?<share>\s*(?:%|percent(?:age)?(?:\s+points?)?))?"
)
#: Pairs of (claimed, found) bounds that exclude each other.
OPPOSED = (("AT_LEAST", "AT_MOST"), ("AT_MOST", "AT_LEAST"), ("GREATER_THAN", "LESS_THAN"), ("LESS_THAN", "GREATER_THAN"), ("GREATER_THAN", "AT_MOST"), ("LESS_THAN", "AT_LEAST"))
PREFIXES = {"AT_MOST": "up to", "AT_LEAST": "at least", "GREATER_THAN": "more than", "LESS_THAN": "less than"}

#: Characters around a quantity in which what describes it is looked for, by what it is.
NEAR, BOUND_BEFORE, BOUND_AFTER, OUTLINE_BEFORE, MONEY_AFTER, STATED = 45, 35, 25, 25, 15, 50
SCHEMA = "array<struct<raw:string,value:double,category:string,unit:string,bound:string,context:array<string>,begin:int,end:int>>"


def choice(cases: list[tuple[Column, Column | str]], other: Column) -> Column:
    return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed(cases), other)


#: Characters on either side of a span that are kept with it, and how many spans they can reach over: each has two at least.
KEPT, REACH = 50, 26
#: Values that running() takes together: arrays are copied only as far as that.
RUN = 128


def running(values: Column, start: Column, onward: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The state after each value of an array. States are put together by pieces of RUN, so time is linear in the values."""
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, F.lit(RUN)))

    def one(acc: Column, x: Column) -> Column:
        return let(onward(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

    def piece(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    return F.aggregate(pieces, F.struct(start.alias("at"), nested.alias("out")), piece, lambda acc: F.flatten(acc["out"]))


def spans(s: Column, pattern: Column) -> Column:
    """(raw, begin, end, left, right) of all matches in a text, with KEPT characters on either side. The text between the matches,
    put together with them, gives places and sides, so no match looks through the whole text again."""
    return let(F.arrays_zip(F.split(s, pattern, -1).alias("gap"), F.regexp_extract_all(s, pattern, F.lit(0)).alias("raw")), _spans)


def _spans(parts: Column) -> Column:
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["raw"]), F.lit(0))
    ends = running(F.transform(parts, length), F.lit(0), lambda at, n: at + n)
    # of a long gap only its ends can be near a match
    short = F.transform(parts, lambda x: F.struct(F.substring(x["gap"], 1, KEPT).alias("head"), F.when(F.length(x["gap"]) > KEPT, F.substring(x["gap"], -KEPT, KEPT)).otherwise(x["gap"]).alias("tail"), x["raw"].alias("raw")))

    def placed(near: Column, i: Column, end: Column) -> Column:
        x = F.get(near, i)
        first = F.greatest(i - REACH, F.lit(0))
        before = F.concat(F.array_join(F.transform(F.slice(near, first + 1, i - first), lambda p: F.concat(p["tail"], p["raw"])), ""), x["tail"])
        after = F.array_join(F.transform(F.slice(near, i + 2, F.lit(REACH)), lambda p: F.concat(p["head"], F.coalesce(p["raw"], F.lit("")))), "")
        left = F.when(F.length(before) > KEPT, F.substring(before, -KEPT, KEPT)).otherwise(before)
        return F.struct(x["raw"].alias("raw"), (end - F.length(x["raw"])).alias("begin"), end.alias("end"), left.alias("left"), F.substring(after, 1, KEPT).alias("right"))

    # the last part has no match
    count = F.size(parts) - 1
    return let(F.struct(short.alias("near"), ends.alias("ends")), lambda v: F.when(count > 0, F.transform(F.slice(v["ends"], 1, count), lambda end, i: placed(v["near"], i, end))).otherwise(F.array().cast("array<struct<raw:string,begin:int,end:int,left:string,right:string>>")))


def ahead(at: Column, n: int) -> Column:
    return F.substring(at["right"], 1, n)


def behind(at: Column, n: int) -> Column:
    return F.when(F.length(at["left"]) > n, F.substring(at["left"], -n, n)).otherwise(at["left"])


def outside(found: Column, taken: Column) -> Column:
    """Those of the spans found, in order, that begin in no span of taken: both are sorted together and swept once."""
    mark = lambda xs, kind: F.transform(xs, lambda x: F.struct(x["begin"].alias("begin"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    def swept(both: Column) -> Column:
        covered = running(both, F.lit(0), lambda until, x: F.when(x["kind"] == 0, F.greatest(until, x["end"])).otherwise(until))
        free = F.filter(F.zip_with(both, covered, lambda x, until: F.when(x["kind"] == 1, x["begin"] >= until)), lambda f: f.isNotNull())
        pairs = F.zip_with(found, free, lambda x, f: F.struct(x.alias("x"), f.alias("f")))
        return F.transform(F.filter(pairs, lambda p: p["f"]), lambda p: p["x"])

    return F.when(F.size(taken) == 0, found).otherwise(let(F.array_sort(F.concat(mark(taken, 0), mark(found, 1))), swept))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def context(at: Column) -> Column:
    """Stems of the four words on either side, without common words and numbers."""
    left = words(behind(at, NEAR))
    near = F.concat(F.slice(left, F.greatest(F.size(left) - 3, F.lit(1)), F.lit(4)), F.slice(words(ahead(at, NEAR)), 1, 4))
    return F.array_sort(F.array_distinct(F.filter(F.transform(near, words_of.stem), lambda w: (w != "") & ~w.isin(*COMMON) & ~w.rlike(r"^\d+$"))))


def bound(at: Column) -> Column:
    left, right = F.lower(behind(at, BOUND_BEFORE)), F.lower(ahead(at, BOUND_AFTER))
    cases = [(left.rlike("(?U)" + p), name) for name, p in BEFORE] + [(right.rlike("(?U)" + p), name) for name, p in AFTER]
    return choice([(test, F.lit(name)) for test, name in cases], F.lit("EXACT"))


def time_unit(following: Column) -> Column:
    """The unit of time that the first of the next five words to name one names; null if none does."""
    named = lambda w: choice([(F.rtrim(F.lower(w), F.lit(",.;:")).rlike(f"(?:{p})$"), F.lit(unit)) for p, unit in TIME.items()], F.lit(None).cast("string"))
    return F.get(F.filter(F.transform(F.slice(following, 1, 5), named), lambda u: u.isNotNull()), F.lit(0))


def counted(following: Column) -> Column:
    """The stem of the first following word that can be what is counted."""
    first = F.get(F.filter(F.transform(following, words_of.stem), lambda w: ~w.isin(*NOT_UNITS)), F.lit(0))
    return F.when(first.isNull() | first.isin(*COMMON), "").otherwise(first)


def numbers_outline(m: Column) -> Column:
    """Whether a number only numbers a section, a rule, a line. White space beyond KEPT characters is not looked through."""
    plain = (m["currency"] == "") & (m["share"] == "") & (m["scale"] == "")
    line_start = (m["begin"] == 0) | behind(m, 1).isin("\r", "\n")
    follows = lambda p: m["right"].rlike(p)
    titled = F.when(plain & line_start, follows(r"(?U)^\.\s+[A-Z]")).otherwise(False) | F.when(plain & F.contains(m["number"], F.lit(".")), follows(r"(?U)^\s+[A-Z]")).otherwise(False)
    headed = F.regexp_replace(F.lower(behind(m, OUTLINE_BEFORE)), r"(?U)\s+$", "").rlike("(?U)" + OUTLINE)
    return headed | titled


def dates(s: Column) -> Column:
    """Quantities that are days of a year: month times 100 and day."""
    months = F.create_map(*[F.lit(x) for item in MONTHS.items() for x in item])

    def found(pattern: str, month: int, day: int) -> Column:
        group = lambda x, i: F.regexp_extract(x["raw"], "(?iU)" + pattern, i)
        value = lambda x: (F.element_at(months, F.lower(group(x, month))) * 100 + group(x, day).cast("int")).cast("double")
        return F.transform(spans(s, F.lit("(?iU)" + pattern)), lambda x: quantity(x, x["raw"], value(x), F.lit("date"), F.lit("date"), F.lit("EXACT")))

    return F.concat(found(MONTH_DAY, 1, 2), found(DAY_MONTH, 2, 1))


def quantity(at: Column, raw: Column, value: Column, category: Column, unit: Column, of_bound: Column) -> Column:
    return F.struct(raw.alias("raw"), value.alias("value"), category.alias("category"), unit.alias("unit"), of_bound.alias("bound"), context(at).alias("context"), at["begin"].alias("begin"), at["end"].alias("end"))


def amounts(s: Column, taken: Column) -> Column:
    """Quantities that are amounts, shares, years, durations and counts, outside the spans that are taken."""
    pattern = "(?iU)" + AMOUNT
    part = lambda x, i: F.regexp_extract(x["raw"], pattern, i)
    free = let(spans(s, F.lit(pattern)), lambda found: outside(found, taken))
    read = F.transform(free, lambda x: F.struct(*[x[c].alias(c) for c in ("raw", "begin", "end", "left", "right")], *[part(x, i).alias(name) for i, name in enumerate(("currency", "number", "scale", "share"), 1)]))
    spelled = F.create_map(*[F.lit(x) for k, v in NUMBERS.items() for x in (k, float(v))])
    scaled = F.create_map(*[F.lit(x) for item in SCALES.items() for x in item])

    def one(m: Column) -> Column:
        word = F.lower(m["number"])
        value = F.coalesce(F.try_element_at(spelled, word), word.try_cast("double")) * F.coalesce(F.try_element_at(scaled, F.lower(m["scale"])), F.lit(1.0))
        return let(F.struct(value.alias("value"), words(ahead(m, NEAR)).alias("following")), lambda v: let(time_unit(v["following"]), lambda unit: told(m, v, unit)))

    def told(m: Column, v: Column, unit: Column) -> Column:
        year = (v["value"] >= 1900) & (v["value"] <= 2099) & (m["currency"] == "") & (m["share"] == "")
        money = (m["currency"] != "") | F.contains(F.lower(ahead(m, MONEY_AFTER)), F.lit("dollar"))
        kinds = [(unit.isNotNull(), "duration", unit), (year, "year", F.lit("year")), (money, "currency", F.lit("currency")), (m["share"] != "", "percentage", F.lit("percent"))]
        category = choice([(test, F.lit(name)) for test, name, _ in kinds], F.lit("count"))
        measure = choice([(test, x) for test, _, x in kinds], counted(v["following"]))
        raw = F.regexp_replace(m["raw"], r"(?U)^\s+|\s+$", "")
        return quantity(m, raw, v["value"], category, measure, bound(m))

    return F.transform(F.filter(read, lambda m: ~numbers_outline(m)), one)


def quantities(text: Column | str) -> Column:
    """All quantities of a text as SCHEMA: the dates first, then the amounts, each in order. Offsets are those of the text
    without thousands commas."""
    plain = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(\d),(\d)", "$1$2")
    none, digit = F.array().cast(SCHEMA), lambda s: s.rlike(r"(?U)\d")
    # most texts have no number at all, and no date is without digits
    number = lambda s: digit(s) | s.rlike(r"(?iU)\b(?:" + "|".join(NUMBERS) + r")\b")
    found = lambda s: let(F.when(digit(s), dates(s).cast(SCHEMA)).otherwise(none), lambda d: F.concat(d, amounts(s, d).cast(SCHEMA)))
    return let(plain, lambda s: F.when(number(s), found(s)).otherwise(none))


def display(q: Column) -> Column:
    """A quantity as readers see it: its bound, what was written, and its unit."""
    raw, unit = q["raw"], q["unit"]
    named = (unit != "") & ~F.contains(F.lower(raw), unit) & ~q["category"].isin("currency", "percentage", "date", "year")
    plural = F.when((q["value"] != 1) & ~unit.endswith("s"), F.concat(unit, F.lit("s"))).otherwise(unit)
    shown = F.when(named, F.concat_ws(" ", raw, plural)).otherwise(raw)
    prefix = None
    for bound, words in PREFIXES.items():
        prefix = F.when(q["bound"] == bound, words) if prefix is None else prefix.when(q["bound"] == bound, words)
    return F.when(prefix.isNotNull() & ~F.lower(raw).startswith(prefix), F.concat_ws(" ", prefix, shown)).otherwise(shown)


def _meaning(a: Column, b: Column, generic: bool = False) -> Column:
    """Number of context words that two quantities share and that say something."""
    words = F.filter(F.array_intersect(a["context"], b["context"]), lambda w: F.length(w) > 2)
    return F.size(words if generic else F.array_except(words, F.array(*[F.lit(w) for w in GENERIC])))


def _units_fit(a: Column, b: Column) -> Column:
    x, y = F.rtrim(a["unit"], F.lit("s")), F.rtrim(b["unit"], F.lit("s"))
    return (x == y) | (x == "") | (y == "")


def _same_value(a: Column, b: Column) -> Column:
    return F.abs(a["value"] - b["value"]) <= 0.001


def contradiction(claimed: Column, found: Column) -> Column:
    """What contradicts the first claimed quantity that is contradicted, as a sentence; null if nothing does."""
    corroborates = lambda c, e: (c["category"] == e["category"]) & (c["bound"] == e["bound"]) & _units_fit(c, e) & _same_value(c, e) & ((_meaning(c, e) >= 1) | (F.size(c["context"]) == 0))
    opposed = lambda c, e: F.concat_ws(">", c["bound"], e["bound"]).isin([f"{a}>{b}" for a, b in OPPOSED])
    needed = lambda c: F.when(c["category"].isin("year", "currency", "percentage"), 1).otherwise(2)
    against = lambda c, e: (c["category"] == e["category"]) & _units_fit(c, e) & (_meaning(c, e) >= needed(c)) & (~_same_value(c, e) | opposed(c, e))

    def told(c: Column, e: Column) -> Column:
        say = lambda a, b, d: F.concat(F.lit(a), display(c), F.lit(b), display(e), F.lit(d))
        value = say("Direct quantitative contradiction: Claim specifies '", "' but source specifies '", "'.")
        return F.when(~_same_value(c, e), value).otherwise(say("Direct boundary contradiction: Claim asserts '", "' but source specifies '", "'."))

    open_ones = F.filter(claimed, lambda c: ~F.exists(found, lambda e: corroborates(c, e)))
    each = F.transform(open_ones, lambda c: F.get(F.transform(F.filter(found, lambda e: against(c, e)), lambda e: told(c, e)), F.lit(0)))
    return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))


def grounds(c: Column, e: Column) -> Column:
    """Whether a found quantity grounds a claimed one: the same value, a compatible bound and enough shared context."""
    hard = ("currency", "percentage", "date")
    kinds = (c["category"] == e["category"]) | ~(c["category"].isin(*hard) | e["category"].isin(*hard))
    bounds = (c["bound"] == e["bound"]) | (c["bound"] == "EXACT") | (e["bound"] == "EXACT")
    enough = F.when((c["category"] == "year") | ((c["unit"] == e["unit"]) & (c["unit"] != "")), 1).otherwise(2)
    return kinds & _same_value(c, e) & bounds & (_meaning(c, e, generic=True) >= enough)


def grounded(claimed: Column, found: Column) -> Column:
    """Whether each claimed quantity is grounded by one that was found."""
    return F.forall(claimed, lambda c: F.exists(found, lambda e: grounds(c, e)))


def stated(claimed: Column, found: Column, text: Column) -> Column:
    """grounded(), and for quantities that are not, whether their plain value stands in the text near a word of their context."""

    def near(c: Column) -> Column:
        value = F.when(c["value"] == F.floor(c["value"]), c["value"].cast("decimal(38,0)").cast("string")).otherwise(c["value"].cast("string"))
        places = spans(text, F.concat(F.lit("(?U)\\b"), F.regexp_replace(value, r"\.", r"\\\\."), F.lit("\\b")))
        around = lambda x: F.lower(F.concat(behind(x, STATED), x["raw"], ahead(x, STATED)))
        said = lambda x: F.transform(F.filter(words(around(x)), lambda w: F.length(w) > 2), words_of.stem)
        return F.exists(places, lambda x: F.arrays_overlap(said(x), c["context"]))

    return F.forall(claimed, lambda c: F.exists(found, lambda e: grounds(c, e)) | near(c))
