"""Numbers and dates in text: every reading of them, as sets to ground claims in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, let

#: Suffixes and their factors.
THOUSAND = r"tys\.?|tysi[aą]c\p{L}*|thousand|tsd\.?|k"
MILLION = r"mln\.?|milion\p{L}*|million\p{L}*|mio\.?|m"
BILLION = r"mld\.?|miliard\p{L}*|billion\p{L}*|bn|mrd\.?"
#: How grouped and plain numbers look.
SPACES = "\u00a0\u202f"
GROUPED = rf"[0-9]{{1,3}}(?:[ {SPACES}.,'][0-9]{{3}})+(?:[.,][0-9]{{1,4}})?"
PLAIN = r"[0-9]+(?:[.,][0-9]{1,4})?"
#: Month names, January to December.
MONTHS = [
    "stycznia styczeń styczen january jan januar jänner",
    "lutego luty february feb februar",
    "marca marzec march mar märz marz",
    "kwietnia kwiecień kwiecien april apr",
    "maja maj may mai",
    "czerwca czerwiec june jun juni",
    "lipca lipiec july jul juli",
    "sierpnia sierpień sierpien august aug",
    "września wrzesień wrzesien wrzesnia september sep sept",
    "października październik pazdziernik pazdziernika october oct oktober okt",
    "listopada listopad november nov",
    "grudnia grudzień grudzien december dec dezember dez",
]
MONTH_OF = {name: k + 1 for k, names in enumerate(MONTHS) for name in names.split()}
MONTH_NAMES = "|".join(sorted(MONTH_OF, key=len, reverse=True))


def to_cents(v: Column) -> Column:
    """Rounded cents, kept as a double: no saturation at large values."""
    return F.round(v * 100)


def interpret_number(token: Column) -> Column:
    """All readings of a number token as doubles: a lone separator may be decimal or thousands."""
    number = lambda x: x.try_cast("double")

    def lone(c):
        """With one kind of separator: a decimal if it stands once, thousands if all groups have three digits."""
        return let(F.split(F.replace(c, F.lit(","), F.lit(".")), r"\."), lambda g: F.array(
            F.when(F.size(g) == 2, number(F.array_join(g, "."))),
            F.when(F.forall(F.slice(g, 2, 1000), lambda x: F.length(x) == 3), number(F.array_join(g, ""))),
        ))

    def both(c):
        """With both kinds: the last one is the decimal point."""
        decimal_comma = F.regexp_replace(F.replace(c, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
        return F.array(number(F.when(c.rlike(r",[^.]*$"), decimal_comma).otherwise(F.replace(c, F.lit(","), F.lit("")))))

    def read(c):
        comma, dot = c.contains(","), c.contains(".")
        return F.when(comma & dot, both(c)).when(comma | dot, lone(c)).otherwise(F.array(number(c)))

    bare = F.when(token.rlike(f"[ {SPACES}']"), F.translate(token, f" {SPACES}'", "")).otherwise(token)
    found = F.filter(let(bare, read), lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return let(found, lambda a: F.when(F.size(a) < 2, a).otherwise(F.array_distinct(a)))


def multiplier(suffix: Column) -> Column:
    full = lambda p: suffix.rlike(f"(?iu)^(?:{p})$")
    return F.when(suffix == "", None).when(full(THOUSAND), 1e3).when(full(MILLION), 1e6).when(full(BILLION), 1e9)


def _mentions(t: Column) -> Column:
    """Every number with its suffix, grouped ones and their parts. A suffix has no digit, so what follows is the same with it
    taken along."""
    tail = rf"(?:{WS}?(?:{THOUSAND}|{MILLION}|{BILLION})(?!\p{{L}}))?"
    found = [F.regexp_extract_all(t, F.lit(f"(?iu)(?:{p}){tail}"), F.lit(0)) for p in (GROUPED + "(?![0-9])", PLAIN)]
    return F.array_distinct(F.concat(*found))


def collect_numbers(t: Column) -> Column:
    """Distinct cents of all numbers in a text: each reading, with and without its suffix's factor; also
    with line breaks between digits read as spaces."""
    breaks = r"([0-9])[ \t]*\n[ \t]*(?=[0-9])"
    none = F.array().cast("array<string>")
    mentions = F.when(t.rlike(breaks), F.concat(_mentions(t), _mentions(F.regexp_replace(t, breaks, "$1 ")))).when(t.rlike("[0-9]"), _mentions(t)).otherwise(F.when(t.isNotNull(), none))

    def readings(m):
        # a mention without a suffix ends with a digit
        bare = F.right(m, F.lit(1)).between("0", "9")
        suffix = F.when(~bare, F.regexp_replace(m, rf"^[^\p{{L}}]*[0-9]{WS}?", ""))
        token = F.when(bare, m).otherwise(F.regexp_replace(m, "[^0-9]+$", ""))

        def scaled(plain):
            factor = let(suffix, multiplier)
            return let(factor, lambda f: F.when(f.isNull(), plain).otherwise(F.concat(plain, F.transform(plain, lambda v: v * f))))

        return let(interpret_number(token), scaled)

    return F.array_distinct(F.transform(F.flatten(F.transform(mentions, readings)), to_cents))


#: Days of each month; February has one more in leap years.
DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """yyyy-MM-dd, null if there is no such day."""
    year, month, day = (x.cast("int") for x in (y, m, d))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.get(F.expr(f"array({', '.join(map(str, DAYS))})"), month - 1) + F.when((month == 2) & leap, 1).otherwise(0)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    text = F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2))
    return F.when((year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= last), text)


def is_iso_date(t: Column) -> Column:
    return t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()


def collect_dates(t: Column) -> Column:
    """Distinct ISO dates: numeric day-month-year in both readings, year-month-day, and month names."""
    b, e = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    sep = "[.\\-/]"
    month = F.expr("map(" + ", ".join(f"'{name}', {k}" for name, k in MONTH_OF.items()) + ")")
    none = F.array().cast("array<string>")

    def each(pattern: str, make):
        """One extraction of whole matches; their parts are taken from each match."""
        p = F.lit(pattern)
        return F.flatten(F.transform(F.regexp_extract_all(t, p, F.lit(0)), make))

    def numeric(*orders):
        """The readings of a numeric form: the places of year, month and day."""

        def readings(m):
            parts = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
            return let(parts, lambda g: F.array(*[iso_date(*[F.get(g, F.lit(k)) for k in order]) for order in orders]))

        return readings

    def named(m):
        name = F.element_at(month, F.lower(F.regexp_extract(m, r"\p{L}+", 0)))
        day = F.regexp_extract(m, r"(?<![0-9])[0-9]{1,2}(?![0-9])", 0)
        return F.array(iso_date(F.right(m, F.lit(4)), name, day))

    # The two forms with any word for the month: most texts have none, and need not be searched for names.
    shape = rf"[0-9](?:\.?{WS}+\p{{L}}+\.?|,?){WS}+[0-9]{{4}}"
    # A number ends no run of digits, so that the two numeric forms are kept apart as they may overlap.
    found = F.concat(
        each(f"(?=[0-9]){b}[0-9]{{1,2}}{sep}[0-9]{{1,2}}{sep}[0-9]{{4}}{e}", numeric((2, 1, 0), (2, 0, 1))),
        each(f"(?=[0-9]){b}[0-9]{{4}}{sep}[0-9]{{1,2}}{sep}[0-9]{{1,2}}{e}", numeric((0, 1, 2))),
        F.when(t.rlike(shape) & t.rlike(rf"(?iu){b}(?:{MONTH_NAMES})[. \s\u00a0-\uffff]"), F.concat(
            each(rf"(?iu){b}[0-9]{{1,2}}\.?{WS}+(?:{MONTH_NAMES})\.?{WS}+[0-9]{{4}}{e}", named),
            each(rf"(?iu){b}(?:{MONTH_NAMES})\.?{WS}+[0-9]{{1,2}},?{WS}+[0-9]{{4}}{e}", named),
        )).otherwise(none),
    )
    return F.when(~t.rlike("[0-9]{4}"), none).when(t.isNotNull(), F.array_distinct(F.filter(found, lambda d: d.isNotNull())))


def grounding_status(present: Column, scan_pages: Column, page: Column) -> Column:
    """grounded, from-scan or not-found."""
    miss = F.when((F.size(scan_pages) == 0) | scan_pages.isNull(), "not-found").when(page.isNotNull() & ~F.array_contains(scan_pages, page), "not-found").otherwise("from-scan")
    return F.when(present, "grounded").otherwise(miss)
