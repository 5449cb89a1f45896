"""Text projections as Column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the contract means it: more than Java's \s.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once: within lambdas, Spark shares no common subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The characters of WS.
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Control characters that go; line breaks and tabs apart.
CONTROLS = "".join(map(chr, [*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]))


def trim_ws(t: Column) -> Column:
    return F.btrim(t, F.lit(SPACE_CHARS))


def one_line(t: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(F.translate(t, SPACE_CHARS, " " * len(SPACE_CHARS)), " {2,}", " ")


def collapse(t: Column) -> Column:
    return F.btrim(one_line(t))


def utf16_length(t: Column) -> Column:
    """Length in UTF-16 units, which the limits are stated in."""
    return F.when(F.octet_length(t) == F.length(t), F.length(t)).otherwise((F.octet_length(F.encode(t, "UTF-16LE")) / 2).cast("int"))


def strip_controls(t: Column, keep_breaks: bool) -> Column:
    return F.translate(t, CONTROLS if keep_breaks else CONTROLS + "\t\n\r", "")


def normalize_text(t: Column) -> Column:
    t = F.replace(F.replace(strip_controls(t, True), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, "[ \t]+\n", "\n")
    return trim_ws(F.regexp_replace(t, "\n{3,}", "\n\n"))


def sanitize_file_name(name: Column) -> Column:
    base = F.element_at(F.split(name, r"[\\/]"), -1)
    clean = F.left(trim_ws(strip_controls(base, False)), F.lit(255))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("dokument.pdf"))


def non_empty(t: Column) -> Column:
    return F.nullif(trim_ws(t), F.lit(""))


def export_file_name(name: Column) -> Column:
    base = F.left(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"[^\p{L}\p{N}._-]+", "_"), F.lit(120))
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("dokument")), F.lit(".insight.json"))


def _pairs() -> str:
    """Latin letters with marks as an SQL array of (decomposed, composed); one expression, however many there are."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
            pairs.append((parts, c))
    # Letters with two marks come first: what remains has one.
    pairs.sort(key=lambda p: -len(p[0]))
    return "array(" + ", ".join(f"struct('{a}' AS a, '{b}' AS b)" for a, b in pairs) + ")"


COMPOSED = _pairs()


def composed(t: Column) -> Column:
    """Latin letters of two characters (a letter and a combining mark) as one, so that both spellings are equal. Other scripts
    stay as they are."""
    return F.when(t.rlike(r"\p{M}"), F.aggregate(F.expr(COMPOSED), t, lambda s, p: F.replace(s, p["a"], p["b"]))).otherwise(t)


def normalize_key(t: Column) -> Column:
    """Key for case- and space-insensitive equality, also of composed and decomposed letters."""
    return F.lower(composed(collapse(t)))


#: Letters and what they fold to.
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžłÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzzlaaaaaaceeeeiiiinooooouuuuy"


def fold(t: Column) -> Column:
    """Lower case without diacritics, for Latin text, combining marks too; ł is l, ß is ss."""
    marked = F.replace(F.translate(F.regexp_replace(F.lower(t), r"\p{M}+", ""), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(marked)


def ends_sentence(t: Column) -> Column:
    return t.rlike("[.!?…。！？؟।][\\p{Pe}\\p{Pf}\"'»”]*$")


def complete_sentence(t: Column) -> Column:
    return let(collapse(t), lambda c: F.when(ends_sentence(c), c).otherwise(F.concat(c, F.lit("."))))


#: Abbreviations that end no sentence before a word, German months after an ordinal.
TITLES = "dr prof mgr mr mrs ms mme mlle sr sra srta"
GERMAN_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"


def count_sentences(t: Column, lang: Column) -> Column:
    """Sentences with a letter or digit, by the JVM's break iterator; title abbreviations and German
    ordinal dates are masked first."""
    masked = F.regexp_replace(t, rf"(?iu)(?<![A-Za-z0-9_])({TITLES.replace(' ', '|')})\.(?=\s+\p{{L}})", "$1\u2060")
    german = F.regexp_replace(masked, rf"(?iu)(?<![A-Za-z0-9_])([1-9]|[12][0-9]|3[01])\.(?=\s+(?:{GERMAN_MONTHS.replace(' ', '|')})\s+[0-9]{{4}}(?![A-Za-z0-9_]))", "$1\u2060")
    text = F.when(lang == "de", german).otherwise(masked)
    return F.size(F.filter(F.sentences(text, lang, F.lit("")), lambda s: F.exists(s, lambda w: w.rlike(r"[\p{L}\p{N}]"))))


def non_space_length(t: Column) -> Column:
    return F.length(F.translate(t, SPACE_CHARS, ""))


def is_scan_page(t: Column, threshold: int = 20) -> Column:
    return non_space_length(t) < threshold


def escape_delimiters(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?i)<({WS}*/?{WS}*document(?![A-Za-z0-9_]))", "‹$1")


def excerpt_appears(source: Column, excerpt: Column) -> Column:
    """Whether excerpt stands in source without cutting a word at either end. The first place decides nearly
    always; only where a word is cut there, a pattern looks for others."""
    word = r"^[\p{L}\p{N}]"
    first, last = excerpt.rlike(word), F.right(excerpt, F.lit(1)).rlike(word)
    at = F.instr(source, excerpt)
    before, after = F.substring(source, at - 1, F.lit(1)), F.substring(source, at + F.length(excerpt), F.lit(1))
    cut = (first & (at > 1) & before.rlike(word)) | (last & after.rlike(word))
    quoted = F.concat(F.lit(r"\Q"), F.replace(excerpt, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    head = F.when(first, r"(?<![\p{L}\p{N}])").otherwise("")
    tail = F.when(last, r"(?![\p{L}\p{N}])").otherwise("")
    elsewhere = F.rlike(source, F.concat(head, quoted, tail))
    return F.when((excerpt == "") | ~F.contains(source, excerpt), False).when(~cut, True).otherwise(elsewhere)


def locate_excerpt(source: Column, context: Column, cap: int = 300) -> Column:
    """The source's own spelling of context: itself if it appears, else the first run of the same words
    in any case with any separators, at most cap long; null if there is none."""

    def respelled(words):
        quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), F.array_join(quoted, r"[^\p{L}\p{N}]+"), F.lit(r"(?![\p{L}\p{N}])"))
        runs = F.filter(F.regexp_extract_all(source, pattern, F.lit(0)), lambda m: F.length(m) <= cap)
        return F.when(F.size(words) > 0, F.get(runs, F.lit(0)))

    words = F.regexp_extract_all(context, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(excerpt_appears(source, context), context).otherwise(let(words, respelled))


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def valid_page(page: Column, page_count: Column) -> Column:
    return F.when(page <= page_count, page)


def excerpt_at(flat: Column, at: Column, cap: int = 200) -> Column:
    """A sentence-bounded excerpt of a one-line text around position at (0-based)."""
    back = F.locate(" .", F.reverse(F.substring(flat, F.lit(1), at)))
    start = F.greatest(F.when(back > 0, at - back).otherwise(0), at - cap // 2, F.lit(0))
    stop = F.regexp_instr(F.substring(flat, at + 1, F.length(flat)), F.lit(r"[.!?](\s|$)"))
    end = let(stop, lambda n: F.when(n == 0, F.least(F.length(flat), at + cap)).otherwise(at + n))
    cut = let(start, lambda a: collapse(F.substring(flat, a + 1, end - a)))
    return let(cut, lambda c: F.when(F.length(c) > cap, F.concat(F.left(c, F.lit(cap - 1)), F.lit("…"))).otherwise(c))


def polish_amount(v: Column) -> Column:
    """pl-PL number: no-break spaces between thousands from 10 000 on, a comma, up to two decimals."""

    def shortened(whole):
        return F.when(whole.endswith(",00"), F.substring_index(whole, ",", 1)).when(whole.endswith("0"), F.left(whole, F.length(whole) - 1)).otherwise(whole)

    text = let(F.translate(F.format_number(v, 2), ",.", "\u00a0,"), shortened)
    return F.when(F.abs(v) < 10000, F.replace(text, F.lit("\u00a0"), F.lit(""))).otherwise(text)


def format_duration(ms: Column) -> Column:
    return F.concat(F.regexp_replace(F.translate(F.format_number(ms / 1000, 1), ",.", "\u00a0,"), ",0$", ""), F.lit(" s"))


JSON_TOKEN = r'"(?:\\.|[^"\\])*"(?:\s*:)?|\b(?:true|false|null)\b|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?'


def json_tokens(t: Column) -> Column:
    """Tokens of a JSON text with their class: key, string, boolean, null, number."""
    kind = lambda x: F.when(x.rlike(r'^".*:$'), "key").when(x.startswith('"'), "string").when(x.isin("true", "false"), "boolean").when(x == "null", "null").otherwise("number")
    return F.transform(F.regexp_extract_all(t, F.lit(JSON_TOKEN), F.lit(0)), lambda x: F.struct(kind(x).alias("kind"), x.alias("token")))
