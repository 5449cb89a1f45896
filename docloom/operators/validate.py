"""Validation: every rule adds (path, message) issues to a row; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.functions.text import count_sentences, let, trim_ws, utf16_length

def no_issues() -> Column:
    return F.array().cast("array<struct<path:string,message:string>>")


def issue(bad: Column, path: Column | str, message: str) -> Column:
    p = path if isinstance(path, Column) else F.lit(path)
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(p.alias("path"), F.lit(message).alias("message")))


def issues(*found: Column) -> Column:
    return F.filter(F.concat(*found), lambda i: i.isNotNull())


def text_bounds(t: Column, path: Column | str, most: int, nullable: bool = False) -> Column:
    own = trim_ws(t)
    # a text has no more UTF-16 units than bytes
    bad = (own == "") | ((F.octet_length(t) > most) & (utf16_length(own) > most))
    return issue(t.isNotNull() & bad if nullable else bad, path, f"Expected 1 to {most} characters.")


def request_issues() -> Column:
    """Issues of a request: columns file_name, page_count, pages."""
    pages = F.col("pages")
    at = lambda i, f: F.concat(F.lit("pages."), i.cast("string"), F.lit("." + f))
    earlier = lambda p, i: F.array_contains(F.transform(F.slice(pages, F.lit(1), i), lambda q: q["number"]), p["number"])

    def of_page(p, i):
        return F.array(
            issue((p["number"] < 1) | (p["number"] > S.MAX_PAGES), at(i, "number"), f"Expected 1 to {S.MAX_PAGES}."),
            issue(utf16_length(p["text"]) > S.MAX_PAGE_CHARS, at(i, "text"), f"Expected at most {S.MAX_PAGE_CHARS} characters."),
            issue(p["source"].isNotNull() & ~p["source"].isin("text", "ocr", "attachment"), at(i, "source"), "Unknown source."),
            issue(p["number"] > F.col("page_count"), at(i, "number"), "Page number exceeds pageCount."),
            issue(earlier(p, i), at(i, "number"), "Duplicate page number."),
        )

    own = F.array(
        text_bounds(F.col("file_name"), "fileName", 255),
        issue((F.col("page_count") < 1) | (F.col("page_count") > S.MAX_PAGES), "pageCount", f"Expected 1 to {S.MAX_PAGES}."),
        issue((F.size(pages) < 1) | (F.size(pages) > S.MAX_PAGES), "pages", f"Expected 1 to {S.MAX_PAGES} items."),
    )
    return issues(own, F.flatten(F.transform(pages, of_page)))


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a strict contract does not know."""
    return F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed]))


def result_issues() -> Column:
    """Issues of a result: columns document, summary, keyPoints, keywords, entities, amounts, dates."""
    d = F.col("document")
    at = lambda name, i, f="": F.concat(F.lit(name + "."), i.cast("string"), F.lit(f))
    valid_date = lambda x: x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()
    n = count_sentences(F.col("summary"), d["language"])
    each = lambda name, make: F.transform(F.col(name), make)

    def amount(a, i):
        return F.array(
            issue(F.isnan(a["value"]) | (F.abs(a["value"]) == float("inf")), at("amounts", i, ".value"), "Expected a finite number."),
            issue(~a["currency"].isin(S.CURRENCIES), at("amounts", i, ".currency"), "Unknown currency."),
            text_bounds(a["context"], at("amounts", i, ".context"), 300),
            issue(a["page"].isNotNull() & (a["page"] < 1), at("amounts", i, ".page"), "Expected 1 or more."),
        )

    def date(a, i):
        return F.array(
            issue(~valid_date(a["date"]), at("dates", i, ".date"), "Expected an ISO date."),
            text_bounds(a["context"], at("dates", i, ".context"), 300),
            issue(a["page"].isNotNull() & (a["page"] < 1), at("dates", i, ".page"), "Expected 1 or more."),
        )

    own = F.array(
        text_bounds(d["fileName"], "document.fileName", 255),
        issue((d["pages"] < 1) | (d["pages"] > S.MAX_PAGES), "document.pages", f"Expected 1 to {S.MAX_PAGES}."),
        issue(~d["language"].isin(S.LANGUAGES), "document.language", "Unknown language."),
        issue(~d["type"].isin(S.DOCUMENT_TYPES), "document.type", "Unknown type."),
        text_bounds(d["title"], "document.title", 300, nullable=True),
        issue(d["date"].isNotNull() & ~valid_date(d["date"]), "document.date", "Expected an ISO date."),
        text_bounds(F.col("summary"), "summary", 2000),
        issue(let(n, lambda k: (k < 3) | (k > 5)), "summary", "Expected 3–5 sentences in the summary."),
        issue((F.size("keyPoints") < 3) | (F.size("keyPoints") > 7), "keyPoints", "Expected 3 to 7 items."),
        issue(F.size("keywords") > 20, "keywords", "Expected at most 20 items."),
    )
    return issues(
        own,
        each("keyPoints", lambda x, i: text_bounds(x, at("keyPoints", i), 500)),
        each("keywords", lambda x, i: text_bounds(x, at("keywords", i), 80)),
        F.flatten(each("amounts", amount)),
        F.flatten(each("dates", date)),
    )


def payload_issues(p: Column) -> Column:
    """Issues of an extraction payload: each summary entry one sentence, three to five in all."""
    lang = p["language"]
    one = F.transform(p["summarySentences"], lambda s, i: issue(count_sentences(s, lang) != 1, F.concat(F.lit("summarySentences."), i.cast("string")), "Expected exactly one sentence."))
    n = F.size(p["summarySentences"])
    own = F.array(
        issue(p.isNull(), "(root)", "Response was not valid JSON."),
        issue(p.isNotNull() & ((n < 3) | (n > 5)), "summarySentences", "Expected 3–5 sentences in the summary."),
        issue(p.isNotNull() & ~lang.isin(S.LANGUAGES), "language", "Unknown language."),
        issue(p.isNotNull() & (F.size(p["amounts"]) > 200), "amounts", "Expected at most 200 items."),
        issue(p.isNotNull() & (F.size(p["dates"]) > 200), "dates", "Expected at most 200 items."),
    )
    return issues(own, F.coalesce(one, no_issues()))


def split(df: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without issues, (doc_id, path, message) of the others)."""
    d = df.withColumn("issues", found)
    return d.where(F.size("issues") == 0).drop("issues"), d.select("doc_id", F.explode("issues").alias("i")).select("doc_id", "i.path", "i.message")


def error_body(errors: DataFrame, dimension: DataFrame) -> DataFrame:
    """errors (doc_id, code, issues) with message, status and the first 20 issues."""
    return errors.join(F.broadcast(dimension), "code").withColumn("issues", F.slice("issues", 1, 20))


def retry_feedback(found: Column) -> Column:
    """The first ten issues as lines for a second attempt."""
    lines = F.transform(F.slice(found, 1, 10), lambda i: F.concat(F.lit("- "), i["path"], F.lit(": "), i["message"]))
    return F.concat(F.lit("These points of the last answer break a rule:\n"), F.array_join(lines, "\n"), F.lit("\nSend the whole JSON object again with all of them mended."))
