"""Joins, folds, the pipeline and its streaming forms on small inputs."""

import json

from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.operators import cite, merge, state, validate
from docloom.plans import pipeline
from docloom.streaming import limits

PAYLOAD = {
    "language": "pl", "type": "faktura", "title": " T ", "date": "2024-03-12", "summarySentences": ["Pierwsze zdanie", "Drugie.", "Trzecie."],
    "keyPoints": ["a", "b", "c"], "keywords": ["K", "k", "L"], "organizations": ["ACME", "acme "], "people": [],
    "amounts": [{"value": 1234.5, "currency": "PLN", "context": "kwota 1 234,50", "page": 1}, {"value": 9.0, "currency": "PLN", "context": "x", "page": 7}],
    "dates": [{"date": "2024-03-12", "context": "12.03.2024", "page": 1}, {"date": "2030-01-01", "context": "y", "page": None}],
    "injectionDetected": False, "injectionExcerpt": None,
}


def request(doc, pages, name="f.pdf", count=None):
    return (doc, name, count or len(pages), pages, None)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), S.REQUEST)


def test_pipeline(spark):
    good = request(1, [(1, "Faktura 12.03.2024 na kwotę 1 234,50 PLN. Klucz AKIA" + "Z" * 16, "ocr")], name="AKIA" + "A" * 16)
    r = requests(spark, good, request(2, [(1, "  ", "text")]), request(3, [(1, "a", "text"), (1, "b", "text")]), request(4, [(1, "x" * 60000, "text")] * 1 + [(k, "x" * 60000, "text") for k in range(2, 10)]), request(5, [(1, "tekst", "text")]), request(6, [(1, "tekst", "text")]))
    e = spark.createDataFrame([(1, 0, json.dumps(PAYLOAD)), (6, 0, json.dumps(PAYLOAD | {"language": "zz"}))], "doc_id bigint, chunk_id int, payload_json string")
    results, errors = pipeline.analyze(r, e)
    assert {x["doc_id"]: x["code"] for x in errors.collect()} == {2: "NO_TEXT_LAYER", 3: "VALIDATION_FAILED", 4: "DOCUMENT_TOO_LONG", 5: "AI_UNAVAILABLE", 6: "AI_INVALID_RESPONSE"}
    x = results.first().asDict(recursive=True)
    assert x["document"] == {"fileName": "dokument.pdf", "pages": 1, "language": "pl", "type": "faktura", "title": "T", "date": "2024-03-12"}
    assert x["summary"] == "Pierwsze zdanie. Drugie. Trzecie."
    assert x["keywords"] == ["K", "L"] and x["entities"]["organizations"] == ["ACME"]
    assert [a["page"] for a in x["amounts"]] == [1, None]
    assert [(w["code"], w["path"]) for w in x["warnings"]] == [("SECRETS_REDACTED", None), ("OCR_PAGES", None), ("AMOUNT_NOT_IN_TEXT", "amounts[1]"), ("DATE_NOT_IN_TEXT", "dates[1]")]
    assert x["meta"]["redactions"] == [{"kind": "aws-access-key-id", "count": 2}]
    name, body = pipeline.export(results).first()
    assert name == "dokument.insight.json" and json.loads(body)["document"]["title"] == "T"


def test_pipeline_citations(spark):
    """Citations are checked against the fragment's pages, contexts get its spelling; one miss fails the document."""
    page = [(1, "Faktura 12.03.2024 na KWOTĘ: 1 234,50 PLN.", "text")]
    r = requests(spark, *[request(k, page) for k in range(1, 6)])
    item = lambda context, page=1, value=1234.5: {"value": value, "currency": "PLN", "context": context, "page": page}
    claims = {1: item("kwotę 1 234,50"), 2: item("kwotę 1 234,50", page=2), 3: item("kwota 1 234,50"), 4: item("Faktura 12.03.2024", value=7.0), 5: item("anything", page=None)}
    payload = PAYLOAD | {"dates": [], "summarySentences": ["Pierwsze zdanie.", "Drugie.", "Trzecie."]}
    e = spark.createDataFrame([(k, 0, json.dumps(payload | {"amounts": [a]})) for k, a in claims.items()], "doc_id bigint, chunk_id int, payload_json string")
    calls = spark.createDataFrame([(1, "id1", "small", True, "2026-01-01T00:00:00.000Z", 7)], "doc_id bigint, " + pipeline.CALLS)
    results, errors = pipeline.analyze(r, e, calls=calls, citations=True)
    got = {x["doc_id"]: x.asDict(recursive=True) for x in results.collect()}
    assert {k: x["amounts"][0]["context"] for k, x in got.items()} == {1: "KWOTĘ: 1 234,50", 5: "anything"}
    assert {x["doc_id"]: (x["code"], [(i["path"], i["message"]) for i in x["issues"]]) for x in errors.collect()} == {
        2: ("AI_INVALID_RESPONSE", [("amounts[0].page", cite.NO_PAGE)]),
        3: ("AI_INVALID_RESPONSE", [("amounts[0].context", cite.NOT_COPIED)]),
        4: ("AI_INVALID_RESPONSE", [("amounts[0].context", cite.NO_VALUE)]),
    }
    assert {k: got[1]["meta"][k] for k in ("requestId", "model", "durationMs")} == {"requestId": "id1", "model": "small", "durationMs": 7}
    assert [w["message"] for w in got[1]["warnings"] if w["code"] == "FALLBACK_MODEL"] == ["Główny model AI był niedostępny — użyto modelu zapasowego (small)."]


def test_client_counts_last_wins(spark):
    d = spark.createDataFrame([([("a", 2), ("b", 1), ("a", 5)],)], "f array<struct<kind:string,count:int>>")
    assert [tuple(x) for x in d.select(pipeline.last_counts(F.col("f")).alias("x")).first()["x"]] == [("a", 5), ("b", 1)]


def test_request_issues(spark):
    r = requests(spark, request(1, [(1, "a", "text"), (1, "b", "bad"), (3, "c", None)], name=" ", count=2))
    got = [(i["path"], i["message"]) for i in validate.split(r, validate.request_issues())[1].collect()]
    assert sorted(got) == sorted([("fileName", "Expected 1 to 255 characters."), ("pages.1.number", "Duplicate page number."), ("pages.1.source", "Unknown source."), ("pages.2.number", "Page number exceeds pageCount.")])


def test_retry_feedback(spark):
    d = spark.createDataFrame([([("a", "m")] * 12,)], "i array<struct<path:string,message:string>>")
    assert d.select(validate.retry_feedback(F.col("i")).alias("x")).first()["x"].count("- a: m") == 10


def test_unknown_keys(spark):
    d = spark.createDataFrame([('{"number":1,"image":"x"}',)], "j string")
    assert d.select(validate.unknown_keys(F.col("j"), ["number", "text"]).alias("x")).first()["x"] == ["image"]


def test_merge_keeps_first(spark):
    d = spark.createDataFrame([(1, 0, " Acme  Inc"), (1, 1, "acme inc"), (1, 2, ""), (1, 3, "Zed"), (2, 0, "ACME INC")], "doc bigint, pos int, t string")
    assert sorted((r["doc"], r["t"]) for r in merge.unique_strings(d, ["doc"], "t", ["pos"], 1).collect()) == [(1, "Acme Inc"), (2, "ACME INC")]


def test_citations(spark):
    pieces = spark.createDataFrame([(1, 1, 0, "Kwota 100 zł"), (1, 1, 1, "do zapłaty")], "doc_id bigint, page int, pos int, text string")
    sources = cite.page_texts(pieces)
    assert sources.first()["source"] == "Kwota 100 zł do zapłaty"
    items = spark.createDataFrame([(1, "a0", 1, "100 zł do", 100.0), (1, "a1", 2, "x", 1.0), (1, "a2", 1, "00 zł", 100.0), (1, "a3", 1, "Kwota", 100.0), (1, "a4", None, "?", 1.0)], "doc_id bigint, path string, page int, context string, value double")
    got = {r["path"]: r["message"] for r in cite.validate_amounts(items, sources).collect()}
    assert got == {"a1.page": cite.NO_PAGE, "a2.context": cite.NOT_COPIED, "a3.context": cite.NO_VALUE}
    loose = spark.createDataFrame([(1, "a", 1, "KWOTA: 100 ZŁ", 100.0)], items.schema)
    assert cite.restore(loose, sources).first()["context"] == "Kwota 100 zł"


def test_source_contexts(spark):
    pages = spark.createDataFrame([(1, 1, 0, "lorem " * 20 + "za 250,00 EUR w dniu 01.02.2023 " + "ipsum " * 60), (1, 2, 0, "znów 250,00 EUR")], "doc_id bigint, page int, pos int, text string")
    c = cite.source_contexts(pages)
    first = {(r["page"], r["cents"], r["date"]): r["excerpt"] for r in c.collect()}
    assert "250,00 EUR" in first[1, 25000.0, None] and len(first[1, 25000.0, None]) <= 240
    assert not first[1, 25000.0, None].startswith("rem") and (1, None, "2023-02-01") in first
    items = spark.createDataFrame([(1, "a", 250.0, 2), (1, "b", 250.0, 9), (1, "c", 7.0, 1)], "doc_id bigint, path string, value double, page int")
    assert {r["path"]: r["page"] for r in cite.resolve(items, c).collect()} == {"a": 2, "b": 1, "c": None}


def test_rate_limit_and_stream_agree(spark, tmp_path):
    ts = [(1, t) for t in (0, 10, 20, 30, 100, 105)] + [(2, 5), (2, 200)]
    events = spark.createDataFrame(ts, "user_id bigint, ts_us bigint")
    batch = sorted(tuple(r) for r in state.rate_limit(events, "user_id", "ts_us", 2, 100).collect())
    assert batch == [(1, 0, True), (1, 10, True), (1, 20, False), (1, 30, False), (1, 100, True), (1, 105, True), (2, 5, True), (2, 200, True)]
    events.write.parquet(str(tmp_path / "in"))
    q = limits.rate_limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 2, 100).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("limited").collect()) == batch


def test_analyze_stream(spark, tmp_path):
    requests(spark, request(1, [(1, "Razem 10,00 PLN. Jest drugie zdanie. Jest trzecie zdanie.", "text")])).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(S.REQUEST).json(str(tmp_path / "in"))
    limits.analyze_stream(source, pipeline.rule_based_payloads, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out/results/*")).select("amounts.value").first()[0] == [10.0]


def test_cache(spark):
    rows = [("s", 0, 0, "a", 1, False), ("s", 1, 1, "a", 1, False), ("s", 2, 2, "b", 1, False), ("s", 3, 3, "c", 1, False), ("s", 4, 4, "a", 1, False), ("s", 5, 5, "c", 1, False), ("s", 6, 20, "c", 1, False), ("s", 7, 21, "big", 99, False), ("s", 8, 22, "big", 99, False), ("s", 9, 23, "c", 1, True)]
    got = state.cache_replay(spark.createDataFrame(rows, "scope string, pos bigint, ts bigint, key string, weight int, purge boolean"), 2, 10, 10).orderBy("pos").collect()
    assert [r["cache_hit"] for r in got] == [False, True, False, False, False, True, False, False, False, False]


def test_retry_outcome(spark):
    cases = [(["ok"], "OK", 1), (["invalid", "ok"], "OK", 2), (["invalid", "invalid"], "AI_INVALID_RESPONSE", 2), (["retryable", "ok"], "OK", 2), (["retryable", "retryable"], "AI_UNAVAILABLE", 2), (["fatal"], "AI_UNAVAILABLE", 1), (["retryable", "invalid", "ok"], "OK", 3)]
    d = spark.createDataFrame(cases, "k array<string>, o string, n int").select("o", "n", state.retry_outcome(F.col("k")).alias("r"))
    assert all((r["r"]["outcome"], r["r"]["attempts"]) == (r["o"], r["n"]) for r in d.collect())


def test_budget(spark):
    rows = [(1, 0, 0, 50, 0, 1, 10, 1, 5), (1, 1, 1, 60, 0, 1, 10, 1, 5), (2, 0, 0, 1, 0, 0, 0, 1, 5), (3, 0, 3, 1, 0, 0, 0, 1, 5)]
    d = spark.createDataFrame(rows, "root_id bigint, visit int, depth int, pages int, images int, attachments int, attachment_bytes bigint, decoded bigint, size bigint")
    assert {r["root_id"]: r["failed_at"] for r in state.budget_admission(d).collect()} == {1: 1, 2: None, 3: 0}


def test_workflow(spark):
    a = [("extract", None), ("progress", 40), ("analyze", None), ("progress", 90)]
    d = spark.createDataFrame([(a,), (a[:2],)], "a array<struct<type:string,percent:int>>")
    assert [tuple(r["x"]) for r in d.select(state.workflow_phase(F.col("a")).alias("x")).collect()] == [("analyzing", None), ("extracting", 40)]


def test_error_body(spark):
    d = spark.createDataFrame([(1, "RATE_LIMITED", [("p", "m")] * 30)], "doc_id bigint, code string, issues array<struct<path:string,message:string>>")
    r = validate.error_body(d, S.error_dimension(spark)).first()
    assert r["status"] == 429 and len(r["issues"]) == 20
    assert len(S.CURRENCIES) == 158 and len(S.LANGUAGES) == 183


def test_passages_around_numbers(spark):
    """Against a scan by position."""
    import random
    import re

    r = random.Random(8)
    texts = ["", "7", "no number", "1.2,3/4 5", "x1y 2..3 .4", "a" * 300 + "5" + "b" * 300] + ["".join(r.choice("ab1 2.,ż-") for _ in range(r.randint(0, 500))) for _ in range(40)]
    word = lambda c: c.isalnum()

    def passage(t, at):
        a, b = max(0, at - 60), min(len(t), at + 180)
        head, tail = t[a:at], t[at:b]
        if a and word(t[a - 1]):
            cut = next((k for k, c in enumerate(head) if not word(c)), None)
            head = "" if cut is None else head[cut + 1 :]
        if b < len(t) and word(t[b]):
            cut = next((k for k in range(len(tail) - 1, -1, -1) if not word(tail[k])), 0)
            tail = tail[:cut]
        return (head + tail).strip(" ")

    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cite._mentions(F.col("t")).alias("m"))
    for row in d.collect():
        want = [passage(row["t"], m.start()) for m in re.finditer(r"[0-9][0-9.,/-]*", row["t"])]
        assert [m["excerpt"] for m in row["m"]] == want


def test_full_texts_are_those_of_prepare(spark):
    key = "AKIA" + "Z" * 16
    r = requests(spark, request(1, [(2, f"b {key}\r\n\r\n\r\n\r\nc ", "text"), (1, " a ", "ocr")]), request(2, [(1, "  ", "text")]), request(3, [(1, "x" * (S.MAX_TOTAL_CHARS + 1), "text")]))
    of = lambda d: sorted(tuple(x) for x in d.select("doc_id", "full_text", "error").collect())
    got = of(pipeline.full_texts(r))
    assert got == of(pipeline.prepare(r)) and [e for *_, e in got] == [None, "NO_TEXT_LAYER", "DOCUMENT_TOO_LONG"]


def test_statements_are_dealt_over_tasks(spark):
    """One file of few rows must not put the whole pipeline into one task."""
    from docloom.session import spread

    d = spread(spark.range(100).coalesce(1), "id")
    assert d.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
