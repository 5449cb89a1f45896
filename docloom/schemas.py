"""Types, limits and dimensions of the data model. The values are fixed by the data contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Limits.
MAX_FILE_BYTES, MAX_PAGES, MAX_PAGE_CHARS, MAX_TOTAL_CHARS = 10 * 1024 * 1024, 500, 60_000, 480_000
CHUNK_BUDGET, MAX_CHUNKS, SCAN_THRESHOLD, HISTORY_SIZE = 120_000, 4, 20, 10

#: ISO 4217 codes in use, ISO 639-1 codes, document types.
CURRENCIES = """AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF
CLP CNY COP CRC CUC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL
HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL
MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON
RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH
UGX USD UYU UZS VED VES VND VUV WST XAF XCD XCG XOF XPF YER ZAR ZMW ZWG""".split()
LANGUAGES = """aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de
dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia
id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo
lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl
ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk
tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu""".split()
DOCUMENT_TYPES = "faktura umowa oferta raport inne".split()

#: Error codes with message and HTTP status.
ERRORS = [
    ("BAD_REQUEST", "Nieprawidłowe żądanie.", 400),
    ("VALIDATION_FAILED", "Dane wysłane do analizy mają niepoprawny format.", 422),
    ("PAYLOAD_TOO_LARGE", "Dokument jest zbyt duży, aby go przeanalizować.", 413),
    ("UNSUPPORTED_MEDIA_TYPE", "Nieobsługiwany typ danych żądania.", 415),
    ("ORIGIN_NOT_ALLOWED", "Ta strona nie ma dostępu do API analizy.", 403),
    ("RATE_LIMITED", "Wysłano zbyt wiele żądań. Odczekaj chwilę i spróbuj ponownie.", 429),
    ("NO_TEXT_LAYER", "Nie znaleziono tekstu w dokumencie — plik może być pustym skanem.", 422),
    ("DOCUMENT_TOO_LONG", "Dokument jest zbyt długi, aby przeanalizować go w całości.", 413),
    ("AI_INVALID_RESPONSE", "Model AI zwrócił niepoprawną odpowiedź, również przy ponownej próbie.", 502),
    ("AI_UNAVAILABLE", "Usługa AI jest chwilowo niedostępna. Spróbuj ponownie za moment.", 503),
    ("AI_TIMEOUT", "Analiza trwała zbyt długo i została przerwana.", 504),
    ("NOT_FOUND", "Nie znaleziono zasobu.", 404),
    ("INTERNAL", "Wystąpił nieoczekiwany błąd serwera.", 500),
]

#: Codes that a client finds itself, with message.
CLIENT_ERRORS = [
    ("NOT_PDF", "To nie jest plik PDF. Wybierz plik z rozszerzeniem .pdf."),
    ("FILE_TOO_LARGE", "Plik jest większy niż 10 MB. Wybierz mniejszy dokument."),
    ("FILE_EMPTY", "Plik jest pusty."),
    ("MULTIPLE_FILES", "Upuść jeden plik PDF naraz."),
    ("PDF_ENCRYPTED", "Plik PDF jest zabezpieczony hasłem. Usuń zabezpieczenie i spróbuj ponownie."),
    ("PDF_CORRUPT", "Nie udało się odczytać pliku PDF — może być uszkodzony."),
    ("TOO_MANY_PAGES", "Dokument ma zbyt wiele stron (maksymalnie 500)."),
    ("INSPECTION_FAILED", "Nie udało się bezpiecznie odczytać całego dokumentu. Żadna treść nie została wysłana do AI. Wybierz czytelniejszy plik PDF."),
    ("INSPECTION_LIMIT", "Dokument przekracza limit kontroli: 100 stron, 30 obrazów, 10 załączników lub 2 minuty odczytu. Żadna treść nie została wysłana do AI."),
    ("ATTACHMENT_UNSUPPORTED", "Dokument zawiera nieobsługiwany załącznik, aktywną treść lub dodatkowe warstwy. Żadna treść nie została wysłana do AI. Usuń te elementy i spróbuj ponownie."),
    ("NETWORK", "Brak połączenia z serwerem analizy. Sprawdź połączenie z internetem i spróbuj ponownie."),
    ("TIMEOUT", "Serwer analizy nie odpowiedział w wyznaczonym czasie."),
    ("INVALID_RESPONSE", "Serwer zwrócił wynik w niepoprawnym formacie, więc nie został wyświetlony."),
    ("UNKNOWN", "Wystąpił nieoczekiwany błąd. Spróbuj ponownie."),
]

#: Severity of each warning.
SEVERITY = {
    "PROMPT_INJECTION_SUSPECTED": "warning",
    "SECRETS_REDACTED": "warning",
    "AMOUNT_NOT_IN_TEXT": "warning",
    "DATE_NOT_IN_TEXT": "warning",
    "VALUE_FROM_SCAN": "info",
    "OCR_PAGES": "info",
    "SCAN_PAGES_SKIPPED": "warning",
    "DOCUMENT_CHUNKED": "info",
    "FALLBACK_MODEL": "info",
}

PAGE = "struct<number:int,text:string,source:string>"
INSPECTION = "struct<profile:string,attachments:int,images:int,barcodes:int,metadata:int,cacheHit:boolean,redactions:array<struct<kind:string,count:int>>>"
REQUEST = f"doc_id bigint, file_name string, page_count int, pages array<{PAGE}>, inspection {INSPECTION}"
AMOUNT = "struct<value:double,currency:string,context:string,page:int>"
DATE = "struct<date:string,context:string,page:int>"
PAYLOAD = (
    "struct<language:string,type:string,title:string,date:string,summarySentences:array<string>,keyPoints:array<string>,keywords:array<string>,"
    f"organizations:array<string>,people:array<string>,amounts:array<{AMOUNT}>,dates:array<{DATE}>,injectionDetected:boolean,injectionExcerpt:string>"
)
ENVELOPE = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>>"


def error_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code string, message string, status int")


def message_dimension(spark: SparkSession) -> DataFrame:
    """source (api or client), code, message of every error."""
    rows = [("api", c, m) for c, m, _ in ERRORS] + [("client", c, m) for c, m in CLIENT_ERRORS]
    return spark.createDataFrame(rows, "source string, code string, message string")
