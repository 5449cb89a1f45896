"""Files: admission by facts and magic bytes, text attachments, PNG metadata, requests as JSON."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schemas as S


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, size, content of the files below path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.REQUEST).json(path)


def file_code(name: Column, mime: Column, size: Column) -> Column:
    """The first reason to refuse a file by its facts; null if there is none."""
    pdf = (F.coalesce(mime, F.lit("")) == "application/pdf") | F.lower(name).endswith(".pdf")
    return F.when(~pdf, "NOT_PDF").when(size == 0, "FILE_EMPTY").when(size > S.MAX_FILE_BYTES, "FILE_TOO_LARGE")


def has_pdf_signature(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 1024), F.lit(b"%PDF-"))


def image_kind(content: Column) -> Column:
    png, jpeg = F.lit(bytes([137, 80, 78, 71, 13, 10, 26, 10])), F.lit(bytes([255, 216, 255]))
    return F.when(F.startswith(content, png), "image/png").when(F.startswith(content, jpeg), "image/jpeg")


def kind_of(content: Column, name: Column) -> Column:
    """pdf, image, text or ATTACHMENT_UNSUPPORTED."""
    return F.when(has_pdf_signature(content), "pdf").when(image_kind(content).isNotNull(), "image").when(name.rlike(r"(?i)\.(txt|md|csv|json)$"), "text").otherwise("ATTACHMENT_UNSUPPORTED")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def decode_text(content: pd.Series) -> pd.DataFrame:
    """Text of an attachment by its byte order mark, UTF-8 otherwise; invalid bytes or control characters are an error."""

    def one(b):
        b = bytes(b or b"")
        encoding = "utf-16-le" if b[:2] == b"\xff\xfe" else "utf-16-be" if b[:2] == b"\xfe\xff" else "utf-8"
        try:
            text = b.decode(encoding).removeprefix("﻿")
        except UnicodeDecodeError:
            return None, "INSPECTION_FAILED"
        if any(ord(c) < 32 and ord(c) not in (9, 10, 12, 13) for c in text):
            return None, "ATTACHMENT_UNSUPPORTED"
        return text, None

    return pd.DataFrame([one(b) for b in content], columns=["text", "error"])


class PngError(Exception):
    pass


def _inflate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, S.MAX_PAGE_CHARS + 1)
    except zlib.error as e:
        raise PngError("INSPECTION_FAILED") from e
    if len(out) > S.MAX_PAGE_CHARS:
        raise PngError("INSPECTION_LIMIT")
    return out


def png_texts(data: bytes) -> list[str]:
    """The texts in a PNG's metadata chunks; the file must end with its end chunk."""
    at, out = 8, []
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if at + n + 12 > len(data):
            raise PngError("INSPECTION_FAILED")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"acTL":
            raise PngError("ATTACHMENT_UNSUPPORTED")
        if kind in (b"tEXt", b"zTXt", b"iTXt", b"iCCP"):
            out.append(_png_text(kind, body))
        if kind == b"IEND":
            if at != len(data):
                break
            return out
    raise PngError("INSPECTION_FAILED")


def _png_text(kind: bytes, body: bytes) -> str:
    keyword, zero, rest = body.partition(b"\0")
    if not keyword or not zero:
        raise PngError("INSPECTION_FAILED")
    if kind in (b"zTXt", b"iCCP"):
        if rest[:1] != b"\0":
            raise PngError("ATTACHMENT_UNSUPPORTED")
        rest = _inflate(rest[1:])
    elif kind == b"iTXt":
        if rest[:1] not in (b"\0", b"\1") or rest[1:2] != b"\0":
            raise PngError("ATTACHMENT_UNSUPPORTED")
        parts = rest[2:].split(b"\0", 2)
        if len(parts) < 3:
            raise PngError("INSPECTION_FAILED")
        rest = _inflate(parts[2]) if rest[:1] == b"\1" else parts[2]
    if len(rest) > S.MAX_PAGE_CHARS:
        raise PngError("INSPECTION_LIMIT")
    try:
        return rest.decode("utf-8" if kind == b"iTXt" else "latin-1")
    except UnicodeDecodeError as e:
        raise PngError("INSPECTION_FAILED") from e


@F.pandas_udf(T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def png_metadata(content: pd.Series) -> pd.DataFrame:
    def one(b):
        try:
            return png_texts(bytes(b or b"")), None
        except PngError as e:
            return None, str(e)

    return pd.DataFrame([one(b) for b in content], columns=["texts", "error"])


#: The characters of PDFDocEncoding that are not those of Latin-1, from 0x18 and from 0x80 on.
PDF_DOC = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜", strict=True)) | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", strict=True)) | {0x9F: "\ufffd", 0xA0: "€"}


@F.pandas_udf(T.StringType())
def decode_pdf_string(content: pd.Series) -> pd.Series:
    """A PDF text string: UTF-16 by its mark, else single bytes of PDFDocEncoding."""

    def one(b):
        b = bytes(b or b"")
        if b[:2] == b"\xfe\xff":
            return b[2:].decode("utf-16-be", "replace")
        if b[:2] == b"\xff\xfe":
            return b[2:].decode("utf-16-le", "replace")
        return b.decode("latin-1").translate(PDF_DOC)

    return content.map(one)


def stream_strings(data: bytes) -> list[bytes]:
    """Literal (balanced, with escapes) and hexadecimal strings of a PDF content stream."""
    out, i, n = [], 0, len(data)
    named = {b"n"[0]: 10, b"r"[0]: 13, b"t"[0]: 9, b"b"[0]: 8, b"f"[0]: 12}
    while i < n:
        c = data[i]
        if c == 0x28:
            depth, i, text = 1, i + 1, bytearray()
            while i < n and depth:
                c = data[i]
                if c == 0x5C and i + 1 < n:
                    octal = bytes(x for x in data[i + 1 : i + 4])
                    k = 0
                    while k < len(octal) and 0x30 <= octal[k] <= 0x37:
                        k += 1
                    if k:
                        text.append(int(octal[:k], 8) & 255)
                        i += 1 + k
                    else:
                        if data[i + 1] not in (10, 13):
                            text.append(named.get(data[i + 1], data[i + 1]))
                        i += 2
                    continue
                depth += (c == 0x28) - (c == 0x29)
                if depth:
                    text.append(c)
                i += 1
            if not depth:
                out.append(bytes(text))
        elif c == 0x3C and data[i + 1 : i + 2] != b"<":
            end = data.find(b">", i)
            digits = bytes(x for x in data[i + 1 : end] if x not in b" \t\r\n\f\0") if end > 0 else b""
            if end > 0 and all(x in b"0123456789abcdefABCDEF" for x in digits):
                out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
                i = end
            i += 1
        else:
            i += 2 if c == 0x3C else 1
    return out


def unfilter_png_rows(data: bytes, width: int, channels: int) -> bytes:
    """Undo the PNG predictors of 8-bit rows (None, Sub, Up, Average, Paeth)."""
    row = width * channels
    out, above = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        if len(line) < row or kind > 4:
            raise PngError("INSPECTION_FAILED")
        for i in range(row):
            a = line[i - channels] if i >= channels else 0
            b, c = above[i], above[i - channels] if i >= channels else 0
            if kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[kind]
            line[i] = (line[i] + near) & 255
        out += line
        above = line
    return bytes(out)


def join_text_items(items: Column) -> Column:
    """Text of positioned items array<struct<pos, str, hasEOL, x, y, width, height>>, in order of pos."""
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("any"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))

    def step(s, i):
        size = F.greatest(s["h"], i["height"], F.lit(1.0))
        gap = i["x"] - (s["x"] + s["w"])
        spaced = ~s["out"].rlike(r"\s$") & ~i["str"].rlike(r"^\s") & (i["str"] != "")
        same = F.abs(i["y"] - s["y"]) < size * 0.5
        glue = F.when(~s["any"] | s["out"].endswith("\n"), "").when(~same, "\n").when(~spaced, "").when(gap > size * 2, "   ").when(gap > size * 0.2, " ").otherwise("")
        out = F.concat(s["out"], glue, i["str"], F.when(i["hasEOL"], "\n").otherwise(""))
        on = (i["str"] != "") | i["hasEOL"]
        keep = lambda new, old: F.when(on, new).otherwise(old)
        return F.struct(out.alias("out"), (s["any"] | on).alias("any"), keep(i["x"], s["x"]).alias("x"), keep(i["y"], s["y"]).alias("y"), keep(i["width"], s["w"]).alias("w"), keep(i["height"], s["h"]).alias("h"))

    from docloom.functions.text import trim_ws

    return F.aggregate(F.array_sort(items), zero, step, lambda s: trim_ws(F.regexp_replace(s["out"], "[ \t]+\n", "\n")))
