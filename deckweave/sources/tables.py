"""Tables, folders of artifacts and JSON documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

PAGES = "array<struct<n:int,lines:array<struct<h:string,p:string,c:int>>>>"
PAGE_DOC = f"meta struct<source:string,course:string,module:string,pageCount:int,pageCountAfterClean:int,lineCount:int,schema:string,schemaHint:string,generatedAt:string>, pages {PAGES}"
COOKIE = "name string, value string, domain string, path string, expires bigint, httpOnly boolean, secure boolean, sameSite string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved_decks(spark: SparkSession, folder: str) -> DataFrame:
    """(course, path, file_base, ext, bytes, status) of deck files in ``<folder>/<course>/pdf`` by course and path; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    found = F.regexp_extract("path", "([^/]+)/pdf/([^/]+)\\.source\\.(?i:(pdf|pptx?))$", 1)
    own = files.withColumn("course", found).where("course <> ''")
    base = F.regexp_extract("path", "/pdf/([^/]+)\\.source\\.[^./]+$", 1)
    return own.select("course", "path", base.alias("file_base"), F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).alias("ext"), "bytes", F.lit("ok-from-disk").alias("status")).orderBy("course", "path")


def page_documents(spark: SparkSession, path: str) -> DataFrame:
    """Page documents in JSON, one a file, with the path each came from; unreadable ones have null pages."""
    return spark.read.schema(PAGE_DOC).json(path, multiLine=True, mode="PERMISSIVE").withColumn("source_path", F.input_file_name())


def page_lines(documents: DataFrame, key: str) -> DataFrame:
    """(key, page_pos, page, line_no, h, p, c): page documents in long form."""
    page = documents.select(key, F.posexplode("pages").alias("page_pos", "pg"))
    line = page.select(key, (F.col("page_pos") + 1).alias("page_pos"), F.col("pg.n").alias("page"), F.posexplode("pg.lines").alias("line_no", "line"))
    return line.select(key, "page_pos", "page", (F.col("line_no") + 1).alias("line_no"), "line.h", "line.p", "line.c")


class CookieFileError(ValueError):
    """A cookie file that can't be used; ``code`` is MISSING, EMPTY or INVALID."""

    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path}")
        self.code = code


def cookies(spark: SparkSession, path: str) -> DataFrame:
    """A cookie file's entries, numbered in their order."""
    try:
        raw = spark.read.text(path, wholetext=True)
        text = raw.head()
    except Exception as error:
        raise CookieFileError("MISSING", path) from error
    if text is None or not text[0].strip():
        raise CookieFileError("EMPTY", path)
    schema = f"array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in Ty._parse_datatype_string(COOKIE).fields)}>>"
    parsed = raw.select(F.from_json("value", schema).alias("all"))
    if parsed.where("all IS NOT NULL AND size(all) > 0").isEmpty():
        raise CookieFileError("EMPTY" if text[0].strip() == "[]" else "INVALID", path)
    own = parsed.select(F.posexplode("all").alias("cookie_no", "c")).select("cookie_no", "c.*")
    return own.withColumnsRenamed({"httpOnly": "http_only", "sameSite": "same_site"})
