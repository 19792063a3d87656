"""Readers: JSON lines, parquet, CSV, Markdown tables, HTML and WARC captures, crawl indexes."""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_COMMENTS = "id string, author string, body string, parent_id string, link_id string, subreddit string, score long, created_utc long, controversiality string"
RAW_POSTS = (
    "id string, author string, title string, url string, domain string, subreddit string, score long, num_comments long, num_crossposts long, upvote_ratio double, "
    "created_utc long, media struct<oembed: struct<title: string, description: string>>"
)


@dataclass(frozen=True)
class Catalog:
    """Places of an archive's tables below one folder."""

    base: str

    def path(self, name: str, form: str = "parquet") -> str:
        return f"{self.base.rstrip('/')}/{name}.{form}"

    def paths(self, names: Sequence[str]) -> dict[str, str]:
        return {n: self.path(n) for n in names}

    def read(self, spark: SparkSession, name: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
        """A table, its columns cut at the scan, at most ``limit`` rows if given."""
        df = spark.read.parquet(self.path(name))
        df = df.select(*columns) if columns else df
        return df.limit(limit) if limit is not None else df


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType | None = RAW_COMMENTS, skip_bad: bool = True, limit: int | None = None) -> DataFrame:
    """JSON lines, plain or gzipped, from a pattern or a list of files, united by name.

    With a schema nothing is inferred and no file is read twice. Broken lines drop out, or fail the read if not ``skip_bad``.
    """
    r = spark.read.option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST")
    df = (r.schema(schema) if schema else r).json(paths if isinstance(paths, str) else list(paths))
    return df.limit(limit) if limit is not None else df


def media_titles(posts: DataFrame) -> DataFrame:
    """Posts whose embedded medium has a title, with ``combined_payload``: title and description."""
    t, d = F.col("media.oembed.title"), F.col("media.oembed.description")
    return posts.where(t.isNotNull() & (t != "")).select("id", t.alias("title"), F.concat_ws(" - ", t, d).alias("combined_payload"))


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", skip_bad: bool = True, limit: int | None = None) -> DataFrame:
    """A CSV file with a header and a given schema; a byte order mark is no part of the first name."""
    df = spark.read.option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST").csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', enforceSchema=True)
    return df.limit(limit) if limit is not None else df


def decimal_comma(c: Column) -> Column:
    """A number written with a decimal comma."""
    return F.regexp_replace(c, ",", ".").try_cast("double")


def read_month_partitions(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """Parquet below ``month_str=YYYY-MM`` folders; a filter on months prunes folders."""
    df = spark.read.parquet(path)
    return df.where(F.col("month_str").isin(*months)) if months else df


def describe(df: DataFrame) -> DataFrame:
    """``(column_name, column_type)``."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, column_type string")


def markdown_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The body lines of Markdown tables as columns; lines of another width, headings and rules drop out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    lines = spark.read.text(path).where(F.trim("value").startswith("|")).withColumn("c", cells).where(F.size("c") == len(columns))
    lines = lines.where(~F.forall("c", lambda x: x.rlike(r"^:?-*:?$")) & (F.lower(F.col("c")[0]) != columns[0].lower()))
    return lines.select(*(F.col("c")[i].alias(n) for i, n in enumerate(columns)))


# ---- HTML ----------------------------------------------------------------------------------------------------------------
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Posts(HTMLParser):
    """Posts of a forum page: blocks of class ``post`` with an author, a time and a body; advertisement blocks are passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.posts, self.stack = "", [], []
        self.meta: dict[str, str] = {}
        self.ld: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        kind = a.get("class", "").split()
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        if tag in _VOID:
            if tag == "br" and self.posts and self._in("body"):
                self.posts[-1]["body"] += "\n"
            return
        role = next((r for r in ("post", "author", "time", "body", "midAd") if r in kind), "")
        if tag in ("script", "style"):
            role = "ld" if a.get("type") == "application/ld+json" else "skip"
            if role == "ld":
                self.ld.append("")
        if tag == "title":
            role = "title"
        if role == "post":
            self.posts.append({"post_id": re.sub(r"\D", "", a.get("id", "")), "author": "", "time": "", "body": ""})
        self.stack.append((tag, role))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def _in(self, role: str) -> bool:
        return any(r == role for _, r in self.stack)

    def handle_data(self, data: str) -> None:
        if self._in("ld"):
            self.ld[-1] += data
        if self._in("skip") or self._in("midAd"):
            return
        if self._in("title"):
            self.title += data
        for role in ("author", "time", "body"):
            if self.posts and self._in("post") and self._in(role):
                self.posts[-1][role] += data


def parse_page(html: str) -> _Posts:
    p = _Posts()
    p.feed(html)
    p.close()
    return p


_PAGE = "key {kind}, thread_title string, post_no int, post_id string, author string, raw_timestamp string, body string"


def forum_posts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Posts of captured forum pages in their order; a missing author is ``unknown``, script text is no body, pages without posts give none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = parse_page(text)
                for i, x in enumerate(p.posts):
                    clean = re.sub(r"\s+", " ", x["time"]).strip().removeprefix("posted on ").strip()
                    rows.append((k, p.title.strip(), i, x["post_id"] or None, x["author"].strip() or "unknown", clean, x["body"].strip()))
            names = [n.split()[0] for n in _PAGE.split(", ")]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=None)

    fixed = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), F.col(html).alias("html"))
    out = fixed.mapInArrow(_typed(run), _PAGE.format(kind=kind))
    return out


def _typed(run):  # noqa: ANN001, ANN202 - a wrapper that fixes the width of integers
    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            i = b.schema.get_field_index("post_no")
            yield b.set_column(i, "post_no", b.column(i).cast(pa.int32()))

    return typed


def byline(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, title, author)`` of a page: the author from structured data, else from meta tags; null if neither names one."""
    kind = pages.schema[key].dataType.simpleString()
    names = ("author", "article:author", "parsely-author", "dc.creator", "byl")
    ld_author = re.compile(r'"author"\s*:\s*(?:\[\s*)?(?:\{[^{}]*?"name"\s*:\s*"([^"]+)"|"([^"]+)")')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles, authors = [], []
            for text in b.column(1).to_pylist():
                p = parse_page(text or "")
                m = next((m for s in p.ld if (m := ld_author.search(s))), None)
                authors.append((m[1] or m[2]) if m else next((p.meta[n] for n in names if p.meta.get(n)), None))
                titles.append(p.title.strip() or None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(titles, pa.string()), pa.array(authors, pa.string())], names=["key", "title", "author"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, title string, author string")


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(path, html)`` of gzipped WARC members: record head, HTTP head and page are parted by blank lines; less than three parts give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                except (OSError, EOFError):
                    continue
                parts = raw.split(b"\r\n\r\n", 2)
                if len(parts) == 3:
                    rows.append((p, parts[2].decode("utf-8", "replace").strip()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["path", "html"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, html string")


def crawl_catalog(index: DataFrame, latest: bool = True) -> DataFrame:
    """Captured pages of an index ``(url, status, mime, timestamp, filename, offset, length)``: thread and page of good HTML captures.

    An address with a percent sign, space, ``<``, ``*`` or a hyphen after the path's number is no page. The page is a number,
    ``lastpost`` or 1. With ``latest`` one capture, the latest, of each page is kept.
    """
    path = F.regexp_extract("url", r"/(thread\d+[^?#]*)", 1)
    thread = F.regexp_extract(path, r"^thread(\d+)", 1)
    page = F.regexp_extract(path, r"(?:/pg|/page)(\d+|lastpost)", 1)
    good = (F.col("status").cast("string") == "200") & F.contains("mime", F.lit("html")) & (thread != "") & ~path.rlike(r"[% <*-]")
    rows = index.where(good).select(
        thread.cast("long").alias("thread_id"), F.when(page == "", "1").otherwise(page).alias("page_num"), "timestamp", "url", "filename", "offset", "length"
    )
    if not latest:
        return rows
    best = rows.groupBy("thread_id", "page_num").agg(F.max(F.struct("timestamp", "url", "filename", "offset", "length")).alias("b"))
    return best.select("thread_id", "page_num", "b.*")


def exists(path: str) -> bool:
    """Whether a local path is there."""
    return os.path.exists(path.removeprefix("file://"))
