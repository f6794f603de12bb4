"""Line dedup by site-relative frequency, in DataFrame functions.

For each host, the pages that hold a line are divided by the host's pages; lines above a boilerplate ratio are dropped
from that host's pages. Where a host's pages are of several languages, each language can be a host of its own, as a line
is of one language and its share of all pages would hide it. Pages with the same text are one page, so copies of a
document do not turn its own lines into boilerplate; near copies are one page too where their classes are given. Lines
are held as two 64-bit hashes; counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import scratch

#: A line is boilerplate if more than this part of its host's pages holds it, and at least so many pages do.
RATIO, LEAST_PAGES = 0.05, 5
#: The part for the pages of one language of a host, as in the pipeline; the README has the line frequencies behind it.
LANGUAGE_RATIO = 0.01
#: What a text with words has: a character that is no ASCII white space.
WORD = r"[^\x20\x09-\x0D]"
#: Hosts' boilerplate is broadcast up to so many bytes on disk; beyond, pages and boilerplate are shuffled by host.
BROADCAST_BYTES = 24 << 20


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(F.lit("line"), _bare(line)).alias("b"))


def _host_of(df: DataFrame, host_col: str, lang_col: str | None) -> Column:
    return F.struct(df[host_col].alias("host"), df[lang_col].alias("lang")) if lang_col else df[host_col]


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, lang_col: str | None = None, classes: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(host, lines): each host's boilerplate lines as hashes, at most the mean lines of a page / ratio.

    With lang_col, a host is a struct of host and language. With classes (an id and its class, each id once), rows of one
    class are one page: rows with words are of their id's class there, else of their own id's. Classes meet the lines'
    hashes, so no text is shuffled.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    pages = df.select(
        _host_of(df, host_col, lang_col).alias("host"), (df[id_col] if classes is not None else F.lit(None)).alias("id"),
        text.rlike(WORD).alias("worded"), F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"),
        F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: _bare(x) != ""), _hash)).alias("lines"),
    )
    found = F.lit(None)
    if classes is not None:
        pages = pages.join(classes.toDF("id", "class"), "id", "left")
        found = F.when(F.col("worded"), F.coalesce("class", "id"))
    page = F.struct(F.when(found.isNull(), F.col("hash")).alias("a"), F.when(found.isNull(), F.col("bytes")).alias("b"), found.cast("string").alias("class"))
    pages = pages.select("host", page.alias("page"), "lines")
    held = pages.select("host", "page", F.explode("lines").alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total")).withColumnRenamed("host", "_host")
    common = counts.join(totals, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("pages") > ratio * F.col("total"))
    return common.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", ratio: float = RATIO, least_pages: int = LEAST_PAGES, lang_col: str | None = None, classes: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows and columns of df without their hosts' boilerplate lines; chars_col, if it is there, is counted anew.

    Every row stays, with an empty text if no line is left. Lines compare without white space at their ends; blank
    lines are never boilerplate and stay. A null host (or language) is one of its own; a null text stays null. Repeated
    rows are one page and all lose the same lines; a line at the ratio itself stays. An empty table gives an empty one. With lang_col, lines are counted among the host's pages of one language; with
    classes, rows of one class are one page.
    """
    host, found = scratch.fresh(df, "_host"), scratch.fresh(df, "_lines")
    lines, at = scratch.keep(boilerplate(df, host_col, text_col, ratio, least_pages, lang_col, classes, id_col).select(F.col("host").alias(host), F.col("lines").alias(found)))
    if scratch.table_bytes(df.sparkSession, at) <= BROADCAST_BYTES:
        lines = F.broadcast(lines)
    joined = df.join(lines, _host_of(df, host_col, lang_col).eqNullSafe(F.col(host)), "left")
    left = F.filter(F.split(df[text_col], "\n"), lambda x: (_bare(x) == "") | ~F.array_contains(F.col(found), _hash(x)))
    text = F.when(F.col(found).isNull() | df[text_col].isNull(), df[text_col]).otherwise(F.array_join(left, "\n"))
    out = joined.withColumn(text_col, text)
    if chars_col in df.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(df.schema[chars_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
