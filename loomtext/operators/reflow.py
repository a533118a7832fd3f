"""Running text of paginated documents: pages of lines become paragraphs.

All native: lines explode from pages, headers and footers are lines that come
back near the top or the end of almost every page of a document, and
paragraphs are sessions between lines that close one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSING = r"[。！？：；.!?:;]\s*$"
INNER = r"[！；，。“]"
DOTS = r"\.{6,}\s*[0-9]+"
EDGE = 3


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\x{3000}]", "")


def lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, line, bare of pages (doc_id, page_no, text)."""
    x = pages.select("doc_id", "page_no", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return x.withColumn("bare", _bare(F.col("line")))


def running_lines(pages: DataFrame) -> DataFrame:
    """doc_id, bare, place, n: headers and footers: among the first or last three
    text lines of at least three pages and of all but two of the document's."""
    x = lines(pages).where("bare <> '' and not bare rlike '^[0-9]{1,9}$'")
    page = Window.partitionBy("doc_id", "page_no")
    x = x.withColumns({"top": F.row_number().over(page.orderBy("line_no")), "end": F.row_number().over(page.orderBy(F.desc("line_no")))})
    edges = x.select("doc_id", "bare", F.explode(F.filter(F.array(F.when(F.col("top") <= EDGE, "top"), F.when(F.col("end") <= EDGE, "end")), lambda v: v.isNotNull())).alias("place"))
    count = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    n = edges.groupBy("doc_id", "bare", "place").agg(F.count("*").alias("n")).join(count, "doc_id")
    return n.where((F.col("n") > 2) & (F.col("n") >= F.col("pages") - 2)).select("doc_id", "bare", "place", "n")


def body_lines(pages: DataFrame) -> DataFrame:
    """Lines without headers, footers, page numbers, contents and blank lines."""
    page = Window.partitionBy("doc_id", "page_no")
    x = lines(pages).where("bare <> ''")
    number = F.col("bare").rlike("^[0-9]{1,9}$")
    x = x.withColumns({"top": F.sum((~number).cast("int")).over(page.orderBy("line_no")), "end": F.sum((~number).cast("int")).over(page.orderBy(F.desc("line_no")))})
    run = running_lines(pages).groupBy("doc_id", "bare").agg(F.collect_set("place").alias("places"))
    x = x.join(run, ["doc_id", "bare"], "left")
    at = lambda p: F.coalesce(F.array_contains("places", p), F.lit(False)) & (F.col("top" if p == "top" else "end") <= EDGE)
    paging = F.col("bare").rlike("^[0-9]{1,9}$") & ((F.col("top") < EDGE) | (F.col("end") < EDGE))
    skip = F.upper("bare").isin("目录", "MENU", "CONTENTS") | F.col("bare").rlike(DOTS)
    return x.where(~(at("top") | at("end") | paging | skip)).select("doc_id", "page_no", "line_no", "line", "bare")


def paragraphs(pages: DataFrame) -> DataFrame:
    """doc_id, paragraph_no, text: lines joined where a sentence runs on.

    A line that ends a sentence closes its paragraph; a line that is at least as
    long as the document's mean (30 at most) and ends none runs on; a short line
    without inner marks stands alone, as does one that opens a list."""
    x = body_lines(pages)
    mean = x.groupBy("doc_id").agg(F.least(F.floor(F.avg(F.length("bare"))), F.lit(30)).alias("mean"))
    x = x.join(mean, "doc_id")
    closes = F.col("line").rlike(CLOSING)
    inner = F.col("line").rlike(INNER)
    long = F.length("bare") >= F.col("mean")
    lists = F.col("line").rlike("^(?:[◆■•（]|[-*] )") | (~closes & ~inner & ~long & F.col("line").rlike("[:：]"))
    x = x.withColumns({"alone": lists | (~long & ~closes & ~inner), "ends": closes | lists | (~long & ~closes & ~inner)})
    doc = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    opens = F.coalesce(F.lag("ends").over(doc), F.lit(True)) | F.col("alone")
    x = x.withColumn("paragraph_no", F.sum(opens.cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line_no", F.rtrim("line").alias("line")))), lambda v: v["line"]), " ")
    return x.groupBy("doc_id", "paragraph_no").agg(text.alias("text"))


def reflowed(pages: DataFrame) -> DataFrame:
    """doc_id, text: one row for each document, a paragraph a line."""
    p = paragraphs(pages).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_no", "text"))).alias("p"))
    return p.select("doc_id", F.array_join(F.transform("p", lambda v: v["text"]), "\n").alias("text"))


def digits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}"))
