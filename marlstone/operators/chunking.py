"""Passages from files: symbols, whole texts, packed table rows and packed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_SYMBOL = 4_294_967_295
DOC_LINE = r"^\s*(///|//!|/\*\*|\*/|\*|#\[|@)"  # fixed values: starts of lines that belong to a symbol's documentation


def chunk_id(path: Column, qualified: Column, sub_idx: Column, body: Column) -> Column:
    """16 bytes as hex; the same for the same body wherever it stands in the file."""
    key = F.concat_ws("\x1f", path, F.coalesce(qualified, F.lit("")), sub_idx.cast("string"), body)
    return F.substring(F.sha2(key, 256), 1, 32)


def text_chunks(files: DataFrame) -> DataFrame:
    """One passage per file, lines 1 to the number of newlines plus 1."""
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.select(
        "file_path",
        F.lit(NO_SYMBOL).alias("sym_id"),
        F.col("file_path").alias("symbol_qualified"),
        F.lit("document").alias("symbol_kind"),
        F.lit(1).cast("long").alias("start_line"),
        (newlines + 1).cast("long").alias("end_line"),
        "content",
    )


def symbol_chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A symbol's lines, with the documentation above it if it has any. symbols: sym_id, file, line, end_line, doc, kind, qualified."""
    lines = F.split("content", "\n", -1)
    joined = symbols.join(files.select(F.col("file_path").alias("file"), lines.alias("lines")), "file")
    above = F.reverse(F.slice("lines", 1, F.greatest(F.col("line") - 1, F.lit(0)).cast("int")))
    doc_lines = F.aggregate(
        above,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, x: F.struct(F.when(a["on"] & x.rlike(DOC_LINE), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & x.rlike(DOC_LINE)).alias("on")),
        lambda a: a["n"],
    )
    first = F.col("line") - F.when(F.col("doc").isNotNull(), doc_lines).otherwise(0)
    placed = joined.withColumn("start_line", first.cast("long"))
    return placed.select(
        F.col("file").alias("file_path"),
        "sym_id",
        F.col("qualified").alias("symbol_qualified"),
        F.col("kind").alias("symbol_kind"),
        "start_line",
        F.col("end_line").cast("long").alias("end_line"),
        F.array_join(F.slice("lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n").alias("content"),
    )


def _fold(items: Column, add, close) -> Column:
    """Greedy packing over an array: state is the closed packs and an open one (null when none is open)."""
    return F.aggregate(items, F.struct(F.array().cast(_PACKS).alias("done"), F.lit(None).cast(_PACK).alias("open")), add, close)


_PACK = "struct<body:string,bytes:bigint,first:bigint,last:bigint,heading:string>"
_PACKS = f"array<{_PACK}>"


def _pack(body: Column, size: Column, first: Column, last: Column, heading: Column) -> Column:
    return F.struct(body.alias("body"), size.cast("long").alias("bytes"), first.cast("long").alias("first"), last.cast("long").alias("last"), heading.cast("string").alias("heading")).cast(_PACK)


def _finish(state: Column) -> Column:
    return F.when(state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))


def pack_rows(files: DataFrame, budget: int, path: str = "file_path", content: str = "content") -> DataFrame:
    """Rows of tabular files: the header line and blank lines are left out, rows fill a passage up to budget bytes (one larger row alone).

    Columns: file_path, pack_idx, symbol_qualified (path:rows:first-last), start_line, end_line, content; lines are physical.
    """
    lines = F.split(F.col(content), "\n", -1)
    rows = F.filter(
        F.transform(lines, lambda x, i: F.struct((i + 1).alias("no"), F.rtrim(x, F.lit("\r")).alias("row"))),
        lambda r: (r["no"] > 1) & (r["row"] != ""),
    )

    def add(s: Column, r: Column) -> Column:
        size, o = F.octet_length(r["row"]), s["open"]
        fits = o["bytes"] + 1 + size <= budget
        alone = _pack(r["row"], size, r["no"], r["no"], F.lit(None))
        joined = _pack(F.concat(o["body"], F.lit("\n"), r["row"]), o["bytes"] + 1 + size, o["first"], r["no"], F.lit(None))
        return (
            F.when(o.isNull(), F.struct(s["done"].alias("done"), alone.alias("open")))
            .when(fits, F.struct(s["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.concat(s["done"], F.array(o)).alias("done"), alone.alias("open")))
        )

    packs = files.select(F.col(path).alias("file_path"), F.posexplode(_fold(rows, add, _finish)).alias("pack_idx", "p"))
    return packs.select(
        "file_path",
        F.col("pack_idx").cast("long").alias("pack_idx"),
        F.concat("file_path", F.lit(":rows:"), F.col("p.first").cast("string"), F.lit("-"), F.col("p.last").cast("string")).alias("symbol_qualified"),
        F.col("p.first").alias("start_line"),
        F.col("p.last").alias("end_line"),
        F.col("p.body").alias("content"),
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc, content, headings) from (doc, page, text, heading): page texts with form feeds between them, by page."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text", "heading")))
    return pages.groupBy("doc").agg(ordered.alias("p")).select(
        "doc", F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\f\n").alias("content"), F.transform("p", lambda x: x["heading"]).alias("headings")
    )


def pack_pages(docs: DataFrame, budget: int) -> DataFrame:
    """Passages of whole pages, from (doc, content, headings) with form feeds between pages.

    Blank pages are left out but counted. A passage ends before a page with a heading once it holds half the budget,
    and after a page that fills the budget. Columns: doc, pack_idx, symbol_qualified, start_line, end_line, content.
    """
    raw = F.split("content", "\f", -1)
    blank = r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$"
    pages = F.filter(
        F.transform(raw, lambda x, i: F.struct((i + 1).alias("no"), F.regexp_replace(x, blank, "").alias("text"), F.try_element_at(F.col("headings"), i + 1).alias("heading"))),
        lambda p: p["text"] != "",
    )

    def add(s: Column, p: Column) -> Column:
        o, size = s["open"], F.octet_length(p["text"])
        early = o.isNotNull() & p["heading"].isNotNull() & (o["bytes"] >= budget // 2)
        done = F.when(early, F.concat(s["done"], F.array(o))).otherwise(s["done"])
        fresh = o.isNull() | early
        body = F.when(fresh, p["text"]).otherwise(F.concat(o["body"], F.lit("\n\n"), p["text"]))
        grown = F.when(fresh, size).otherwise(o["bytes"] + 2 + size)
        pack = _pack(body, grown, F.when(fresh, p["no"]).otherwise(o["first"]), p["no"], F.when(fresh, p["heading"]).otherwise(o["heading"]))
        full = grown >= budget
        return F.struct(
            F.when(full, F.concat(done, F.array(pack))).otherwise(done).alias("done"),
            F.when(full, F.lit(None).cast(_PACK)).otherwise(pack).alias("open"),
        )

    packs = docs.select("doc", F.posexplode(_fold(pages, add, _finish)).alias("pack_idx", "p"))
    span = F.concat(F.lit("p."), F.col("p.first").cast("string"), F.lit("-"), F.col("p.last").cast("string"))
    return packs.select(
        "doc",
        F.col("pack_idx").cast("long").alias("pack_idx"),
        F.when(F.col("p.heading").isNull(), span).otherwise(F.concat("p.heading", F.lit(" · "), span)).alias("symbol_qualified"),
        F.col("p.first").alias("start_line"),
        F.col("p.last").alias("end_line"),
        F.col("p.body").alias("content"),
    )
