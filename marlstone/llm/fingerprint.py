"""Operator 2: document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A document is the set of digests (xxhash64) of its paragraphs: its lines, and within a line its sentences. A sketch has
three tables of cells; a digest falls into one cell of each, and a cell holds the number, the exclusive-or and the
checksums' exclusive-or of its digests. The fingerprint is the sketch of ``WIDTH`` cells a table, as text.

Two versions are compared by subtracting the cells of one from those of the other, in which the digests of both cancel,
and peeling: a cell with one digest left gives it away, which frees its other cells, and so on. The sketches of a pair
have the least power of two of cells a table, ``WIDTH`` at least, that leaves ``ROOM`` cells a table for each digest.
Where cells remain after ``SWEEPS`` sweeps over the tables, the difference is too large for the sketch, and the pair is
tried again with twice the cells, until every pair is peeled. So every difference is recovered whole, by peeling alone.

Cells are rows: digests are exploded to their cells, cells are summed within the task that holds the pair, and each step
of peeling explodes the cells that gave a digest away to their changes and sums again. No step shuffles; a pair is never
gathered in memory, since the sums can spill.

The likeness of two documents is the Jaccard similarity of their digest sets, from the number of recovered digests and
the numbers in the sketches. The order and the repetition of paragraphs do not count; of two texts without any, it is 1.

The next document of each is found with one shuffle of the texts: rows are dealt by ranges of doc_id, every range also
gets the last row of the one before, and a window within a range looks back one row. An id that holds more rows than a
range, and the rows without an id, have ranges of their own by the text's md5.

Order is by doc_id, nulls least, then by the text's md5. Null texts are empty; repeated rows are each other's next; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.common import Scratch, text_or_empty

WIDTH = 8
ROOM = 0.67
SWEEPS = 3
RANGE_ROWS = 250
MOST_RANGES = 1 << 16
#: More than the parts into which the rows of one id are dealt.
_PARTS = 1 << 20


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    parts = F.filter(F.split(text, r"\n+|(?<=[.!?])\s+"), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _cell(digest: Column, table: Column | int, width: Column | int) -> Column:
    """The cell of a digest in table 0, 1 or 2; the tables' cells are numbered one after the other."""
    table = table if isinstance(table, Column) else F.lit(table)
    width = width if isinstance(width, Column) else F.lit(width)
    return (F.xxhash64(digest, table).bitwiseAND(width.cast("long") - 1) + table * width).cast("long")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(3))


def cells(digests: Column, width: int = WIDTH) -> Column:
    """The sketch of an array of digests, as an array of (n, k, h)."""
    placed = F.transform(digests, lambda d: F.struct(d.alias("k"), _check(d).alias("h"), *[_cell(d, t, width).alias(f"c{t}") for t in range(3)]))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def add(c: Column, x: Column) -> Column:
        return F.struct((c["n"] + 1).alias("n"), c["k"].bitwiseXOR(x["k"]).alias("k"), c["h"].bitwiseXOR(x["h"]).alias("h"))

    def cell(xs: Column, t: int, i: int) -> Column:
        return F.aggregate(F.filter(xs, lambda x: x[f"c{t}"] == i), none, add)

    return F.element_at(F.transform(F.array(placed), lambda xs: F.array(*[cell(xs, i // width, i) for i in range(3 * width)])), 1)


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: number, digests and checksums of each cell, in hexadecimal."""
    cell = lambda x: F.concat_ws(":", x["n"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["h"])))
    return F.array_join(F.transform(sketch, cell), ",")


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one cell added; empty cells go. Recovered digests (not live) pass through, their number is their side."""
    added = rows.groupBy(*keys, "live", "cell").agg(F.max("w").alias("w"), F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return added.where("n <> 0 OR (live AND (k <> 0 OR h <> 0))")


def peeled(pairs: DataFrame, keys: list[str], room: float = ROOM, sweeps: int = SWEEPS) -> DataFrame:
    """The cells of all pairs after peeling: keys, live (a cell that remains), cell (else the digest), n (else the side).

    ``pairs`` has the keys, the digest arrays a and b, and grown (how often the cells are doubled); it is partitioned by
    keys, so that no step shuffles.
    """
    wanted = F.greatest((F.size("a") + F.size("b")) * F.lit(float(room)), F.lit(float(WIDTH)))
    width = F.pow(F.lit(2.0), F.ceil(F.log2(wanted)) + F.col("grown")).cast("long")
    sides = F.array(F.struct(F.lit(1).cast("long").alias("n"), F.col("a").alias("ks")), F.struct(F.lit(-1).cast("long").alias("n"), F.col("b").alias("ks")))
    rows = pairs.select(*keys, width.alias("w"), F.explode(sides).alias("x")).select(*keys, "w", "x.n", F.explode("x.ks").alias("k"))
    rows = rows.select(*keys, "w", "n", "k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t"))
    rows = _summed(rows.select(*keys, "w", F.lit(True).alias("live"), _cell(F.col("k"), F.col("t"), F.col("w")).alias("cell"), "n", "k", _check(F.col("k")).alias("h")), keys)
    zero = F.lit(0).cast("long").alias("h")

    def row(live: Column, cell: Column, n: Column, h: Column) -> Column:
        return F.struct(live.alias("live"), cell.alias("cell"), n.alias("n"), F.col("k"), h.alias("h"))

    for _ in range(sweeps):
        for t in range(3):
            alone = F.col("live") & (F.abs("n") == 1) & (F.col("cell") == _cell(F.col("k"), t, F.col("w"))) & (F.col("h") == _check(F.col("k")))
            given = row(F.lit(False), F.col("k"), F.col("n"), zero)
            freed = [row(F.lit(True), _cell(F.col("k"), u, F.col("w")), -F.col("n"), F.col("h")) for u in range(3) if u != t]
            same = row(F.col("live"), F.col("cell"), F.col("n"), F.col("h"))
            rows = rows.select(*keys, "w", F.explode(F.when(alone, F.array(given, *freed)).otherwise(F.array(same))).alias("x"))
            rows = _summed(rows.select(*keys, "w", "x.*"), keys)
    return rows


def _dealt(pairs: DataFrame, keys: list[str]) -> DataFrame:
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, keys[0])


def difference_sizes(pairs: DataFrame, keys: list[str], scratch: Scratch, room: float = ROOM, sweeps: int = SWEEPS) -> DataFrame:
    """(keys, m): the number of recovered digests of each pair (keys, a, b) that differs at all."""
    done = None
    grown, left = 0, pairs
    while True:
        rows = peeled(_dealt(left.withColumn("grown", F.lit(grown)), keys), keys, room, sweeps)
        tried = scratch.save(rows.groupBy(*keys).agg(F.max("live").alias("failed"), F.count("*").alias("m")))
        good = tried.where("NOT failed").select(*keys, "m")
        done = good if done is None else done.unionByName(good)
        failed = tried.where("failed").select(*keys)
        if failed.isEmpty():
            return done
        left = pairs.join(failed, keys, "left_semi")
        grown += 1


def differences(pairs: DataFrame, keys: list[str], scratch: Scratch, room: float = ROOM, sweeps: int = SWEEPS) -> DataFrame:
    """(keys, digest, side) of every digest that only one of a and b holds: side 1 for a, -1 for b."""
    done = None
    grown, left = 0, pairs
    while True:
        rows = scratch.save(peeled(_dealt(left.withColumn("grown", F.lit(grown)), keys), keys, room, sweeps))
        failed = rows.where("live").select(*keys).distinct()
        good = rows.join(failed, keys, "left_anti").select(*keys, F.col("cell").alias("digest"), F.col("n").cast("int").alias("side"))
        done = good if done is None else done.unionByName(good)
        if failed.isEmpty():
            return done
        left = pairs.join(failed, keys, "left_semi")
        grown += 1


def edited(text: Column, following: Column) -> Column:
    """The last half of the text replaced by as much of the start of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def _nested(bounds: list[int]) -> tuple[Column, Column]:
    """Literal bounds in groups: the first of each group, and the groups."""
    size = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    array = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})")
    return array([g[0] for g in groups]), F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in g) + ")" for g in groups) + ")")


def _range(docs: DataFrame, range_rows: int, most_ranges: int) -> Column:
    """The number of a row's range, in the order of rows; from doc_id and tie (the text's md5)."""
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = min(most_ranges, max(1, -(-n // range_rows)))
    found = []
    if parts > 1 and nulls < n:
        shares = [i / parts for i in range(1, parts)]
        found = [int(b) for b in docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts))).first()[0] or []]
    bounds = sorted(set(found))
    at = F.lit(0)
    if bounds:
        firsts, groups = _nested(bounds)
        group = F.size(F.filter(firsts, lambda b: b < F.col("doc_id")))
        size = max(1, math.isqrt(len(bounds)))
        inside = F.size(F.filter(F.element_at(groups, F.greatest(group, F.lit(1))), lambda b: b < F.col("doc_id")))
        at = F.when(group == 0, 0).otherwise((group - 1) * size + inside)
    # Ids that fill whole ranges are bounds, so they are the greatest of their range; each is split by the tie.
    split = {b: c for b, c in Counter(found).items() if c > 1}
    pieces = F.lit(0)
    if split:
        pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b, c in split.items() for x in (b, c)]), F.col("doc_id").cast("long")), F.lit(0))
    pieces = F.when(F.col("doc_id").isNull(), min(_PARTS - 2, -(-nulls // range_rows))).otherwise(pieces)
    share = F.conv(F.substring("tie", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    part = F.when(pieces > 0, F.floor(share * pieces) + 1).otherwise(0)
    return F.when(F.col("doc_id").isNull(), -1).otherwise(at).cast("long") * _PARTS + part.cast("long")


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """(doc_id, text, own, next_text, following): with the next document by descending doc_id (after the last, the first), and the paragraphs of both."""
    spark = docs.sparkSession
    at = _range(docs, range_rows, most_ranges)
    placed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.md5("text")).withColumn("at", at)
    # The last row of each range, in order: about most_ranges of them at most.
    last = (
        placed.select("doc_id", "tie", "at")
        .groupBy("at")
        .agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("x"))
        .orderBy("at")
        .collect()
    )
    # The range after the last is the first: its least row looks back to the greatest of all.
    moved = [(r["x"]["doc_id"], r["x"]["tie"], last[(i + 1) % len(last)]["at"]) for i, r in enumerate(last)]
    targets = spark.createDataFrame(moved, "m_id bigint, m_tie string, m_at bigint")
    carried = placed.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tie") == F.col("m_tie"))).select(
        "doc_id", "text", "tie", F.col("m_at").alias("at"), F.lit(True).alias("carried")
    )
    both = placed.withColumn("carried", F.lit(False)).unionByName(carried)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(n, "at").withColumn("own", paragraphs(F.col("text")))
    back = Window.partitionBy("at").orderBy(F.desc("carried"), F.asc_nulls_first("doc_id"), "tie")
    looked = both.withColumn("next_text", F.lag("text").over(back)).withColumn("following", F.lag("own").over(back))
    return looked.where("NOT carried").select("doc_id", "text", "own", "next_text", "following")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    scratch = Scratch(docs.sparkSession, "fingerprint")
    texts = with_next(docs).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    digests = scratch.save(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited_text", 256).alias("edited_sha256"),
            "own",
            paragraphs(F.col("edited_text")).alias("changed"),
            "following",
        )
    )
    scratch.release()
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("changed").alias("b")), F.struct(F.lit(1).alias("which"), F.col("following").alias("b")))
    pairs = digests.select("row", F.col("own").alias("a"), F.explode(both).alias("x")).select("row", "x.which", "a", "x.b")
    sizes = difference_sizes(pairs, ["row", "which"], scratch)
    of_row = sizes.groupBy("row").agg(*[F.max(F.when(F.col("which") == i, F.col("m"))).alias(f"m{i}") for i in (0, 1)])

    def likeness(b: str, m: str) -> Column:
        total, apart = F.size("own") + F.size(b), F.coalesce(m, F.lit(0))
        return F.when(total == 0, 1.0).otherwise((total - apart).cast("double") / (total + apart))

    return digests.join(of_row, "row", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(cells(F.col("own"))).alias("fingerprint"),
        fingerprint(cells(F.col("changed"))).alias("edited_fingerprint"),
        likeness("changed", "m0").alias("near_edited"),
        likeness("following", "m1").alias("near_next"),
    )


def brute_force(rows: list[tuple[int, str]]) -> dict[int, tuple[str, float, float]]:
    """By doc_id the edited text and the two likenesses, from the paragraphs themselves; for tests."""
    import re

    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    of = lambda t: {p for p in re.split(r"\n+|(?<=[.!?])\s+", t) if p}
    near = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    out = {}
    for i, (doc_id, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        out[doc_id] = (changed, near(of(text), of(changed)), near(of(text), of(after)))
    return out
