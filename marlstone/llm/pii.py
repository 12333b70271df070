"""Operator 4: personal data, and terms that disclose it, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers by pattern and check (digits, Luhn). Their
normalised values are the corpus's protected entities.

A term (a word of three letters or more) is judged by what it tells about an entity. Over all documents, n_e hold the
entity, n_t the term, and n_te both, wherever they stand in the text. The pointwise mutual information
log2(n_te * N / (n_e * n_t)) is compared with the entity's own information log2(N / n_e): at ``ALPHA`` of it or more the
term discloses the entity, if at least ``SUPPORT`` different texts hold the two together. In every document that holds
the entity, all occurrences of its disclosing terms get spans of kind "term" and are generalised with the base spans by
redact().

All counts cover all documents. Entities that too few texts hold for any term to have the support are left out before
terms are counted. Counts are summed within tasks before they are shuffled; texts are shuffled only of documents that
hold one of the other entities, one for each text.

A null text is empty and has no spans; a null doc_id is reported as null; repeated rows are counted and reported each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA = 0.9
SUPPORT = 3
NULL_ID = -(1 << 63)

# The patterns match what the plain ones of the contract match. Possessive repeats and the look-behinds keep every
# failing start from being tried again within the same run of characters.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"

_SPANS = "array<struct<s:int,k:int,e:int,m:string>>"


def let(value: Column, body) -> Column:
    """Evaluates value once for a body that reads it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: Column, kind: int, valid=None) -> Column:
    """Spans (start, kind, end, matched text) of the leftmost matches that do not overlap; those not valid are dropped."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["p"])
        end = at + F.length(x["m"])
        span = F.struct(at.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["m"].alias("m"))
        ok = x["m"].isNotNull() if valid is None else x["m"].isNotNull() & valid(x["m"])
        return F.struct(F.coalesce(end, at).alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digits pass: from the right, every second is doubled, less 9 if above 9."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice"))

    def step(acc: Column, c: Column) -> Column:
        v = c.cast("int")
        doubled = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.struct((acc["sum"] + F.when(acc["twice"], doubled).otherwise(v)).alias("sum"), (~acc["twice"]).alias("twice"))

    return F.aggregate(F.reverse(F.filter(F.split(d, ""), lambda c: c != "")), start, step, lambda acc: acc["sum"] % 10 == 0)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and kind."""
    none = F.array().cast(_SPANS)
    numbers = text.rlike("[0-9]")
    kinds = [
        F.when(F.contains(text, F.lit("@")), matches(text, F.lit(EMAIL), 0)).otherwise(none),
        F.when(numbers, matches(text, F.lit(IP), 1, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))).otherwise(none),
        F.when(
            numbers,
            matches(text, F.lit(CARD), 2, lambda m: let(digits(m), lambda d: F.length(d).between(14, 19) & luhn(d))),
        ).otherwise(none),
        F.when(
            numbers & F.contains(text, F.lit("+")),
            matches(text, F.lit(PHONE), 3, lambda m: F.length(digits(m)).between(10, 15)),
        ).otherwise(none),
    ]
    return F.array_sort(F.concat(*kinds))


def entity(x: Column) -> Column:
    """The normalised value of a span, with its kind."""
    value = F.when(x["k"] == 0, F.lower(x["m"])).when(x["k"] == 1, x["m"]).otherwise(digits(x["m"]))
    return F.concat(x["k"].cast("string"), F.lit(":"), value)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing(shown: DataFrame, held: DataFrame, docs: DataFrame, scratch: Scratch, alpha: float, support: int) -> DataFrame:
    """(entity, term) of the terms that disclose an entity.

    shown has key, entity, n (the documents of a text and an entity in it) and n_e; held has key, text of those texts.
    """
    terms = held.select("key", F.explode(terms_of(F.col("text"))).alias("term"))
    joint = (
        terms.join(shown.select("key", "entity", "n", "n_e"), "key")
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_te"), F.count("*").alias("texts"), F.max("n_e").alias("n_e"))
        .where(F.col("texts") >= support)
    )
    n_t = docs.select(F.explode(terms_of(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n = docs.agg(F.count("*").alias("n"))
    judged = scratch.save(joint).join(n_t, "term").crossJoin(F.broadcast(n))  # n is one row
    told = F.log2(F.col("n_te") * F.col("n") / (F.col("n_e") * F.col("n_t")).cast("double"))
    own = F.log2(F.col("n") / F.col("n_e"))
    return judged.where((own > 0) & (told >= alpha * own)).select("entity", "term")


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id, key (md5 of the text), base and spans (arrays of start, kind, end, text)."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    based = rows.select("doc_id", F.md5("text").alias("key"), base_spans(F.col("text")).alias("base"))
    found = scratch.save(based.withColumn("entities", F.array_distinct(F.transform("base", entity))))
    own_id = F.coalesce("doc_id", F.lit(NULL_ID)).alias("own_id")
    by_text = scratch.save(found.select("key", own_id, F.explode("entities").alias("entity")).groupBy("entity", "key").agg(F.count("*").alias("n"), F.min("own_id").alias("one")))
    common = by_text.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    shown = scratch.save(by_text.join(common.select("entity", "n_e"), "entity"))
    # One document of each text: copies do not meet by their text, but by text and id.
    one = shown.select("key", F.col("one").alias("own_id")).distinct()
    likely = rows.where(F.col("text").rlike("[0-9@]")).select(F.md5("text").alias("key"), own_id, "text")
    held = scratch.save(likely.join(one, ["key", "own_id"], "left_semi").dropDuplicates(["key", "own_id"]).select("key", "text"))
    terms = scratch.save(disclosing(shown, held, docs, scratch, alpha, support))
    of_text = shown.join(terms, "entity").groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    # Terms are letters only, so they need no quoting.
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{M}])"))
    spotted = scratch.save(held.join(of_text, "key").select("key", matches(F.col("text"), pattern, 4).alias("told")))
    free = F.filter("told", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    both = F.when(F.col("told").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free)))
    return found.join(spotted, "key", "left").select("doc_id", "key", "base", both.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span generalised to its kind; of overlapping spans the first is."""
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(marks, x["k"] + 1))
        past = x["s"] < acc["at"]
        return F.struct(F.when(past, F.greatest(acc["at"], x["e"])).otherwise(x["e"]).alias("at"), F.when(past, acc["out"]).otherwise(more).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text) with all spans generalised."""
    found = find(docs, alpha, support).select("key", "spans").dropDuplicates(["key"])
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("key", F.md5("text"))
    return rows.join(found, "key").select("doc_id", redact(F.col("text"), F.col("spans")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find(), and the number of terms."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(4).alias("n_term"),
    )
