"""Tokens, chunks and lexical ranking as DataFrame expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.predicates import bounded
from tessera.session import settled

WORD = r"(?U)\w+"
TERM = r"(?U)\w+(?:[-.]\w+)*"
CHUNK_CHARS = 1200


def collapse(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, start, chunk: windows of `size` code points without overlap; texts without characters have none."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one pass over the text
    return docs.select(doc_id, F.posexplode(pieces).alias("number", "chunk")).select(doc_id, (F.col("number") * size).alias("start"), "chunk")


def equal_to(term: str) -> Callable[[Column], Column]:
    return lambda t: F.when(t == F.lit(term), t)


def lexical_score(found: Column, terms: list[str], prefix: str | None = None) -> Column:
    """Mean over the query terms of their count in the tokens, 3 at most; an unfinished last word adds one half if a
    token begins with it. Null tokens score 0."""
    total = F.lit(0)
    for term in terms:
        total = total + F.least(F.lit(3), F.coalesce(F.size(F.array_compact(F.transform(found, equal_to(term)))), F.lit(0)))
    score = total.cast("double") / max(len(terms), 1)
    return score + F.when(F.exists(found, lambda t: t.startswith(prefix)), 0.5).otherwise(0.0) if prefix else score


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, tf of each row. A row's terms are counted before anything is shuffled, as all of them are in one
    task; repeated rows are counted each for itself."""
    rows = docs.select(doc_id, tokens(F.col(text), TERM).alias("words"), F.monotonically_increasing_id().alias("of_row"))  # before terms are rows
    words = rows.select("of_row", doc_id, F.explode("words").alias("term"))
    return words.groupBy("of_row", doc_id, "term").agg(F.count(F.lit(1)).alias("tf")).select(doc_id, "term", "tf")


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, query: list[str], doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score of each document that holds a query term. The texts are read once: a settled row of each document
    holds its size and how often each query term occurs."""
    terms = list(dict.fromkeys(query))
    words = docs.select(doc_id, tokens(F.col(text), TERM).alias("words"))
    own = [F.size(F.filter("words", equals(t))).cast("long").alias(f"tf_{i}") for i, t in enumerate(terms)]
    sized = settled(words.select(doc_id, F.size("words").alias("size"), *own), "bm25")
    whole = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("size").alias("avg_size"), *[F.count(F.when(F.col(f"tf_{i}") > 0, 1)).alias(f"df_{i}") for i in range(len(terms))]).first()
    score, some = F.lit(0.0), F.lit(False)
    for i in range(len(terms)):
        tf, df = F.col(f"tf_{i}"), whole[f"df_{i}"]
        idf = math.log(1 + (whole["n_docs"] - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / (whole["avg_size"] or 1.0)))
        some = some | (tf > 0)
    return sized.where(some).select(doc_id, score.alias("score"))


def equals(term: str) -> Callable[[Column], Column]:
    return lambda t: t == F.lit(term)


def tfidf_cosine(docs: DataFrame, query: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: cosine of the query and each document that shares a term, weights (1 + ln tf) (1 + ln((N + 1) /
    (df + 1))). Terms are counted inside each row and settled once; only they are shuffled, for their frequencies."""
    counts = settled(term_counts(docs, doc_id, text), "term-counts")
    idf = 1 + F.log((F.lit(docs.count()) + 1) / (F.col("df") + 1))
    rated = document_frequencies(counts).select("term", idf.alias("idf"))
    asked = {t: query.count(t) for t in query}
    own = {r["term"]: (1 + math.log(asked[r["term"]])) * r["idf"] for r in rated.where(F.col("term").isin(list(asked))).collect()}
    if not own:
        return counts.select(doc_id, F.lit(0.0).alias("score")).limit(0)
    norm = math.sqrt(sum(q * q for q in own.values()))
    q = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in own.items()], F.lit(0.0))
    hits = counts.where(F.col("term").isin(list(own))).select(F.col(doc_id).alias("hit_id")).distinct()
    near = counts.join(hits, F.col(doc_id) == F.col("hit_id"), "left_semi")  # the norms of documents that share a term alone
    rows = near.join(rated, "term").select(doc_id, ((1 + F.log("tf")) * F.col("idf")).alias("w"), q.alias("q"))
    sums = rows.groupBy(doc_id).agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn")).where("dot > 0")
    return sums.select(doc_id, (F.col("dot") / (F.col("dn") * F.lit(norm))).alias("score"))


def fuse(channels: list[DataFrame], item: str, score: str = "score", constant: int = 60, most: int = 10_000) -> DataFrame:
    """item, fused: reciprocal rank fusion; each channel, a result list of at most `most` rows, is ranked by score, ties
    by item. A longer channel is an error."""
    out = None
    for channel in channels:
        channel = bounded(channel, most)
        rank = F.row_number().over(Window.orderBy(F.desc(score), F.asc(item)))  # a channel is a bounded result list
        part = channel.select(item, (1 / (constant + rank)).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(item).agg(F.sum("part").alias("fused"))


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags; the five basic entities are decoded, white space is collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def span_is(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether the code points from start until before end are the quote."""
    return F.coalesce(text.substr(start + 1, end - start) == quote, F.lit(False))


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote occurs, without overlap; null of an empty one."""
    return ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.nullif(F.length(quote), F.lit(0))).cast("int")


def labels_grounded(text: Column, quote: Column, labels: Column) -> Column:
    """Whether the quote occurs exactly once in the text and each label, none of them empty, exactly once in the quote."""
    once = F.coalesce(occurrences(text, quote) == 1, F.lit(False))
    return once & F.coalesce(F.forall(labels, lambda x: F.coalesce(occurrences(quote, x) == 1, F.lit(False))), F.lit(False))


def spreadsheet_safe(value: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe in front."""
    risky = F.ltrim(value).rlike(r"^[=+@-]") | value.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def number_value(text: Column) -> Column:
    """1,234.5 and 1.234,5 and 3 1/2 as numbers; null if it is none."""
    plain = F.regexp_replace(F.trim(text), r"(?<=\d),(?=\d{3}(\D|$))", "")
    european = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?<=\d)\.(?=\d{3}(\D|$))", ""), ",", ".")
    mixed = F.regexp_extract(text, r"^\s*(\d+)\s+(\d+)/(\d+)\s*$", 0) != ""
    parts = [F.regexp_extract(text, r"^\s*(\d+)\s+(\d+)/(\d+)\s*$", i).try_cast("double") for i in (1, 2, 3)]
    return F.when(mixed, parts[0] + parts[1] / parts[2]).otherwise(F.coalesce(plain.try_cast("double"), european.try_cast("double")))


def fingerprint(*columns: str) -> Column:
    """A stable id of named values: sha256 over their JSON in the order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
