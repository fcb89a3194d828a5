"""Checks before data is taken in: recomputed rows, event batches, assertion spans, keys; places, pages and their chain."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fingerprint, occurrences, span_is
from tessera.operators.predicates import RequestError
from tessera.operators.quality import duration_hours, flags
from tessera.session import settled

DURATION_TOLERANCE = 1e-9


def recomputed(rows: DataFrame, status: str, created: str, closed: str, is_closed: str, hours: str, required: list[str]) -> DataFrame:
    """rows with problems (sorted): what a normalised row states that its own dates and status don't give."""
    own_closed = F.coalesce(F.lower(F.trim(status)) == "closed", F.lit(False))
    span = duration_hours(F.col(created), F.col(closed))
    own_hours = F.when(own_closed & (span >= 0), span)
    same_hours = F.coalesce(F.abs(F.col(hours) - own_hours) <= F.greatest(F.lit(1e-12), DURATION_TOLERANCE * F.abs(own_hours)), F.col(hours).isNull() & own_hours.isNull())
    tests = {"closed_flag_differs": ~F.col(is_closed).eqNullSafe(own_closed), "duration_differs": ~same_hours, **{f"missing_{c}": F.col(c).isNull() | (F.trim(c) == "") for c in required}}
    return rows.withColumn("problems", flags(tests))


def staged_events(events: DataFrame, event: str, document: str, version: str, content: str, required: list[str], known: DataFrame | None = None) -> DataFrame:
    """events with outcome: accepted, duplicate (the same event again), or why it is rejected: missing_<column>,
    event_conflict (its id stands for other content) or version_conflict (its version of the document does).

    known: events taken in before, with the same columns; they come first. Of rows with one event id or version the
    smallest content is the accepted one, so the result doesn't depend on the order of arrival.
    """
    marked = events.withColumn("known_before", F.lit(False))
    if known is not None:
        marked = known.select(*events.columns).withColumn("known_before", F.lit(True)).unionByName(marked)
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in [event, *required]], F.lit(None).cast("string"))
    marked = marked.withColumn("missing", missing)
    sound = F.when(F.col("missing").isNull(), F.struct(~F.col("known_before"), F.col(content)))
    of_event, of_version = Window.partitionBy(event), Window.partitionBy(document, version)
    first_event = F.min(sound).over(of_event).getField(content)
    staged = marked.withColumn("first_of_event", first_event)
    alive = F.when(F.col("missing").isNull() & F.col(content).eqNullSafe(F.col("first_of_event")), F.struct(~F.col("known_before"), F.col(content)))
    staged = staged.withColumn("first_of_version", F.min(alive).over(of_version).getField(content))
    again = F.row_number().over(Window.partitionBy(event, content, "missing").orderBy(F.desc("known_before")))
    staged = staged.withColumn("copy", again)
    outcome = F.coalesce(F.col("missing"), F.when(~F.col(content).eqNullSafe(F.col("first_of_event")), "event_conflict").when(~F.col(content).eqNullSafe(F.col("first_of_version")), "version_conflict").when(F.col("copy") > 1, "duplicate").otherwise("accepted"))
    return staged.withColumn("outcome", outcome).where(~F.col("known_before")).drop("known_before", "missing", "first_of_event", "first_of_version", "copy")


def staged_assertions(assertions: DataFrame, sources: DataFrame, item: str, document: str, start: str, end: str, quote: str, subject: str, object_: str, text: str) -> DataFrame:
    """assertions with outcome: accepted, missing_source, wrong_span (the text from start to end isn't the quote, or that is empty),
    ambiguous_quote (it occurs more than once), same_endpoints, or assertion_conflict (an id of several rows)."""
    s = sources.select(F.col(document).alias("source_doc"), F.col(text).alias("source_text"))
    rows = assertions.join(s, F.col(document) == F.col("source_doc"), "left").withColumn("of_id", F.count(F.lit(1)).over(Window.partitionBy(item)))
    outcome = (
        F.when(F.col("source_doc").isNull(), "missing_source")
        .when(~span_is(F.col("source_text"), F.col(start), F.col(end), F.col(quote)) | (F.length(quote) == 0), "wrong_span")
        .when(occurrences(F.col("source_text"), F.col(quote)) > 1, "ambiguous_quote")
        .when(F.col(subject).eqNullSafe(F.col(object_)), "same_endpoints")
        .when(F.col("of_id") > 1, "assertion_conflict")
        .otherwise("accepted")
    )
    return rows.withColumn("outcome", outcome).drop("source_doc", "source_text", "of_id")


def batch_outcomes(batches: DataFrame, done: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, outcome of each batch by its idempotency key: new, replayed (done with the same payload) or
    idempotency_conflict (done with another). done: key, payload. The payload is a digest of the rows in any order."""
    digest = F.sha2(F.concat_ws(",", F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))), 256)
    now = batches.groupBy(key).agg(digest.alias("payload"))
    before = done.select(F.col(key).alias("done_key"), F.col("payload").alias("done_payload"))
    outcome = F.when(F.col("done_key").isNull(), "new").when(F.col("payload") == F.col("done_payload"), "replayed").otherwise("idempotency_conflict")
    return now.join(before, F.col(key) == F.col("done_key"), "left").select(key, outcome.alias("outcome"), "payload")


def key_check(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_rows, n_keys, unique (each row has a key of its own; a null in a key is no key)."""
    has = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    n_keys = F.countDistinct(F.when(has, F.struct(*keys)))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), n_keys.alias("n_keys"), (n_keys == F.count(F.lit(1))).alias("unique"))


def counts_by(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n: how often each value of each field occurs, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with place, from 0, in a total order of the whole table, without one window over it.

    The rows are written once, in ranges of the order and with the number of their range, as a second evaluation would
    sample other ranges. Each range is ranked on its own and begins after the rows of those before it.
    """
    ordered = settled(rows.repartitionByRange(*order).withColumn("of_range", F.spark_partition_id()), "ranges")
    counts = ordered.groupBy("of_range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = counts.select(F.col("of_range").alias("own_range"), F.coalesce(F.sum("n").over(Window.orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skipped"))
    own = F.row_number().over(Window.partitionBy("of_range").orderBy(*order))
    ranked = ordered.withColumn("own_place", own).join(F.broadcast(before), F.col("of_range") == F.col("own_range"))
    return ranked.withColumn("place", F.col("skipped") + F.col("own_place") - 1).drop("of_range", "own_range", "own_place", "skipped")


def numbered_pages(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """rows with page and place (both from 0): pages of `size` rows in a total order of the whole table (see placed)."""
    return placed(rows, order).withColumn("page", F.floor(F.col("place") / size))


def filled(sizes: np.ndarray, used: int, items: int, max_items: int, max_bytes: int) -> int:
    """How many of the first sizes still fit on a page that holds `items` items of `used` bytes."""
    room = np.cumsum(sizes[: max_items - items])
    return int(np.searchsorted(room, max_bytes - used, side="right"))


def page_starts(upto: np.ndarray, first: int, max_items: int, max_bytes: int) -> Iterator[int]:
    """Where pages begin if one does at `first`: each ends before the first item that it can't hold. upto: bytes before
    each item, and of all."""
    while first < len(upto) - 1:
        yield first
        first = min(first + max_items, int(np.searchsorted(upto, upto[first] + max_bytes, side="right")) - 1)


def byte_pages(rows: DataFrame, order: list[Column], size: Column, max_items: int, max_bytes: int, segment_rows: int = 1 << 17) -> DataFrame:
    """rows with page and place (from 0): pages in a total order of the whole table, of at most max_items rows and
    max_bytes of `size` in all; the first row that a page can't hold opens the next. A row larger than a page is an
    error.

    Where pages begin depends on all rows before. The table is cut into segments of places; a page that a segment has
    begun reaches at most max_items rows into the next one, so each segment says for each of these beginnings where its
    last page begins and how many pages there are. The driver links these tables (max_items + 1 entries of a segment),
    and each segment cuts its pages from the beginning that holds.
    """
    plain = settled(placed(rows, order).withColumn("bytes_of", size.cast("long")), "placed")
    if (largest := plain.agg(F.max("bytes_of").alias("b")).first()["b"]) is not None and largest > max_bytes:
        raise RequestError("budget_exceeded", f"an item of {largest} bytes fits no page of {max_bytes}")
    cut = plain.select(F.floor(F.col("place") / segment_rows).alias("segment"), "place", F.coalesce("bytes_of", F.lit(0)).alias("bytes_of"))

    def ways(table: pa.Table) -> pa.Table:
        sizes = table.sort_by("place")["bytes_of"].to_numpy()
        upto, n, out = np.concatenate(([0], np.cumsum(sizes))), len(sizes), []
        known: dict[int, tuple[int, int]] = {}  # of a beginning, its last page and the number of pages
        for first in range(min(max_items, n) + 1):
            path, met = [], None
            for at in page_starts(upto, first, max_items, max_bytes):
                if at in known:
                    met = known[at]
                    break
                path.append(at)
            last, pages = met or (path[-1] if path else n, 0)
            for i, begin in enumerate(reversed(path)):
                known[begin] = (last, pages + i + 1)
            last, pages = known.get(first, (n, 0))
            out.append((first, int(upto[n] - upto[last]), n - last, pages))
        head = sizes[:max_items].tolist()
        columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
        return pa.table({"segment": pa.array([table["segment"][0].as_py()] * len(out), pa.int64()), "n": pa.array([n] * len(out), pa.int64()), "head": pa.array([head if i == 0 else [] for i in range(len(out))], pa.list_(pa.int64())), **dict(zip(("first", "used", "items", "pages"), columns, strict=True))})

    found = cut.groupBy("segment").applyInArrow(ways, "segment long, n long, head array<long>, first long, used long, items long, pages long").orderBy("segment", "first").collect()
    entries: dict[int, tuple[int, int]] = {}  # of each segment, where its first page begins and that page's number
    used, items, pages, table, heads, counts = 0, 0, 0, {}, {}, {}
    for r in found:
        table[r["segment"], r["first"]] = (r["used"], r["items"], r["pages"])
        if r["head"] or r["first"] == 0:
            heads[r["segment"]], counts[r["segment"]] = np.array(r["head"], np.int64), r["n"]
    for segment, n in counts.items():
        first = filled(heads[segment], used, items, max_items, max_bytes) if pages else 0
        entries[segment] = (first, pages)
        if first >= n:  # all of it belongs to the page before
            used, items = used + int(heads[segment].sum()), items + n
        else:
            used, items, more = table[segment, first]
            pages += more

    def cut_pages(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        first, before = entries[table["segment"][0].as_py()]
        starts = page_starts(np.concatenate(([0], np.cumsum(table["bytes_of"].to_numpy()))), first, max_items, max_bytes)
        page = before - 1 + np.searchsorted(np.fromiter(starts, np.int64), np.arange(table.num_rows), side="right")
        return pa.table({"paged_place": table["place"], "page": pa.array(page, pa.int64())})

    pages_of = cut.groupBy("segment").applyInArrow(cut_pages, "paged_place long, page long")
    return plain.drop("bytes_of").join(pages_of, F.col("place") == F.col("paged_place")).drop("paged_place")


def page_chain(pages: DataFrame, page: str, place: str, item: str) -> DataFrame:
    """page, first_item, last_item, items, digest, cursor, next_cursor: each page's digest is of its items in order, its
    cursor names where it begins and the digest of the page before, so a page from another state of the table fits none."""
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, item))), lambda x: x[item].cast("string")), "\n"), 256)
    sums = pages.groupBy(page).agg(F.min(place).alias("start"), F.count(F.lit(1)).alias("items"), F.min_by(item, place).alias("first_item"), F.max_by(item, place).alias("last_item"), digest.alias("digest"))
    before = sums.select((F.col(page) + 1).alias("next_page"), F.col("digest").alias("previous"))
    linked = sums.join(before, F.col(page) == F.col("next_page"), "left").drop("next_page")
    cursor = F.concat_ws(".", F.lit("v1"), page, "start", F.substring(F.coalesce("previous", F.lit("")), 1, 16))
    return linked.withColumn("cursor", cursor)


def chain_faults(chain: DataFrame, replayed: DataFrame, page: str) -> DataFrame:
    """page, fault of the replayed pages (the same columns) that don't fit the chain: missing, extra, or differs."""
    a = chain.select(F.col(page).alias("own_page"), fingerprint("cursor", "digest", "items").alias("own_print"))
    b = replayed.select(F.col(page).alias("their_page"), fingerprint("cursor", "digest", "items").alias("their_print"))
    fault = F.when(F.col("their_page").isNull(), "missing").when(F.col("own_page").isNull(), "extra").when(F.col("own_print") != F.col("their_print"), "differs")
    return a.join(b, F.col("own_page") == F.col("their_page"), "full_outer").select(F.coalesce("own_page", "their_page").alias(page), fault.alias("fault")).where("fault is not null")
