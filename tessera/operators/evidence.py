"""Evidence search, entity resolution, citation joins and evaluation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fingerprint, lexical_score, tokens
from tessera.operators.aggregates import first_per_key
from tessera.operators.graph import reachable
from tessera.operators.quality import conflicts


def name_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def all_terms(text: Column, terms: list[str]) -> Column:
    """Whether the text holds every term, in any case."""
    lowered = F.lower(text)
    return reduce(Column.__and__, [F.coalesce(F.contains(lowered, F.lit(t.lower())), F.lit(False)) for t in terms], F.lit(True))


def all_tokens(text: Column, terms: list[str]) -> Column:
    """Whether every token of the terms is one of the text's tokens, in any case; a part of a longer word is none."""
    wanted = sorted({t for term in terms for t in re.findall(r"\w+", term.lower())})
    own = F.coalesce(tokens(text), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), own)) == 0


def searched(evidence: DataFrame, text: str, terms: list[str], entities: str, scope: list[object]) -> DataFrame:
    """The evidence that holds every term (see all_terms) and, if the scope isn't empty, is about one of its entities.
    entities: an array column."""
    about = F.arrays_overlap(F.col(entities), F.array(*map(F.lit, scope))) if scope else F.lit(True)
    return evidence.where(all_terms(F.col(text), terms) & F.coalesce(about, F.lit(False)))


def save_baseline(items: DataFrame, item: str, path: str, kind: str) -> None:
    """Write the ids and fingerprints of a finding or a neighbourhood, to be compared later; a used path is an error."""
    own = items.select(F.col(item).alias("item"), fingerprint(*items.columns).alias("print"), F.lit(kind).alias("kind"))
    own.write.mode("error").parquet(path)


def since_baseline(items: DataFrame, item: str, path: str) -> DataFrame:
    """item, change (added, removed, changed or unchanged) of items against a saved baseline with the same columns."""
    before = items.sparkSession.read.parquet(path).select(F.col("item").alias("old_item"), F.col("print").alias("old_print"))
    now = items.select(F.col(item).alias("new_item"), fingerprint(*items.columns).alias("new_print"))
    change = F.when(F.col("old_item").isNull(), "added").when(F.col("new_item").isNull(), "removed").when(F.col("old_print") == F.col("new_print"), "unchanged").otherwise("changed")
    return now.join(before, F.col("new_item") == F.col("old_item"), "full_outer").select(F.coalesce("new_item", "old_item").alias("item"), change.alias("change"))


def preview(evidence: DataFrame, item: str, text: str, typed: str, most: int = 12) -> DataFrame:
    """item, score of at most `most` rows for a query that is being typed: its last word may be unfinished."""
    words = re.findall(r"\w+", typed.lower())
    last = words[-1] if words and re.search(r"\w$", typed) else None
    score = lexical_score(tokens(F.col(text)), words, prefix=last)
    return evidence.select(item, score.alias("score")).where("score > 0").orderBy(F.desc("score"), item).limit(most)


def resolved(queries: DataFrame, asked: str, entities: DataFrame, entity: str, names: str) -> DataFrame:
    """queries with entity_id and outcome: an id comes before a name; matched, ambiguous (several, id null) or
    unknown. names: an array column of names and aliases."""
    by_id = entities.select(F.col(entity).cast("string").alias("k"), F.lit(0).alias("rank"), F.col(entity).alias("e"))
    by_name = entities.select(F.explode(names).alias("n"), F.col(entity).alias("e")).select(name_key(F.col("n")).alias("k"), F.lit(1).alias("rank"), "e")
    keys = by_id.union(by_name).groupBy("k", "rank").agg(F.min("e").alias("e"), F.countDistinct("e").alias("n"))
    best = keys.groupBy("k").agg(F.min_by(F.struct("e", "n"), "rank").alias("m"))
    out = queries.join(best, name_key(F.col(asked)) == F.col("k"), "left")
    outcome = F.when(F.col("m").isNull(), "unknown").when(F.col("m.n") > 1, "ambiguous").otherwise("matched")
    return out.withColumn("outcome", outcome).withColumn("entity_id", F.when(F.col("outcome") == "matched", F.col("m.e"))).drop("k", "m")


def exact_before_substring(entities: DataFrame, name: str, asked: str) -> DataFrame:
    """Entities named exactly so, or, if there are none, those whose name holds it."""
    key = name_key(F.col(name))
    kind = F.when(key == asked.lower(), 0).when(F.contains(key, F.lit(asked.lower())), 1)
    hits = entities.withColumn("match_class", kind).where("match_class is not null")
    best = hits.agg(F.min("match_class").alias("best_class"))  # one row
    return hits.join(F.broadcast(best), F.col("match_class") == F.col("best_class")).drop("best_class", "match_class")


def united(parts: list[DataFrame], item: str, order: list[Column]) -> DataFrame:
    """The rows of all parts, of each item the first in order."""
    return first_per_key(reduce(DataFrame.unionByName, parts), [item], order)


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows that are missing from the actual ones, as often as they are."""
    return expected.exceptAll(actual)


def named_ends(edges: DataFrame, a: str, b: str, names: DataFrame, node: str, name: str) -> DataFrame:
    """edges with a_name and b_name, null for ends that nothing names."""
    for end in (a, b):
        own = names.select(F.col(node).alias("named_node"), F.col(name).alias(f"{end}_name"))
        edges = edges.join(own, F.col(end) == F.col("named_node"), "left").drop("named_node")
    return edges


def of_documents(assertions: DataFrame, docs: DataFrame, document: str) -> DataFrame:
    """Assertions of the given documents, each once however often a document is given."""
    return assertions.join(docs.select(F.col(document).alias("of_document")), F.col(document) == F.col("of_document"), "left_semi")


def conflict_packet(edges: DataFrame, target: DataFrame, hops: int, evidence: DataFrame, entity: str, item: str, subject: list[str], value: str) -> DataFrame:
    """subject, n_values, vals of the conflicting values in the evidence about all entities within `hops` steps of the
    target (column node); evidence of several entities counts once."""
    near = reachable(edges, target, hops).select(F.col("node").alias("near_node"))
    about = evidence.join(near, F.col(entity) == F.col("near_node"), "left_semi").dropDuplicates([item])
    return conflicts(about, subject, value)


def cited_evidence(in_scope: DataFrame, edges: DataFrame, cited: str, evidence: DataFrame, item: str) -> DataFrame:
    """Evidence in scope and evidence that traversed edges cite, each once."""
    proof = edges.select(F.explode(cited).alias("proof_id")).distinct()
    return in_scope.unionByName(evidence.join(proof, F.col(item) == F.col("proof_id"), "left_semi")).dropDuplicates([item])


def baseline_scope(items: DataFrame, item: str, document: str, tracked_documents: DataFrame, tracked_items: DataFrame, supersedes: str) -> DataFrame:
    """Items of a tracked document, or that supersede a tracked item; each once."""
    docs = tracked_documents.select(F.col(document).alias("t_doc")).distinct()
    ids = tracked_items.select(F.col(item).alias("t_item")).distinct()
    by_doc = items.join(docs, F.col(document) == F.col("t_doc"), "left_semi").select(item)
    by_link = items.select(item, F.explode(supersedes).alias("old")).join(ids, F.col("old") == F.col("t_item"), "left_semi").select(item)
    return items.join(by_doc.union(by_link).distinct().withColumnRenamed(item, "scope_id"), F.col(item) == F.col("scope_id"), "left_semi")


def vectors_in_step(items: DataFrame, vectors: DataFrame, item: str, text_hash: str) -> DataFrame:
    """item, state: present, stale (another text was embedded) or missing."""
    v = vectors.select(F.col(item).alias("v_item"), F.col(text_hash).alias("v_hash"))
    state = F.when(F.col("v_item").isNull(), "missing").when(F.col("v_hash") != F.col(text_hash), "stale").otherwise("present")
    return items.join(v, F.col(item) == F.col("v_item"), "left").select(item, state.alias("state"))


def set_report(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, verdict: hit, missed or extra."""
    e, f = expected.select(F.col(key).alias("e")).distinct(), found.select(F.col(key).alias("f")).distinct()
    verdict = F.when(F.col("f").isNull(), "missed").when(F.col("e").isNull(), "extra").otherwise("hit")
    return e.join(f, F.col("e") == F.col("f"), "full_outer").select(F.coalesce("e", "f").alias(key), verdict.alias("verdict"))


def approval_pairs(messages: DataFrame, sender: str, recipients: str, text: str, known: DataFrame, person: str) -> DataFrame:
    """low, high, n: requests for approval with exactly one known direct recipient, who ranks higher. Asking for
    approval says nothing about management."""
    asks = messages.where(F.col(text).rlike(r"(?i)\b(approval|approve|sign[- ]?off)\b")).withColumn("request", F.monotonically_increasing_id())
    each = asks.select("request", F.col(sender).alias("low"), F.explode(F.array_distinct(recipients)).alias("high"))
    real = each.join(known.select(F.col(person).alias("known_id")).distinct(), F.col("high") == F.col("known_id"), "left_semi")
    single = real.groupBy("request", "low").agg(F.count(F.lit(1)).alias("people"), F.min("high").alias("high")).where((F.col("people") == 1) & (F.col("low") != F.col("high")))
    return single.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))


def roster(rows: DataFrame, explicit: str, email: str, content: list[str]) -> DataFrame:
    """rows with identity: the explicit id, else the address, else a hash of the row."""
    mail = F.nullif(F.lower(F.trim(email)), F.lit(""))
    own = F.substring(F.sha2(F.to_json(F.struct(*content)), 256), 1, 24)
    return rows.withColumn("identity", F.coalesce(F.nullif(F.trim(explicit), F.lit("")), mail, own))


def bounded_page(rows: DataFrame, order: list[Column], size: Column, max_items: int, max_bytes: int, after: int = 0) -> DataFrame:
    """The page of an ordered inventory that begins after `after` rows: at most max_items of them and max_bytes in
    all, the first overflow ending it."""
    page = rows.orderBy(*order).offset(after).limit(max_items)  # the page is bounded, so one window may hold it
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return page.withColumn("page_bytes", F.sum(size).over(window)).where(F.col("page_bytes") <= max_bytes)


def roster_links(people: DataFrame, person: str, names: str, unit: str, manager: str) -> tuple[DataFrame, DataFrame]:
    """people with unit_id (a hash of the folded unit name) and manager_id, manager_outcome: the person whom the stated
    manager names by id, address or any of names, an array column (matched; unknown, ambiguous or none, the id null); and
    the units: unit_id, name, people. A person never is its own manager: that is outcome self."""
    unit_key = F.nullif(name_key(F.col(unit)), F.lit(""))
    with_unit = people.withColumn("unit_id", F.when(unit_key.isNotNull(), F.concat(F.lit("unit_"), F.substring(F.sha2(unit_key, 256), 1, 20))))
    units = with_unit.where("unit_id is not null").groupBy("unit_id").agg(F.min(F.trim(unit)).alias("name"), F.count(F.lit(1)).alias("people"))
    found = resolved(with_unit, manager, people, person, names)
    own = F.col("entity_id") == F.col(person)
    outcome = F.when(F.nullif(F.trim(manager), F.lit("")).isNull(), "none").when(own, "self").otherwise(F.col("outcome"))
    linked = found.withColumn("manager_outcome", outcome).withColumn("manager_id", F.when(F.col("manager_outcome") == "matched", F.col("entity_id")))
    return linked.drop("outcome", "entity_id"), units
