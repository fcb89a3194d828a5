"""What messages say about reporting, and the managers that follow: addresses, times, statements, candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.comms import contact_score, directed_pairs, statement_score, top_contacts, unquoted_lines
from tessera.operators.evidence import name_key

# Marks and words that make a line no statement of its sender, what may stand before one, its patterns.
QUOTATION = '["“”‘’]'
ATTRIBUTION = r"(?i)'|\b(?:said|wrote|says|quote|example|suppose|imagine|if|whether|wish)\b"
OPENING = r"(?:for the record,|for your records,|to clarify,)?"
REPORT = rf"(?i)^\s*{OPENING}\s*I\s+(do not\s+|don't\s+|no longer\s+)?report\s+(?:directly\s+)?to\s+(.+)$"
MANAGER = r"(?i)^\s*([^.!?]{1,160}?)\s+is\s+my\s+(?:line\s+|direct\s+)?manager\b"
APPROVAL = rf"(?i)^\s*{OPENING}\s*(please\s+(?:review\s+and\s+)?approve|(?:I|we)\s+need\s+your\s+approval|could\s+you\s+approve)\b"
NAME_CHARS = 160
NAME_ENDS = r"[ \t.,;:!?\r]"
AFTER_NAME = r"^\s*(?:[.;!?]|$)"


def addresses(text: Column) -> Column:
    """The mail addresses of a header, lower-cased, in order; mailto: and angle brackets go."""
    plain = F.regexp_replace(F.lower(text), r"mailto:", "")
    return F.regexp_extract_all(plain, F.lit(r'[^\s<>@,;"]+@[^\s<>@,;"]+'), F.lit(0))


def message_time(value: Column) -> tuple[Column, Column]:
    """The time of a header as a zone-free timestamp, and a flag: null (the time is UTC), timezone_unknown (the wall
    clock as stated), invalid_timestamp or missing_timestamp (no time). ISO 8601 and RFC 2822 are read."""
    v = F.nullif(F.trim(value), F.lit(""))
    zoned = v.rlike(r"^\d{4}-.*(Z|[+-]\d{2}:?\d{2})$")
    mail = F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss xx"))
    instant = F.coalesce(F.when(zoned, F.try_to_timestamp(v)), mail)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    naive = F.when(~zoned & v.rlike(r"^\d{4}-\d{2}-\d{2}"), v.try_cast("timestamp_ntz"))
    flag = F.when(v.isNull(), "missing_timestamp").when(instant.isNotNull(), F.lit(None)).when(naive.isNotNull(), "timezone_unknown").otherwise("invalid_timestamp")
    return F.coalesce(utc, naive), flag


def canonical_utc(time: Column) -> Column:
    """A UTC wall clock as text to the microsecond."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def leading_names(text: Column) -> Column:
    """What may be a name at the beginning of a text: structs of its key, its length, and whether the text may go on so
    behind it. A longer name that nobody has must not be cut to a known one, so only the end of a clause may follow."""
    chars = F.sequence(F.lit(1), F.least(F.length(text), F.lit(NAME_CHARS)))
    ends = F.filter(chars, lambda i: (i == F.length(text)) | text.substr(i + 1, F.lit(1)).rlike(NAME_ENDS))
    names = F.transform(ends, lambda i: F.struct(name_key(text.substr(F.lit(1), i)).alias("key"), i.alias("chars"), text.substr(i + 1, F.length(text)).rlike(AFTER_NAME).alias("ends")))
    return F.when(F.length(text) > 0, names)


def statements(messages: DataFrame, message: str, body: str, aliases: DataFrame, name: str, person: str) -> DataFrame:
    """message, line_no, kind (direct_report, negative_report or approval_request), target: what the sender states.

    Quoted and forwarded lines are left out, and so are lines with quotation marks and sentences after words of
    attribution or doubt. A statement begins its sentence. The target is the person who alone has the longest known name
    that begins what follows, if the clause ends with that name; approval requests have none.
    """
    lines = unquoted_lines(messages, message, body).where(~F.col("line").rlike(QUOTATION))
    sentences = F.split("line", r"(?<=[.!?])")
    before = F.transform(sentences, lambda s, i: F.struct(s.alias("said"), F.array_join(F.slice(sentences, F.lit(1), i), "").alias("before")))
    said = lines.select(message, "line_no", "line", F.posexplode(before).alias("sentence_no", "s")).select(message, "line_no", "line", "sentence_no", "s.*").where(~F.col("before").rlike(ATTRIBUTION))
    said = said.withColumn("rest", F.col("line").substr(F.length("before") + 1, F.length("line")))  # a name may hold a full stop
    report, manager = F.regexp_extract("rest", REPORT, 2), F.regexp_extract("said", MANAGER, 1)
    kind = F.when((report != "") & (F.regexp_extract("rest", REPORT, 1) != ""), "negative_report").when((report != "") | (manager != ""), "direct_report").when(F.col("said").rlike(APPROVAL), "approval_request")
    whole = F.array(F.struct(name_key(manager).alias("key"), F.length(manager).alias("chars"), F.lit(True).alias("ends")))
    named = F.when(report != "", leading_names(report)).when(manager != "", whole)
    found = said.select(message, "line_no", "sentence_no", kind.alias("kind"), named.alias("names")).where("kind is not null")
    known = aliases.groupBy(name_key(F.col(name)).alias("alias_key")).agg(F.min(person).alias("target"), F.countDistinct(person).alias("people")).where("people = 1")
    asked = found.where("names is not null").select(message, "line_no", "sentence_no", "kind", F.explode("names").alias("n")).select(message, "line_no", "sentence_no", "kind", "n.*")
    hits = asked.join(known, F.col("key") == F.col("alias_key"))
    best = hits.groupBy(message, "line_no", "sentence_no", "kind").agg(F.max_by(F.struct("target", "ends"), "chars").alias("t")).where("t.ends")
    return best.select(message, "line_no", "kind", "t.target").unionByName(found.where("kind = 'approval_request'").select(message, "line_no", "kind", F.lit(None).cast(aliases.schema[person].dataType).alias("target")))


def manager_candidates(pairs: DataFrame, stated: DataFrame, most: int = 8) -> DataFrame:
    """person, candidate, score, statements, denials.

    pairs: a, b, sent (see directed_pairs); stated: person, candidate, statements, denials (distinct texts). Candidates
    are a person's busiest contacts and all whom statements name. Traffic alone scores low, a person's own statement
    high, and a denial holds the score down.
    """
    total = pairs.groupBy(F.col("a").alias("person")).agg(F.sum("sent").alias("total_out"))
    busy = top_contacts(pairs, most).select("person", F.col("contact").alias("candidate"))
    chosen = busy.union(stated.select("person", "candidate")).distinct()
    forth = pairs.select(F.col("a").alias("person"), F.col("b").alias("candidate"), F.col("sent").alias("fwd"))
    back = pairs.select(F.col("b").alias("person"), F.col("a").alias("candidate"), F.col("sent").alias("rev"))
    rows = chosen.join(forth, ["person", "candidate"], "left").join(back, ["person", "candidate"], "left").join(total, "person", "left").join(stated, ["person", "candidate"], "left").na.fill(0, ["fwd", "rev", "total_out", "statements", "denials"])
    both, more = F.col("fwd") + F.col("rev"), F.greatest("fwd", "rev", F.lit(1))
    traffic = F.when(both > 0, contact_score(F.col("fwd") / F.greatest("total_out", F.lit(1)), F.least("fwd", "rev") / more, both)).otherwise(0.0)
    said = F.when(F.col("statements") > 0, statement_score(F.col("statements"), both, F.lit(False))).otherwise(traffic)
    score = F.when(F.col("denials") > 0, F.least(said, F.lit(0.30))).otherwise(said)
    return rows.select("person", "candidate", score.alias("score"), "statements", "denials")


def selected_managers(people: DataFrame, candidates: DataFrame, threshold: float = 0.55, margin: float = 0.08) -> DataFrame:
    """person, manager, reason for each row of people (column person): the best candidate, ties to the smaller, if its
    score and its lead are enough, else null and why not."""
    order = Window.partitionBy("person").orderBy(F.desc("score"), "candidate")
    rows = candidates.withColumns({"place": F.row_number().over(order), "next_score": F.lead("score").over(order)}).where("place = 1")
    lead = F.col("score") - F.coalesce("next_score", F.lit(0.0))
    reason = F.when(F.col("denials") > 0, "conflicting_evidence").when(F.col("score") < threshold, "weak_evidence").when(lead + 1e-12 < margin, "close_alternatives").otherwise("threshold_and_margin_met")
    best = rows.select(F.col("person").alias("judged"), "candidate", reason.alias("reason"))
    out = people.select("person").join(best, F.col("person") == F.col("judged"), "left")
    return out.select("person", F.when(F.col("reason") == "threshold_and_margin_met", F.col("candidate")).alias("manager"), F.coalesce("reason", F.lit("empty_candidate_set")).alias("reason"))


def traffic_metrics(messages: DataFrame, message: str, sender: str, recipients: str, units: DataFrame, person: str, unit: str) -> DataFrame:
    """person, breadth, sent, received, cross_unit, cross_unit_eligible over messages among known people.

    sent: messages with a known recipient; received: messages; eligible: interactions where both units are known, of
    which cross_unit are between different units.
    """
    known = units.select(F.col(person).alias("p"), F.col(unit).alias("u"))
    each = messages.select(message, F.col(sender).alias("s"), F.explode(F.array_distinct(recipients)).alias("r")).where("s <> r")
    real = each.join(known.select(F.col("p").alias("s"), F.col("u").alias("su")), "s").join(known.select(F.col("p").alias("r"), F.col("u").alias("ru")), "r")
    eligible = (F.col("su").isNotNull() & F.col("ru").isNotNull()).cast("long")
    crossing = F.when(F.col("su") != F.col("ru"), 1).otherwise(0).cast("long")
    sides = F.array(F.struct(F.col("s").alias("person"), F.col("r").alias("other"), F.lit(True).alias("out")), F.struct(F.col("r").alias("person"), F.col("s").alias("other"), F.lit(False).alias("out")))
    rows = real.select(message, eligible.alias("eligible"), crossing.alias("crossing"), F.explode(sides).alias("x")).select(message, "eligible", "crossing", "x.*")
    return rows.groupBy("person").agg(
        F.countDistinct("other").alias("breadth"), F.countDistinct(F.when(F.col("out"), F.col(message))).alias("sent"), F.countDistinct(F.when(~F.col("out"), F.col(message))).alias("received"),
        F.sum("crossing").alias("cross_unit"), F.sum("eligible").alias("cross_unit_eligible"),
    )


__all__ = ["addresses", "canonical_utc", "directed_pairs", "leading_names", "manager_candidates", "message_time", "selected_managers", "statements", "traffic_metrics"]
