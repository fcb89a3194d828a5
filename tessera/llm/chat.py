"""Chat formatting (operator 7): reply trees to training conversations.

Messages point to their parents. Self-joins on the parent pointer, whose reach doubles each round, enumerate the
ancestors of every leaf, so a path of n messages takes log2(n) rounds. The branches of a tree are ranked by the sum of
their messages' scores and each chosen path becomes one conversation.

The template marks turns with control strings. Inside texts a backslash is doubled and every control string gets a
backslash after its first character, so none is left and the original text can be restored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import kept, kept_schema, written

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
START = "<s>"
#: Role -> what stands before and after its text.
TURNS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}
TRAINED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """One string and the loss mask: the (start, end) of each assistant text in it, in code points."""
    parts, spans, at = [START], [], len(START)
    for role, text in turns:
        before, after = TURNS.get(role) or (f"<<ROLE>>{escape(role)}<<TEXT>>", "<</ROLE>>")
        body = escape(text)
        if role == TRAINED:
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that format_turns has put into the string."""
    at, turns = len(START), []
    while at < len(formatted):
        role = next((r for r in ("user", "system") if formatted.startswith(TURNS[r][0], at)), "")
        if not role and formatted.startswith("<<ROLE>>", at):
            middle = formatted.index("<<TEXT>>", at)
            role, before, after = unescape(formatted[at + 8 : middle]), formatted[at : middle + 8], "<</ROLE>>"
        else:
            role = role or TRAINED
            before, after = TURNS[role]
        end = formatted.index(after, at + len(before))
        turns.append((role, unescape(formatted[at + len(before) : end])))
        at = end + len(after)
    return turns


def branch_paths(messages: DataFrame) -> DataFrame:
    """tree_id, leaf_id, message_id, up (steps from the leaf) for every root-to-leaf path.

    messages: tree_id, message_id, parent_id, one row for each message. A message whose parent is null or missing is
    a root. Messages that reach no root (cycles) are on no path.
    """
    nodes = messages.select("tree_id", "message_id", "parent_id")
    known = nodes.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"))
    jumps = nodes.join(known, nodes["tree_id"].eqNullSafe(known["t"]) & (nodes["parent_id"] == known["m"])).select("tree_id", "message_id", F.col("parent_id").alias("above"))
    jumps = written(jumps, "jumps")
    first = jumps
    parents = first.select(F.col("tree_id").alias("t"), F.col("above").alias("m")).distinct()
    paths = nodes.join(parents, nodes["tree_id"].eqNullSafe(parents["t"]) & (nodes["message_id"] == parents["m"]), "left_anti").select("tree_id", F.col("message_id").alias("leaf_id"), "message_id", F.lit(0).cast("long").alias("up"))
    deepest = messages.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    reach = 1
    while reach < deepest and not jumps.isEmpty():
        step = jumps.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "above")
        above = paths.join(step, paths["tree_id"].eqNullSafe(step["t"]) & (paths["message_id"] == step["m"])).select("tree_id", "leaf_id", F.col("above").alias("message_id"), (F.col("up") + reach).alias("up"))
        paths = written(paths.union(above), "paths")
        next_step = jumps.select(F.col("tree_id").alias("t2"), F.col("message_id").alias("m2"), F.col("above").alias("above2"))
        jumps = written(jumps.join(next_step, jumps["tree_id"].eqNullSafe(next_step["t2"]) & (jumps["above"] == next_step["m2"])).select("tree_id", "message_id", F.col("above2").alias("above")), "jumps")
        reach *= 2
    inner = first.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"))
    roots = nodes.join(inner, nodes["tree_id"].eqNullSafe(inner["t"]) & (nodes["message_id"] == inner["m"]), "left_anti").select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"))
    whole = paths.join(roots, paths["tree_id"].eqNullSafe(roots["t"]) & (paths["message_id"] == roots["m"]), "left_semi").select(F.col("tree_id").alias("t"), F.col("leaf_id").alias("l"))
    return paths.join(whole, paths["tree_id"].eqNullSafe(whole["t"]) & (paths["leaf_id"] == whole["l"]), "left_semi")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree_id, leaf_id, branch (rank from 1), score, formatted, loss_spans (structs of start, end in code points).

    messages: tree_id, message_id, parent_id, role, text, score. The best `branches` paths of each tree by summed
    score are formatted, ties by the smaller leaf_id. Null text, role and score count as empty, empty and 0; rows that
    repeat a (tree_id, message_id) count once, the smallest; rows without message_id are left out. Other columns are
    not read. An empty table gives no rows.
    """
    content = F.struct("parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    once = written(messages.where("message_id is not null").groupBy("tree_id", "message_id").agg(F.min(content).alias("c")).select("tree_id", "message_id", "c.*"), "messages")
    paths = branch_paths(once)
    own = once.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("score").alias("s"))
    scored = paths.join(own, paths["tree_id"].eqNullSafe(own["t"]) & (paths["message_id"] == own["m"])).groupBy("tree_id", "leaf_id").agg(F.sum("s").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id"))
    chosen = scored.withColumn("branch", rank).where(F.col("branch") <= branches).select(F.col("tree_id").alias("t0"), F.col("leaf_id").alias("l0"), "branch", "score")
    places = paths.join(chosen, paths["tree_id"].eqNullSafe(chosen["t0"]) & (paths["leaf_id"] == chosen["l0"])).select("tree_id", "leaf_id", "message_id", "up", "branch", "score")
    said = once.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "role", "text")  # texts come last, for chosen paths alone
    lines = places.join(said, places["tree_id"].eqNullSafe(said["t"]) & (places["message_id"] == said["m"]))
    turns = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    gathered = lines.groupBy("tree_id", "leaf_id", "branch", "score").agg(turns.alias("turns"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    ids = {f.name: f.dataType.simpleString() for f in gathered.schema}

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [format_turns([(t["role"], t["text"]) for t in row]) for row in batch.column(4).to_pylist()]
            masks = [[{"start": a, "end": b} for a, b in mask] for _, mask in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x for x, _ in found], pa.string()), pa.array(masks, spans)], names=["tree_id", "leaf_id", "branch", "score", "formatted", "loss_spans"])

    return gathered.mapInArrow(of_batches, f"tree_id {ids['tree_id']}, leaf_id {ids['leaf_id']}, branch int, score double, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted
    strings and their loss masks alone. One row for each row, repeated ones too; an empty table gives no rows. A kept
    column with the name of a result is called kept_<name>."""
    results = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    names = [*formatted.select(*kept(keep, results)).columns, *results]

    def digests(text: str, mask: list[dict]) -> tuple:
        turns = parse_turns(text)
        said = "".join(f"{role}\n{words}\n" for role, words in turns).encode()
        loss = "".join(unescape(text[x["start"] : x["end"]]) for x in mask)
        return len(turns), hashlib.sha256(said).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            rows = [digests(t, m) for t, m in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=names)

    return formatted.select(*keep, F.col("formatted").alias("read_text"), F.col("loss_spans").alias("read_mask")).mapInArrow(of_batches, kept_schema(formatted, keep, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
