"""Spelling variants grouped by a frequency-vector trie (operator 13).

A word becomes the vector of its counts in groups of letters; the most frequent letters have groups of their own. The
trie has a level for each group, and words of one vector share a leaf. A word that differs from another by one inserted,
deleted or replaced letter has at most one count more in one group (a surplus) and one less in one group (a deficit). So
a search from a word goes down the trie and may leave the word's own counts once upwards and once downwards; what it
meets in the leaves is verified letter by letter.

The trie is spread over Spark by its top: a cell is a node that has at most `chunk` words below it and whose parents
have more. Each word is stored in its cell and visits the cells that its budget reaches. Surplus is spent before
deficit, so a pair of words is met from one side only, and within a leaf from the smaller word. A cell builds its part
of the trie and takes all its visitors down together, level by level. Cells with many visitors are dealt to several
tasks, as are leaves of more than `chunk` words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import byte_texts, parts, written

RUN = "[A-Za-zÀ-ÿ]"
#: Counts above this are alike, which costs a comparison and loses nothing.
MOST = 15
#: Words of a task are written out when so many different ones are held.
HELD = 200_000
#: Words up to this length are compared as rows of an array, longer ones one by one.
SHORT = 48
PLAIN, ADDED, MOVED = 0, 1, 2


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, one_in: int = 31) -> DataFrame:
    """word, n over whole texts: maximal runs of Latin letters, A-Z lower-cased, of at least `shortest` code points.

    Each run of a document whose crc32(<doc_id>:<run>) is divisible by `one_in` loses the code point at that crc32 modulo
    its length first. Null texts have no runs; a row without an id has nothing before the colon.
    """
    runs = re.compile(f"{RUN}{{{shortest},}}")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in parts(batches):
            for own_id, data in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                if not data:
                    continue
                prefix = zlib.crc32(b":" if own_id is None else b"%d:" % own_id)
                for word, n in Counter(runs.findall(data.lower().decode())).items():  # bytes.lower() is of A-Z alone
                    h = zlib.crc32(word.encode(), prefix)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    found = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(of_batches, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, groups: int) -> dict[str, int]:
    """letter -> group: the most frequent letters alone, all others in turn in the last quarter of the groups."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    order = [r["letter"] for r in letters.orderBy(F.desc("n"), "letter").collect() if r["letter"]]  # an alphabet
    alone = groups - max(1, groups // 4)
    return {c: i if i < alone else alone + (i - alone) % (groups - alone) for i, c in enumerate(order)}


def vectors_of(words: list[str], group_of: dict[str, int], groups: int) -> np.ndarray:
    """A row of counts, at most MOST each, for each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    known = np.array([group_of.get(chr(c), 0) for c in range(max(map(ord, group_of), default=0) + 1)])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    own = known[np.minimum(points, len(known) - 1)] if len(points) else np.empty(0, np.int64)
    counts = np.bincount(np.repeat(np.arange(len(words)), lengths) * groups + own, minlength=len(words) * groups)
    return np.minimum(counts, MOST).reshape(-1, groups).astype(np.int64)


def mixed(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The key of a child by its parent's. Two nodes of one key only share visitors."""
    key = (key ^ count.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def prefix_keys(vectors: np.ndarray, depth: int) -> np.ndarray:
    key = np.full(len(vectors), depth, np.uint64)
    for level in range(depth):
        key = mixed(key, vectors[:, level])
    return key


def depths(groups: int) -> list[int]:
    """Where the top of the trie may end."""
    return sorted({*range(3, groups, 3), groups})


def is_in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def own_cells(vectors: np.ndarray, split: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Key and depth of each word's cell: the first node of its path that isn't split."""
    cell, at = np.zeros(len(vectors), np.uint64), np.zeros(len(vectors), np.int32)
    going = np.arange(len(vectors))
    for depth in depths(vectors.shape[1]):
        key = prefix_keys(vectors[going], depth)
        on = is_in(key, split.get(depth, np.empty(0, np.uint64)))
        cell[going[~on]], at[going[~on]] = key[~on], depth
        going = going[on]
    return cell, at


def steps(counts: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Which of the searches (rows) may go on to which count in the next level, and the state they have then."""
    all_ = np.arange(len(counts))
    yield all_, counts, -1
    up = np.flatnonzero((state == PLAIN) & (counts < MOST))
    yield up, counts[up] + 1, ADDED
    down = np.flatnonzero((state == ADDED) & (counts > 0))
    yield down, counts[down] - 1, MOVED


def visited_cells(vectors: np.ndarray, split: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, cell, depth, state: all cells that the words' searches reach. Budgets are spent between the words' own counts
    and the cells' prefixes."""
    groups = vectors.shape[1]
    row, state = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    path = np.zeros((len(vectors), 0), np.int64)
    found, level = [], 0
    for depth in depths(groups):
        while level < depth:
            new = [(at, np.concatenate((path[at], count[:, None]), axis=1), state[at] if then < 0 else np.full(len(at), then)) for at, count, then in steps(vectors[row, level], state)]
            row, path, state = np.concatenate([row[at] for at, _, _ in new]), np.concatenate([p for _, p, _ in new]), np.concatenate([s for _, _, s in new])
            level += 1
        key = prefix_keys(path, depth)
        on = is_in(key, split.get(depth, np.empty(0, np.uint64)))
        found.append((row[~on], key[~on], np.full((~on).sum(), depth, np.int32), state[~on]))
        row, path, state = row[on], path[on], state[on]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Trie:
    """The words of a cell below `depth`. Each level has the sorted keys of its nodes; a leaf is a run of rows."""

    def __init__(self, vectors: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.order = np.lexsort(vectors[:, depth:].T[::-1]) if depth < vectors.shape[1] else np.arange(len(vectors))
        rows = vectors[self.order]
        node = np.zeros(len(rows), np.int64)
        self.levels = []
        for level in range(depth, rows.shape[1]):
            key = node * (MOST + 1) + rows[:, level]
            kinds, node = np.unique(key, return_inverse=True)
            self.levels.append(kinds)
        self.starts = np.searchsorted(node, np.arange(node[-1] + 2)) if len(node) else np.zeros(1, np.int64)

    def leaves(self, vectors: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """visitor, leaf, state of all searches that end in a leaf: a depth-first search of each, all of them level by
        level; a search ends where the trie has no node."""
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for level, kinds in enumerate(self.levels, self.depth):
            new = []
            for at, count, then in steps(vectors[row, level], state):
                key = node[at] * (MOST + 1) + count
                child = np.minimum(np.searchsorted(kinds, key), len(kinds) - 1)
                there = kinds[child] == key
                new.append((row[at[there]], child[there], state[at[there]] if then < 0 else np.full(there.sum(), then)))
            row, node, state = (np.concatenate(x) for x in zip(*new, strict=True))
        return row, node, state


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Words:
    """Words as rows of code points, for comparing many pairs at a time."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        short = [w if len(w) <= SHORT else "" for w in words]
        self.points = np.array(short, f"<U{SHORT + 2}").view(np.uint32).reshape(len(words), -1) if words else np.zeros((0, SHORT + 2), np.uint32)

    def near(self, own: np.ndarray, other: Words, at: np.ndarray, most: int = 50_000) -> np.ndarray:
        """Of the pairs (own[i], at[i]), whether they are one edit apart."""
        out = np.zeros(len(own), bool)
        for start in range(0, len(own), most):
            i, k = own[start : start + most], at[start : start + most]
            a, b, la, lb = self.points[i], other.points[k], self.lengths[i], other.lengths[k]
            swap = la > lb
            a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            same = a == b
            replaced = (low == high) & ((~same).sum(axis=1) == 1)
            before = np.logical_and.accumulate(same[:, :-1], axis=1)
            inserted = (low + 1 == high) & (before | (a[:, :-1] == b[:, 1:])).all(axis=1)
            found = replaced | inserted
            for j in np.flatnonzero(high > SHORT):
                found[j] = one_edit(self.words[i[j]], other.words[k[j]])
            out[start : start + most] = found
        return out


def met(stored: pa.Table, visitors: pa.Table, group_of: dict[str, int], groups: int) -> pa.Table:
    """a, n_a, b, n_b of the near words among those stored in a cell and its visitors."""
    names = ["a", "n_a", "b", "n_b"]
    if not stored.num_rows or not visitors.num_rows:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.int64()) * 2], names=names)
    own, come = Words(stored["word"].to_pylist()), Words(visitors["v_word"].to_pylist())
    trie = Trie(vectors_of(own.words, group_of, groups), stored["depth"][0].as_py())
    visitor, leaf, state = trie.leaves(vectors_of(come.words, group_of, groups), visitors["state"].to_numpy().astype(np.int64))
    sizes = np.diff(trie.starts)[leaf]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(sizes)
    for start in range(0, len(leaf), step := 20_000):
        part = slice(start, start + step)
        count = sizes[part]
        for cut in np.array_split(np.arange(len(count)), max(1, int(count.sum()) // 1_000_000)):
            n = count[cut]
            who = np.repeat(np.arange(start, start + len(count))[cut], n)
            row = trie.starts[leaf[who]] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, v = trie.order[row], visitor[who]
            good = come.near(v, own, at)
            v, at, s = v[good], at[good], state[who[good]]
            once = np.array([k != PLAIN or come.words[x] < own.words[y] for x, y, k in zip(v.tolist(), at.tolist(), s.tolist(), strict=True)], bool)
            pairs.append((v[once], at[once]))
    assert not len(ends) or ends[-1] == sizes.sum()
    v, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
    return pa.table([visitors["v_word"].take(pa.array(v)), visitors["v_n"].take(pa.array(v)), stored["word"].take(pa.array(at)), stored["n"].take(pa.array(at))], names=names)


def split_nodes(words: DataFrame, group_of: dict[str, int], groups: int, chunk: int) -> dict[int, np.ndarray]:
    """depth -> sorted keys of the nodes with more than `chunk` words, leaves left out: a chunk-th of the words at most."""
    ends = depths(groups)[:-1]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = vectors_of(batch.column(0).to_pylist(), group_of, groups)
            for depth in ends:
                key, n = np.unique(prefix_keys(vectors, depth), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), depth, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["depth", "cell", "n"])

    found = words.select("word").mapInArrow(of_batches, "depth int, cell long, n long").groupBy("depth", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > chunk)
    table = found.select("depth", "cell").toArrow()
    depth, cell = table["depth"].to_numpy(), table["cell"].to_numpy().view(np.uint64)
    return {d: np.sort(cell[depth == d]) for d in ends}


def near_words(words: DataFrame, groups: int = 16, chunk: int = 2048, most_split: int = 100_000) -> DataFrame:
    """a, n_a, b, n_b: each pair of different words one edit apart, once. words: word, n, each word once.

    At most `most_split` split nodes a level go to the tasks: cells grow with the words where that asks for it.
    """
    group_of = letter_groups(words, groups)
    chunk = max(chunk, words.count() // most_split)
    split = split_nodes(words, group_of, groups, chunk)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, depth = own_cells(vectors_of(batch.column(0).to_pylist(), group_of, groups), split)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(depth), *batch.columns], names=["cell", "depth", "word", "n"])

    def going(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            row, cell, depth, state = visited_cells(vectors_of(batch.column(0).to_pylist(), group_of, groups), split)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(state.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["v_cell", "state", "v_word", "v_n"])

    plain = words.select("word", "n")
    placed = plain.mapInArrow(stored, "cell long, depth int, word string, n long")
    visitors = plain.mapInArrow(going, "v_cell long, state int, v_word string, v_n long")
    # Cells whose words or visitors are too many for one task are dealt out: shares of words times shares of visitors.
    most = chunk * 32
    words_of = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > chunk)
    visits_of = visitors.groupBy(F.col("v_cell").alias("cell")).agg(F.count(F.lit(1)).alias("visits")).where(F.col("visits") > most)
    hot = written(words_of.join(visits_of, "cell", "full_outer").select("cell", F.coalesce(F.ceil(F.col("words") / chunk), F.lit(1)).alias("rows"), F.coalesce(F.ceil(F.col("visits") / most), F.lit(1)).alias("columns")), "hot-cells")
    if hot.isEmpty():
        placed, visitors = placed.withColumn("share", F.lit(0).cast("long")), visitors.withColumn("v_share", F.lit(0).cast("long"))
    else:
        rows, columns = F.coalesce("rows", F.lit(1)).cast("long"), F.coalesce("columns", F.lit(1)).cast("long")
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        own = F.pmod(F.xxhash64("word"), rows)
        placed = placed.join(hot, "cell", "left").select("cell", "depth", "word", "n", F.explode(F.transform(F.sequence(zero, columns - one), lambda c: own * columns + c)).alias("share"))
        own = F.pmod(F.xxhash64("v_word"), columns)
        visitors = visitors.join(hot, F.col("v_cell") == F.col("cell"), "left").select("v_cell", "state", "v_word", "v_n", F.explode(F.transform(F.sequence(zero, rows - one), lambda r: r * columns + own)).alias("v_share"))

    def meet(table: pa.Table, come: pa.Table) -> pa.Table:
        return met(table, come, group_of, groups)

    return placed.groupBy("cell", "share").cogroup(visitors.groupBy("v_cell", "v_share")).applyInArrow(meet, "a string, n_a long, b string, n_b long")


def followed(forms: DataFrame) -> DataFrame:
    """word, root of all words that have a form: forms are followed to the last. Each form is at least twice as frequent as
    its word, so there is no cycle; the reach doubles each round."""
    reach = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = reach.select(F.col("word").alias("mid"), F.col("root").alias("up"))
        moved = written(reach.join(step, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        reach = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reach


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, times: int = 10, one_in: int = 31, **search: int) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each different word of at least `least` occurrences (see
    word_counts).

    form: the near word (one edit apart) of largest n, ties to the smallest in code-point order, if it occurs at least
    `times` as often as the word, else null; root: the last of the forms of forms, the word itself if it has none; n_near:
    the number of near words; form_n: the form's n. Repeated rows count as often as they occur. An empty table, or one
    without such words, gives no rows. Other columns are not read.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes a word, but much work
    words = written(word_counts(docs, doc_id, text, shortest, one_in).where(F.col("n") >= least).repartition(tasks, "word"), "words")
    pairs = written(near_words(words, **search), "near-words")
    sides = F.array(F.struct(F.col("a").alias("of"), (-F.col("n_b")).alias("less"), F.col("b").alias("near")), F.struct(F.col("b").alias("of"), (-F.col("n_a")).alias("less"), F.col("a").alias("near")))
    best = pairs.select(F.explode(sides).alias("x")).select("x.*").groupBy("of").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    known = words.join(best, F.col("word") == F.col("of"), "left")
    enough = -F.col("best.less") >= times * F.col("n")
    known = written(known.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = followed(known.where("form is not null")).select(F.col("word").alias("varied"), "root")
    return known.join(roots, F.col("word") == F.col("varied"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
