"""Corpus operators against brute-force versions, exact round trips and held-out accuracy, with the odd cases: nulls,
empty, blank and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, langid, media, packing, pieces, search, shared, simhash, substrings, toxicity, urlfilter

TEXTS = "doc_id long, text string, lang string, fp long, block int, score double"


def prose(rng: random.Random, n: int, words: int = 60) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_documents() -> list[tuple]:
    """Copies, near copies, shared passages, a very long text, blanks, nulls, repeated rows and clashing columns."""
    rng = random.Random(3)
    base = [prose(rng, 120, 5000) for _ in range(12)]
    shared = prose(rng, 60, 5000)
    texts = [*base, *base[:3], base[0].replace(base[0].split()[50], "changed"), f"{prose(rng, 30, 5000)} {shared} {prose(rng, 9, 5000)}"]
    texts += [f"{shared}  {prose(rng, 40, 5000)}\t\n{shared}", None, "", " \n\t", "one two three", "a\u00a0b c", prose(rng, 6000, 900), "x " * 500]
    rows = [(i, t, "en", 1, 2, 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, base[1], None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), TEXTS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], TEXTS)


# Substring dedup


def brute_removal(rows: list[tuple], size: int) -> list[tuple]:
    seen, out = set(), []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [600, 1 << 20])
def test_substring_dedup_equals_brute_force(docs, block_bytes):
    found = substrings.remove_repeats(docs, window=20, block_bytes=block_bytes, keep=("score", "block"))
    rows = found.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str) == brute_removal(odd_documents(), 20)
    assert found.columns[-2:] == ["score", "block"] and {r.block for r in rows} == {2, None}


@pytest.mark.parametrize("block_bytes", [700, 1 << 20])
def test_substring_dedup_of_one_heavy_id(spark, block_bytes):
    """A missing id and a repeated one hold most rows; of one id the order is that of a hash of the text."""
    rng = random.Random(9)
    shared = [prose(rng, 25, 5000) for _ in range(6)]
    rows = [(rng.choice([None, None, 7, 7, i]), f"{prose(rng, 30, 5000)} {rng.choice(shared)} {prose(rng, rng.randrange(40), 5000)}") for i in range(150)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=20, block_bytes=block_bytes, bucket_bytes=2000)
    hashed = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).view(np.int64)))
    numbered = [(k, text) for k, (_, text) in enumerate(hashed)]
    expected = sorted((str(hashed[k][0]), n, gone, mark) for k, n, gone, mark in brute_removal(numbered, 20))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == expected


def test_long_texts_are_read_in_pieces():
    text = b" a\tbb  ccc\n" * 50 + b"x" * 300
    for size in (1, 7, 100, 10_000):
        assert [w for part in substrings.pieces(text, size) for w in part] == text.split()
    keep = np.arange(151) % 2 == 0
    assert substrings.kept_words(text, keep) == b" ".join(text.split()[::2]) and substrings.kept_words(None, None) == b""


def test_substring_dedup_keeps_columns_named_like_results(spark, docs):
    clashing = docs.withColumns({"n_words": F.lit(7), "kept_text": F.lit("k"), "KEPT_SHA256": F.lit("s"), "kept_n_words": F.lit(8), "keep_0": F.lit(9)})
    names = ("n_words", "kept_text", "KEPT_SHA256", "kept_n_words", "keep_0")
    got = substrings.remove_repeats(clashing, window=20, keep=names)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "kept_n_words", "kept_kept_text", "kept_KEPT_SHA256", "kept_kept_n_words", "keep_0"]
    plain = substrings.remove_repeats(docs, window=20).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got.collect()))) == sorted(map(str, map(tuple, plain)))
    assert {tuple(r)[5:] for r in got.collect()} == {(7, "k", "s", 8, 9)}


def test_substring_dedup_of_nothing(nothing):
    assert substrings.remove_repeats(nothing).count() == 0


# SentencePiece


class BruteUnigram:
    """Viterbi over all substrings."""

    def __init__(self, encoder, scores):
        self.encoder, self.scores, self.longest = encoder, scores, max(map(len, scores))

    def encode(self, text: str):
        whole = "▁" + text.replace(" ", "▁")
        best = [(0.0, [])] + [None] * len(whole)
        for end in range(1, len(whole) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                piece = whole[start:end]
                if piece in self.scores:
                    options.append((best[start][0] + self.scores[piece][1], end - start, [*best[start][1], self.scores[piece][0]]))
            if whole[end - 1] not in self.scores:
                options.append((best[end - 1][0] + self.encoder.unknown_score, 1, [*best[end - 1][1], *self.encoder.fallback(whole[end - 1])]))
            total, _, ids = max(options, key=lambda o: o[:2])
            best[end] = (total, ids)
        return best[-1][1]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"))


def test_sentencepiece_equals_brute_force(encoder):
    brute = BruteUnigram(encoder, {p: (i, s) for p, (i, _, s) in encoder.pieces.items()})
    rng = random.Random(5)
    alphabet = "abcdeeilnorstuñéß .,▁\n日😀"
    for text in ["Hello  world", " lead", "trail ", "\x00\x01", "e" * 70, *["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(60)]]:
        ids, score, _ = encoder.encode(text)
        assert ids.tolist() == brute.encode(text)
        assert np.isfinite(score)
        assert encoder.decode(ids) == text.replace("▁", " ")


def test_sentencepiece_round_trip_on_spark(docs, nothing):
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decode_ids(pieces.encode_texts(docs, model, ["doc_id"]), model, ["doc_id", "n_unspelled"])
    assert sorted((r.doc_id or -1, r.decoded) for r in found.collect()) == sorted((r[0] or -1, r[1] or "") for r in odd_documents())
    assert pieces.encode_texts(nothing, model, ["doc_id"]).count() == 0


# Exact top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]  # coarse, so that scores tie
    vectors += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [2.0]), (405, []), (None, [1.0] * 8), (7, vectors[7][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    found = search.top_k(frame, F.col("vec_id") % 100 == 0, k=10, block_rows=16, shard_blocks=4, batch_queries=2)
    rows = [(i, np.floor(np.array(v + [0.0] * (8 - len(v))) * 1024).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, x in rows:
        if q % 100 == 0:
            scores = sorted(((-int(x @ y), i) for i, y in rows if i != q))[:10]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_top_k_of_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert search.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in search.top_k(two, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[(1 << 30) + 1, 3]]), np.array([[(1 << 30) - 1, 5]])
    assert search.products(a, b)[0, 0] == (1 << 60) - 1 + 15


# URL filters

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:stop]


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "://x", "HTTP://WWW.Example.COM/en/1?q=/es/", "http://a.net/es/1", "http://a.net/ES/1", "http://net/fr/", "http://xnet/fr/", "https://example.com?en/", "http://É.com/", "a://b://c/d", "http://b.org/en/" + "y" * 20000, "http://h\n/a\nb?c"]
    urls += [f"http://site{i}.net/{lang}/{i}" for i in range(200) for lang in ("es", "fr")] + [f"http://blog{i}.com/{i}" for i in range(200)]
    urls += [f"http://other{i}.org/fr/{i}" for i in range(20)]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labelled = urlfilter.labelled_by_rules(pages, RULES)
    got = {r.page_id: r for r in urlfilter.judge(pages, RULES, labelled, ["page_id"]).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = brute_parts(url)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (RULES[rule] if rule else "block" if got[i].score >= 0.5 else "allow")
    hits = [(got[i].score >= 0.5) == (RULES[got[i].rule] == "block") for i in got if got[i].rule]
    assert np.mean(hits) > 0.95
    both = urlfilter.judge(pages.union(pages).where("page_id < 3"), RULES, labelled, ["page_id", "host"])
    assert both.columns == ["page_id", "kept_host", "host", "path", "rule", "score", "verdict"] and both.count() == 6
    empty = urlfilter.judge(pages.limit(0), RULES, labelled.limit(0), ["page_id"])
    assert empty.count() == 0


# Media


def test_media_round_trip(docs, nothing):
    stored = media.to_media(docs, ["doc_id", "score"])
    found = media.describe_media(stored, ["doc_id", "n_bytes"]).collect()
    expected = []
    for doc_id, text, *_ in odd_documents():
        data = (text or "").encode()
        padded = data + b" " * (-len(data) % 192 or (0 if data else 192))
        expected.append((doc_id, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), "ipcm", len(padded) / 8000))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.codec, r.duration) for r in found), key=str) == sorted(expected, key=str)
    assert media.to_media(nothing, ["doc_id"]).count() == 0 and media.describe_media(media.to_media(nothing, ["doc_id"]), ["doc_id"]).count() == 0
    clashing = media.describe_media(media.to_media(docs.withColumn("media", F.lit(1)), ["doc_id", "media"]).withColumn("codec", F.lit("x")), ["kept_media", "codec"])
    assert clashing.columns[:3] == ["kept_media", "kept_codec", "codec"] and clashing.count() == len(odd_documents())


def test_keyframe_ranges_point_into_the_file():
    body = bytes(random.Random(1).randrange(256) for _ in range(192 * 200))
    data = media.build_media(body)
    track = media.read_tracks(data)[0]
    assert media.payload(data, track) == body
    assert [data[a : a + n] for a, n in track.keyframe_ranges()] == [body[k : k + 192] for k in range(0, len(body), 192 * 16)]
    with pytest.raises(ValueError):
        media.read_tracks(data[:-5])
    with pytest.raises(ValueError, match="fragmented"):
        media.read_tracks(data + media._box(b"moof", b""))
    with pytest.raises(ValueError, match="no stsz or stz2"):
        media.read_tracks(data.replace(b"stsz", b"free"))
    assert media.read_tracks(media._box(b"free", b"")) == []


@pytest.mark.parametrize(("width", "sizes"), [(4, [3, 15, 1]), (8, [200, 7]), (16, [60_000, 1, 2])])
def test_compact_sizes(width, sizes):
    packed = bytes([0x3F, 0x10]) if width == 4 else b"".join(n.to_bytes(width // 8, "big") for n in sizes)
    table = bytes(7) + bytes([width]) + len(sizes).to_bytes(4, "big") + packed
    assert media._compact_sizes(memoryview(table), 0) == sizes


# Packing


@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_equals_the_plain_tokenizer(spark, docs, nothing, plain_tokenizer):
    path = public_tokenizers.path("byte_bpe_50k.json")
    special = spark.createDataFrame([(50, "a <|endoftext|> b", None, None, None, None), (51, "<|endoftext|>" * 700, None, None, None, None)], docs.schema)
    rows = packing.pack(docs.union(special), path, public_tokenizers.PATTERN, slice_rows=7).collect()
    texts = [(r[0], r[1]) for r in odd_documents()] + [(50, "a <|endoftext|> b"), (51, "<|endoftext|>" * 700)]
    wanted: dict = {}
    for doc_id, text in texts:
        wanted.setdefault(doc_id, []).append(np.array([*plain_tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in wanted[r.doc_id])
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total <= 1024 and total & (total - 1) == 0
    for doc_id, ids in wanted.items():  # each id of each document in one piece, repeated rows being documents of their own
        ends = sorted((r.start, r.start + r.length) for r in rows if r.doc_id == doc_id)
        assert sum(b - a for a, b in ends) == sum(map(len, ids))
        assert len(ids) > 1 or [a for a, _ in ends] == [0, *[b for _, b in ends][:-1]]
    assert packing.pack(nothing, path, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab é,'s1.!\n\t\r\u00a0\x1c\x85\u2003日я\u0345\u180e", "  ", " ab.", "can't", " <|endoftext|>", "\n\n", "ab\ncd ", "12", "x" * 70]), max_size=25).map("".join))
def test_words_give_the_ids_of_the_whole_text(text):
    words = packing.word_ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert np.frombuffer(words.of(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "é", "Re", *packing.MARKS, "\n", "\n", " ", " ", "'", "1", "\t", "\r"]), max_size=25).map("".join))
def test_marked_words_give_the_ids_of_the_whole_text(text):
    words = packing.word_ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert np.frombuffer(words.of(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_in_use_outlast_marked_words_that_come_once():
    words = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 100)
    plain, solved = words.tokenizer, []

    def tokenize(spelled):
        solved.append(spelled)
        return plain.model.tokenize(spelled)

    words.model = SimpleNamespace(tokenize=tokenize)
    words.tokenizer = SimpleNamespace(model=words.model, encode=plain.encode)
    used = "a " + " ".join(x + y for x in "bcdfg" for y in ("an", "el", "in", "os"))
    once = [f"a other{k}" for k in range(400)]
    for text in [used, *once, used]:
        assert np.frombuffer(words.of(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert solved.count("\u0120ban") == 1


def test_knapsack_and_plan():
    lengths, worth = np.array([3, 5, 7]), np.array([0.3, 0.56, 0.7])
    best, _ = packing.best_fills(lengths, worth, 16)
    assert best[16] == pytest.approx(max(0.3 * a + 0.56 * b + 0.7 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16))
    rng = random.Random(2)
    histogram = {n: rng.randrange(1, 50) for n in range(1, 65)}
    plan = packing.make_plan(histogram, 64)
    used = {n: 0 for n in histogram}
    for length, start, end, *_ in plan.places:
        assert start == used[length]
        used[length] = end
    assert all(used[n] == start for n, start, _ in plan.stream) and plan.gap <= 0.002
    assert sum(n * (e - s) for n, s, e, *_ in plan.places) + plan.stream_tokens == sum(n * c for n, c in histogram.items())


# Chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<<TEXT>>"]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "a", " ", "\n", "/INST]", "é"]), max_size=8).map("".join)), max_size=6))
def test_template_is_reversible(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 4, "assistant", "end", 0.5),
        ("t", 5, 4, "assistant", "end", 0.5), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0), (None, 1, None, None, None, None), ("o", 9, 8, "user", "orphan", 1.0), ("n", None, None, "user", "z", 1.0),
        *[("long", i, i - 1 or None, "user", str(i), 0.0) for i in range(1, 40)],
    ]
    messages = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double").withColumn("up", F.lit(1))
    found = {(r.tree_id, r.branch): r.formatted for r in chat.format_trees(messages, branches=2).collect()}
    turns = {k: chat.parse_turns(v) for k, v in found.items()}
    assert turns["t", 1] == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")]
    assert turns["t", 2] == [("user", "q"), ("assistant", "bad")]
    assert turns[None, 1] == [("", "")] and turns["o", 1] == [("user", "orphan")]
    assert [t for _, t in turns["long", 1]] == [str(i) for i in range(1, 40)]
    assert len(found) == 5
    assert chat.format_trees(messages.limit(0)).count() == 0 and chat.read_back(chat.format_trees(messages.limit(0)), ["tree_id"]).count() == 0
    long = spark.createDataFrame([("x", 1, None, "assistant", "[INST]\\" * 100_000, 1.0)], messages.drop("up").schema)
    row = chat.read_back(chat.format_trees(long).withColumn("n_turns", F.lit(7)), ["tree_id", "n_turns"]).first()
    assert (row.kept_n_turns, row.n_turns, row.loss_chars) == (7, 1, 700_000)


# Language ID and toxicity


def labelled(n: int) -> list[tuple]:
    rng = random.Random(8)
    stems = {"aa": ["kora", "meli", "tuno"], "bb": ["shrek", "gnolt", "prask"], "cc": ["ñuié", "ßolä", "çeê"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(stems))
        words = ["".join(rng.choices(stems[lang], k=rng.randrange(1, 3))) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zwurgle", "vlaxen"]))
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def test_language_id(spark):
    rows = labelled(400)
    frame = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(None, "kora", "aa"), (900, None, "bb"), (901, "meli", None)], "doc_id long, text string, lang string")
    filters = langid.train(frame.where("doc_id is null or doc_id % 4 <> 0"))
    assert filters.languages == ("aa", "bb", "cc")
    asked = frame.union(spark.createDataFrame([(910, "", None), (911, "12 +-", None), (912, "kora " * 20000, None)], frame.schema))
    got = {r.doc_id: r for r in langid.identify(asked, filters, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows if i % 4 == 0)
    assert [got[i].lang_pred for i in (900, 910, 911, 912)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.in_known_language(asked, filters).where("doc_id in (900, 910, 911)").count() == 0
    twice = langid.identify(asked.union(asked).withColumn("lang_pred", F.lit(1)), filters, ["doc_id", "LANG_PRED"])
    assert twice.columns == ["doc_id", "kept_LANG_PRED", "lang_pred", "score"] and twice.count() == 2 * asked.count()
    none = langid.train(frame.limit(0))
    assert {r.lang_pred for r in langid.identify(frame, none, ["doc_id"]).collect()} == {"und"}


def test_bloom_counts_are_corrected():
    rng = np.random.default_rng(4)
    masks = np.where(rng.random(1 << 10) < 0.3, 1, 0).astype(np.uint8)
    filters = langid.Filters(("aa",), masks, np.array([(masks.mean()) ** 2]))
    strange = rng.integers(0, 1 << 32, 20000, dtype=np.uint32)
    assert filters.counts(strange)[0] < 0.03 * len(strange)


def test_toxicity(spark):
    rows = labelled(800)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(5000, None), (5001, ""), (5002, "zwurgle " + "kora " * 30000), (None, "kora")], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows if i % 4] + [(1, None), (2, 7), (None, 1)], "doc_id long, label int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert np.mean([got[i].predicted == x for i, _, _, x in rows if i % 4 == 0]) > 0.97
    assert got[5002].predicted == 1 and got[5000].score == got[5001].score < 0.5
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(1 for r in got.values() if r.score < 0.5)
    blank = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, blank, ["doc_id"]).collect()} == {0.5}
    assert toxicity.without_toxic(docs, blank).count() == docs.count()
    assert toxicity.score(docs.union(docs), model, ["doc_id", "score"]).columns == ["doc_id", "kept_score", "score", "predicted"]
    assert toxicity.score(docs.union(docs), model, ["doc_id"]).count() == 2 * docs.count() and toxicity.without_toxic(docs.limit(0), model).count() == 0


def test_tasks_give_back_what_earlier_ones_have_freed(monkeypatch):
    """What other operators have freed doesn't stay with the worker: a small block behind it holds no memory."""
    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE")
    blocks = [bytes(2000) for _ in range(100_000)]
    last = bytes(2000)
    blocks.clear()
    before = rss()
    shared.forget()
    assert before - rss() > 100_000_000 and len(last) == 2000
    forgot = []
    for module in (langid, toxicity):
        monkeypatch.setattr(module, "forget", lambda: forgot.append(1))
        assert list(module._document_counts(iter([])))[1:] == []
    assert len(forgot) == 2


# SimHash


def brute_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(docs, nothing):
    got = simhash.near_components(docs, shingle=4, radius=4).collect()
    rows = [(r[0], brute_fingerprint(r[1])) for r in odd_documents()]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if bin(rows[i][1] ^ rows[k][1]).count("1") <= 4:
                a, b = parent[i], parent[k]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    least = {p: min((rows[i][0] for i in range(len(rows)) if parent[i] == p and rows[i][0] is not None), default=None) for p in parent}
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((d, f"{fp:016x}", least[p]) for (d, fp), p in zip(rows, parent, strict=True)), key=str)
    assert simhash.near_components(nothing).count() == 0


def test_groups_grow_with_the_rows():
    assert [simhash.enough_groups(n, 4) for n in (0, 250_000, 10_000_000, 10**9)] == [6, 6, 7, 10]


@pytest.mark.parametrize(("chunk", "groups"), [(5, None), (10_000, None), (10_000, 8)])
def test_near_pairs_lose_no_link(spark, chunk, groups):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(7))}) for c in centres for _ in range(25)} | {0, (1 << 64) - 1, 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed + signed[:5] + [None]], "fp long")
    roots = {r.node: r.root for r in simhash.connected(simhash.near_pairs(frame, radius=4, chunk=chunk, groups=groups)).collect()}
    values, parent = sorted(prints), {}
    for x in values:
        parent[x] = x
        for y in values:
            if y in parent and bin(x ^ y).count("1") <= 4:
                a, b = parent[x], parent[y]
                parent = {k: min(a, b) if v in (a, b) else v for k, v in parent.items()}
    groups, expected = {}, {}
    for x, s in zip(prints, signed, strict=True):
        groups.setdefault(roots.get(s, s), set()).add(x)
        expected.setdefault(parent[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_wide_fingerprints_find_copies_of_similarity_over_point_eight(spark):
    rng = random.Random(6)
    rows, pairs = [], []
    for i in range(0, 600, 2):
        words = [f"v{rng.randrange(20000)}" for _ in range(rng.randrange(80, 300))]
        changed = list(words)
        for k in rng.sample(range(len(words)), max(1, len(words) // 60)):
            changed[k] = f"z{rng.randrange(20000)}"
        rows += [(i, " ".join(words)), (i + 1, " ".join(changed))]
        a, b = (set(simhash.word_shingles(" ".join(w).encode().split(), 5)) for w in (words, changed))
        pairs.append((i, len(a & b) / len(a | b)))
    got = {r.doc_id: r.component_id for r in simhash.wide_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [i for i, similarity in pairs if similarity >= 0.8]
    assert len(close) > 150 and np.mean([got[i + 1] == i for i in close]) > 0.97
    assert all(c in (i, i - i % 2) for i, c in got.items())


def jaccard(a: str, b: str) -> float:
    x, y = (set(simhash.word_shingles(t.encode().lower().split(), 5)) for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_near_copies_are_exactly_those_of_similarity_point_eight(spark, chunk):
    rng = random.Random(16)
    rows = []
    for i in range(0, 800, 2):
        words = [f"v{rng.randrange(20000)}" for _ in range(rng.randrange(60, 300))]
        changed = list(words)
        at = rng.randrange(len(words))
        changed[at : at + round(rng.uniform(0.08, 0.22) * len(words))] = [f"z{rng.randrange(20000)}"] * 7
        rows += [(i, " ".join(words)), (i + 1, " ".join(changed))]
    base = [f"h{k}" for k in range(200)]
    for i in range(1000, 1030):  # one group whose links differ, all with the same frequent shingles
        words = list(base)
        for k in range(rng.randrange(12)):
            words[rng.randrange(200)] = f"y{rng.randrange(20000)}"
        rows.append((i, " ".join(words)))
    texts = dict(rows)
    pairs = [(i, i + 1) for i in range(0, 800, 2)] + [(i, k) for i in range(1000, 1030) for k in range(i + 1, 1030)]
    similarity = {(i, k): jaccard(texts[i], texts[k]) for i, k in pairs}
    least = {i: i for i in texts}
    for (i, k), s in similarity.items():
        if s >= 0.8:
            low, high = sorted((least[i], least[k]))
            least = {n: low if m == high else m for n, m in least.items()}
    assert sum(0.8 <= s < 0.82 for s in similarity.values()) > 20 and sum(0.65 <= s < 0.8 for s in similarity.values()) > 100
    got = simhash.wide_components(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()
    assert {r.doc_id: r.component_id for r in got} == least


def test_near_copies_search_by_fingerprints_first(spark, monkeypatch):
    """The first links of near copies are the pairs of operator 9's search whose sets are similar; the rest is found as well."""
    rng = random.Random(18)
    rows = []
    for i in range(0, 200, 2):
        words = [f"v{rng.randrange(20000)}" for _ in range(rng.randrange(60, 300))]
        changed = list(words)
        for k in rng.sample(range(len(words)), max(1, len(words) // rng.choice([20, 60, 200]))):
            changed[k] = f"z{rng.randrange(20000)}"
        rows += [(i, " ".join(words)), (i + 1, " ".join(changed))]
    seen = {}
    search, roots = simhash.near_pairs, simhash.similar_roots

    def watched_search(fps, radius, **more):
        seen["fps"] = {r.fp for r in fps.select("fp").collect()}
        return search(fps, radius, **more)

    def watched_roots(cells, nodes, links, *more):
        ids = {r.node: r.doc_id for r in nodes.collect()}
        seen["links"] = {tuple(sorted((ids[r.a], ids[r.b]))) for r in links.collect()}
        return roots(cells, nodes, links, *more)

    monkeypatch.setattr(simhash, "near_pairs", watched_search)
    monkeypatch.setattr(simhash, "similar_roots", watched_roots)
    got = {r.doc_id: r.component_id for r in simhash.wide_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [brute_fingerprint(t, 2) for _, t in rows]
    near = {i for i in range(0, 200, 2) if bin(prints[i] ^ prints[i + 1]).count("1") <= 4}
    similar = {i for i in range(0, 200, 2) if jaccard(rows[i][1], rows[i + 1][1]) >= 0.8}
    assert seen["fps"] == {p - (1 << 64) if p >> 63 else p for p in prints}
    assert seen["links"] == {(i, i + 1) for i in near & similar}
    assert len(near & similar) > 20 and similar - near and near - similar
    assert got == {i: i - i % 2 if i - i % 2 in similar else i for i in range(200)}


def test_representatives_keep_all_columns(docs):
    left = simhash.representatives(docs, shingle=5)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 0 in ids and 12 not in ids and ids.count(2) == 1 and ids.count(None) == 1


def test_representatives_keep_clashing_columns(spark, nothing):
    rows = [(1, "a b c d e f g", "x", 1, 5), (1, "a b c d e f g", "x", 2, 6), (2, "A b c d e f g", "y", 3, 7), (3, "", "z", 4, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string, row_of_id int, place int")
    left = simhash.representatives(docs, shingle=5)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]
    assert all((r.gone_id, r.row_of_id, r.place) in [(x[2], x[3], x[4]) for x in rows] for r in left.collect())
    assert simhash.representatives(nothing).count() == 0


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(5)
    for size in (0, 1, 40, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for changed in (0, 1, size // 20, size):
            b = np.unique(np.concatenate((a[changed:], rng.integers(0, 1 << 63, changed + size // 4, dtype=np.uint64))))
            distance = simhash.sketch_distance(simhash.parity_sketch(a), simhash.parity_sketch(b))
            assert distance <= len(np.setxor1d(a, b))
            assert size < 300 or changed < size or distance > 0.6 * min(len(a), len(b))


def test_representatives_remove_rows_not_ids(spark):
    rng = random.Random(17)
    first, second, third = (prose(rng, 80, 5000) for _ in range(3))
    rows = [(1, first), (2, first), (2, second), (2, second), (3, third), (None, first), (None, first)]
    left = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, first), (2, second), (3, third), (None, first), (None, first)], key=str)
