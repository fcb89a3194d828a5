"""The registered queries that SQL can't express, as they are registered, against plain Python over whole tables, exact
round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash

from tessera.llm import chat, queries

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(name: str, folder: str = FOLDER) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2_gives_texts_back(spark):
    got = {r.doc_id: r for r in queries.op2_sentencepiece(spark, FOLDER).collect()}
    docs = rows_of("documents")
    assert len(got) == len(docs)
    assert all(got[d["doc_id"]].decoded_sha256 == sha((d["text"] or "").replace("▁", " ")) for d in docs)


def test_op4_rules_and_held_out_verdicts(spark):
    rules = queries.URL_RULES

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
        return "".join(c.lower() if c.isascii() else c for c in host), path[:stop]

    got = {r.page_id: r for r in queries.op4_url_filter(spark, LARGER).collect()}
    pages = rows_of("pages", LARGER)
    assert len(got) == len(pages)
    for page in pages:
        host, path = parts(page["url"])
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, row = max(fits, key=len, default=None), got[page["page_id"]]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (rules[rule] if rule else "block" if row.score >= 0.5 else "allow")


def test_op4_is_compiled(spark):
    """No stage of the query falls back to the interpreter because its code is too large."""
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert queries.op4_url_filter(spark, FOLDER).count() == len(rows_of("pages"))
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_op4_model_equals_a_plain_one(spark):
    """The model half: the same descent in plain Python, on the same features, gives the same scores."""
    from pyspark.sql import functions as F

    from tessera.llm import urlfilter

    labelled = urlfilter.labelled_by_rules(spark.read.parquet(f"{LARGER}/pages.parquet"), queries.URL_RULES)
    host, path = urlfilter.host_and_path(F.col("url"))
    rows = [(r.label, r.found) for r in labelled.select("label", urlfilter.features(host, path, 256).alias("found")).collect()]
    assert len(rows) > 20 and all(len(set(f)) == len(f) for _, f in rows)
    model = urlfilter.train(labelled, max_rows=10**6, buckets=256, rounds=6)
    w, seen, b, seen_b, n = np.zeros(256), np.full(256, 1e-8), 0.0, 1e-8, len(rows)
    for _ in range(6):
        slope, slope_b = np.zeros(256), 0.0
        for y, found in rows:
            error = 1 / (1 + np.exp(-(w[found].sum() / np.sqrt(len(found)) + b))) - y
            slope[found] += error / np.sqrt(len(found))
            slope_b += error
        on = np.isin(np.arange(256), np.unique(np.concatenate([f for _, f in rows])))
        slope = np.where(on, slope / n + 1e-4 * w, 0)
        seen += slope**2
        w -= slope / np.sqrt(seen)
        seen_b += (slope_b / n) ** 2
        b -= 0.5 * slope_b / n / np.sqrt(seen_b)
    assert np.allclose(model.weights, w, atol=1e-9) and abs(model.intercept - b) < 1e-9


def test_op4_model_on_urls_it_has_not_seen(spark):
    from pyspark.sql import functions as F

    from tessera.llm import urlfilter

    labelled = urlfilter.labelled_by_rules(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), queries.URL_RULES).distinct()
    away = F.pmod(F.xxhash64("url", F.lit(77)), F.lit(4)) == 0
    model = urlfilter.train(labelled.where(~away), max_rows=2000)
    host, path = urlfilter.host_and_path(F.col("url"))
    judged = labelled.where(away).select("label", model.score(urlfilter.features(host, path, len(model.weights))).alias("score")).collect()
    assert len(judged) > 50 and np.mean([(r.score >= 0.5) == (r.label == 1) for r in judged]) > 0.9


def test_op5_round_trip(spark):
    got = {r.doc_id: r for r in queries.op5_media(spark, FOLDER).collect()}
    for doc in rows_of("documents"):
        data, row = (doc["text"] or "").encode(), got[doc["doc_id"]]
        stored = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]))
        assert row.media_bytes > row.payload_bytes and "keyframe" in row.feature


def plain_feature(data: bytes) -> str:
    """The feature of a stored file, by the places of its tables' names."""
    moov = data.rindex(b"moov") if data.index(b"mdat") < data.rindex(b"moov") else data.index(b"moov")

    def numbers(kind: bytes, skip: int, width: int = 1) -> list:
        at = data.index(kind, moov) + 8 + skip
        (n,) = struct.unpack_from(">I", data, at)
        flat = struct.unpack_from(f">{n * width}I", data, at + 4)
        return [flat[i : i + width] for i in range(0, len(flat), width)] if width > 1 else list(flat)

    at = data.index(b"stsz", moov) + 8
    size, count = struct.unpack_from(">2I", data, at)
    assert size == 192
    chunks, runs, keys = numbers(b"stco", 0), numbers(b"stsc", 0, 3), numbers(b"stss", 0)
    offsets = []
    for i, chunk in enumerate(chunks):
        per = next(n for first, n, _ in reversed(runs) if i + 1 >= first)
        offsets += [chunk + size * k for k in range(per)]
    assert len(offsets) == count and keys == list(range(1, count + 1, 16))
    ranges = [f"{offsets[k - 1]}+{size}" for k in keys]
    digest = hashlib.md5(",".join(ranges).encode()).hexdigest()
    codec = data[data.index(b"stsd", moov) + 16 :][:4].decode()
    return f"codec={codec};duration={count * 192 / 8000:.3f};keyframes={len(keys)};keyframe_bytes={size * len(keys)};first={ranges[0]};last={ranges[-1]};ranges_md5={digest}"


def test_op5_feature_equals_a_plain_reading(spark):
    from tessera.llm import media

    got = {r.doc_id: r.feature for r in queries.op5_media(spark, FOLDER).collect()}
    stored = media.to_media(spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id"]).collect()
    assert len(got) == len({r.doc_id for r in stored}) and all(got[r.doc_id] == plain_feature(bytes(r.media)) for r in stored)


def test_op6_ids_and_sequences(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d["doc_id"]: np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4") for d in rows_of("documents")}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, FOLDER).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.offset + r.length))
    for doc_id, own in ids.items():
        cuts = sorted(pieces[doc_id])
        assert [a for a, _ in cuts] == [0, *[b for _, b in cuts][:-1]] and cuts[-1][1] == len(own)
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [0, *[b for _, b in own][:-1]] and own[-1][1] <= 1024


def plainly_escaped(text: str) -> str:
    out = text.replace("\\", "\\\\")
    for control in sorted(chat.CONTROLS, key=len, reverse=True):  # none is part of another's rest
        out = out.replace(control, control[0] + "\\" + control[1:])
    return out


def test_op7_digests(spark):
    control = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for r in rows_of("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", control), (1, "assistant", control)]
    got = {r.conv_id: r for r in queries.op7_chat(spark, FOLDER).collect()}
    assert set(got) == set(turns)
    for conv_id, said in turns.items():
        said.sort()
        loss = "".join(t for _, r, t in said if r == "assistant")
        size = len(chat.START) + sum(len("".join(chat.TURNS.get(r) or (f"<<ROLE>>{plainly_escaped(r)}<<TEXT>>", "<</ROLE>>"))) + len(plainly_escaped(t)) for _, r, t in said)
        row = got[conv_id]
        assert (row.n_turns, row.turns_sha256) == (len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said)))
        assert (row.loss_chars, row.loss_sha256, row.formatted_chars) == (len(loss), sha(loss), size)


def test_op8_held_out_languages(spark):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, LARGER).collect()}
    docs = rows_of("documents", LARGER)
    assert len(got) == len(docs)
    known = {d["lang"] for d in docs if d["lang"] and not held_out(d["doc_id"])}
    hits = []
    for d in docs:
        row = got[d["doc_id"]]
        letters = any(c.isalpha() for c in d["text"] or "")
        assert row.held_out == held_out(d["doc_id"]) and 0 <= row.score <= 1
        assert row.lang_pred in known if letters else row.lang_pred == "und"
        if row.held_out and d["lang"] and letters:
            hits.append(row.lang_pred == d["lang"])
    assert len(hits) > 100 and np.mean(hits) > 0.95


def test_op8_equals_plain_sets(spark):
    """The bitmask filters decide as plain sets of each language's n-grams do, and their counts are close to exact."""
    from tessera.llm import langid
    from tessera.llm.grams import text_hashes

    docs = rows_of("documents")
    learned: dict = defaultdict(list)
    for d in docs:
        if d["lang"] and not held_out(d["doc_id"]):
            learned[d["lang"]].append(set(text_hashes(d["text"] or "", langid.ORDERS).tolist()))
    share: dict = defaultdict(dict)
    for lang, sets in learned.items():
        for grams in sets:
            for g in grams:
                share[g][lang] = share[g].get(lang, 0) + 1 / len(sets)
    own: dict = {lang: set() for lang in learned}
    for g, found in share.items():
        top = max(found.values())
        for lang, x in found.items():
            if top >= 0.01 and x >= 0.01 and x >= 0.2 * top:
                own[lang].add(g)
    got = {r.doc_id: r for r in queries.op8_language_id(spark, FOLDER).collect()}
    sure = 0
    for d in docs:
        if any(c.isalpha() for c in d["text"] or ""):
            grams = text_hashes(d["text"], langid.ORDERS).tolist()
            exact = {lang: sum(g in s for g in grams) / len(grams) for lang, s in own.items()}
            first, second = sorted(exact.values())[-1], sorted(exact.values())[-2]
            assert abs(got[d["doc_id"]].score - first) < 0.05
            if first - second > 0.05:
                sure += 1
                assert got[d["doc_id"]].lang_pred == max(exact, key=exact.get)
    assert sure > 150


def test_op10_equals_a_plain_model(spark):
    """Chi-square features, log-count ratios and the regression in plain numpy over a dense matrix give the scores."""
    from tessera.llm import toxicity

    docs = {d["doc_id"]: d["text"] or "" for d in rows_of("documents", LARGER)}
    labels = [(x["doc_id"], x["toxic"]) for x in rows_of("labels", LARGER) if x["toxic"] in (0, 1) and not held_out(x["doc_id"]) and x["doc_id"] in docs]
    grams = [set(toxicity.buckets(docs[i]).tolist()) for i, _ in labels]
    y = np.array([t for _, t in labels], float)
    counts: dict = defaultdict(lambda: [0, 0])
    for found, t in zip(grams, y, strict=True):
        for g in found:
            counts[g][int(t)] += 1
    n0, n1, n = (y == 0).sum(), y.sum(), len(y)
    chi = {g: n * (b * n0 - a * n1) ** 2 / (n0 * n1 * (a + b) * (n - a - b) + 1e-9) for g, (a, b) in counts.items() if a + b >= 3}
    chosen = sorted(sorted(chi, key=lambda g: (-chi[g], g))[:2048])
    ratio = np.log((np.array([counts[g][1] for g in chosen]) + 1) / (n1 + 2) / ((np.array([counts[g][0] for g in chosen]) + 1) / (n0 + 2)))
    x = np.array([[g in found for g in chosen] for found in grams]) * ratio
    theta, m, v, b, mb, vb = np.zeros(len(chosen)), 0.0, 0.0, np.log((n1 + 1) / (n + 2) / (1 - (n1 + 1) / (n + 2))), 0.0, 0.0
    for t in range(1, 301):
        error = 1 / (1 + np.exp(-np.clip(x @ theta + b, -30, 30))) - y
        slope, slope_b = x.T @ error / n + 1e-3 * theta, error.sum() / n
        m, v, mb, vb = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2, 0.9 * mb + 0.1 * slope_b, 0.99 * vb + 0.01 * slope_b**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b = b - 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weight = dict(zip(chosen, theta * ratio, strict=True))
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, LARGER).collect()}
    assert len(labels) > 300
    for i, text in docs.items():
        want = 1 / (1 + np.exp(-(b + sum(weight.get(g, 0.0) for g in set(toxicity.buckets(text).tolist())))))
        assert abs(got[i].score - want) < 1e-3


def test_op9_components(spark):
    docs = rows_of("documents")
    prints = {}
    for d in docs:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"] or "").encode().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    least = {i: i for i in ids}
    for i in ids:
        for k in ids:
            if k < i and (prints[i] ^ prints[k]).bit_count() <= 4 and least[i] != least[k]:
                low, high = sorted((least[i], least[k]))
                least = {n: low if m == high else m for n, m in least.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_dedup(spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in ids}


def test_near_copies_of_real_documents_equal_brute_force(spark):
    """Every pair of documents of similarity 0.8 or more on five-word shingles is found, and no other one."""
    from tessera.llm import simhash

    sets, holders = {}, defaultdict(list)
    for d in rows_of("documents", LARGER):
        sets[d["doc_id"]] = set(simhash.word_shingles((d["text"] or "").encode().lower().split(), 5)) if d["text"] else set()
        for gram in sets[d["doc_id"]]:
            holders[gram].append(d["doc_id"])
    shared: dict = defaultdict(int)
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                shared[a, b] += 1
    pairs = {(a, b) for (a, b), n in shared.items() if n * 180 >= (len(sets[a]) + len(sets[b])) * 80}
    empty = sorted(i for i, grams in sets.items() if not grams)
    least = {i: i for i in sets}
    for a, b in [*pairs, *zip(empty, empty[1:], strict=False)]:
        if least[a] != least[b]:
            low, high = sorted((least[a], least[b]))
            least = {n: low if m == high else m for n, m in least.items()}
    got = {r.doc_id: r.component_id for r in simhash.wide_components(spark.read.parquet(f"{LARGER}/documents.parquet")).collect()}
    near = [(a, b) for a, b in pairs if sets[a] != sets[b]]
    assert got == least and len(near) > 5


def test_op10_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"  # the smaller ones hold out few toxic documents
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, folder).collect()}
    docs = rows_of("documents", folder)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    pairs = [(got[x["doc_id"]].predicted, x["toxic"]) for x in rows_of("labels", folder) if held_out(x["doc_id"]) and x["doc_id"] in got]
    assert len(pairs) > 50 and np.mean([p == t for p, t in pairs]) > 0.95
    toxic = [p for p, t in pairs if t]
    assert np.mean(toxic) > 0.8


@pytest.mark.parametrize("name", ["op2_sentencepiece", "op4_url_filter", "op5_media", "op6_packing", "op7_chat", "op8_language_id", "op9_simhash_dedup", "op10_toxicity"])
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "conversations", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op7_chat" else 0)
