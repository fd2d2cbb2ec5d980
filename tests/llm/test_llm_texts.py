"""Operators over texts against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vintry.llm import byte_bpe, licenses, packing, quality, simhash, token_counts, toxicity
from vintry.llm.boosting import boost, isotonic
from vintry.llm import components as component_module
from vintry.llm.components import components
from vintry.llm.segments import piece_ranges
from vintry.llm.words import word_encoder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN

AWKWARD = [
    None, "", " ", "\n", "a", "Don't  stop\n\nnow ", "ÉCOLE é́ ß İ", "tab\tand\x1cother\x85blanks\xa0here",
    "x <|endoftext|> y", "<|ENDOFTEXT|>", "日本語 текст", "a" * 3000, "ab " * 9000, "9 99 999 's 'S",
    "thinger" * 700 + " tail",
]
EXTRA = "doc_id bigint, text string, score string, IDS string, fingerprint string, start string, n_tokens string"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "s", "i", "f", "x", "n") for i, t in enumerate(AWKWARD)]
    rows += [rows[5], rows[5], (None, "no id", "s", "i", "f", "x", "n")]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("doc_id < 0")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def plain_ids(library, text):
    return library.encode(text, add_special_tokens=False).ids if text else []


@pytest.fixture(scope="module")
def mixed():
    draw = random.Random(5)
    parts = ["the", " ", " ", "\n", "é", "don't", "\x1c", "'s", "<|", "<|endoftext|>", "中", "1", "##", "\xa0", "aaaa", "Θ"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 400))) for _ in range(150)]


def test_word_encoder_is_the_library(library, mixed):
    texts = [t or "" for t in AWKWARD] + mixed
    found = word_encoder(WORDS).encode_batch(texts)
    assert [f.tolist() for f in found] == [plain_ids(library, t) for t in texts]


def test_byte_bpe_is_the_library_and_round_trips(mixed):
    coder = byte_bpe.byte_bpe(RANKS, PATTERN)
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = [t or "" for t in AWKWARD] + mixed
    found = coder.encode_batch(texts)
    assert [f.tolist() for f in found] == [other.encode_ordinary(t) for t in texts]
    flat, _ = coder.decode_flat(np.concatenate(found))
    assert flat.tobytes() == "".join(texts).encode()


def test_byte_bpe_lower_rank_appears_late():
    # Joining "b" and "c" makes a pair with a lower rank than their own.
    ranks = {bytes([b]): 10 + b for b in range(256)} | {b"bc": 5, b"abc": 1, b"bcb": 0, b"aa": 3}
    coder = byte_bpe.ByteBpe(ranks, r"\S+|\s+")
    other = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    for text in ("abcbc", "bcbcbc", "aaabcaa", "abcabcbcb", "aaaaa"):
        assert coder.merge([text.encode()])[0] == other.encode_ordinary(text), text
    both = coder.merge([b"abcbc", b"", b"aaaaa"])
    assert both == [coder.merge([b"abcbc"])[0], [], coder.merge([b"aaaaa"])[0]]


def test_byte_bpe_columns(awkward, nothing):
    encoded = byte_bpe.encode(awkward, RANKS, PATTERN)
    assert encoded.columns.count("ids") == 1 and "IDS" not in encoded.columns
    rows = byte_bpe.decode(encoded, RANKS, PATTERN).collect()
    assert len(rows) == awkward.count()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    assert byte_bpe.decode(byte_bpe.encode(nothing, RANKS, PATTERN), RANKS, PATTERN).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        bad = encoded.limit(1).select(F.array(F.lit(10**6)).alias("ids"))
        byte_bpe.decode(bad, RANKS, PATTERN).collect()


def test_pieces_cover_a_text():
    draw = random.Random(1)
    for size in (1, 7, 50):
        data = "".join(draw.choice("ab  \n") for _ in range(400)).encode()
        ranges = piece_ranges(data, size)
        assert b"".join(data[a:b] for a, b in ranges) == data


@pytest.mark.parametrize(("chunk", "overlap"), [(60, 4), (300, 20), (1000, 100)])
def test_chunked_counts_are_whole_counts(library, mixed, chunk, overlap):
    encoder = word_encoder(WORDS)
    for text in [*AWKWARD[4:], *mixed]:
        assert token_counts.count_tokens(encoder, text, chunk, overlap) == len(plain_ids(library, text))


def test_token_count_columns(awkward, nothing, library):
    found = token_counts.token_counts(awkward, WORDS, limit=2048, chunk=500, overlap=16)
    for r in found.collect():
        n = len(plain_ids(library, r["text"]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 2048)
    assert token_counts.token_counts(nothing, WORDS).count() == 0


def test_packing_holds_every_id_once(awkward, nothing, library):
    pieces = packing.pack(awkward, WORDS).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    by_document: dict = {}
    for p in pieces:
        assert p["length"] == 1 << p["bucket"] == len(p["ids"]) <= 4096 and p["offset"] == 0
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        by_document.setdefault(p["doc_id"], []).append(p)
    for i, text in enumerate(AWKWARD):
        own = sorted(by_document[i], key=lambda p: p["start"])
        whole = [*plain_ids(library, text), 2]
        copies = 3 if i == 5 else 1
        assert sorted(x for p in own for x in p["ids"]) == sorted(whole * copies)
        if copies == 1:
            assert [x for p in own for x in p["ids"]] == whole
            assert {p["doc_tokens"] for p in own} == {len(whole)}
    assert "no id" not in by_document and len(by_document[None]) >= 1
    assert packing.pack(nothing, WORDS).count() == 0
    assert "ids" not in [c.lower() for c in packing.pack(awkward, WORDS, with_ids=False).columns]


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ")
             .replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_brute_force(mixed):
    for text in [*AWKWARD, *mixed]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(values, linked):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize(("n", "parts"), [(0, None), (1, None), (3000, None), (1500, 2), (3000, 4)])
def test_near_pairs_by_brute_force(spark, n, parts):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, max(n // 12, 1), dtype=np.uint64) * np.uint64(2)
    values = set()
    while len(values) < n:
        x = int(base[draw.integers(len(base))])
        for b in draw.integers(0, 64, draw.integers(0, 7)):
            x ^= 1 << int(b)
        values.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in values]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = {(r["a"], r["b"]) for r in simhash.near_pairs(df, parts=parts).collect()}
    one = np.array(sorted(signed), np.int64).view(np.uint64)
    expected = set()
    for i, x in enumerate(one):
        near = np.flatnonzero(np.bitwise_count(one[:i] ^ x) <= 4)
        expected |= {tuple(sorted((int(one[j].view(np.int64)), int(x.view(np.int64))))) for j in near}
    assert found == expected


def test_thresholds_spend_every_unit():
    draw = np.random.default_rng(1)
    costs = [np.sort(draw.random((6, 50)) * 100, axis=0) for _ in range(3)]
    got = simhash.allocate(costs)
    assert ((got + 1).sum(axis=0) == 5).all() and (got >= -1).all()
    spent = sum(np.take_along_axis(c, got[i : i + 1] + 1, 0)[0] for i, c in enumerate(costs))
    for q in range(50):
        best = min(costs[0][a, q] + costs[1][b, q] + costs[2][5 - a - b, q] for a in range(6) for b in range(6 - a))
        assert spent[q] == pytest.approx(best)


def test_near_duplicate_documents(spark, awkward, nothing):
    base = " ".join(f"word{i}" for i in range(300))
    more = [(100, base), (101, base + " tail"), (99, base.upper()), (102, base), (103, "   "), (104, None)]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = docs.collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    lowest: dict = {}
    for r, c in zip(rows, roots):
        if r["doc_id"] is not None:
            lowest[c] = min(lowest.get(c, r["doc_id"]), r["doc_id"])
    expected = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], f"{p:016x}", lowest.get(c)) for r, p, c in zip(rows, prints, roots)
    )
    found = simhash.near_duplicates(docs.withColumn("component_id", F.lit("old"))).collect()
    assert sorted((-1 if r[0] is None else r[0], r["fingerprint"], r["component_id"]) for r in found) == expected
    kept = simhash.keep_one(docs.withColumn("source", F.lit("s"))).collect()
    assert len(kept) == len(set(roots)) and kept[0].asDict().keys() == {"doc_id", "text", "source"}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == {x for x in lowest.values() if x is not None}
    assert simhash.near_duplicates(nothing).count() == simhash.keep_one(nothing).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    draw = random.Random(8)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    links += [(2000, 2001), (2001, 2000), (3000, 3000), (None, 4)]
    draw.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {2000: 2000, 2001: 2000}
    assert components(df.where("a < 0"), "a", "b").count() == 0


@pytest.mark.parametrize("held", [1 << 17, 8])
def test_spanning_keeps_what_is_connected(spark, monkeypatch, held):
    monkeypatch.setattr(component_module, "HELD", held)
    draw = random.Random(12)
    links = [(a, b) for g in range(3) for a in range(60 * g, 60 * g + 40) for b in range(60 * g, a)]
    links += [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(150)]
    links += [(i, i + 1) for i in range(5000, 5100)] + [(-(2**63), 2**63 - 1), (9, 9)]
    draw.shuffle(links)
    df = spark.createDataFrame(links + [(None, 5), (6, None)], "a bigint, b bigint").coalesce(1)
    forest = [tuple(r) for r in component_module.spanning(df, "a", "b").collect()]

    def groups(pairs):
        root = {x: x for p in links for x in p}
        def top(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {x: top(x) for x in root}

    assert groups(forest) == groups(links)
    if held > 8:  # one block: one link per node that is not its component's smallest
        assert len(forest) == sum(x != r for x, r in groups(links).items())
    assert component_module.spanning(df.where("a < -9 and b < 0"), "a", "b").count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean, junk and toxic documents of invented words, and their labels."""
    draw = random.Random(4)
    words = ["".join(draw.choice(["an", "the", "ro", "li", "tem"]) for _ in range(draw.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [draw.choice(words) for _ in range(draw.randint(5, 80))]
        quality, toxic = int(i % 3 != 0), int(i % 5 == 0)
        if not quality:
            text = [w + "###" for w in text]
        if toxic:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(["idiot", "zugrel", "you"]))
            text.append("scum")
        rows.append((i, " ".join(text)))
        labels.append((i, quality, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label", "limit"), [
    (quality.classified, "quality", 0.5), (toxicity.scored, "toxic", 0.7),
])
def test_classifiers(spark, labelled, awkward, nothing, operator, label, limit):
    docs, labels = labelled
    # Repeated and contradicting labels, labels of no document, and nulls.
    extra = spark.createDataFrame(
        [(0, 0, 1), (1, 1, 0), (1, 0, 1), (10**6, 1, 1), (None, 1, 0), (3, None, None)], labels.schema
    )
    every = docs.unionByName(awkward.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 5000))
    found = operator(every.withColumn("score", F.lit("old")), labels.unionByName(extra), label).collect()
    assert len(found) == every.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
        out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == out
    tested = [r for r in found if r["held_out"] and r["doc_id"] < 5000]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in tested]) > 0.95
    # Labels of held-out documents change nothing.
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r["doc_id"]: r["score"] for r in operator(docs, turned, label).collect()}
    first = {r["doc_id"]: r["score"] for r in operator(docs, labels, label).collect()}
    assert first == again
    # No label at all, and no document.
    blank = operator(docs, labels.where("doc_id < 0"), label).select("score").distinct().collect()
    assert [r["score"] for r in blank] == [0.5]
    assert operator(nothing, labels, label).count() == 0


@pytest.mark.parametrize("n", [1, 2, 6, 12])
def test_few_toxic_labels_still_teach(spark, n):
    draw = random.Random(n)
    words = ["".join(draw.choice(["an", "the", "ro", "li", "tem"]) for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(400):
        text = [draw.choice(words) for _ in range(60)]
        if i % 2:
            for w in ("idiot", "scum", "you", "moron"):
                text.insert(draw.randrange(60), w)
        rows.append((i, " ".join(text), i % 2))
    learnable = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    taught = [i for i in learnable if i % 2][:n] + [i for i in learnable if not i % 2][:60]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, truth int").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in taught], "doc_id bigint, toxic int")
    found = toxicity.scored(docs, labels).where("held_out").collect()
    right = np.mean([r["predicted"] == r["truth"] for r in found])
    assert right > 0.9 if n > 1 else len({r["score"] for r in found}) > 1


def test_boosting_and_calibration():
    draw = np.random.default_rng(2)
    x = draw.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost(x[:1500], y[:1500], np.ones(1500))
    z = model.margins(x)
    assert ((z[1500:] > 0) == y[1500:]).mean() > 0.97
    curve = isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert curve(np.array([0, 2.0, 2.5, 3.0, 9])).tolist() == [0, 0.5, 0.5, 0.5, 1]


def test_learnt_terms_by_brute_force(spark):
    draw = random.Random(11)
    words = ["".join(draw.choice(["an", "the", "ro", "li", "tem", "Ü"]) for _ in range(draw.randint(1, 4))) for _ in range(60)]
    rows = []
    for i in range(400):
        y = int(i % 4 == 0)
        text = [draw.choice(words) for _ in range(draw.randint(0, 30))]
        if y and i % 3:
            text += draw.choices(["grumpig", "grumpox", "blarg", "snerf"], k=2)
        rows.append((i % toxicity.FOLDS if i < 390 else 0, y, " ".join(text) if i % 50 else None))
    sample = spark.createDataFrame(rows, "fold int, y int, text string")

    def terms(text):
        found = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        return found | {w[:k] + "*" for w in found for k in toxicity.STEMS if len(w) > k}

    def expected(left_out, most):
        used = [(y, terms(t)) for k, y, t in rows if k != left_out]
        n1 = sum(y for y, _ in used)
        n0, scores = len(used) - n1, []
        for term in set().union(*(ts for _, ts in used)):
            in1 = sum(y for y, ts in used if term in ts)
            in0 = sum(1 - y for y, ts in used if term in ts)
            share, other = in1 / n1, (in0 + 0.5) / n0
            if in1 >= toxicity.LEARNT_ROWS and share >= toxicity.LEARNT_LEAST and share / other >= toxicity.LEARNT_RATIO:
                scores.append((-share * math.log(share / other), term))
        return {term for _, term in sorted(scores)[:most]}

    def held(lexicon):
        return set(lexicon.words) | {s + "*" for _, stems in lexicon.stems for s in stems}

    every = toxicity.learnt_terms(sample)
    assert len(every) == toxicity.FOLDS + 1 and {"blarg", "snerf", "grump*"} <= held(every[-1])
    assert [held(x) for x in every] == [expected(k, toxicity.LEARNT_TERMS) for k in range(toxicity.FOLDS + 1)]
    assert len(held(toxicity.learnt_terms(sample, 3)[-1])) == 3
    # One class only, and a class that one fold alone holds.
    assert toxicity.learnt_terms(sample.where("y = 0")) == [toxicity.Lexicon()] * (toxicity.FOLDS + 1)
    alone = toxicity.learnt_terms(sample.where("y = 0 or fold = 2"))
    assert held(alone[2]) == set() and "blarg" in held(alone[-1])


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_toxicity_on_the_given_tables(spark, sf_dir):
    """Of held-out toxic documents with an insult all are found, and no clean one."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").where("toxic is not null")
    rows = rows.select("toxic", "predicted", "text").collect()
    insulted = [set(toxicity._WORD.findall((r["text"] or "").lower())) & toxicity.INSULTS for r in rows]
    assert sum(map(bool, insulted)) >= 10
    assert np.mean([r["predicted"] for r, i in zip(rows, insulted) if i and r["toxic"]]) >= 0.9
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) <= 0.02


def test_toxicity_features():
    x = dict(zip(toxicity.FEATURES, toxicity.describe("You are 1d10t and i d i o t, STUPID!", toxicity.Lexicon())))
    assert x["insults"] > 0 and x["hidden"] > 0 and x["disguised"] > 0 and x["shouted"] > 0 and x["calls"] > 0
    assert toxicity.describe(None, toxicity.Lexicon()) == toxicity.describe("", toxicity.Lexicon())


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""


@pytest.mark.parametrize(("text", "expected"), [
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("Some text.\nThis work is licensed under the GNU General Public License, version 3.\nmore", ["GPL-3"]),
    ("a\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Released under the MIT License.", ["MIT"]),
    (MIT, ["MIT"]),
    ("x\n" + MIT + "\nReleased under the MIT License.\nReleased under CC BY 4.0.", ["MIT", "CC-BY-4.0"]),
    ("// SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0+"]),
    ("Released under CC0 1.0 Universal.", ["CC0-1.0"]),
    ("The key is 9fcc0a12, under no licence.", []),
    ("All rights reserved.", []),
    ("He lost his driving licence.", []),
    (None, []), ("", []),
])
def test_licences(spark, text, expected):
    got = licenses.scan(spark.createDataFrame([(text, "x")], "text string, unmatched string")).first()
    assert got["licences"] == expected
    for span in got["licence_spans"]:
        assert 0 <= span["start"] < span["end"] <= len(text)
    if text == "All rights reserved.":
        assert got["unmatched"] == 1


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
ADVERT = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
GNU = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation; either version {number} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""

NOTICES = [
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY.""", "MIT", 4),
    ("""Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.""", "ISC", 2),
    (BSD.format(more=""), "BSD-2-Clause", 5),
    (BSD.replace("1. ", "* ").replace("2. ", "* ").format(more=ENDORSE.replace("3. ", "* ")), "BSD-3-Clause", 6),
    (BSD.format(more=ADVERT + ENDORSE), "BSD-4-Clause", 7),
    ("""Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""", "Apache-2.0", 5),
    ("""The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.""", "Apache-2.0", 2),
    (GNU.format(kind="", number=2), "GPL-2-or-later", 2),
    (GNU.format(kind="Lesser ", number=2.1), "LGPL-2.1", 2),
    (GNU.format(kind="Affero ", number=3), "AGPL-3", 2),
    ("""This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""", "MPL-2.0", 2),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v.
2.0. If a copy of the MPL was not distributed with this file, You can obtain one
at https://mozilla.org/MPL/2.0/.""", "MPL-2.0", 2),
    ("""All rights reserved. This program and the accompanying materials are made
available under the terms of the Eclipse Public License v1.0 which accompanies
this distribution.""", "EPL-1.0", 2),
    ("""This work is licensed under a Creative Commons
Attribution-NonCommercial-ShareAlike 4.0 International License.""", "CC-BY-NC-SA-4.0", 1),
    ("This work is licensed under the Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0", 1),
    ("Released under the\nMIT License.", "MIT", 1),
    ("Distributed under the terms of the 3-Clause\nBSD license.", "BSD-3", 1),
    ("It is released under the ISC license.", "ISC", 1),
    ("This work is marked with CC0 1.0 Universal.", "CC0-1.0", 1),
    ("""This is free and unencumbered software released into the public
domain.""", "Unlicense", 1),
    ("This table was placed in the\npublic domain.", "Public-domain", 1),
    ("SPDX-License-Identifier: BSL-1.0", "BSL-1.0", 1),
    ("Not mine. Available under the GNU General Public License, version 3.", "GPL-3", 1),
]


@pytest.mark.parametrize("form", [
    lambda t: t,
    lambda t: "x\n" + "\n".join(x for x in t.split("\n") if x) + "\ny",
    lambda t: "Copyright 2020 A. Person " + " ".join(t.split()) + " More text.",
    lambda t: "/*\n" + "\n".join((" * " + x).rstrip() for x in t.split("\n")) + "\n */\nint main;",
    lambda t: "\n".join(("// " + x).rstrip() for x in t.split("\n")) + "\nint main;",
    lambda t: "\n".join("# " + x for x in t.split("\n") if x) + "\nimport os",
], ids=["plain", "no blank lines", "flattened", "starred", "slashed", "hashed"])
@pytest.mark.parametrize(("notice", "licence", "n"), NOTICES, ids=[f"{i}-{x[1]}" for i, x in enumerate(NOTICES)])
def test_real_notices(form, notice, licence, n):
    text = form(notice)
    found = licenses.identified(text)
    matched, _ = licenses.licences(found)
    assert [m[0] for m in matched] == [licence], (found, text)
    assert len(found) == n, (found, text)
    for (a, b, _), (c, _, _) in zip(found, [*found[1:], (len(text), 0, 0)]):
        assert 0 <= a < b <= c


def test_notices_in_one_run_are_kept_apart():
    text = "Released under the MIT License\nThis part is licensed under the GNU General Public License, version 3\nAll rights reserved"
    assert [name for _, _, name in licenses.identified(text)] == ["MIT-ref", "GPL-ref#:3", "Rights-reserved"]


def test_long_block_without_full_stops_is_read_in_linear_time():
    import time

    text = "\n".join(f"item {i} available in version {i}, any place" for i in range(20_000)) + "\nmusic commons"
    start = time.process_time()
    assert licenses.identified(text) == []
    assert time.process_time() - start < 20


def test_every_licence_sentence_has_a_mark():
    names = {name for name, _ in licenses.SENTENCES}
    assert {p.removesuffix("?") for _, parts in licenses.RULES for p in parts} <= names
    for name, pattern in licenses.SENTENCES:
        assert any(mark in pattern for mark in licenses.MARKS) or "cc )(by" in pattern, name


def test_licence_rows(awkward, nothing):
    assert licenses.scan(awkward).count() == awkward.count()
    assert licenses.scan(nothing).count() == 0


def test_digests_of_the_query(spark, awkward, tmp_path):
    from vintry.llm.queries import op6_byte_bpe

    awkward.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    coder = byte_bpe.byte_bpe(RANKS, PATTERN)
    for r in op6_byte_bpe(spark, str(tmp_path)).collect():
        text = (AWKWARD[r["doc_id"]] if r["doc_id"] is not None else "no id") or ""
        ids = coder.encode_batch([text])[0].tolist()
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
