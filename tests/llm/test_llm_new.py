"""Conversation repair, streaming BPE and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vintry.llm import merkle, repair, stream_bpe
from vintry.llm.positions import positions

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


# Conversation repair

TAKES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        held = found[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return found


def cheapest(rows):
    """All edits by one automaton over rows, the least (cost, audit) per place kept."""
    seen, states, counts = set(), {0: (0, "", ())}, defaultdict(int)
    for _, role, text in rows:
        blank = not text.strip(" \t\n\v\f\r")
        copy = not blank and (role, text) in seen
        short = not blank and not copy and text.rstrip(" \t\n\v\f\r")[-1] not in ".!?"
        seen.add((role, text))
        for name, holds in (("blank", blank), ("duplicate", copy), ("truncated", short)):
            counts[name] += holds
        new = {}

        def offer(place, *value):
            new[place] = min(new.get(place, value), value, key=lambda v: v[:2])

        for place, (cost, audit, body) in states.items():
            for _ in range(3):
                offer(place, cost + 2, audit + "D", body)
                if not blank and not copy:
                    if (place, role[:1]) in TAKES:
                        offer(TAKES[place, role[:1]], cost + 5 * short, audit + "K", body + ((role, text),))
                    for letter, name in NAMES.items():
                        if (place, letter) in TAKES:
                            offer(TAKES[place, letter], cost + 1 + 5 * short, audit + "R", body + ((name, text),))
                letter = "a" if place == 2 else "u"
                place, cost, audit, body = TAKES[place, letter], cost + 5, audit + "I", body + ((NAMES[letter], ""),)
        states = new
    ends = []
    for place, (cost, audit, body) in states.items():
        for _ in range(3):
            if place in (0, 3):
                ends.append((cost, audit, body))
            letter = "a" if place == 2 else "u"
            place, cost, audit, body = TAKES[place, letter], cost + 5, audit + "I", body + ((NAMES[letter], ""),)
    return min(ends, key=lambda v: v[:2]), counts


def summary(rows):
    result = []
    for conv, held in damage(rows).items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        (cost, audit, body), counts = cheapest(held)
        turns = [t for t, _, _ in held if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        lines = "\n".join(f"{r}:{t}" for r, t in body)
        result.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            counts["blank"], counts["duplicate"], counts["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(lines.encode()).hexdigest(),
        ))
    return sorted(result, key=str)


def random_turns(draw, conv, n):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    texts = ["One.", "two!", "three", " ", "", None, "four? ", "five.\n", "six", "\x1c"]
    return [
        (conv, draw.choice([None, i, i, i + draw.randint(0, 3)]), draw.choice(roles[: draw.choice((3, 5, 8))]),
         draw.choice(texts[:1] + [f"t{draw.randint(0, 4 * n)}."] * 6 + texts))
        for i in range(n)
    ]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, Segment string"


def summarised(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = repair.conversations_summary(repair.damaged(table), **options)
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_repair_is_brute_force(spark):
    draw = random.Random(4)
    rows = [r for conv in range(150) for r in random_turns(draw, conv, draw.randint(1, 12))]
    rows += random_turns(draw, None, 6) + rows[:20]
    assert summarised(spark, rows) == summary(rows)


def test_repair_of_cut_conversations_is_that_of_whole_ones(spark):
    draw = random.Random(9)
    rows = [r for conv in range(12) for r in random_turns(draw, conv, draw.randint(1, 60))]
    rows += random_turns(draw, None, 40)
    assert summarised(spark, rows, segment_rows=5) == summary(rows)


def test_repair_of_one_long_conversation():
    draw = random.Random(2)
    roles = [draw.choice(["user", "assistant"]) for _ in range(1000)]
    texts = [f"{i}" + "." * (draw.random() < 0.9) for i in range(1000)]
    done = repair.repair(repair.Turns.of(roles, texts, set()), repair.START, repair._AT_END, True)
    (cost, audit, _), _ = cheapest(list(zip(range(1000), roles, texts)))
    assert (done.cost, done.audit) == (cost, audit)


def test_repair_of_nothing(spark):
    assert summarised(spark, []) == []
    dropped = next(t for t in range(999) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert summarised(spark, [(7, dropped, "user", "x.")]) == [(7, 0, 0, 0, 0, 0, 0, "", empty)]


# Streaming BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


PARTS = [
    "the", " ", " ", "\n", "é", "é", "don't", "\x1c", "'s", "'r", "'", "e", "<|", "<|endoftext|>",
    "<|startof", "text|>", "中文字", "1", "##", "\xa0", "aaaa", "Θ", "Σ", "İ", "ᄀ", "ᅡ",
    "ᆨ", "thing", "ING", "!", "?!'", "'ll", "ͅ", "Å",
]


def test_encoder_is_the_library_for_feeds_of_any_size(library):
    shared, draw = stream_bpe.vocabulary(WORDS), random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 100)))
        wanted = library.encode(text, add_special_tokens=False).ids
        for feed in (1, 3, 19, 1 << 16):
            assert stream_bpe.encode_text(shared, text, feed).tolist() == wanted, (feed, text)
        assert stream_bpe.encode_texts(shared, [None, text, "", "a" + text])[1].tolist() == wanted
        assert stream_bpe.decode_ids(WORDS, wanted, 7) == library.decode(wanted, skip_special_tokens=False)


def test_long_pieces_keep_a_bounded_window(library):
    shared, draw = stream_bpe.vocabulary(WORDS), random.Random(8)
    runs = ["th", "in", "an", "a", "aa", "er", "ing", "on"]
    texts = ["".join(draw.choice(runs) for _ in range(20_000)), "a" * 50_000, "=!" * 20_000, "é" * 9_000]
    for text in texts:
        machine, found, held = stream_bpe.Encoder(shared), [], 0
        for at in range(0, len(text), 500):
            found += machine.feed(text[at : at + 500]).tolist()
            held = max(held, len(machine.machine.symbols) + len(machine.plain) + len(machine.text))
        found += machine.finish().tolist()
        assert found == library.encode(text, add_special_tokens=False).ids
        assert held <= machine.machine.window + 1500


def test_lookahead_is_sufficient_and_needed():
    """Small merge lists: no text changes a token that ends before the lookahead."""
    draw = random.Random(6)
    for _ in range(40):
        tokens, pairs = list("abc"), []
        while len(pairs) < 8:
            pair = (draw.choice(tokens), draw.choice(tokens))
            if "".join(pair) not in tokens:
                pairs.append(pair)
                tokens.append("".join(pair))
        ahead = stream_bpe.sufficient_lookahead(pairs, set("abc"))
        ids = {t: i for i, t in enumerate(tokens)}
        merges = stream_bpe.Merges(pairs, ids)
        assert merges.lookahead == ahead
        for _ in range(60):
            text = "".join(draw.choice("abc") for _ in range(40))
            more = text + "".join(draw.choice("abc") for _ in range(12))
            short, long = (merges.run([ids[c] for c in t]) for t in (text, more))
            pieces = [[ids[c] for c in t] for t in (text, more, text[:1], text[:7])]
            assert merges.run_many(pieces) == [merges.run(p)[0] for p in pieces]
            stable = [(t, e) for t, e in zip(*short) if e <= len(text) - ahead]
            assert list(zip(*long))[: len(stable)] == stable
    assert stream_bpe.sufficient_lookahead([("a", "b"), ("b", "c")], set("abc")) == 1
    assert stream_bpe.sufficient_lookahead([("b", "c"), ("a", "b")], set("abc")) == 2
    with pytest.raises(ValueError):
        stream_bpe.sufficient_lookahead([("ab", "c"), ("a", "b")], set("abc"))


def test_decoder_is_the_library_on_any_bytes():
    other, draw = Tokenizer.from_file(BYTES), random.Random(1)
    for _ in range(300):
        ids = [draw.randrange(50_257 if draw.random() < 0.3 else 256) for _ in range(draw.randint(0, 60))]
        for feed in (1, 4, 1000):
            assert stream_bpe.decode_ids(BYTES, ids, feed) == other.decode(ids, skip_special_tokens=False)


def test_round_trip_of_awkward_rows(spark, library):
    texts = [None, "", " ", "Don't  stop\n\nnow ", "x <|endoftext|> y", "a" * 3000, "ab " * 9000, "x", "x"]
    rows = [(i, t, "i", "d") for i, t in enumerate(texts)] + [(None, "no id", "i", "d")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, IDS string, Decoded string")
    found = stream_bpe.round_trip(table, WORDS)
    assert [c.lower() for c in found.columns] == ["doc_id", "text", "ids", "decoded"]
    for row in found.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert stream_bpe.round_trip(table.where("doc_id < 0"), WORDS).count() == 0
    unknown = spark.createDataFrame([([3, None, -1, 99_999_999],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in stream_bpe.decode(unknown, WORDS).collect()] == [library.decode([3]), ""]


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    texts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return h(*texts)


def climb(nodes):
    """Root, and each node's siblings with their sides."""
    proofs, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for proof, at in zip(proofs, places):
            proof.append((at % 2 == 1, level[at ^ 1] if at ^ 1 < len(level) else ""))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        places = [at // 2 for at in places]
    return level[0], proofs


def brute_manifest(rows, claims):
    by_lang = defaultdict(list)
    for row, claim in zip(rows, claims):
        by_lang[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), leaf(claim)))
    order = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {lang: climb([r[2] for r in sorted(by_lang[lang])]) for lang in order}
    root, upper = climb([trees[lang][0] for lang in order])
    found = []
    for at, lang in enumerate(order):
        for row, proof in zip(sorted(by_lang[lang]), trees[lang][1]):
            whole, node = proof + upper[at], row[3]
            for left, sibling in whole:
                node = h(sibling, node) if left else h(node, sibling)
            found.append((row[1] if row[0] else None, row[2], trees[lang][0], root, h(*[s for _, s in whole]), node))
    return sorted(found, key=str)


@pytest.mark.parametrize("every", [2, 8])
def test_manifest_is_brute_force(spark, every):
    draw = random.Random(every)
    rows = [
        (draw.choice([i, i, i, 5, None]), draw.choice(["a", None]), draw.choice([None, "", "de", "en", "en", "é"]),
         draw.choice([3, None]), draw.choice(["", None, "text é", "x" * 5000]))
        for i in range(300)
    ]
    rows += [(-1, "s", "single", 1, "one leaf"), rows[0], rows[0]]
    claims = [(*r[:3], None if r[3] is None else r[3] + (r[0] is not None and r[0] % 3 == 0), r[4]) for r in rows]
    table = spark.createDataFrame(
        [(*r, "x") for r in rows],
        "doc_id bigint, source string, lang string, n_chars bigint, text string, Node string",
    ).repartition(5)
    more = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(table, {"n_chars": more}, every).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof.sibling", ""), 256), "claimed_root"
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_manifest(rows, claims)
    alone = merkle.manifest(table.where("lang = 'single'"), None, every).first()
    assert alone["proof"] == [] and alone["leaf"] == alone["root"] == alone["claimed_root"]
    assert merkle.manifest(table.where("doc_id > 999"), None, every).count() == 0


def test_positions_spread_equal_rows(spark):
    table = spark.range(2000).select((F.col("id") % 3 == 0).cast("string").alias("g"), F.lit(1).alias("o"))
    found = positions(table, ["g"], ["o"])
    for group, n in (("true", 667), ("false", 1333)):
        rows = found.where(F.col("g") == group).collect()
        assert sorted(r["position"] for r in rows) == list(range(n))
        assert {r["group_rows"] for r in rows} == {n}
