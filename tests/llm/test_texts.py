"""Operators on texts against brute force on small fixtures, and on odd input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quietwave.llm import decontam, langid, lm, media, packing, sharding, simhash, suffix, toxicity
from quietwave.llm.common import Work, components, crc_fold
from quietwave.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return QUERIES[name](spark, SF).collect()


def fingerprint(text, size=4):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(fps, distance):
    parent = {k: k for k in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k in keys}


def test_simhash_query_is_brute_force(spark, documents):
    want = {k: fingerprint(r["text"]) for k, r in documents.items()}
    reach = classes(want, 4)
    got = result(spark, "op2_simhash_near_dedup")
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {k: (want[k], reach[k]) for k in want}


@pytest.mark.parametrize("block", [4096, 7])
def test_near_links_of_planted_fingerprints(spark, block):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = {}
    for b in base:
        for _ in range(30):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << bit
            fps[x] = x
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 4, block=block)
    work = Work(spark, "test")
    joined = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in components(links, work).collect()}
    want = classes(fps, 4)
    groups = lambda of: {frozenset(v) for v in by(of).values() if len(v) > 1}

    def by(of):
        out = collections.defaultdict(set)
        for k, v in of.items():
            out[v].add(k)
        return out

    assert groups(joined) == groups(want)


def jaccard_classes(texts, size=5, similarity=0.8):
    """The smallest key of every text's class under links of shingle sets of the similarity or more; texts without words are one class."""
    words = {k: (t or "").lower().split() for k, t in texts.items()}
    grams = {k: {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for k, w in words.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(grams[a] & grams[b])
            if grams[a] == grams[b] or both >= similarity * (len(grams[a]) + len(grams[b]) - both):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k in keys}


def test_near_copies_of_edited_texts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = {}
    for base in range(40):
        words = [word() for _ in range(rng.choice([30, 120, 400]))]
        texts[10 * base] = " ".join(words)
        for copy in range(1, 6):
            edited = list(words)
            for at in rng.sample(range(len(words)), len(words) * copy // 60):
                edited[at] = word()
            texts[10 * base + copy] = " ".join(edited)
    # a shingle repeated many times makes different texts no copies
    texts |= {400 + i: " ".join(["ha"] * 300 + [word() for _ in range(60)]) for i in range(4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    want = jaccard_classes(texts)
    # no text joins another class; a link at the very bound may be missed
    assert all(want[k] == want[got[k]] for k in got)
    assert sum(got[k] != want[k] for k in got) <= len(texts) // 50


def planted_crowd(rng, crowd, pairs, shared=200, own=28):
    """Texts of one boilerplate with a part of their own (similarity 0.78), some of them followed by a near copy (0.82)."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, texts = [word() for _ in range(shared)], {}
    for i in range(crowd):
        texts[2 * i] = " ".join(base + [word() for _ in range(own)])
        if i < pairs:
            words = texts[2 * i].split()
            for at in (20, 60, 100, 140, -2):
                words[at] = word()
            texts[2 * i + 1] = " ".join(words)
    return texts


def test_near_copies_in_a_boilerplate_crowd(spark):
    texts = planted_crowd(random.Random(3), 300, 80)
    want = jaccard_classes(texts)
    assert sum(k != v for k, v in want.items()) == 80
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()} == want


def test_near_copies_of_short_texts(spark):
    rng, texts = random.Random(4), {}
    for i in range(120):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(8 + i % 7)]
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join([*words, "further"] if i % 3 else words[:-1] + ["other"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = jaccard_classes(texts)
    assert sum(k != v for k, v in want.items()) > 70
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()} == want


def test_keep_first_goes_by_rows(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(5, a), (5, b), (5, b), (7, c), (1, c + " more"), (7, d), (None, e), (None, e), (None, e + " more"), (None, f), (9, f), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = collections.Counter(map(tuple, simhash.keep_first(docs).collect()))
    # of the two unnamed near copies either text may stay
    unnamed = [r for r in kept if r[0] is None]
    assert len(unnamed) == 1 and unnamed[0][1] in (e, e + " more") and kept[unnamed[0]] == 1
    assert {r: n for r, n in kept.items() if r[0] is not None} == {(5, a): 1, (5, b): 1, (1, c + " more"): 1, (7, d): 1, (9, f): 1}


@pytest.mark.parametrize("block, small", [(4096, 8), (7, 8), (7, 2)])
def test_similar_links_keep_what_is_connected(spark, block, small):
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    values = {}
    for group in range(6):
        base = rng.getrandbits(128)
        for _ in range(3 + 5 * group):
            x = base
            for bit in rng.sample(range(128), rng.randint(0, 9)):
                x ^= 1 << bit
            values[x] = x
    rows = [(signed(x & (1 << 64) - 1), signed(x >> 64), [1, 2 + x % 3]) for x in values]
    links = simhash.similar_links(spark.createDataFrame(rows, "s0 long, s1 long, lists array<int>"), 10, block, small).collect()
    whole = lambda low, high: low % (1 << 64) | high % (1 << 64) << 64
    pairs = [(whole(r["a0"], r["a1"]), whole(r["b0"], r["b1"])) for r in links]
    assert all((a ^ b).bit_count() <= 10 for a, b in pairs)
    parent = {x: x for x in values}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    assert {k: root(k) for k in values} == classes(values, 10)


def test_position_sets_cover():
    from itertools import combinations
    assert len(simhash.position_sets(4)) == 20
    assert all(any(set(s) <= set(four) for s in simhash.position_sets(4)) for four in combinations(range(8), 4))


def test_simhash_odd_input(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9
    of = collections.defaultdict(set)
    for r in rows:
        of[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert of[1] == of[2] == {(0, 1)} and of[4] == of[7] and next(iter(of[4]))[1] == 4 and next(iter(of[None]))[1] is None
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "8", "None"]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links, Work(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def repeats(texts, length):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        out.append((len(t), sum(mask), sum(mask[i] and not (i and mask[i - 1]) for i in range(len(mask))), hashlib.sha256(bytes(b for b, m in zip(t, mask, strict=True) if not m)).hexdigest()))
    return out


def test_repeats_query_is_brute_force(spark, documents):
    keys = sorted(documents)
    want = dict(zip(keys, repeats([documents[k]["text"].encode() for k in keys], 200), strict=True))
    assert {r["doc_id"]: tuple(r)[1:] for r in result(spark, "op4_suffix_array_dedup")} == want


@pytest.mark.parametrize("most", [50_000, 3])
def test_repeats_of_edited_copies(spark, most):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(700)) for _ in range(4)]
    texts = ["x" * 900, "ab" * 300, "ab" * 299, base[0], base[0] + "tail"]
    for _ in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyzé")
        cut = rng.randrange(300)
        texts.append("".join(t)[cut:cut + rng.randint(150, 700)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    spans = {bytes(r["text_id"]): r["spans"] for r in suffix.find_spans(docs, Work(spark, "test"), most=most).collect()}
    for t, (size, removed, n, _) in zip(texts, repeats([t.encode() for t in texts], 200), strict=True):
        cuts = suffix.merged([(s["s"], s["e"]) for s in spans.get(hashlib.md5(t.encode()).digest(), [])])
        assert (sum(e - s for s, e in cuts), len(cuts)) == (removed, n)


def test_repeats_odd_input(odd, empty):
    got = suffix.mark_texts(odd, keep=["doc_id"]).collect()
    assert len(got) == 9 and {r["doc_id"]: r["n_removed"] for r in got}[4] == 0
    long = next(r for r in got if r["doc_id"] == 3)
    assert long["n_removed"] == long["n_bytes"] and long["n_spans"] == 1
    kept = suffix.drop_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == 8 and {r["n_bytes"] for r in kept.collect()} == {"x"}
    assert suffix.drop_repeats(empty).count() == 0


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row, above = [i], row
        for j, d in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d)))
    return min(row)


def test_decontamination_is_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 20)))) for i in range(8)] + [(8, ""), (9, None), (10, "tiny item"), (11, None)]
    items[11] = (11, items[0][1].upper())
    docs = []
    for d in range(60):
        filler, inner = " ".join(word() for _ in range(20)), list(rng.choice(items[:8])[1])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(inner))
            inner[at:at + 1] = rng.choice([[], ["q"], ["q", inner[at]]])
        docs.append((d, f"{filler}\n {''.join(inner)} {filler}" if d % 3 else filler))
    docs += [(60, None), (61, ""), (None, items[1][1]), (62, "a TINY  item here")]
    found = decontam.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for k, t in docs:
        for i, item in items:
            own = decontam.normal(item or "")
            if own and t:
                distance = edit_distance_in(own, decontam.normal(t))
                if distance <= (int(len(own) * decontam.RATE) if len(own) >= decontam.SHORTEST else 0):
                    want.add((k, i, distance))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()} == want and len(want) > 10
    split = decontam.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slice_bytes=100)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in split.collect()} == want


def test_decontamination_odd_input(spark, odd, empty):
    items = spark.createDataFrame([(1, "no key at all"), (2, None)], "item_id long, text string")
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == 8
    assert decontam.drop_contaminated(empty, items).count() == 0 and decontam.drop_contaminated(odd, items.where("false")).count() == 9


def test_packing_is_the_tokenizer(spark, odd, empty):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    hard = ["it's you're I'LL 'sx ''s 12½x ²³", "a\x1cb\x85c\xa0d e ΑΣ Σ ǅ ﬁ é", "<|endoftext|> ¡¿ßÀÖ×÷ÿ ªº_-- ​﻿", None, "", "x" * 5000, "don'T-stop!!'s …"]
    docs = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for table in (docs, odd.select("doc_id", "text").where("doc_id IS NOT NULL").distinct()):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        ids = {k: [*own.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
        place, seen = collections.defaultdict(list), collections.Counter()
        for r in packing.pack(table, tokenizer_path("word_bpe_49k.json"), length=256, open_bins=2).collect():
            part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
            place[r["sequence_id"]].append((r["offset"], r["length"]))
            seen[r["doc_id"]] += r["length"]
        assert seen == {k: len(v) for k, v in ids.items()}
        for held in place.values():
            ends = np.cumsum([n for _, n in sorted(held)])
            assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert packing.pack(odd, tokenizer_path("word_bpe_49k.json")).select("doc_id", "piece").count() > 9 and packing.pack(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 2, 4)] == [(0, 0), (1, 0), (2, 0), (2, 8), (0, 6)]


def test_packing_query_fills_sequences(spark):
    got = result(spark, "op8_best_fit_packing")
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= math.ceil(total / 2048) + 1


def test_language_held_out(spark, documents):
    got = result(spark, "op9_language_id")
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_input(spark, odd, empty):
    model = langid.fit(odd, F.lit(True))
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert got[None] == got[""] == got["12 34 -- !!"] == ("und", 0.0) and got["short text here"][0] in ("en", "de", "fr")
    assert langid.fit(empty, F.lit(True)) is None and {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"} and langid.predict(empty, model).count() == 0


def test_lm_query_base_and_gain(spark, documents):
    train = [r for k, r in documents.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    counts = collections.Counter(w for r in train for w in [*r["text"].encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    got = result(spark, "op10_lm_scoring")
    for r in got:
        words = [*documents[r["doc_id"]]["text"].encode().lower().split(), b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_is_brute_force(spark):
    rng = random.Random(4)
    texts = [(i, None if i == 3 else " ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    texts += [(5, texts[5][1]), (None, "a b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    learn, held = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True)), F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    token = lambda t: ["^", *(t or "").split(), "$"]

    def count(role):
        one, two = collections.Counter(), collections.Counter()
        for k, t in texts:
            own = "scored" if k is not None and k % 4 == 0 else "held" if k is not None and k % 4 == 1 else "kept"
            if own in role:
                one.update(token(t))
                two.update(zip(token(t), token(t)[1:], strict=False))
        return one, two

    def low(one, w):
        total = sum(c for x, c in one.items() if x != "^")
        return (one[w] + 0.5) / (total + 0.5 * len(one))  # the start sign stands for the unseen word

    one, two = count(("kept",))
    table = collections.Counter()
    for k, t in texts:
        if k is not None and k % 4 == 1:
            for a, b in zip(token(t), token(t)[1:], strict=False):
                ratio = two[a, b] / one[a] / low(one, b) if one[a] else 0
                table[math.floor(math.log2(one[a])) + 1 if one[a] else 0, round(lm.BINS * math.log2(ratio)) if ratio else lm.ZERO] += 1
    weights = lm.learn_weights([(*k, n) for k, n in sorted(table.items())])
    one, two = count(("kept", "held"))
    want = collections.defaultdict(list)
    for k, t in texts:
        total = 0.0
        for a, b in zip(token(t), token(t)[1:], strict=False):
            share = weights[math.floor(math.log2(one[a])) + 1] if one[a] else 0
            total += math.log10(share * (two[a, b] / one[a] if one[a] else 0) + (1 - share) * low(one, b))
        want[k].append(total)
    got = collections.defaultdict(list)
    for r in lm.score(docs, learn, held).collect():
        got[r["doc_id"]].append(r["score"])
    assert got.keys() == want.keys() and all(sorted(got[k]) == pytest.approx(sorted(want[k])) for k in want)


def test_lm_equal_chunks_count_each(spark):
    rng = random.Random(8)
    one = [(i, " ".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(8)]
    other = [(i, " ".join("abcdefgh"[(i + j) % 8] for j in range(30))) for i in range(8)]
    rows, got = one * 5 + other, []
    for slices in (6, 1):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), "doc_id long, text string")
        assert docs.rdd.getNumPartitions() == slices
        got.append(sorted((r["doc_id"], r["base_score"], r["score"]) for r in lm.score(docs, F.lit(True), F.col("doc_id") % 2 == 1).collect()))
    assert [r[0] for r in got[0]] == [r[0] for r in got[1]]
    assert [r[2] for r in got[0]] == pytest.approx([r[2] for r in got[1]], rel=1e-9)


def test_lm_odd_input(odd, empty):
    got = lm.score(odd, F.lit(True), F.lit(False)).collect()
    assert len(got) == 9 and {r["doc_id"]: r["n_tokens"] for r in got}[1] == 1
    untrained = lm.score(odd, F.lit(False), F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and lm.score(empty, F.lit(True), F.lit(False)).count() == 0


def test_toxicity_query(spark, documents):
    got = result(spark, "op1_toxicity")
    assert sorted(r["doc_id"] for r in got) == sorted(documents) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_learns(spark):
    rng = random.Random(6)
    plain = lambda n: [rng.choice(["tree", "house", "river", "stone", "cloud", "walk", "green"]) for _ in range(n)]
    rows, marks = [], []
    for i in range(600):
        bad, words = i % 6 == 0, plain(rng.randint(20, 60))
        if bad:
            for w in rng.sample(["zorgle", "Z0RGLE", "blarf", "you blarf"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    fold = crc_fold("doc_id", 5)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, fold != 0)).where(fold == 0).collect()}
    assert all((s >= 0.5) == (k % 6 == 0) for k, s in got.items())


def test_toxicity_capitals_of_every_length():
    at = toxicity.NAMES.index("capitals")
    for part, share in (("ŒŠ ШЖ яж ", 4 / 9), ("AB ab ", 2 / 6), ("ÀÞ àþ ", 2 / 6)):
        assert [toxicity.features(part * n, {}, {})[at] for n in (5, 50)] == pytest.approx([share, share])


def test_toxicity_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score"] and got.count() == 9
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, labels.where("false"), F.lit(True))).collect()} == {0.0} and toxicity.score(empty, model).count() == 0


def test_media_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (1, 1), (8, 64), (9, 13, 3)):
        samples = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_bmp(samples)) == samples).all()
        if len(shape) == 2:
            assert (media.decode(media.encode_pgm(samples)) == samples).all()
    assert (media.decode(b"P2 # grey\n3 2\n#x\n255\n1 2 3\n4 5 6") == [[1, 2, 3], [4, 5, 6]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1") == [[0, 255, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert media.decode(b"P6 1 1 255 abc").tolist() == [[[97, 98, 99]]]
    picture = rng.integers(0, 256, (12, 18))
    assert np.allclose(media.area_resize(picture, 4, 6), picture.reshape(4, 3, 6, 3).mean(axis=(1, 3))) and np.allclose(media.area_resize(picture, 5, 7).mean(), picture.mean())


def test_media_query(spark, documents):
    for r in result(spark, "op7_media_columns"):
        raw = documents[r["doc_id"]]["text"].encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_media_odd_input(spark, odd, empty):
    got = media.media_features(media.texts_to_media(odd)).collect()
    assert len(got) == 9 and {r["doc_id"]: r["payload_bytes"] for r in got}[1] == 64
    broken = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"P5 9"),), (bytearray(b"BMxx"),)], "media binary")
    assert {r["feature"] for r in media.media_features(broken).collect()} == {None} and media.media_features(media.texts_to_media(empty)).count() == 0


def test_sharding_query(spark, documents):
    got = result(spark, "op6_external_shuffle_sharding")
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {k: (len(r["text"].encode()) + 8, zlib.crc32(r["text"].encode())) for k, r in documents.items()}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (24, r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_odd_input(spark, odd, empty):
    sized = odd.withColumn("size", sharding.record_size())
    got = sharding.shuffle_into_shards(sized, "doc_id", "size", 3, bucket_bytes=20_000).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 9 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffle_into_shards(empty.withColumn("size", F.lit(1)), "doc_id", "size", 3).count() == 0
    plan = sharding.shuffle_into_shards(sized, "doc_id", "size", 3)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
