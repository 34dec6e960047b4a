"""The training-data operators against brute force on small tables, with the awkward rows of each."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, fingerprints, jaccard, language_id, packing, quality, registry, secret_scans, token_counts, url_filters, warc
from quarry.llm.common import hash_word, spans, text_slices
from quarry.llm.components import connected

public_tokenizers = pytest.importorskip("public_tokenizers")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A word and its complement: polynomials modulo 2**64 can't tell them apart.
THUE_MORSE, SWAPPED = "".join("ab"[i.bit_count() & 1] for i in range(2048)), str.maketrans("ab", "ba")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, tile int"


def docs(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, 0.5, 7, 1) for i, t in texts], DOCS)


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 12), (12, 10), (7, 7)] + [(100, x) for x in range(101, 150)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n for n, c in got.items() if c == 3} == {3, 4, 5, 9}
    assert {n for n, c in got.items() if c == 10} == {10, 11, 12}
    assert {n for n, c in got.items() if c == 100} == set(range(100, 150)) and 7 not in got
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    texts = pa.array(["one two", None, "two", "x" * 3000 + " two"])
    found = set()
    for _, _, buf, offsets in text_slices(texts, 100):
        from quarry.llm.common import hash_spans

        starts, ends = spans((buf != 32).astype(np.uint8), offsets)
        found.update(hash_spans(buf, starts, ends).tolist())
    assert found == {hash_word(b"one"), hash_word(b"two"), hash_word(b"x" * 3000)}


def test_language_id(spark, sf_dir):
    rows = language_id.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    own = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in own) >= 0.95 * len(own)


def test_language_id_edges(spark):
    train = spark.createDataFrame([("der die das und nicht " * 20, "de"), ("the and of that with " * 20, "en"), ("x", None), (None, "fr")], "text string, lang string")
    model = language_id.fit(train)
    assert model.languages == ["de", "en"]
    got = language_id.predict(docs(spark, [(1, "the and of"), (2, "und das"), (3, None), (4, ""), (5, "12 — 34"), (6, "Ω"), (7, "the and of " * 5000)]), model, ["doc_id"]).collect()
    assert {r.doc_id: r.lang_pred for r in got} | {6: ""} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "", 7: "en"}
    empty = language_id.predict(docs(spark, [(1, "a")]), language_id.fit(train.limit(0)), ["doc_id"]).collect()
    assert [(r.lang_pred, r.score) for r in empty] == [("und", 0.0)]
    assert language_id.predict(docs(spark, []), model, ["doc_id"]).count() == 0


def test_copies_of_a_text_are_learned_once(spark):
    texts = spark.createDataFrame([(f"der die das {i} und nicht {'xyzw'[i % 4]}", "de") for i in range(120)], "text string, lang string")
    first = texts.orderBy(F.xxhash64("text")).first()
    copies = texts.union(spark.createDataFrame([first] * 200, texts.schema))
    one, many = language_id.fit(texts), language_id.fit(copies)
    assert many.log_n == one.log_n and many.step.tolist() == one.step.tolist()


def test_phrases_are_greedy_longest_matches():
    sample = "abracadabra alakazam"
    model = language_id.LanguageModel({"x": sample})
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abrcdklzm q") for _ in range(rng.randint(1, 60)))
        n, i = 0, 0
        while i < len(text):
            k = 0
            while i + k < len(text) and text[i : i + k + 1].replace("q", "#") in sample:
                k += 1
            n, i = n + 1, i + max(k, 1)
        buf = np.frombuffer(text.encode(), np.uint8)
        got = model.phrases(buf, np.array([0, len(buf)]))[0, 0]
        assert abs(got - n) <= 1 + text.count("q")


def test_quality(spark, sf_dir):
    rows = quality.op2_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in own if r.quality], [r.score for r in own if not r.quality]
    assert np.mean(good) > 0.7 and (not bad or np.mean(bad) < np.mean(good))


def test_quality_edges(spark):
    train = spark.createDataFrame([("good words here now", 1), ("### $$$ %%%", 0), (None, 1)] * 20, "text string, quality int").where("text IS NOT NULL")
    w = quality.fit(train, "quality")
    got = {r.doc_id: r.score for r in quality.score(docs(spark, [(1, "good words"), (2, "### $$$"), (3, None), (4, ""), (5, "good words " * 9000)]), w, ["doc_id"]).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] and got[5] > 0.5
    assert set(quality.score(docs(spark, [(1, "a")]), quality.fit(train.limit(0), "quality"), ["doc_id"]).toPandas()["score"]) == {0.5}


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "A<|ENDOFTEXT|>b it<|startoftext|>'S x", "<|endoftext|><|endoftext|>é1", "<|endof", "text|> y", THUE_MORSE + " " + THUE_MORSE.translate(SWAPPED), "it's he'll '###é 12é4 «bonjour» don’t", "", "É́a — x3.5 abc\x1cdef ghi\x0bj İSTANBUL ΣΑΣ ﬁ ½ áb 中文,字 😀!!", "<|endoftext|>x", "naïve—test's", "a\tb\r\nc\x0cd", "x1y2-z_3 THE the", None]
    encoder = packing.PartEncoder(path)
    for limit in (1, 1 << 20):
        got = []
        for lo, hi, buf, offsets in text_slices(pa.array(texts), limit):
            ids, first = encoder.encode(buf, offsets, 1)
            got += [ids[first[i] : first[i + 1]].tolist() for i in range(hi - lo)]
        assert got == [own.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_encoder_keeps_the_parts_of_its_slice(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHE_PARTS", 3)
    own, encoder = Tokenizer.from_file(path), packing.PartEncoder(path)
    for text in ("one two three four", "one five six seven eight nine", "one two", "nine ten, 12", "ten"):
        _, _, buf, offsets = next(text_slices(pa.array([text])))
        assert encoder.encode(buf, offsets, 1)[0].tolist() == own.encode(text, add_special_tokens=False).ids + [1]


def test_best_fit_places_as_a_plain_scan_does():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400)
    sequence, offset = packing.best_fit_decreasing(lengths, 100)
    room, plain = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, -s) for s, r in enumerate(room) if r >= lengths[i]]
        if fits:
            s = -min(fits, key=lambda x: x[0])[1]
        else:
            room.append(100)
            s = len(room) - 1
        plain[i] = room[s]
        room[s] -= lengths[i]
    assert len(room) == sequence.max() + 1
    for s in set(sequence.tolist()):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(sequence == s))
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 100


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b c d " * 3000), (-4, "x <|endoftext|> y<|startoftext|>'s"), (-5, THUE_MORSE), (-6, THUE_MORSE.translate(SWAPPED))], "doc_id long, text string"))
    rows = packing.pack_documents(df, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in df.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[r.doc_id], key=lambda x: x.piece)
        assert [(p.piece, p.start, p.length) for p in pieces] == [(k, k * 4096, min(4096, len(ids) - k * 4096)) for k in range(-(-len(ids) // 4096))]
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces]
    for own_pieces in by_sequence.values():
        own_pieces.sort()
        assert own_pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own_pieces, own_pieces[1:])) and sum(own_pieces[-1]) <= 4096
    assert len(by_sequence) <= math.ceil(sum(r.length for r in rows) / 4096) + 2
    assert packing.pack_documents(df.limit(0), path).count() == 0
    clashing = docs(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]).withColumns({"pack_group": F.lit("x"), "piece": F.lit("y")})
    got = packing.pack_documents(clashing, path).collect()
    assert Counter((r.doc_id, r.length) for r in got) == {(1, 3): 2, (None, 3): 1, (None, 1): 1} and sorted((r.sequence_id, r.offset) for r in got) == [(0, 0), (0, 3), (0, 6), (0, 9)]
    groups = packing.token_pieces(clashing.unionByName(clashing).repartition(1), path, 4096, 1, "doc_id", "text", 4).toPandas()["pack_group"]
    assert sorted(Counter(groups).values()) == [2, 2, 2, 2]  # whatever the ids are


def judged(texts, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    out = {}
    for i, text in texts:
        w, hit, own = find((text or "").translate(A_Z)), set(), set()
        for item, t in items:
            q = find((t or "").translate(A_Z))
            k = min(13, len(q))
            for a in range(len(q) - k + 1) if k else ():
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == q[a : a + k]:
                        own.add("" if item is None else str(item))
                        hit.update(range(b, b + k))
        out[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "of", "é", "x1", "Größe", "rare"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 14, 20])))) for i in range(30)] + [(99, None), (98, "?!"), (97, items_text := "one two three")]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, items[3][1]), (103, "a. ONE, two-three b"), (104, "one two"), (105, "three"), (106, "the " * 20000 + items_text)]
    texts += [(None, items[4][1]), (None, THUE_MORSE), (7000, " ".join(f"b{k}" for k in range(3, 60)))]
    items += [(None, items[5][1]), (None, "four five six"), (96, THUE_MORSE.translate(SWAPPED)), (95, " ".join(f"b{k}" for k in range(90)))]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 40)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs(spark, texts), bench).collect()
    want = Counter(x for i, t in texts for x in [(i, *judged([(i, t)], items)[i])])
    assert Counter(tuple(r) for r in got) == want
    assert decontamination.contamination(docs(spark, []), bench).count() == 0
    clean = decontamination.contamination(docs(spark, texts), bench.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)


def test_proximity(spark):
    index, table = decontamination.build_index(docs(spark, [(1, "alpha x x beta gamma"), (2, "alpha x x x x x beta"), (3, "beta"), (4, "beta alpha")]))
    item = next(decontamination.item_blocks(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")))
    found = decontamination.proximity_matches(index, item, 3).join(table, ["segment", "ordinal"])
    assert {(r.doc_id, r.spread) for r in found.collect()} == {(1, 3), (4, 1)}


def test_token_counts_follow_edits():
    counter = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng, letters = random.Random(2), "ab  \n\t'st1 2é.,!   "
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        tree = token_counts.CountedText(text, counter)
        for _ in range(3):
            a = rng.randint(0, len(text))
            b, new = rng.randint(a, min(len(text), a + 6)), "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_token_counts(spark, sf_dir):
    counter = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in token_counts.op5_token_counts(spark, sf_dir).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text))
        assert r.edited_tokens == len(counter.encoding.encode_ordinary(token_counts.edited(text, token_counts.sample_edits(len(text)))))
        assert r.reencoded < 60
    nulls = token_counts.count_tokens(docs(spark, [(1, None), (2, "")]), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert [(r.n_tokens, r.n_pretokens) for r in nulls] == [(0, 0)] * 2


def test_entropy_levels():
    buf = np.frombuffer("Ächa hello hello world aaaaaaaabbbb 12345 the the thing of things and aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa".encode(), np.uint8)
    full, w = fingerprints._FULL, fingerprints.WINDOW
    want = [(full - sum(int(np.round(c * math.log2(c) * (1 << 20))) for c in Counter(buf[i : i + w].tolist()).values())) * 1000 // full for i in range(len(buf) - w + 1)]
    assert fingerprints.entropy_levels(buf).tolist() == want


def test_fingerprints(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "é"), (-5, "word " * 30000)], "doc_id long, text string"))
    ranks = fingerprints.rarity_ranks(fingerprints.entropy_histogram(df))
    got = {r.doc_id: r for r in fingerprints.compare_with_edited(df, ranks).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    same = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 2
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert np.mean([r.near_edited for r in got.values()]) > 0.4 > 0.2 > np.mean([r.near_next for r in got.values()])
    alone = fingerprints.compare_with_edited(docs(spark, [(4, "abc" * 50)]), ranks).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprints.compare_with_edited(docs(spark, []), ranks).count() == 0


@pytest.mark.parametrize("border", [64, 128, 256, 512, 2048])
def test_likeness_across_sizes(border):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))[:n]
    histogram = np.bincount(fingerprints.entropy_levels(np.frombuffer(prose(100000).encode(), np.uint8)), minlength=fingerprints.LEVELS)
    ranks = fingerprints.rarity_ranks(histogram)
    like = lambda *texts: fingerprints.likeness(*fingerprints.chains(pa.array(texts), ranks))
    near, edited, apart = [], [], []
    for _ in range(20):
        text, other = prose(border + 44), prose(border + 44)
        near.append(like(text[: border - 6], text[: border + 4]))
        edited.append(like(text, fingerprints.edited_text(text, other)))
        apart.append(like(text, other[: border - 6]))
    assert np.mean(near) > 0.8 and np.mean(edited) > 0.35 and np.mean(apart) < 0.1
    assert like("", "") == 1.0 and like("", "a") == 0.0 == like("a", "é")


def components(texts):
    find, sets = re.compile(r"[^\x20\x09-\x0D]+").findall, {}
    for i, t in texts:
        w = find((t or "").translate(A_Z))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_SHARE", 0.02)  # so that the small fixture has hot shingles
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 300)}" for _ in range(60)]
    texts = [(i, " ".join(base[:k] + [f"v{i}"] * rng.randint(0, 3) + base[k + rng.randint(0, 2) :])) for i in range(80) for k in [rng.randint(0, 59)]]
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [(200 + i, passage + " " + " ".join(f"q{i}_{k}" for k in range(rng.choice([2, 6, 10, 40])))) for i in range(40)]
    texts += [(400, None), (401, ""), (402, " \t"), (403, "a b"), (404, "A  b"), (405, "a b c d e"), (406, "a b c d"), (407, texts[0][1]), (408, texts[0][1].upper()), (409, "z " * 9000)]
    texts += [(410, THUE_MORSE), (411, THUE_MORSE.translate(SWAPPED))]
    got = jaccard.jaccard_components(docs(spark, texts + texts[:2])).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(texts)
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_jaccard_rows_without_or_with_shared_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(None, a), (None, a), (7, a), (7, b), (3, b), (None, "alone in all the words here"), (None, None), (None, ""), (9, "")]
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs(spark, rows)).collect())
    assert got == Counter([(None, 3, 7), (None, 3, 7), (7, 3, 7), (7, 2, 3), (3, 2, 3), (None, 2, None), (None, 0, None), (None, 0, None), (9, 0, 9)])
    kept = jaccard.one_of_each(docs(spark, rows + [(9, ""), (7, a)]).withColumns({"row": F.lit(1), "digest": F.lit(2)}))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(7, a), (3, b), (None, "alone in all the words here"), (None, None), (None, ""), (9, "")])
    assert kept.columns[-2:] == ["row", "digest"] and jaccard.one_of_each(docs(spark, [])).count() == 0


def test_jaccard_around_the_threshold(spark, monkeypatch):
    """One large family, most of whose pairs are just below or just above the threshold."""
    monkeypatch.setattr(jaccard, "HOT_SHARE", 0.02)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(160)]
    texts = []
    for i in range(260):
        own = list(base)
        for k in range(rng.choice([1, 2, 3, 4, 5, 7])):
            own[rng.randrange(160)] = f"v{i}_{k}"
        texts.append((i, " ".join(own[rng.randint(0, 12) :])))
    want = components(texts)
    got = jaccard.jaccard_components(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and 1 < len({c for _, c in want.values()}) < 260


def test_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n, m in ((3, 4), (100, 120), (700, 900), (2000, 2600)):
        x, y = (np.unique(np.concatenate([rng.integers(0, 1 << 63, k // 4), np.arange(k) << 32]).astype(np.uint64)) for k in (n, m))
        p, q = sorted((np.unpackbits(jaccard.bitmap(s).view(np.uint8)) for s in (x, y)), key=len)
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        assert (p != q).sum() <= len(np.setxor1d(x, y))


def test_hot_shingles_before_an_entry():
    doc, ranks = np.array([0, 0, 0, 1, 1, 1]), np.array([3, 4, 70, 5, 6, 69])
    assert jaccard.hot_before(doc, ranks).tolist() == [0, 1, 0, 0, 1, (1 << 62) | (1 << 63)]


def test_jaccard_on_the_table(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = jaccard.op7_ngram_jaccard(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(texts)


def test_warc(spark, tmp_path):
    rows = [(5, None, "u"), (2, "", "u"), (3, "a\r\n\r\nb", None), (4, "a\r\n\r\nb", "x\ny"), (7, "é" * 50000, "z"), (6, "é" * 50000, "z"), (8, "one", "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("n", F.lit(1))
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(pages), path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    first = {2: None, 5: 2, 3: None, 4: 3, 6: None, 7: 6, 8: None}
    for i, html, _ in rows:
        raw = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if first[i] else "response", first[i])
    small = warc.resolve_revisits(pages, least_bytes=3).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in small} == {4, 7}
    warc.write_archives(warc.resolve_revisits(pages.limit(0)), path + "0")
    assert warc.read_archives(spark, path + "0").count() == 0


@pytest.mark.parametrize("most_hot", [1, 1000])
def test_warc_repeated_and_null_ids(spark, tmp_path, monkeypatch, most_hot):
    monkeypatch.setattr(warc, "MOST_HOT", most_hot)
    rows = [(1, "aa", "u")] * 3 + [(1, "aa", None), (2, "aa", "u"), (1, "bb", "u"), (None, "aa", "u"), (None, "bb", "u")] + [(None, "cc", "u")] * 2 + [(None, "cc", "v"), (3, None, None), (3, "", None), (None, "d", None)]
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(spark.createDataFrame(rows, "page_id long, html string, url string")), path)
    got = warc.read_archives(spark, path).collect()
    name = {base64.b32encode(hashlib.sha1(x.encode()).digest()).decode(): x for x in ("aa", "bb", "cc", "d", "")}
    want = {
        ("aa", 1, "response", None): 1, ("aa", 1, "revisit", 1): 3, ("aa", 2, "revisit", 1): 1, ("aa", None, "revisit", 1): 1,
        ("bb", 1, "response", None): 1, ("bb", None, "revisit", 1): 1, ("cc", None, "response", None): 1, ("cc", None, "revisit", None): 2,
        ("", 3, "response", None): 1, ("", 3, "revisit", 3): 1, ("d", None, "response", None): 1,
    }
    assert Counter((name[r.payload_digest], r.page_id, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload_bytes == len(name[r.payload_digest]) for r in got)
    small = warc.resolve_revisits(spark.createDataFrame(rows, "page_id long, html string, url string"), least_bytes=2).collect()
    assert len(small) == len(rows) and Counter(r.record_type for r in small if r.n < 2) == {"response": 3}


def test_warc_on_the_table(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = warc.op8_warc_revisits(spark, sf_dir).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {i: (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode()) for i, x in pages.items()}


def test_url_filters(spark):
    urls = ["http://EXAMPLE.org/es/x?y#z", "http://a.example.org/en/12", "https://x.org", "http://notexample.org/es/", "http://b.com/fr/", "http://com/de/", "http://b.com/dE/", None, "nothing", "x://y://z.com/fr/#", "http://spam-farm.net/", "http://a.b.casino-win.com/x", "http://xcom/fr/", "http:///fr/", "http://org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("x") for c in ("rule", "key", "fit", "_level0")})
    got = {r.page_id: r for r in url_filters.judge(pages, listed_hosts=url_filters.hosts_with(pages)).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == {r[0]: tuple(r[1:]) for r in c.execute(url_filters.ORACLE).fetchall()}
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("part_mb", [16, 3e-5])
def test_url_filters_by_parts(spark, part_mb):
    """One part or many: the cascade alone tells membership; listed hosts come as a table."""
    urls = ["http://EXAMPLE.org/es/x", "http://a.b.com/fr/", "http://a.b.com/fr/", None, "http://spam-farm.net/x", "http://x.net/", *[f"http://h{i}.net/" for i in range(40)]]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(1, urls[1]), (None, urls[4])], "page_id long, url string")
    listed = spark.createDataFrame([("spam-farm.net",), ("spam-farm.net",), (None,), ("",), ("not.seen",), *[(f"h{i}.net",) for i in range(0, 40, 2)]], "key string")
    got = Counter(tuple(r) for r in url_filters.judge(pages, listed_hosts=listed, part_mb=part_mb).collect())
    assert got[1, "a.b.com", "/fr/", "com/fr/", "allow"] == 2 and got[0, "example.org", "/es/x", "example.org/es/", "block"] == 1
    verdicts = {r[0]: r[4] for r in got}
    assert verdicts[4] == verdicts[None] == "block" and verdicts[3] == verdicts[5] == "allow"
    assert [verdicts[6 + i] for i in range(40)] == ["block", "allow"] * 20


@pytest.mark.parametrize("part_mb", [16, 5e-4])
def test_cascade_is_exact(spark, part_mb):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filters.Cascade(universe, bits_per_key=4, hashes=2, part_mb=part_mb)
    assert cascade.parts == (1 if part_mb == 16 else 3) and max(map(len, cascade.cascades)) > 2
    got = cascade.mark(universe.withColumn("found", F.lit(False)), lambda contains: {"found": F.col("found") | contains(F.col("key"))})
    assert got.where("found <> listed").count() == 0


def test_url_filters_match_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = c.sql(url_filters.ORACLE)
    got = url_filters.op9_url_filters(spark, sf_dir)
    assert set(map(tuple, got.select(*want.columns).collect())) == set(want.fetchall())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("token = \"abc123\"", "assign:0:15"),
        ("TOKEN:abc", ""),
        ("password: secret=abcdefg", "assign:0:24"),
        ("AKIA" + "A" * 16 + " AKIA123", "access:0:20"),
        ("ff" * 12 + " " + "0" * 23, "hex:0:24"),
        ("é token=" + "a" * 24, "assign:2:32,hex:8:32"),
        ("ſecret=abcdefgh", ""),
        ("", ""),
        ('db_pwd = "Tr0ub4dor&3x9Z"', "name:10:24"),
        ('x = "Tr0ub4dor9x9Z"\nsession_credential = x', "name:5:18"),
        ('pwd = "changeme"', ""),
        ("the clock: twelve o'clock = noon", ""),
    ],
)
def test_secret_spans(text, want):
    assert secret_scans.digest(secret_scans.scan(text)) == want


@pytest.mark.parametrize(
    ("text", "want", "masked"),
    [
        ('db_password = "Summer2024!x#9Qz$77"', "assign:3:25,name:15:34", 'db_[SECRET]"'),
        ('auth_pwd = "' + "0f" * 12 + '!Zq#"', "hex:12:36,name:12:40", 'auth_pwd = "[SECRET]"'),
        ('auth_pwd = "x!AKIA' + "B7" * 8 + '?y"', "name:12:36,access:14:34", 'auth_pwd = "[SECRET]"'),
        ("db_password = 'abc123def456'", "assign:3:27", "db_[SECRET]'"),
        ("pwd" + " " * 300 + '= "Tr0ub4dor&3x9Z"', "name:306:320", "pwd" + " " * 300 + '= "[SECRET]"'),
        ("pwd_" + "x" * 300 + ' = "Tr0ub4dor&3x9Z"', "name:308:322", "pwd_" + "x" * 300 + ' = "[SECRET]"'),
        ('passphrase: "correct horse battery staple"', "name:13:41", 'passphrase: "[SECRET]"'),
    ],
)
def test_secrets_are_masked_whole(text, want, masked):
    assert secret_scans.digest(secret_scans.scan(text)) == want
    assert secret_scans.masked(text) == masked


def test_names_are_found_in_linear_time():
    text = "pwd " + "x" * 400000 + ", " + "a" * 400000 + " = 5" + " = " * 100000
    assert [(len(n), v) for n, v, *_ in secret_scans.lexed_pairs(text)] == [(400000, "5")]


def test_secret_scan_rows(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdef api-key=x api_key='zzzzzz9'"), (4, "word " * 50000 + "secret: 0123456789abcdef01234567")]
    got = {r.doc_id: r for r in secret_scans.scan_secrets(docs(spark, rows)).collect()}
    assert (got[1].n_assign, got[1].spans, got[1].base_sha256) == (0, "", hashlib.sha256(b"").hexdigest()) and got[2].spans == ""
    assert got[3].n_assign == 2 and (got[4].n_assign, got[4].n_hex) == (1, 1)
    masked = {r.doc_id: r.text for r in secret_scans.mask_secrets(docs(spark, rows)).collect()}
    assert masked[3] == "[SECRET] api-key=x [SECRET]'" and masked[1] is None and masked[4].endswith("word [SECRET]")
    assert secret_scans.scan_secrets(docs(spark, [])).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stage["quality"](spark, table, sf_dir)
    scores = {r.doc_id: r.predicted for r in quality.op2_quality_classifier(spark, sf_dir).collect()}
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p}
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    one_each = stage["near duplicates"](spark, kept, sf_dir)
    assert {r.doc_id for r in one_each.collect()} == {i for i, (n, c) in components(texts).items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, one_each, sf_dir)
    left = [(r.doc_id, r.text) for r in one_each.collect()]
    assert {r.doc_id for r in clean.collect()} == {i for i, x in judged(left, items).items() if not x[4]}
    safe = stage["secrets"](spark, clean, sf_dir)
    assert {r.doc_id: (r.text, r.n_chars) for r in safe.collect()} == {r.doc_id: (m := secret_scans.masked(r.text), len(m)) for r in clean.collect()}
    assert {r.doc_id for r in stage["packing"](spark, safe, sf_dir).collect()} == {r.doc_id for r in safe.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() >= safe.count()


def test_pipeline_rows(spark, sf_dir):
    """Null, empty, repeated and clashing rows, and no rows, through all stages."""
    import corpus_pipeline

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = [r.text for r in table.where("lang = 'en'").orderBy(F.desc("n_chars")).limit(40).collect()]
    weights = quality.fit(quality.training_rows(table, spark.read.parquet(f"{sf_dir}/labels.parquet")), "quality")
    scores = quality.score_texts(weights, pa.array(good))
    a, b = [t for t, s in zip(good, scores) if s > 0.9 and "WARC" not in t][:2]
    rows = [(3, a), (7, a), (7, b), (9, b + " end"), (9, b + " end"), (None, a), (None, None), (11, "")]
    df = spark.createDataFrame([(i, t, "en", "s", None, 0.1, 7, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, digest string, row string")
    learned = table.select("doc_id", "text", "lang", "source", "n_chars").withColumns({"score": F.lit(0.1), "predicted": F.lit(7), "digest": F.lit("x"), "row": F.lit("y")}).where("doc_id > 20")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    docs_in = df.unionByName(learned)
    first = stages["quality"](spark, docs_in, sf_dir)
    assert first.columns == docs_in.columns and 0 < first.count() < docs_in.count()
    docs_in = df
    for name in ("near duplicates", "decontamination", "secrets"):
        docs_in = stages[name](spark, docs_in, sf_dir)
        assert docs_in.columns == df.columns
        kept[name] = Counter((r.doc_id, r.text) for r in docs_in.collect())
    assert kept["near duplicates"] == Counter([(3, a), (7, b), (None, None), (11, "")])
    assert sum(kept["secrets"].values()) == sum(kept["decontamination"].values()) >= 2
    assert stages["packing"](spark, docs_in, sf_dir).select("doc_id").distinct().count() == len({i for i, _ in kept["secrets"]})
    none = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
        assert none.count() == 0


def test_registry_names_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES] == list(range(1, 14))
