"""Filter interactions, harmonic packing and whitening against plain versions, with awkward rows."""

import itertools
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import filter_audit, harmonic, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")


# ---- filter interactions


def failing(docs):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, part in docs:
        t = t or ""
        words = [w for w in re.split("[ \t\n\x0b\f\r]", t) if w]
        fails = ["A"] * (len(words) < 200) + ["B"] * (100 * len(set(words)) < 50 * len(words)) + ["C"] * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
        fails += ["D"] * any(c in "#$%&*|" for c in t) + ["E"] * (d is not None and d > least[t])
        yield d, part or "", set(fails)


def audited(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    rows, out = list(failing(docs)), {}
    for part in {p for _, p, _ in rows}:
        own = [(d, f) for d, p, f in rows if p == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                total[name] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == {name} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


LONG, MANY, CAPITALS = " ".join(f"w{i}" for i in range(250)), "ab " * 300, " ".join(["QUITE"] * 10 + [f"x{i}" for i in range(300)])
DOCS = [(1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (4, MANY, None), (5, None, ""), (6, "", "b"), (7, "A # b", "b"), (None, LONG, "b"), (None, "A # b", "a"), (8, CAPITALS + " $", "c"), (9, CAPITALS, "c"), (10, "É\U0001f600\x0bx\xa0y" * 90, "c"), (1, MANY, "a"), (1, LONG, "a"), (2**53 + 1, MANY, "c")]
LABELS = [(1, 1, 0), (2, None, 1), (2, 1, None), (3, 0, 1), (None, 1, 1), (4, 1, 1), (77, 1, 1), (2**53 + 1, 1, 1), (2**53, 0, 0)]


def frames(spark, docs=DOCS, labels=LABELS):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("n", "mask", "good", "part", "id", "spread", "digest")})
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"good": F.lit(1), "id": F.lit("x")})


def test_interactions_match_a_plain_run_of_every_order(spark):
    docs, labels = frames(spark)
    got = filter_audit.audit(filter_audit.failure_cells(docs, labels)).collect()
    assert len(got) == 600 * 4 and {tuple(r) for r in got} == audited(DOCS, LABELS)


def test_interactions_match_sql(spark):
    docs, labels = frames(spark)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    con.register("labels", labels.select("doc_id", "quality", "toxic").toArrow())
    want = con.sql(filter_audit.ORACLE)
    got = filter_audit.audit(filter_audit.failure_cells(docs, labels)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_interactions_of_empty_tables(spark):
    docs, labels = frames(spark)
    assert filter_audit.audit(filter_audit.failure_cells(docs.limit(0), labels)).count() == 0
    assert filter_audit.audit(filter_audit.failure_cells(docs, labels.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [2, 3, 5])
def test_solution_gives_shapley_values(n):
    rng = np.random.default_rng(n)
    v = [0, *map(int, rng.integers(0, 1000, (1 << n) - 1))]
    for i, row in enumerate(filter_audit.shapley_solution(n)):
        want = sum(math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) * (v[s | 1 << i] - v[s]) for s in range(1 << n) if not s >> i & 1)
        assert sum(a * b for a, b in zip(row, v)) == want


# ---- harmonic packing


def check_packing(rows, texts, capacity=4096):
    """Every id of every text in one piece, gapless sequences; returns the ids of padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    want = {}
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, []).append(ids)
    assert pieces.keys() == want.keys()
    for i, copies in want.items():
        got = Counter((start, n, crc, total) for start, n, crc, total in pieces[i])
        for (start, n, crc, total), times in got.items():
            fits = [c for c in copies if len(c) == total and zlib.crc32(c[start : start + n].tobytes()) == crc]
            assert len(fits) >= times
        assert sum(n * times for (_, n, _, _), times in got.items()) == sum(map(len, copies))
    return padding


def test_harmonic_packing(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = harmonic.op12_harmonic_packing(spark, sf_dir).collect()
    assert check_packing(rows, texts) <= 0.001 * sum(r.length for r in rows)


def test_harmonic_packing_of_awkward_rows(spark):
    texts = [(2**53 + 1, "one two"), (2**53 + 3, None), (None, ""), (None, "a # b"), (7, "same text"), (7, "same text"), (8, "word " * 30_000), (9, "é\U0001f600")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("start", "length", "offset", "sequence_id")})
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = harmonic.pack_harmonic(df, path).collect()
    assert check_packing(rows, texts) <= 8 * 4
    assert harmonic.pack_harmonic(df.limit(0), path).count() == 0
    assert harmonic.pack_harmonic(spark.createDataFrame([("k", "x")], "doc_id string, text string"), path).first().doc_id == "k"


@pytest.mark.parametrize("capacity", [64, 1000, 4096])
def test_classes_are_filled_with_a_fixed_number(capacity):
    lengths = harmonic.class_lengths(capacity, 4)
    assert capacity in lengths and 1 in lengths
    for n, k in lengths.items():
        assert k == capacity // n and capacity - k * n <= 4
    for size, own in enumerate(harmonic.cuts(capacity, lengths)):
        assert sum(own) == size and set(own) <= set(lengths) and own == sorted(own, reverse=True)
    packer, rng = harmonic.HarmonicPacker(capacity, 4, 0), np.random.default_rng(0)
    sizes = rng.integers(1, 3 * capacity, 300).tolist()
    for i, n in enumerate(sizes):
        packer.add_document(i, memoryview(np.arange(n, dtype="<u4").tobytes()))
    whole = Counter(r[5] for r in packer.rows)
    of_length = {r[5]: r[2] for r in packer.rows}
    assert all(times == lengths[of_length[s]] for s, times in whole.items())
    packer.finish()
    filled = Counter()
    for r in packer.rows:
        filled[r[5]] += r[2]
        assert zlib.crc32(np.arange(r[1], r[1] + r[2], dtype="<u4").tobytes()) == r[3] and r[4] == sizes[r[0]]
    assert sum(filled.values()) == sum(sizes) and all(capacity - n <= 4 or n.bit_count() == 1 for n in filled.values())


# ---- whitening


def plain_fit(vectors):
    x = sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dim = len(sums)
    cov = np.array([[float(Fraction(sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x), n**3)) for b in range(dim)] for a in range(dim)])
    return n, sums, cov


def whitened_rows(df, **kw):
    out = {}
    for r in whitening.whiten(df, **kw).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_scatter_of_a_block_is_exact():
    rng = np.random.default_rng(3)
    for x in (rng.integers(-40, 40, (130, 5)), rng.integers(-(2**62), 2**62, (70, 3)), np.full((3, 2), 7), np.array([[2**62, -(2**62)], [0, 1]]), rng.integers(-5, 5, (1, 4))):
        n, sums, products = whitening.block_scatter(x.astype(np.int64))
        rows = x.tolist()
        assert n == len(rows) and sums == [sum(c) for c in zip(*rows)]
        for a in range(x.shape[1]):
            assert products[a][a:] == [sum(r[a] * r[b] for r in rows) for b in range(a, x.shape[1])]


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * [3.0, 2.0, 1.0, 0.5, 0.2, 0.1] + [100.0, 0, 0, -5, 0, 0]
    vectors = [list(map(float, v)) for v in base]
    rows = [*enumerate(vectors), (500, vectors[0]), (500, vectors[0]), (None, vectors[1]), (601, None), (602, []), (603, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (604, [float("nan")] * 6), (605, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "n", "component", "whitened")})
    n, sums, cov = plain_fit(vectors)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    got = whitening.whiten(df).collect()
    assert len(got) == 303 * 6 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        x = [math.floor(64 * c) + 1_000_000 for c in vectors[{500: 0, None: 1}.get(r.vec_id, r.vec_id)]]
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        k = r.component - 1
        want = sum(float(Fraction(n * c - s, n)) * e for c, s, e in zip(x, sums, vecs[:, k])) / math.sqrt(values[k])
        sign = signs.setdefault(k, 1 if want * r.whitened > 0 else -1)
        assert abs(r.whitened - sign * want) < 1e-8 and abs(r.explained - values[k] / values.sum()) < 1e-9
    assert len({(r.component, r.whitened) for r in got if r.vec_id in (0, 500)}) == 6
    few = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(df.repartition(3), most=2).collect()}
    assert len(few) == 302 * 2 and all(k <= 2 for _, k in few)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    flat = whitened_rows(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 2.0])], schema))
    assert {len(v) for v in flat.values()} == {1} and flat[1][1].explained == 1.0
    huge = whitened_rows(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], schema))
    assert huge[1][1].deviation is None and abs(abs(huge[1][1].whitened) - 1) < 1e-12
    with pytest.raises(Exception, match="differ in size"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)).collect()


def test_whitening_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    n, sums, cov = plain_fit([r.embedding for r in table])
    values, vectors = np.linalg.eigh(cov)
    got = whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert len(got) == len(table)
    for k in (1, 2, 16):
        e, v = values[-k], vectors[:, -k]
        want = np.array([sum(float(Fraction(n * (math.floor(64 * float(c)) + 1_000_000) - s, n)) * y for c, s, y in zip(r.embedding, sums, v)) for r in table]) / math.sqrt(e)
        have = np.array([got[r.vec_id][k].whitened for r in table])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert abs(got[table[0].vec_id][k].explained / (e / np.trace(cov)) - 1) < 1e-9
    assert got[table[0].vec_id][1].identity_error < 1e-9


# ---- earlier operators: ids, languages and columns that were lost


def test_packing_keeps_large_ids_beside_nulls(spark):
    ids = [2**53 + 1, 2**53 + 3, None, 2**53 + 1, 5]
    df = spark.createDataFrame([(i, f"some text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    from quarry.llm import packing

    got = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), capacity=3)
    assert Counter(r.doc_id for r in got.where("piece = 0").collect()) == Counter(ids)
    by_name = packing.pack_documents(df.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))), public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in by_name.collect()} == {str(2**53 + 1), str(2**53 + 3), "none", "5"}


def test_languages_of_long_texts_alone_are_learned(spark):
    from quarry.llm import language_id

    rows = [("the and of that with " * 40, "en")] + [(f"{i} " + "der die das und nicht " * 4000, "de") for i in range(5)] + [("", "fr"), ("", "fr")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en"]
    assert model.log_n[0] <= math.log2(60_001)
    assert model.predict(__import__("pyarrow").array(["und das nicht", "that with the"]))[0] == ["de", "en"]


def test_very_many_languages_are_all_learned(spark):
    from quarry.llm import language_id

    names = ["".join(chr(97 + i // 26**k % 26) for k in range(2)) for i in range(600)]
    rows = [(" ".join([n * 3] * 100), n) for n in names]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted(names)
    assert model.predict(__import__("pyarrow").array([" ".join([names[77] * 3] * 5)]))[0] == [names[77]]


def test_masking_leaves_a_clashing_n_chars_alone(spark):
    from quarry.llm import secret_scans

    df = spark.createDataFrame([(1, "token = abcdef123456", "many"), (2, None, None)], "doc_id long, text string, n_chars string")
    assert [(r.text, r.n_chars) for r in secret_scans.mask_secrets(df).orderBy("doc_id").collect()] == [("[SECRET]", "many"), (None, None)]
    assert secret_scans.scan_secrets(df.limit(0)).count() == 0 and secret_scans.scan_secrets(df.union(df)).count() == 4


def test_kept_trees_follow_a_table_of_edits(spark):
    import random

    import tiktoken  # noqa: F401

    from quarry.llm import token_counts

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    counter, rng = token_counts.counter_of(ranks, pattern), random.Random(1)
    words = ["token", "don't", " é", "\n\n", "  ", "12345", "😀x", "the quick", "...", ""]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(200)) for i in range(30)] + [(30, None), (31, ""), (2**53 + 1, text(50)), (None, text(9)), (5, text(7))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_tokens", "edits", "leaf_chars")})
    trees = token_counts.count_trees(df, ranks, pattern)
    plain = sorted(((i, t or "") for i, t in docs), key=repr)
    for _ in range(2):
        edits = [(i, s, a, a + rng.randrange(9), text(rng.randrange(4))) for i in [*range(0, 34, 3), 2**53 + 1, 5, 777] for s in range(3) for a in [rng.randrange(150)]] + [(31, 9, None, None, "at the end"), (None, 1, 0, 1, "x"), (0, 9, 3, None, None)]
        table = spark.createDataFrame(edits, "doc_id long, seq int, start int, end int, replacement string")
        order = sorted(((i, s, 1 << 40 if a is None else a, 1 << 40 if e is None else e, r or "") for i, s, a, e, r in edits if i is not None), key=lambda e: e[1:])
        plain = [(i, token_counts.edited(t, [e[2:] for e in order if e[0] == i])) for i, t in plain]
        trees = token_counts.stored(token_counts.edit_trees(trees, table, ranks, pattern))
        got = trees.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(plain, key=repr)
        for r in got:
            assert r.n_tokens == len(counter.encoding.encode_ordinary(r.text)) == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(r.text)
            assert (r.reencoded > 0) == (r.doc_id in {e[0] for e in order}) or r.text == "" or r.doc_id == 31
        assert all(r.reencoded < 150 for r in got)
    assert token_counts.edit_trees(trees, table.limit(0), ranks, pattern).where("reencoded > 0").count() == 0
    assert token_counts.edit_trees(trees.limit(0), table, ranks, pattern).count() == 0
    with pytest.raises(ValueError, match="aren't those of this text"):
        token_counts.CountedText.restored("abc", [2], [1], counter)


def test_token_counts_of_awkward_rows(spark):
    from quarry.llm import token_counts

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, "same"), (1, "same"), (None, "no id"), (2, None), (2**53 + 1, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_tokens", "edited_tokens")})
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, ranks, pattern).collect())
    encode = token_counts.counter_of(ranks, pattern).encoding.encode_ordinary
    assert got == Counter((i, len(encode(t or ""))) for i, t in rows)
    assert token_counts.count_tokens(df.limit(0), ranks, pattern).count() == 0
