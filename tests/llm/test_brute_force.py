"""The queries that SQL can't express, against plain versions of their methods; the others against their SQL."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprints, language_id, quality, registry, secret_scans
from quarry.llm.common import hash_word

M = (1 << 64) - 1


@pytest.fixture(scope="module")
def small(sf_dir, tmp_path_factory):
    """A folder with the 60 shortest documents, some awkward rows, and their labels."""
    folder = tmp_path_factory.mktemp("small")
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    docs = sorted(docs, key=lambda r: len(r["text"]))[:60]
    odd = [None, "", "12 — 34", docs[5]["text"], "aaaa " * 400, "Überall GRÖSSE, naïve; x9\tx9"]
    docs += [{"doc_id": -1 - i, "text": t, "lang": None, "source": None, "n_chars": None} for i, t in enumerate(odd)]
    pq.write_table(pa.Table.from_pylist(docs, pq.read_schema(f"{sf_dir}/documents.parquet")), f"{folder}/documents.parquet")
    labels = [{"doc_id": r["doc_id"], "quality": r["doc_id"] % 2, "toxic": 0} for r in docs if r["text"] and r["doc_id"] > 0]
    pq.write_table(pa.Table.from_pylist(labels, pq.read_schema(f"{sf_dir}/labels.parquet")), f"{folder}/labels.parquet")
    return str(folder), {r["doc_id"]: r for r in docs}


def learns(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = c.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(map(tuple, df.select(*want.columns).collect())) == Counter(want.fetchall())


def test_language_id(spark, small):
    """Greedy longest matches by plain substring search, run by run."""
    folder, docs = small
    own = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.fit(own.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"))
    texts = {k: {r["text"] for i, r in docs.items() if learns(i) and r["lang"] == k and r["text"]} for k in model.languages}
    samples = {}
    for k, some in texts.items():  # all of them fit in the bounds, so only their order is the model's own
        order = {r.t: r.h for r in spark.createDataFrame([(t,) for t in some], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
        samples[k] = model.symbol[np.frombuffer("\n".join(sorted(some, key=order.get)).lower().encode(), np.uint8)].tobytes()
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, folder).collect()}
    assert set(got) == set(docs)
    for i, r in docs.items():
        if not any(map(str.isalpha, r["text"] or "")):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        raw, cost = model.symbol[np.frombuffer(r["text"].lower().encode(), np.uint8)].tobytes(), []
        for k in model.languages:
            n = 0
            for lo in range(0, len(raw), language_id.RUN):
                n, match = n + 1, b""
                for c in raw[lo : lo + language_id.RUN]:
                    c = bytes([c])
                    if match + c in samples[k]:
                        match += c
                    else:
                        n, match = n + 1, c if c in samples[k] else b""
            cost.append(n * math.log2(len(samples[k]) + 1))
        assert got[i].lang_pred == model.languages[cost.index(min(cost))]
        low = sorted(cost)[:2]
        assert abs(got[i].score - low[1] / sum(low)) < 1e-9 and got[i].held_out is not learns(i)


def word_features(text):
    """Indices and values of a text, word by word."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x09-\x0d\x20]+", (text or "").encode())
    c = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def mixed(h):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xCF1BBCDCBFA56363)):
            h = (h ^ (h >> shift)) * factor & M
        return (h ^ (h >> 32)) >> (64 - quality.BITS)

    def shape(w, h):
        upper = sum(65 <= x <= 90 for x in w)
        kind = quality._CLASS[w[0]]
        return (1 if not upper else 2 if upper == len(w) else 3) if kind == 1 else 4 if kind == 2 else h | 8

    counts, before, s1, s2 = Counter(), 0, 0, 0
    for w in words:
        h = hash_word(w)
        s = shape(w, h)
        counts.update(mixed(x & M) for x in (h, h * c[0] + before * c[1] + 1, s * c[0] + s1 * c[1] + s2 * c[2] + 2, (h == before) + 3))
        before, s1, s2 = h, s, s1
    return {k: v / math.sqrt(max(len(words), 1)) for k, v in counts.items()} | {quality.BIAS: 1.0}


def test_quality(spark, small):
    """The learner with dictionaries, in the same order of rows."""
    folder, docs = small
    rows = [(docs[i]["text"], i % 2) for i in docs if i > 0 and docs[i]["text"] and learns(i)]
    order = {r.t: r.h for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    f, z, n = quality.FTRL(), Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= f.l1 else -(z[k] - math.copysign(f.l1, z[k])) / ((f.beta + math.sqrt(n[k])) / f.alpha + f.l2)

    def score(x):
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))

    for _ in range(2):
        for t, y in sorted(rows, key=lambda r: (order[r[0]], r[1])):
            x = word_features(t)
            g = score(x) - y
            new = {k: ((g * v), weight(k)) for k, v in x.items()}
            for k, (d, w) in new.items():
                z[k] += d - (math.sqrt(n[k] + d * d) - math.sqrt(n[k])) / f.alpha * w
                n[k] += d * d
    got = {r.doc_id: r for r in quality.op2_quality_classifier(spark, folder).collect()}
    for i, r in docs.items():
        want = score(word_features(r["text"]))
        assert abs(got[i].score - want) < 1e-6 and got[i].held_out is not learns(i)
        assert abs(want - 0.3) < 1e-6 or got[i].predicted == (want >= 0.3)


def plain_fingerprint(text, ranks):
    """The digest window by window."""
    raw, w, reach = (text or "").encode(), fingerprints.WINDOW, fingerprints.REACH

    def entropy(x):
        return (fingerprints._FULL - sum(int(np.round(c * math.log2(c) * (1 << 20))) for c in Counter(x).values())) * 1000 // fingerprints._FULL

    def filled(features):
        out = []
        for lo in range(0, len(features), fingerprints.FILTER_FEATURES):
            bits = np.zeros(fingerprints.FILTER_BITS, bool)
            for x in features[lo : lo + fingerprints.FILTER_FEATURES]:
                h = hash_word(x)
                for i in range(fingerprints.HASHES):
                    bits[(h >> 11 * i) % fingerprints.FILTER_BITS] = True
            out.append(np.packbits(bits).tobytes())
        return base64.b64encode(b"".join(out)).decode()

    rank = [int(ranks[entropy(raw[i : i + w])]) for i in range(len(raw) - w + 1)]
    rarest = [r < fingerprints.LEVELS and all(r < x for x in rank[max(0, i - reach) : i]) and all(r <= x for x in rank[i + 1 : i + 1 + reach]) for i, r in enumerate(rank)]
    rare = [raw[i : i + w] for i, is_it in enumerate(rarest) if is_it]
    return filled(rare or [raw] * bool(raw))


def plain_likeness(one, other):
    """Of two encoded fingerprints, filter by filter."""
    a, b = ([int.from_bytes(raw[i : i + 256]) for i in range(0, len(raw), 256)] for raw in map(base64.b64decode, (one, other)))
    if not a or not b:
        return float(not a and not b)
    a, b = sorted((a, b), key=len)
    best = []
    for x in a:
        scores = []
        for y in b:
            n, m = x.bit_count(), y.bit_count()
            chance = n * m / fingerprints.FILTER_BITS
            scores.append(max(0.0, min(1.0, ((x & y).bit_count() - chance) / max(min(n, m) - chance, 1e-6))))
        best.append((max(scores), x.bit_count()))
    return 1.0 if a == b else sum(s * n for s, n in best) / sum(n for _, n in best)


def test_fingerprints(spark, small):
    folder, docs = small
    ranks = fingerprints.rarity_ranks(fingerprints.entropy_histogram(spark.read.parquet(f"{folder}/documents.parquet")))
    got = {r.doc_id: r for r in fingerprints.op6_fingerprints(spark, folder).collect()}
    ids = sorted(docs, reverse=True)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, following = docs[i]["text"] or "", docs[after]["text"] or ""
        edited = fingerprints.edited_text(text, following)
        assert got[i].fingerprint == plain_fingerprint(text, ranks) and got[i].edited_fingerprint == plain_fingerprint(edited, ranks)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert abs(got[i].near_edited - plain_likeness(got[i].fingerprint, got[i].edited_fingerprint)) < 1e-5
        assert abs(got[i].near_next - plain_likeness(got[i].fingerprint, got[after].fingerprint)) < 1e-5


@pytest.mark.parametrize("shuffle", [1, 3])
def test_next_documents_of_awkward_ids(spark, shuffle):
    """Null, repeated and very large ids, clashing columns, more buckets than rows."""
    rows = [(None, "no id"), (None, None), (5, "five b"), (5, "five a"), (2**53 + 1, "large"), (2**53 + 3, "larger"), (-7, ""), (5, "five a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("bucket", "guest", "to")}).repartition(shuffle)
    ranks = fingerprints.rarity_ranks(fingerprints.entropy_histogram(df))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((i, hashlib.sha256(fingerprints.edited_text(t, after).encode()).hexdigest()) for (i, t), (_, after) in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprints.compare_with_edited(df, ranks).collect()) == want


def test_secret_scans(spark, sf_dir):
    """The base by the contract's own patterns, over every document."""
    kinds = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in secret_scans.op10_secret_scans(spark, sf_dir).collect():
        found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(kinds.items()) for m in p.finditer(texts[r.doc_id]) if least[k](m)]
        counts = Counter(k for _, _, k, _ in found)
        base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
