"""Whitening, centroid clustering and syncmer fingerprints against brute force."""

import hashlib
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quietwave.llm import clusters, syncmers, whitening

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def embeddings(spark):
    """Spread vectors, a third of them one vector, ties, and unusable rows; columns with clashing names."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * (1 + i % 3)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [(7, rows[8][1]), (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [0.5] * 63), (904, [NAN] + [0.5] * 63), (905, [0.5] * 63 + [-INF]), (906, [1.0] * 65)]
    return spark.createDataFrame([(*r, "c", 1.0, 2) for r in rows], "vec_id long, embedding array<float>, x string, cluster double, component int")


def usable(df):
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    return [i for i, _ in kept], np.array([[math.floor(64 * float(e)) for e in v] for _, v in kept])


def plain_clusters(ids, x, k=16, rounds=3):
    order = sorted(range(len(ids)), key=lambda r: (hashlib.sha256(f"1:{'' if ids[r] is None else ids[r]}".encode()).hexdigest(), x[r].tolist()))
    centres = [x[r].tolist() for r in order[:k]]

    def assign():
        found = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for v in x.tolist()]
        return [(d.index(min(d)), min(d)) for d in found]
    for _ in range(rounds):
        near = [c for c, _ in assign()]
        for c in range(len(centres)):
            mine = [v for v, n in zip(x.tolist(), near) if n == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return assign(), centres


def test_clusters_equal_plain_rounds(embeddings):
    got = clusters.cluster_vectors(embeddings).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    ids, x = usable(embeddings)
    near, centres = plain_clusters(ids, x)
    total = sum(d for _, d in near)
    want = [(i, c, d, sum(e for b, e in near if b == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, (c, d) in zip(ids, near)]
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_clusters_of_few_equal_and_no_vectors(spark, embeddings):
    few = embeddings.where("vec_id in (3, 207, 208)")
    got = {r["vec_id"]: r for r in clusters.cluster_vectors(few).collect()}
    assert {r["distance"] for r in got.values()} == {0} and got[207]["cluster"] == got[208]["cluster"] != got[3]["cluster"]
    assert clusters.cluster_vectors(embeddings.where("false")).collect() == []
    assert clusters.cluster_vectors(embeddings.where("vec_id = 900")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]


def test_tables_of_wide_values_and_exact_sums():
    rng = np.random.default_rng(1)
    wide = rng.integers(-(1 << 26), 1 << 26, size=(50, 4))
    centres = wide[:3]
    assert np.array_equal(clusters.distances(wide, centres), ((wide[:, None, :] - centres[None]) ** 2).sum(axis=2))
    big = np.full(5, (1 << 62) - 1)
    assert clusters.exact_sum(big) == 5 * ((1 << 62) - 1)


def test_too_large_entries_stop(spark):
    df = spark.createDataFrame([(1, [3e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        clusters.cluster_vectors(df)


def test_whitening_equals_plain_covariance(embeddings):
    got = whitening.whiten(embeddings).toPandas()
    ids, x = usable(embeddings)
    x = x + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((fit - sums / n).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 16 * len(ids) and (got.n == n).all() and got.identity_error.max() < 1e-12
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, values[:16] / values.sum(), rtol=1e-10)
    want = (x - sums / n) @ vectors[:, :16] / np.sqrt(values[:16])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for v in x]
    rows = {(None if np.isnan(i) else int(i), d): g.sort_values("component").whitened.to_numpy()[:16] for (i, d), g in got.groupby(["vec_id", "deviation"], dropna=False)}
    signs = None
    for i, d, w in zip(ids, deviation, want):
        mine = rows[(i, d)]
        signs = np.sign(mine * w) if signs is None else signs
        assert np.allclose(mine * signs, w, atol=1e-8)


def test_whitening_without_spread(spark, embeddings):
    one = embeddings.where("vec_id in (7, 207)").where("vec_id = 207")
    got = whitening.whiten(one.unionByName(one), parts=4).collect()
    assert len(got) == 8 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in got)
    three = whitening.whiten(embeddings.where("vec_id < 3"), parts=4).toPandas()
    assert three[three.component <= 2].whitened.notna().all() and three[three.component > 2].whitened.isna().all()
    assert three.identity_error.max() < 1e-12
    assert whitening.whiten(embeddings.where("false")).collect() == []
    assert whitening.whiten(embeddings.where("vec_id = 900")).collect() == []


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), np.r_[np.ones(10), 1 + 1e-9 * np.arange(1, 10), np.linspace(0.1, 0.9, 20)],
    np.r_[np.ones(5), 1 + 1e-13 * np.arange(1, 5), np.zeros(10)], np.zeros(6), np.r_[1e12, np.ones(20)]])
def test_refined_eigenvectors_of_clustered_eigenvalues(values):
    size = len(values)
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(size, size)))[0].astype(np.longdouble)
    q = q @ (1.5 * np.eye(size) - 0.5 * q.T @ q)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined_eigenvectors(a)
    top = max(values.max(), 1e-300)
    assert np.abs(found - np.sort(values)[::-1]).max() / top < 1e-17
    assert np.abs(a @ x - x * found).max() / top < 1e-16
    assert np.abs(x.T @ x - np.eye(size)).max() < 1e-17


def test_exact_products_of_large_entries():
    block = np.random.default_rng(3).integers(-(1 << 40), 1 << 40, size=(30, 3))
    plain = block.astype(object)
    assert (whitening.exact_products(block) == plain.T @ plain).all()


# Fingerprints

def plain_hash(text):
    value = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return value - (1 << 64) if value >= 1 << 63 else value


def plain_anchors(text, k, s):
    """(first place, k-mer) of every closed syncmer, straight from the definition."""
    out = {}
    for i in range(len(text) - k + 1):
        inner = [plain_hash(text[i + j:i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(text[i:i + k], i)
    return sorted((p, m) for m, p in out.items())


TEXTS = ["", "a", "abcd", "abcde", "hello world", "aaaaaaaaaaaaaaaaaaaa" * 5, "The quick brown fox jumps over the lazy dog, twice and once more.",
         "Ünïcödé 漢字 😀😀 and some more 😀 letters in a longer line of text 😀😀😀", "line\nline\nline\n" * 20, "word " * 13]


def test_anchors_are_the_closed_syncmers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for mers in (syncmers.LONG_MERS, syncmers.SHORT_MERS):
        rows = df.select("doc_id", syncmers.anchors(F.col("text"), mers).alias("a")).collect()
        for row in rows:
            first = {}
            for packed in row["a"]:
                place, hashed = packed & ((1 << 27) - 1), packed >> 27
                first.setdefault(hashed, place)
            assert sorted(first.values()) == [p for p, _ in plain_anchors(TEXTS[row["doc_id"]], *mers)]


def test_fingerprints_of_edited_and_next_texts(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), size=rng.integers(2, 9))) for _ in range(400)]
    texts = [*TEXTS, " ".join(rng.choice(words, size=9000)), *[" ".join(rng.choice(words, size=rng.integers(1, 300))) for _ in range(40)]]
    texts[20] = texts[21] = texts[25]
    rows = [(None, "no key"), (None, None)] + [(3 * i, t) for i, t in enumerate(texts)] + [(30, "same"), (30, "same"), (30, "same")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fingerprint string, n_chars int").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_hash(r[1] or "") if r[1] else spark.range(1).select(F.xxhash64(F.lit(""))).first()[0]))
    want = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited))
    for chunk_bytes, equal in ((1 << 30, 100), (4000, 100)):
        got = syncmers.fingerprint_documents(df, chunk_bytes=chunk_bytes).toPandas()
        key = lambda r: tuple(map(str, r))
        assert sorted([(None if np.isnan(i) else int(i), n, s) for i, n, s in zip(got.doc_id, got.n_chars, got.edited_sha256)], key=key) == sorted([w[:3] for w in want], key=key)
        # anchors of the edited text, put together from its two parts, are those of the whole
        edited = spark.createDataFrame([(w[2], w[3]) for w in want], "h string, t string").distinct()
        whole = dict(edited.select("h", syncmers.as_text(syncmers.sketch(F.col("t")), F.length("t"))).collect())
        assert (got.edited_fingerprint == got.edited_sha256.map(whole)).all()
        assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    long = got[got.n_chars > 300]
    assert long.near_edited.median() > 0.4 > 0.1 > long.near_next.median()
    same = got[got.doc_id.isin([60, 63, 75])]
    assert same.fingerprint.nunique() == 1 and got[got.doc_id == 60].near_next.item() == 1.0
    again = spark.createDataFrame(got[["fingerprint", "edited_fingerprint", "near_edited"]]).select("near_edited", syncmers.fingerprint_likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("l"))
    assert again.where("near_edited <> l").count() == 0


def test_slices_of_a_long_text_keep_every_anchor(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "SLICE", 40)
    monkeypatch.setattr(syncmers, "BLOCK", 200)
    text = "".join(np.random.default_rng(6).choice(list("abc 😀é"), size=1500))
    df = spark.createDataFrame([(text,)], "t string")
    cut = df.select(syncmers.sketch(F.col("t"), 5000)).first()[0]
    whole = df.select(syncmers._sketch(F.sort_array(syncmers.anchors(F.col("t"), syncmers.LONG_MERS)), 5000)).first()[0]
    assert cut == whole and len(cut) > 200


def test_next_row_with_many_equal_rows(spark):
    rows = [(5, "hot")] * 50 + [(None, "null")] * 20 + [(i, f"t{i}") for i in range(10, 20)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(4)
    got = syncmers.with_next(df, "k", "t", ["k", "t"], "after", chunk_bytes=10, equal_rows=5)
    pairs = sorted((str(r["k"]), str(r["after"]["k"])) for r in got.collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert pairs == sorted((str(a[0]), str(order[(i + 1) % len(order)][0])) for i, a in enumerate(order))


def test_fingerprints_of_odd_and_empty_tables(odd, empty):
    got = syncmers.fingerprint_documents(odd).toPandas()
    assert len(got) == odd.count() and got.near_edited.between(0, 1).all()
    assert got[got.doc_id.isin([1, 2])].fingerprint.tolist() == ["00000000"] * 2
    assert syncmers.fingerprint_documents(empty).collect() == []


def test_fingerprints_are_native(spark):
    from quietwave.llm.queries import QUERIES

    plan = QUERIES["op13_document_fingerprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
