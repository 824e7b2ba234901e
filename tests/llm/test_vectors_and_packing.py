"""Clusters, whitening and packing against plain versions, and on nulls, ties, repeats, empty and clashing input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geochange.llm import clustering, packing, queries, whitening
from tests.oracle import compare

D = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


def _vectors(n, d, seed, clumps=5):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(clumps, d))
    return [(int(i), (at[i % clumps] + 0.3 * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]


NAN, INF = float("nan"), float("inf")


def _with_odd(rows, d):
    """Vectors to leave out, rows that repeat, a null vec_id, equal vectors of other ids."""
    odd = [(900, None), (901, []), (902, [1.0] * (d - 1)), (903, [1.0] * (d - 1) + [None]), (904, [1.0] * (d - 1) + [NAN]), (905, [INF] + [1.0] * (d - 1)), (906, [-INF] + [0.5] * (d - 1))]
    return rows + odd + [rows[3], rows[3], (None, rows[5][1]), (800, rows[3][1]), (801, [0.0] * d)]


# --- clusters ---------------------------------------------------------------------------------------------------


def _plain_clusters(rows, o):
    kept = [(i, [math.floor(o.scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == o.dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{o.seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    c = [x for _, x in order[: o.k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(c))
    for _ in range(o.rounds):
        own = collections.defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        c = [[sum(v) // len(own[k]) for v in zip(*own[k], strict=True)] if k in own else c[k] for k in range(len(c))]
    last = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = collections.Counter()
    for _, k, d in last:
        inertia[k] += d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in last), key=repr)


@pytest.mark.parametrize(("n", "opts"), [(150, clustering.Clustering(k=12, rounds=3, dims=6, scale=16)), (60, clustering.Clustering(k=9, rounds=5, dims=2, scale=3, pivots=4)), (40, clustering.Clustering(k=100, rounds=2, dims=5)), (50, clustering.Clustering(k=6, rounds=2, dims=1, scale=2, pivots=3))])
def test_clusters(spark, n, opts):
    rows = _with_odd(_vectors(n, opts.dims, n), opts.dims)
    df = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("cluster", "x", "squares", "distance", "label")]).repartition(3)
    got = clustering.cluster(df, opts)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_clusters(rows, opts)


def test_clusters_of_little(spark):
    df = spark.createDataFrame(_vectors(3, 64, 1), VECTORS)
    assert clustering.cluster(df.where("false")).count() == 0
    assert clustering.cluster(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    one = clustering.cluster(df.limit(1)).first()
    assert (one["cluster"], one["distance"], one["inertia"]) == (0, 0, 0)
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(50)], VECTORS)  # all centroids are one: no simplex but a point
    assert {tuple(r)[1:5] for r in clustering.cluster(same).collect()} == {(0, 0, 0, 0)}
    huge = spark.createDataFrame([(1, [1e30] * 64)], VECTORS)
    with pytest.raises(Exception, match="components must be within"):
        clustering.cluster(huge).count()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.integers(1, 9))
def test_bounds_hold(seed, d, pivots):
    rng = np.random.default_rng(seed)
    spread = int(rng.choice([2, 300, clustering.MOST]))
    x, c = (rng.integers(-spread, spread + 1, size=(n, d)) for n in (40, 15))
    simplex = clustering.Simplex.among(c, pivots)
    low, high = simplex.bounds(simplex.squares(x), c)
    true = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
    found, far, compared = clustering.nearest(x, simplex.squares(x), c, simplex)
    assert (found == true.argmin(axis=1)).all() and (far == true.min(axis=1)).all() and compared <= true.size


def test_bounds_leave_out_far_centroids():
    rows = np.array([v for _, v in _vectors(2000, 16, 3, clumps=30)])
    x = np.floor(256 * rows).astype(np.int64)
    simplex = clustering.Simplex.among(x[:30], 12)
    assert clustering.nearest(x, simplex.squares(x), x[:30], simplex)[2] < 0.3 * 30 * len(x)


def test_clusters_sql(spark):
    assert compare(queries.op11_centroid_clustering(spark, D), queries.oracle_sql()["op11_centroid_clustering"], D) == ""


# --- whitening --------------------------------------------------------------------------------------------------


def _plain_whitening(kept, o):
    x = [[math.floor(o.scale * float(c)) + o.shift for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    z = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    e, v = np.linalg.eigh(np.cov(z.T, bias=True).reshape(z.shape[1], -1))
    order = np.argsort(-e)[: o.components]
    return n, deviation, (z @ v / np.sqrt(np.maximum(e, 1e-300)))[:, order], e[order] / e.sum()


@pytest.mark.parametrize(("n", "d", "opts"), [(120, 6, whitening.Whitening(block=16)), (200, 40, whitening.Whitening(block=32, slab=60)), (90, 1, whitening.Whitening(components=3))])
def test_whitening(spark, n, d, opts):
    rows = _with_odd(_vectors(n, d, n), d)
    kept = [r for r in rows if r[1] is not None and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]
    df = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("index", "place", "n", "white", "label", "task")]).repartition(5)
    got = whitening.whiten(df, opts)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    total, deviation, white, share = _plain_whitening(kept, opts)
    k = min(d, opts.components)
    assert len(found) == len(kept) * k and {r["n"] for r in found} == {total}
    assert {r["identity_error"] for r in found}.pop() < 1e-9 and len({r["identity_error"] for r in found}) == 1
    for c in range(k):
        own = [r for r in found if r["component"] == c + 1]
        assert abs(own[0]["explained"] / share[c] - 1) < 1e-9
        a = sorted((r["deviation"], r["whitened"]) for r in own)
        tries = [sorted((dev, s * w) for dev, w in zip(deviation, white[:, c].tolist(), strict=True)) for s in (1, -1)]
        assert [x for x, _ in a] == [x for x, _ in tries[0]]
        assert any(np.allclose([w for _, w in a], [w for _, w in t], atol=1e-8) for t in tries)


def test_whitening_of_little(spark):
    df = spark.createDataFrame(_vectors(3, 4, 1), VECTORS)
    for none in (df.where("false"), df.limit(1), df.withColumn("embedding", F.lit(None).cast("array<float>")), df.withColumn("embedding", F.array().cast("array<float>")), spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], VECTORS)):
        assert whitening.whiten(none).count() == 0
    # Three vectors span a plane: two components have variance, the others can't be whitened.
    assert {r[0] for r in whitening.whiten(df).select("component").collect()} == {1, 2}
    far = spark.createDataFrame([(i, [1e14 * (i % 2), float(i)]) for i in range(9)], VECTORS)
    assert {r[0] for r in whitening.whiten(far).select("deviation").collect()} == {None}


def test_whitening_query(spark):
    got = queries.op12_embedding_whitening(spark, D)
    assert got.count() == 500 * 32 and got.agg(F.max("identity_error")).first()[0] < 1e-9


# --- packing ----------------------------------------------------------------------------------------------------


def _plain_plan(lengths, capacity):
    """A bin at a time, over the pieces themselves."""
    left, out = sorted(lengths), []
    while left:
        own, gap = [], capacity
        for k in sorted(set(left), reverse=True):
            while k <= gap and own.count(k) < left.count(k):
                own.append(k)
                gap -= k
        rest = left.copy()
        for k in own:
            rest.remove(k)
        small = min(own)
        twos = [(a + b, a, b) for i, a in enumerate(rest) for b in rest[:i] if a + b <= gap + small] if gap else []
        if twos and max(twos)[0] > small:
            _, a, b = max(twos)
            own.remove(small)
            own += [a, b]
        for k in own:
            left.remove(k)
        out.append(sorted(own, reverse=True))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_is_that_of_single_bins(case):
    capacity, lengths = case
    bins = packing.plan(collections.Counter(lengths), capacity)
    assert [b for own, n in bins for b in [own] * n] == _plain_plan(lengths, capacity)
    assert collections.Counter(k for own, n in bins for k in own * n) == collections.Counter(lengths)


def test_plan_fills_bins():
    rng = random.Random(5)
    lengths = [min(2048, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(20_000)]
    bins = packing.plan(collections.Counter(lengths), 2048)
    assert sum(n for _, n in bins) <= math.ceil(sum(lengths) / 2048) + 1
    # A thousand times the pieces, and hardly a larger plan.
    many = packing.plan({k: 1000 * n for k, n in collections.Counter(lengths).items()}, 2048)
    assert sum(n for _, n in many) <= 1.00001 * sum(lengths) * 1000 / 2048 + 1 and len(many) < 5 * len(bins)
    assert packing.plan({}, 2048) == []
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


@pytest.mark.parametrize("capacity", [2048, 16, 1])
def test_packing(spark, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    long = " ".join(f"w{i % 977}" for i in range(3000))
    rng = random.Random(2)
    texts = ["Hello there, World", "Hello there, World", None, "", long, long, "ÀÉ ß İ 日本 🙂", *(" ".join(["word"] * rng.randrange(60)) for _ in range(80))]
    rows = [(None if i % 13 == 5 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("length", "task", "n", "sequence_id", "number")]).repartition(3)
    packed = packing.pack(df, queries.tokenizer_file(), packing.Packing(capacity))
    got = packed.collect()
    want = collections.Counter()
    for d, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[d, i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == sum(n for _, n in packing.plan(collections.Counter(r["length"] for r in got), capacity))
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / capacity) + (capacity > 1)
    made = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in got:
        assert made[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "don't", "ΣΑΣ", "e\u0301", "½", "\u00a0", "हिन्दी", "x9", "  "]), max_size=8).map("".join))
def test_ids_of_words_are_those_of_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    got = np.frombuffer(packing.packed_ids(text, packing._coder(queries.tokenizer_file())), "<u4").tolist()
    assert got == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, queries.tokenizer_file()).count() == 0
    with pytest.raises(ValueError):
        packing.Packing(0)
