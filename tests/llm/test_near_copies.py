import numpy as np
import pytest
from pyspark.sql import types as T

from cueweave.llm import near_copies as N
from cueweave.llm._graph import components
from cueweave.llm._vec import U, Powers

WORDS = [f"w{i}" for i in range(4000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


def edited(rng, s, k):
    w = s.split()
    for i in rng.choice(len(w), k, replace=False):
        w[i] = str(rng.choice(WORDS))
    return " ".join(w)


def rows(spark, data, extra=""):
    return spark.createDataFrame(data, "doc_id bigint, text string" + extra)


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [text(rng, 200) for _ in range(150)]
    data = [(i, t) for i, t in enumerate(base)]
    for g in range(12):
        for _ in range(g + 1):
            data.append((len(data), edited(rng, base[g], 4)))
    got = {r.doc_id: r.group_id for r in N.near_copies(rows(spark, data)).collect()}
    fp, some = N.fingerprints(np.frombuffer("".join(t for _, t in data).encode(), np.uint8), np.r_[0, np.cumsum([len(t.encode()) for _, t in data])], Powers())
    assert some.all()
    near = [(a, b) for a in range(len(data)) for b in range(a) if np.bitwise_count(fp[a] ^ fp[b]).sum() <= N.DISTANCE]
    met = sum(got.get(a, -1) == got.get(b, -2) for a, b in near)
    assert near and met >= 0.9 * len(near)
    assert set(got) <= {x for p in near for x in p}
    for g in range(12):
        assert got[g] == g


def test_oversized_buckets_split_and_equal_keys_are_compared():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, (300, 4), dtype=np.int64).view(U)
    fp[:40] = fp[0]
    fp[np.arange(40), 3] ^= U(1) << np.arange(40).astype(U)
    keys = N.sampled_keys(fp, 8, 3)
    t = np.repeat(np.arange(8), 300)
    i, j = N.bucket_pairs(t, keys.reshape(-1), np.tile(fp, (8, 1)), 1, 16, 60)
    got = {(min(a % 300, b % 300), max(a % 300, b % 300)) for a, b in zip(i, j)}
    want = {(a, b) for b in range(300) for a in range(b) if np.bitwise_count(fp[a] ^ fp[b]).sum() <= 60}
    assert got <= want and len(got) >= 0.9 * len(want)
    same = np.zeros(100, U)
    i, _ = N.bucket_pairs(np.zeros(100, int), same, np.repeat(fp[:1], 100, 0), 4, 8, 0)
    assert len(i) == 100 * 99 // 2


def test_recall_on_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.group_id for r in N.near_copies(docs).collect()}
    fps = N.fingerprint_table(docs).toPandas()
    ids, fp = fps.doc_id.to_numpy(), fps[N.FP].to_numpy().view(U)
    near = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(fp[:a] ^ fp[a]).sum(1) <= N.DISTANCE)]
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in near) >= 0.9 * len(near) > 0


def test_edges(spark):
    long = "a b c d e " * 30000
    data = [(None, "x y z", 1), (None, "x y z", 1), (1, None, 2), (2, "", 3), (3, "!!! ...", 4), (10, "!!! ...", 4), (11, "??", 4), (12, " \n", 4), (13, " \n", 4), (4, "x y z", 5), (4, "x y z", 5), (9, "X, y z!", 5), (5, long, 6), (6, long + "f", 7), (7, "solo", None)]
    df = rows(spark, data, ", group_id int")
    got = sorted(tuple(r) for r in N.near_copies(df).collect())
    assert got == [(3, 3, 2, True), (4, 4, 2, True), (5, 5, 2, True), (6, 5, 2, False), (9, 4, 2, False), (10, 3, 2, False)]
    left = N.drop_copies(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, d) for d in (1, 2, 3, 4, 5, 7, 11, 12, 13)] + [(True, 0)] * 2
    assert N.near_copies(df.limit(0)).count() == 0
    assert N.drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges,want", [([], {}), ([(3, 3)], {3: 3}), ([(i, i + 1) for i in range(40)] + [(100, 101), (100, None)], {**{i: 0 for i in range(41)}, 100: 100, 101: 100})])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == want


def planted(rng, n, pairs, distance):
    """Random fingerprints, the last `pairs` of which are the first ones with `distance` bits turned."""
    fp = rng.integers(0, 2**64, (n, 4), dtype=U)
    for i in range(pairs):
        fp[n - 1 - i] = fp[i]
        for bit in rng.choice(N.BITS, distance, replace=False):
            fp[n - 1 - i, bit >> 6] ^= U(1) << U(bit & 63)
    return fp


@pytest.mark.parametrize("bits", [12, 18])
def test_recall_at_the_count_of_a_large_corpus(spark, monkeypatch, bits):
    n, pairs = 1000, 400
    fp = planted(np.random.default_rng(4), n, pairs, N.DISTANCE).view(np.int64)
    monkeypatch.setattr(N, "BUCKET_MEAN", n / (2**bits - 1))  # as many bits as a corpus of 64 * 2**bits would have asked for
    fps = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fp)], "id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    got = {(r.a, r.b) for r in N.near_pairs(fps).collect()}
    assert sum((i, n - 1 - i) in got for i in range(pairs)) >= 0.9 * pairs


def test_recall_of_buckets_over_the_cap():
    n, pairs, tables = 8000, 150, 6
    fp = planted(np.random.default_rng(5), n, pairs, N.DISTANCE)
    fp[pairs : pairs + 2000] = fp[pairs]
    fp[np.arange(pairs, pairs + 2000), 0] ^= np.arange(2000, dtype=U)  # a cluster of near copies larger than the cap
    keys = N.sampled_keys(fp, tables, 3)
    bits = 1
    i, j = N.bucket_ties(np.repeat(np.arange(tables), n), keys.reshape(-1), np.tile(fp, (tables, 1)), bits, 512, N.DISTANCE, 3)
    assert (np.bitwise_count(fp[i % n] ^ fp[j % n]).sum(1) <= N.DISTANCE).all()
    pairs_got = {(int(a), int(b)) for a, b in N.tied(np.arange(n), i % n, j % n)}
    assert sum((p, n - 1 - p) in pairs_got for p in range(pairs)) >= 0.9 * pairs
    assert all((pairs, pairs + k) in pairs_got for k in range(1, 2000))


def test_first_bits_leave_recall_at_any_count():
    for n in (0, 1000, 240_000, 14_000_000, 10**10):
        bits = N.first_bits(n, N.TABLES, N.DISTANCE)
        assert 1 - (1 - N.AGAIN * N.agree(bits, N.DISTANCE)) ** N.TABLES >= 0.9


def test_a_text_that_is_nobodys_copy_stays(spark):
    data = [(3, "x y z w v"), (4, "x y z w v"), (4, "an entirely different document about ships"), (4, "an entirely different document about ships"), (5, None), (5, None)]
    left = sorted(map(str, N.drop_copies(rows(spark, data)).collect()))
    assert left == sorted(map(str, rows(spark, [data[0], data[2], data[4], data[5]]).collect()))


def test_keys_of_other_types_and_scripts_without_spaces(spark):
    rng = np.random.default_rng(6)
    signs = [chr(0x4E00 + int(i)) for i in rng.integers(0, 2000, 320)]
    other = [chr(0x4E00 + int(i)) for i in rng.integers(0, 2000, 320)]
    data = [("p-2", "".join(signs)), ("p-1", "".join(signs[:-1]) + "\u4e01"), ("uuid-a", "".join(other)), ("q", "one two\u3000three four"), ("r", "one\u00a0two three four"), ("blank", "\u3000")]
    got = N.near_copies(spark.createDataFrame(data, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.group_id, r.kept) for r in got} == {("p-1", "p-1", True), ("p-2", "p-1", False), ("q", "q", True), ("r", "q", False)}


def test_buckets_too_large_for_a_task_are_split_before_the_shuffle(spark, monkeypatch):
    n, pairs = 1500, 400
    fp = planted(np.random.default_rng(8), n, pairs, N.DISTANCE).view(np.int64)
    monkeypatch.setattr(N, "HOLD", 100)
    monkeypatch.setattr(N, "BUCKET_MEAN", n)  # few bits, so that all first buckets are too large
    fps = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fp)], "id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    got = {(r.a, r.b) for r in N.near_pairs(fps, tables=8).collect()}
    assert sum((i, n - 1 - i) in got for i in range(pairs)) >= 0.9 * pairs
    sizes = {}
    large = []
    for _ in range(2):
        sizes = {}
        for name, _, level in N.buckets(fp.view(U), 8, 6, N.DISTANCE, 7, large):
            for b in name.tolist():
                sizes[b] = sizes.get(b, 0) + 1
        large.append(np.array([b for b, k in sizes.items() if k > 20], U))
    assert len(large[0]) and max(sizes.values()) <= 20
