import numpy as np
import pytest

from cueweave.llm import suffix_repeats as S


def brute(docs, k):
    """All maximal repeats by definition: (length, places), places as (doc, start)."""
    toks = {d: t.split() for d, t in docs}
    out = set()
    longest = max(len(t) for t in toks.values())
    for n in range(k, longest + 1):
        by = {}
        for d, t in toks.items():
            for i in range(len(t) - n + 1):
                by.setdefault(tuple(t[i : i + n]), []).append((d, i))
        many = {w: p for w, p in by.items() if len(p) > 1}
        if not many:
            break
        for p in many.values():
            left = [toks[d][i - 1] if i else ("edge", d) for d, i in p]
            right = [toks[d][i + n] if i + n < len(toks[d]) else ("edge", d) for d, i in p]
            if len(set(left)) > 1 and len(set(right)) > 1:
                out.add((n, tuple(sorted(p))))
    return out


def found(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.repeat_id, []).append(r)
    out = set()
    for rows in by.values():
        for r in rows:
            for g in r.groups:
                out.add((g.length, tuple(sorted((x.doc_id, x.start) for x in rows if r.rank <= x.rank <= g.last_rank))))
    return out


def corpus(seed, n, words=5):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice([f"v{i}" for i in range(words)], rng.integers(5, 40))) for _ in range(n // 2)]
    out = list(base)
    while len(out) < n:
        a, b = rng.choice(base, 2)
        w = a.split() + b.split()[3:9] + a.split()[2:]
        if rng.random() < 0.5:
            w[int(rng.integers(len(w)))] = "edit"
        out.append(" ".join(w))
    out += [base[0], base[0], "p q " * 12, "p q " * 12 + "r", "x y z w " * 9]
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_maximal_repeats_with_all_places(spark, seed):
    docs = corpus(seed, 24)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(S.repeats(df, min_tokens=6, seed=3)) == brute(docs, 6)


def removed(docs, k):
    """Tokens left when each window of k tokens that has an earlier place goes."""
    first, gone = {}, {}
    for d, t in docs:
        w = t.split()
        gone[d] = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first.setdefault(tuple(w[i : i + k]), (d, i)) != (d, i):
                gone[d][i : i + k] = [True] * k
    return {d: [x for x, g in zip(t.split(), gone[d]) if not g] for d, t in docs}


@pytest.mark.parametrize("seed", [4, 5])
def test_cut_leaves_the_first_place(spark, seed):
    docs = corpus(seed, 30)
    df = spark.createDataFrame([(d, t, len(t), "s") for d, t in docs], "doc_id bigint, text string, n_chars bigint, start string")
    got = S.drop_repeats(df, min_tokens=6, seed=3)
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert {d: r.text.split() for d, r in rows.items()} == {d: w for d, w in removed(docs, 6).items() if w}
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 3, n) for n in (1, 2, 40, 7, 90)] + [np.zeros(33, np.int64), np.zeros(20, np.int64)]
    order, lcp, symbol, owner, left = S.suffix_array(seqs)
    flat = np.concatenate(seqs)
    tail = lambda i: tuple(flat[i : i + left[i]])
    assert [tail(i) for i in order] == sorted(tail(i) for i in range(len(flat)))
    for a, b, n in zip(order, order[1:], lcp[1:]):
        x, y = tail(a), tail(b)
        assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_earlier_against_definition():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        lcp, key = [0, *rng.integers(0, 5, n - 1).tolist()], rng.permutation(n).tolist()
        want = [max([0, *[min(lcp[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if key[j] < key[i]]]) for i in range(n)]
        assert S.earlier(lcp, key) == want


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(60))
    data = [(1, "a " + p + " b", 0), (1, "a " + p + " b", 0), (2, p, 1), (3, None, 2), (None, p, 3), (5, "", 4), (6, "short text", 5), (7, "c " + p, None), (8, "z " * 30000, 6)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, rank int")
    got = S.repeats(df)
    rows = got.collect()
    places = {(r.doc_id, r.start, r.length) for r in rows if r.doc_id != 8}
    assert places == {(1, 1, 60), (2, 0, 60), (7, 1, 60)}
    assert {(r.doc_id, r.dup_length) for r in rows if r.doc_id != 8} == {(1, 0), (2, 60), (7, 60)}
    assert any(r.doc_id == 8 for r in rows)
    left = {(r.doc_id, r.text if r.text is None else len(r.text.split())) for r in S.drop_repeats(df).collect()}
    assert left == {(1, 62), (3, None), (None, p and 60), (5, 0), (6, 2), (7, 1), (8, 1)}
    assert S.repeats(df.limit(0)).count() == 0 and S.drop_repeats(df.limit(0)).count() == 0


def test_keys_of_other_types_and_scripts_without_spaces(spark):
    rng = np.random.default_rng(9)
    signs = "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 3000, 320))
    data = [("b", "前" + signs + "后"), ("a", "左" + signs), ("c", signs[:100]), (None, signs)]
    df = spark.createDataFrame(data, "doc_id string, text string")
    got = {(r.doc_id, r.start, r.length, r.dup_length) for r in S.repeats(df).collect()}
    assert got == {("a", 1, 320, 0), ("b", 1, 320, 320), ("c", 0, 100, 100)}
    left = {r.doc_id: r.text for r in S.drop_repeats(df).collect()}
    assert left == {"a": "左" + signs, "b": "前后", None: signs}


def test_windows_of_equal_first_hash_are_told_apart(spark):
    rows = spark.createDataFrame([(5, 1, 1, 0), (5, 1, 2, 0), (5, 2, 3, 0), (5, 2, 3, 0), (5, 3, 4, 0), (5, 3, 4, 7), (9, 0, 5, 0), (9, 0, 6, 0)], "h bigint, c int, doc_id bigint, place bigint")
    got = S._repeated(rows, named=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.h, set()).add((r.doc_id, r.place))
    assert sorted(map(sorted, by.values())) == [[(1, 0), (2, 0)], [(4, 0), (4, 7)], [(5, 0), (6, 0)]]


def test_a_chain_of_runs_in_one_component(spark):
    n = 4000
    words = [f"w{i}" for i in range(n + 40)]
    data = [(i, " ".join(words[i : i + 12])) for i in range(0, n, 5)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = S.repeats(df, min_tokens=6, seed=3).collect()
    assert {r.length for r in got} == {7} and {r.doc_id for r in got} == {d for d, _ in data}
    assert len(got) == 2 * (len(data) - 1)
