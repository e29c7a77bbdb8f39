"""Maximal repeats across a corpus: common-prefix intervals of an enhanced suffix array, kept where what stands before them differs.

How it is spread out. A repeat of MIN_TOKENS tokens holds a seed, the least of its SEED-token hashes, in every copy; so only tokens near a
seed that occurs twice can be in a repeat. Of these, windows of MIN_TOKENS tokens that occur twice are kept, and those that follow one
another in a document make a run. Equal runs become one with a list of places. Runs that share a window are in one component, and each
partition sorts the suffixes of the runs of its components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._state import drop, map_rows, written
from ._vec import Powers, U, chunks, mix, sliding_argmin, span_hash, token_bounds, window_hash

#: Least length of a repeat, and of a seed, in tokens.
MIN_TOKENS = 50
SEED = 16
#: Windows that a task sorts the suffixes of, but for those of one component.
WINDOWS = 1 << 20
#: Rows of a batch that a function yields.
ROWS = 1 << 16


def _tokens(data: np.ndarray, off: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, tok = token_bounds(data, off)
    return span_hash(data, starts, ends, pw), tok, np.repeat(np.arange(len(off) - 1), np.diff(tok))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _np(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, sub, text): sub tells texts of one key apart."""
    t = F.col(text).cast("string")
    return docs.filter(F.col(key).isNotNull() & t.isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.shiftright(F.xxhash64(t), 32).cast("bigint").alias("sub"), t.alias("text"))


def _seeds(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(h, doc_id, place): the least hash of each window; place is sub * 2**32 + first token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                h, tok, doc = _tokens(data, off, pw)
                grams = window_hash(h, seed, pw)
                at = sliding_argmin(grams, k - seed + 1)
                p = np.arange(len(at))
                at = at[p + k <= tok[1:][doc[p]]]
                at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
                d = doc[at]
                place = (_np(part.column(1))[d] << 32) + (at - tok[d])
                yield pa.record_batch([_long(grams[at]), pa.array(_np(part.column(0))[d]), pa.array(place)], ["h", "doc_id", "place"])

    return docs.mapInArrow(run, "h bigint, doc_id bigint, place bigint")


def _repeated(rows: DataFrame, *, named: bool = False) -> DataFrame:
    """Rows (h, doc_id, place) whose h is in another row too; the same row twice counts once. Streams over sorted partitions.

    With `named`, rows have a second hash c besides, both have to agree, and h becomes a name that no other pair of hashes has: the number of
    the partition and of the pair within it.
    """
    by = ["h", "c"] if named else ["h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last = None  # of the open group: its first row, and whether it is known to repeat
        known = False
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            h, d, p = (_np(batch.column(batch.schema.get_field_index(c))) for c in ("h", "doc_id", "place"))
            c = _np(batch.column(batch.schema.get_field_index("c"))) if named else np.zeros(len(h), np.int8)
            go_on = last is not None and h[0] == last[0] and c[0] == last[3]
            if go_on:
                h, d, p, c = (np.r_[np.array([x], v.dtype), v] for x, v in zip(last, (h, d, p, c)))
            edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            size = np.diff(np.r_[edge, len(h)])
            first = np.repeat(edge, size)
            many = np.logical_or.reduceat((d != d[first]) | (p != p[first]), edge)
            many[0] |= go_on and known
            keep = np.repeat(many, size)
            if not go_on:
                serial += 1
            elif known:
                keep[0] = False  # given out before
            name = serial + np.repeat(np.arange(len(edge)), size) if named else h
            serial += len(edge) - 1
            if not many[-1]:
                keep[edge[-1] :] = False
            last, known = (h[edge[-1]], d[edge[-1]], p[edge[-1]], c[edge[-1]]), bool(many[-1])
            if keep.any():
                yield pa.record_batch([pa.array(v[keep]) for v in (name, d, p)], ["h", "doc_id", "place"])

    return rows.repartition("h").sortWithinPartitions(*by).mapInArrow(run, "h bigint, doc_id bigint, place bigint")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, z): the texts for a shuffle, compressed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [pack.compress(t.as_buffer()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["doc_id", "sub", "z"])

    return docs.mapInArrow(run, "doc_id bigint, sub bigint, z binary")


def unpacked(batches: Iterator[pa.RecordBatch], at: int = 2) -> Iterator[pa.RecordBatch]:
    """The batches, some rows at a time, with the texts in place of their compressed form."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [unpack.decompress(z.as_buffer()) for z in part.column(at)]
            yield part.set_column(at, "text", pa.array(texts, pa.large_binary()))


def _listed(seeds: DataFrame) -> DataFrame:
    """(doc_id, sub, at): the first tokens of each text's seeds."""
    return seeds.withColumn("sub", F.shiftright("place", 32)).groupBy("doc_id", "sub").agg(F.collect_list((F.col("place") - F.shiftleft("sub", 32)).cast("int")).alias("at"))


def _windows(docs: DataFrame, listed: DataFrame, k: int, seed: int) -> DataFrame:
    """(h, c, doc_id, place) of the windows of k tokens that hold a seed; c is another hash of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        for batch in unpacked(batches):
            for part, data, off in chunks(batch, "text"):
                h, tok, doc = _tokens(data, off, pw)
                hashes = window_hash(h, k, pw)
                checks = window_hash(mix(h ^ U(0x9FB21C651E98DF25)), k, pw) >> U(32)
                at = part.column(3)
                owner = np.repeat(np.arange(len(at)), _np(at.value_lengths()))
                s = _np(at.flatten()) + tok[owner]
                mark = np.zeros(len(h) + 2, np.int32)
                np.add.at(mark, np.maximum(tok[owner], s - (k - seed)), 1)
                np.add.at(mark, s + 1, -1)
                p = np.flatnonzero(np.cumsum(mark)[: len(hashes)] > 0)
                p = p[p + k <= tok[1:][doc[p]]]
                d = doc[p]
                place = (_np(part.column(1))[d] << 32) + (p - tok[d])
                ids = _np(part.column(0))[d]
                for a in range(0, len(p), ROWS):
                    b = slice(a, a + ROWS)
                    yield pa.record_batch([_long(hashes[p[b]]), pa.array(checks[p[b]].astype(np.uint32).view(np.int32)), pa.array(ids[b]), pa.array(place[b])], ["h", "c", "doc_id", "place"])

    return _packed(docs).join(listed, ["doc_id", "sub"]).select("doc_id", "sub", "z", "at").mapInArrow(run, "h bigint, c int, doc_id bigint, place bigint")


def _runs(windows: DataFrame) -> DataFrame:
    """(run, n, doc_id, place, seq): windows that follow one another. seq has their hashes, only where a task meets that run first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw, seen = Powers(), set()
        rest = [np.zeros(0, np.int64)] * 3

        def out(h: np.ndarray, d: np.ndarray, p: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            size = np.diff(edge)
            a, q = pw.upto(len(h) + 1)
            total = np.zeros(len(h) + 1, U)
            np.cumsum(mix(h.view(U)) * a[: len(h)], out=total[1:], dtype=U)
            name = mix((total[edge[1:]] - total[edge[:-1]]) * q[edge[:-1]] + size.astype(U)).view(np.int64)
            seq = []
            for r, x, y in zip(name.tolist(), edge[:-1].tolist(), edge[1:].tolist()):
                seq.append(None if r in seen else h[x:y].tobytes())
                seen.add(r)
            return pa.record_batch([pa.array(name), pa.array(size.astype(np.int32)), pa.array(d[edge[:-1]]), pa.array(p[edge[:-1]]), pa.array(seq, pa.binary())], ["run", "n", "doc_id", "place", "seq"])

        for batch in batches:
            h, d, p = (np.concatenate([r, _np(batch.column(i))]) for i, r in enumerate(rest))
            if not len(h):
                continue
            new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])]
            h, d, p = h[new], d[new], p[new]
            edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
            if len(edge) > 1:
                yield out(h, d, p, edge)
            rest = [h[edge[-1] :], d[edge[-1] :], p[edge[-1] :]]
        if len(rest[0]):
            yield out(*rest, np.array([0, len(rest[0])]))

    return windows.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(run, "run bigint, n int, doc_id bigint, place bigint, seq binary")


def _edges(runs: DataFrame) -> DataFrame:
    """(a, b) of runs that share a window: each with the one before it among the window's runs."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq in zip(_np(batch.column(0)), batch.column(1)):
                h = np.unique(np.frombuffer(seq.as_buffer(), np.int64))
                yield pa.record_batch([pa.array(h), pa.array(np.full(len(h), name))], ["h", "run"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, r = _np(batch.column(0)), _np(batch.column(1))
            if last is not None:
                h, r = np.r_[last[0], h], np.r_[last[1], r]
            last = h[-1:], r[-1:]
            both = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] != r[:-1]))
            pairs = np.unique(np.stack([r[both], r[both + 1]], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = runs.select("run", "seq").mapInArrow(spread, "h bigint, run bigint")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(link, "a bigint, b bigint").distinct()


def suffix_array(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of all sequences: places sorted, common prefix with the one before, symbol by place, sequence by place, items left by place.

    Prefix doubling; the end of a sequence is less than any item. The ranks of each round are kept and give the common prefixes.
    """
    size = np.array([len(s) for s in seqs])
    flat = np.concatenate(seqs)
    n = len(flat)
    owner = np.repeat(np.arange(len(seqs)), size)
    left = np.cumsum(size)[owner] - np.arange(n)
    _, rank = np.unique(flat, return_inverse=True)
    rank = rank.astype(np.int64)
    levels, step = [rank.astype(np.int32)], 1
    while step < size.max():
        ahead = np.zeros(n, np.int64)
        ok = np.flatnonzero(left > step)
        ahead[ok] = rank[ok + step] + 1
        kinds, after = np.unique(rank * (n + 1) + ahead, return_inverse=True)
        same = len(kinds) == rank.max() + 1
        rank = after.astype(np.int64)
        step *= 2
        if same:
            break
        levels.append(rank.astype(np.int32))
    order = np.argsort(rank, kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    most = np.minimum(left[i], left[j])
    lcp = np.where(rank[i] == rank[j], most, 0)
    live = np.flatnonzero(rank[i] != rank[j])
    for up in range(len(levels) - 1, -1, -1):
        inside = live[lcp[live] < most[live]]
        eq = inside[levels[up][i[inside]] == levels[up][j[inside]]]
        lcp[eq] = np.minimum(lcp[eq] + (1 << up), most[eq])
        go = eq[lcp[eq] < most[eq]]
        i[go] += 1 << up
        j[go] += 1 << up
    return order, np.r_[0, lcp], levels[0].astype(np.int64), owner, left


MANY = -(1 << 62)


def intervals(lcp: list[int], before: list[int], alone: list[int]) -> list[tuple[int, int, int]]:
    """(first, last, length) of the common-prefix intervals of one class whose members are preceded by different items.

    before: what stands before each member, MANY if several things do; alone: length of the interval that a member makes by itself, or 0.
    """
    n = len(before)
    out = [(r, r, a) for r, a in enumerate(alone) if a > max(lcp[r], lcp[r + 1] if r + 1 < n else 0)]
    stack: list[list[int]] = [[0, 0, before[0]]]
    for r in range(1, n + 1):
        depth = lcp[r] if r < n else 0
        low, cur = r - 1, before[r - 1]
        while depth < stack[-1][0]:
            d, low, b = stack.pop()
            cur = cur if b == cur else MANY
            if cur == MANY:
                out.append((low, r - 1, d))
        if depth > stack[-1][0]:
            stack.append([depth, low, cur])
        elif stack[-1][2] != cur:
            stack[-1][2] = MANY
    return out


def earlier(lcp: list[int], key: list[int]) -> list[int]:
    """Longest prefix that each member shares with one of a lesser key."""
    n = len(key)
    best = [0] * n
    for step in (1, -1):
        stack: list[tuple[int, int]] = []
        for r in range(n) if step == 1 else range(n - 1, -1, -1):
            m = (lcp[r] if step == 1 else lcp[r + 1]) if stack else 0
            while stack and key[stack[-1][0]] > key[r]:
                m = min(m, stack.pop()[1])
            if stack:
                best[r] = max(best[r], m)
            stack.append((r, m))
    return best


MEMBER = "repeat_id bigint, rank int, run bigint, shift int, whole int, length int, dup int, first_doc bigint, first_place bigint, groups array<struct<length:int,last_rank:int>>"
GROUPS = pa.list_(pa.struct([("length", pa.int32()), ("last_rank", pa.int32())]))


def _members(runs: DataFrame, k: int, least: int) -> DataFrame:
    """The members of each class whose members are preceded by different items, with the intervals that begin at each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        names, count, doc, place = (np.concatenate([_np(b.column(i)) for b in held]) for i in range(4))
        seqs = [np.frombuffer(s.as_buffer(), np.int64) for b in held for s in b.column(4)]
        order, lcp, symbol, owner, left = suffix_array(seqs)
        flat = np.concatenate(seqs)
        shift = np.array([len(s) for s in seqs])[owner] - left
        copied = (shift == 0) & (count[owner] > 1)
        before = np.where(copied, MANY, np.where(shift > 0, np.r_[0, symbol[:-1]], -1 - owner))
        alone = np.where(copied, left, 0)
        age = np.empty(len(flat), np.int64)
        age[np.lexsort((place[owner] + shift, doc[owner]))] = np.arange(len(flat))
        edge = np.flatnonzero(lcp == 0)
        ends = np.r_[edge[1:], len(order)]
        b = before[order]
        low = np.minimum.reduceat(b, edge)
        differ = (low != np.maximum.reduceat(b, edge)) | (low == MANY)
        at, rank, length, dup, begun = [], [], [], [], []

        def give() -> Iterator[pa.RecordBatch]:
            i = np.array(at, np.int64)
            o, d = owner[i], np.array(dup, np.int64)
            cols = [flat[i], rank, names[o], shift[i], left[i] + k - 1, length, np.where(d > 0, d + k - 1, 0), doc[o], place[o]]
            kinds = [np.int64, np.int32, np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int64]
            yield pa.record_batch([*[pa.array(np.asarray(c).astype(t)) for c, t in zip(cols, kinds)], pa.array(begun, GROUPS)], [x.split()[0] for x in MEMBER.split(", ")])
            for c in (at, rank, length, dup, begun):
                c.clear()

        for a, z in zip(edge[differ].tolist(), ends[differ].tolist()):
            rows = order[a:z]
            near = lcp[a:z].tolist()
            deep = np.zeros(z - a, np.int64)
            starts: list[list] = [[] for _ in range(z - a)]
            for first, last, d in sorted(intervals(near, before[rows].tolist(), alone[rows].tolist()), key=lambda g: g[2]):
                deep[first : last + 1] = d + k - 1
                starts[first].append({"length": d + k - 1, "last_rank": last})
            at += rows.tolist()
            rank += range(z - a)
            length += deep.tolist()
            dup += earlier(near, age[rows].tolist())
            begun += starts
            if len(at) >= ROWS:
                yield from give()
        if at:
            yield from give()

    parts = max(least, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a number that stays: small partitions hold little memory
    return runs.repartition(parts, "component").select("run", "count", "doc_id", "place", "seq").mapInArrow(run, MEMBER)


def _by_rank(docs: DataFrame, text: str, key: str, found) -> DataFrame:
    """What `found` gives for `docs` with its keys, of a type that is no integer, by their rank; with the keys themselves again."""
    ranks = written(docs.select(F.col(key).alias("_key")).filter("_key is not null").distinct().sort("_key").withColumn("_rank", F.monotonically_increasing_id()), "ranks")
    body = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    out = found(body.join(ranks, "_key").select(F.col("_rank").alias("doc_id"), "text"))
    names = out.columns
    named = written(out.join(ranks, out["doc_id"] == ranks["_rank"]).drop("doc_id").withColumnRenamed("_key", "doc_id").select(names), "repeats")
    drop(out, ranks)
    return named


def repeats(docs: DataFrame, *, min_tokens: int = MIN_TOKENS, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Maximal repeats of at least `min_tokens` tokens, with every place of each.

    A row is a place in a class: the suffixes that begin with the same `min_tokens` tokens (class `repeat_id`), given where different things
    stand before them. `rank` is the suffix's place in the class's sorted order (equal for copies of the same run). The class's maximal
    repeats are the intervals of that order: a row's `groups` has each one that begins at its rank as (length in tokens, last rank), and all
    rows of the class from the rank to the last rank are its places. `length` is the longest repeat at this place; `dup_length` is how much
    from here on has an earlier place, by (doc_id, start), and 0 for the first. `start` counts tokens (white space apart) from 0. A repeat
    within one document counts as between two. So the rows grow with the places and not with their pairs. Tokens are those of `_vec`, and
    passages are held equal if two hashes of theirs, of 96 bits, are; repeat_id is a number of one call.

    Rows with a null key or text take no part; repeated rows count once; texts of fewer tokens can't repeat. Other columns play no part. A
    key that is no integer goes by its rank, at the price of one more shuffle of the texts, and keeps its type.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        return _by_rank(docs, text, key, lambda some: repeats(some, min_tokens=min_tokens, seed=seed))
    docs = _keyed(docs, text, key)
    listed = written(_listed(_repeated(_seeds(docs, min_tokens, seed))), "seeds")
    runs = written(_runs(_repeated(_windows(docs, listed, min_tokens, seed), named=True)), "runs")
    drop(listed)
    distinct = runs.groupBy("run").agg(F.count("*").cast("int").alias("count"), F.min(F.struct("doc_id", "place")).alias("first"), F.max("seq").alias("seq"))
    distinct = written(distinct.select("run", "count", "first.doc_id", "first.place", "seq"), "distinct-runs")
    groups = components(_edges(distinct), "a", "b")
    windows = distinct.agg(F.sum(F.length("seq"))).first()[0] or 0
    members = _members(distinct.join(groups.withColumnRenamed("node", "run"), "run", "left").withColumn("component", F.coalesce("component", "run")), min_tokens, math.ceil(windows / 8 / WINDOWS))
    first = (F.col("doc_id") == F.col("first_doc")) & (F.col("place") == F.col("first_place"))
    start = (F.col("place") - F.shiftleft(F.shiftright("place", 32), 32)).cast("int") + F.col("shift")
    out = members.join(runs.select("run", "doc_id", "place"), "run").select(
        "repeat_id", "rank", "doc_id", start.alias("start"), "length", F.when(first, F.col("dup")).otherwise(F.col("whole")).alias("dup_length"), "groups", F.shiftright("place", 32).alias("text_key")
    )
    out = written(out, "repeats")
    drop(runs, distinct, groups)
    return out


def drop_repeats(docs: DataFrame, *, min_tokens: int = MIN_TOKENS, seed: int = SEED, text: str = "text", key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """`docs` without the tokens that `repeats` finds at an earlier place, with the length column set anew where there is one.

    Of each repeat the first place stays, by (doc_id, start). A document of which no token is left goes; one without repeats, with a null
    key or a null text stays as it is.
    """
    found = repeats(docs, min_tokens=min_tokens, seed=seed, text=text, key=key)
    per = found.filter("dup_length > 0").groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_sub")).agg(F.collect_set(F.struct("start", "dup_length")).alias("_spans"))
    per = written(per, "spans")
    drop(found)
    sub = F.shiftright(F.xxhash64(docs[text].cast("string")), 32).cast("bigint")
    joined = docs.join(per, (docs[key] == per["_doc"]) & (sub == per["_sub"]), "left").select(*[docs[f"`{c}`"] for c in docs.columns], per["_spans"])
    at = docs.columns.index(text)
    has = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:-1])
            spans = batch.column(len(cols))
            hit = np.flatnonzero(~_np(spans.is_null()))
            if not len(hit):
                yield pa.record_batch(cols, batch.schema.names[:-1])
                continue
            texts = cols[at].to_pylist()
            counts = cols[has].to_pylist() if has is not None else None
            gone = np.zeros(len(texts), bool)
            for i in hit.tolist():
                texts[i] = cut(texts[i], [(s["start"], s["dup_length"]) for s in spans[i].as_py()])
                gone[i] = not texts[i]
                if counts:
                    counts[i] = len(texts[i])
            cols[at] = pa.array(texts, cols[at].type)
            if counts:
                cols[has] = pa.array(counts, cols[has].type)
            yield pa.record_batch(cols, batch.schema.names[:-1]).filter(pa.array(~gone))

    return map_rows(joined, run, docs.schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans of (first token, tokens) and the white space after each; at the text's end, before it."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, _, _ = token_bounds(data, np.array([0, len(data)]))
    mark = np.zeros(len(starts) + 1, np.int64)
    for s, n in spans:
        mark[s] += 1
        mark[min(s + n, len(starts))] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    if gone.all():
        return ""
    first = np.r_[0, starts[1:]] if len(starts) else starts
    keep = np.repeat(~gone, np.diff(np.r_[first, len(data)]))
    out = data[keep].tobytes().decode()
    return out.rstrip() if gone[-1] else out
