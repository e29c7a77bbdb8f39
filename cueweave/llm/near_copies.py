"""Near-duplicate groups by random bit sampling over SimHash fingerprints of 256 bits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._state import drop, written
from ._vec import Powers, U, chunks, mix, span_hash, token_bounds, window_hash

BITS = 256
#: Most differing bits of a near copy; about 0.74 in cosine of the sets of word pairs.
DISTANCE = 60
TABLES = 32
#: A bucket of more fingerprints than this is split by further sampled bits.
BUCKET_CAP = 512
#: Fingerprints a bucket would have at its first bits if bits were fair.
BUCKET_MEAN = 64
#: Share of the pairs at `distance` that the first bits of all tables have to bring together; that the further tables of a bucket over the
#: cap have to find again, and those of a bucket over the cap in one of these.
MEET, AGAIN, DEEPER = 0.97, 0.8, 0.95
#: A bucket of more fingerprints than HOLD is split before the shuffle, by tables of SPLIT further bits, as often as DEPTH.
HOLD, SPLIT, DEPTH = 1 << 20, 6, 3
#: Fingerprints of a bucket over the cap that all of it is compared with, so that one cluster of near copies is no reason to split.
CENTRES = 8
FP = ["f0", "f1", "f2", "f3"]
Pair = tuple[np.ndarray, np.ndarray]


def _fold() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        t[a:b] = np.arange(a, b)
    t[65:91] = np.arange(97, 123)
    return t


def fingerprints(data: np.ndarray, off: np.ndarray, pw: Powers) -> Pair:
    """(n, 4) words of each text's fingerprint, and whether the text has any feature.

    The features are the distinct pairs of neighbouring words, ASCII case and punctuation aside; of a single word, that word; of signs alone,
    the text itself. A tied bit takes that of the least feature. A text of white space alone has none.
    """
    n = len(off) - 1
    folded = _fold()[data]
    starts, ends, tok = token_bounds(folded, off)
    h = span_hash(folded, starts, ends, pw)
    count = np.diff(tok)
    doc = np.repeat(np.arange(n), count)
    pairs = window_hash(h, 2, pw)
    inside = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    single = count[doc] == 1 if len(doc) else np.zeros(0, bool)
    solid = np.r_[0, np.cumsum(data > 32)]
    bare = np.flatnonzero((count == 0) & (solid[off[1:]] > solid[off[:-1]]))
    bare = bare[[len(token_bounds(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[0]) > 0 for i in bare]] if len(bare) else bare
    whole = span_hash(data, off[bare], off[bare + 1], pw)
    key = np.r_[(bare.astype(U) << U(48)) | (whole >> U(16)), (doc[:-1][inside].astype(U) << U(48)) | (pairs[inside] >> U(16)), (doc[single].astype(U) << U(48)) | (h[single] >> U(16))]
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    owner = (key >> U(48)).astype(np.int64)
    value = key & U((1 << 48) - 1)
    some = np.zeros(n, bool)
    some[owner] = True
    first = np.searchsorted(owner, np.arange(n))
    first = np.minimum(first, max(0, len(owner) - 1))
    sign = np.where((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1, 1, -1).astype(np.float32)
    out = np.zeros((n, 4), U)
    if not len(key):
        return out, some
    for w in range(4):
        word = mix(value * U(2 * w + 1) + U(0xA0761D6478BD642F * (w + 1) & (2**64 - 1)))
        tie = word[first]
        for b in range(8):
            byte = ((word >> U(8 * b)) & U(255)).astype(np.int64)
            votes = np.bincount(owner * 256 + byte, minlength=n * 256).reshape(n, 256).astype(np.float32) @ sign
            votes += 0.5 * sign[((tie >> U(8 * b)) & U(255)).astype(np.int64)]
            out[:, w] |= np.packbits(votes > 0, axis=1, bitorder="little")[:, 0].astype(U) << U(8 * b)
    return out, some


def text_key(text: Column) -> Column:
    """What tells the texts of one key apart."""
    return F.xxhash64(text.cast("string"))


def fingerprint_table(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, f0..f3) of each row with a key and more than white space; the key keeps its type."""
    src = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    out = T.StructType([*src.schema.fields[:2], *[T.StructField(f, T.LongType()) for f in FP]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                fp, some = fingerprints(data, off, pw)
                cols = [*part.columns[:2], *[pa.array(np.ascontiguousarray(fp[:, w]).view(np.int64)) for w in range(4)]]
                yield pa.record_batch(cols, out.names).filter(pa.array(some))

    return src.mapInArrow(run, out)


def draws(tables: int, seed: int) -> list[np.ndarray]:
    """The bits in the order in which each table draws them."""
    rng = np.random.default_rng(seed)
    return [rng.permutation(BITS) for _ in range(tables)]


def picked(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Those bits of each fingerprint as one number, the first the highest."""
    out = np.zeros(len(fp), U)
    for i, bit in enumerate(bits):
        out |= ((fp[:, bit >> 6] >> U(bit & 63)) & U(1)) << U(len(bits) - 1 - i)
    return out


def sampled_keys(fp: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """(tables, n): 64 bits drawn without repeats from each fingerprint, another draw for each table; the first drawn is the highest."""
    return np.array([picked(fp, d[:64]) for d in draws(tables, seed)], U).reshape(tables, len(fp))


def bucket_pairs(table: np.ndarray, key: np.ndarray, fp: np.ndarray, bits: int, cap: int, distance: int) -> Pair:
    """Places (i, j) of fingerprints that share a bucket and differ in at most `distance` bits.

    A bucket over the cap is split by one more sampled bit at a time. One that all 64 bits leave over the cap is compared as it is.
    """
    order = np.lexsort((key, table))
    table, key, fp = table[order], key[order], fp[order]
    n = len(key)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    differ = key[1:] ^ key[:-1]
    new_table = table[1:] != table[:-1]
    edge = np.ones(n + 1, bool)
    for level in range(bits, 65):
        cut = new_table | ((differ >> U(64 - level)) != 0) if level < 64 else new_table | (differ != 0)
        if level == bits:
            edge[1:n] = cut
        else:
            edge[1:n] |= cut & big[1:]
        at = np.flatnonzero(edge)
        sizes = np.diff(at)
        if sizes.max() <= cap:
            break
        big = np.repeat(sizes > cap, sizes)
    end = np.repeat(at[1:], sizes)
    left, right = [], []
    rows = np.arange(n)
    words = [np.ascontiguousarray(fp[:, w]) for w in range(4)]
    shift = 1
    while len(rows := rows[rows + shift < end[rows]]):
        d = sum(np.bitwise_count(f[rows] ^ f[rows + shift]).astype(np.int16) for f in words)
        hit = rows[d <= distance]
        left.append(order[hit])
        right.append(order[hit + shift])
        shift += 1
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def agree(bits: int, distance: int, of: int = BITS) -> float:
    """Chance that two fingerprints `distance` bits apart are equal in `bits` bits, drawn without repeats from `of`."""
    return math.prod(max(0, of - distance - i) / (of - i) for i in range(bits))


def tables_for(bits: int, distance: int, share: float, of: int = BITS) -> int:
    """Tables of `bits` sampled bits that bring together that share of the pairs at `distance`."""
    p = agree(bits, distance, of)
    return 1 if p >= share else math.ceil(math.log1p(-share) / math.log1p(-p))


def first_bits(n: int, tables: int, distance: int) -> int:
    """Bits of the buckets that are shuffled: as would give BUCKET_MEAN of n fingerprints each, but no more than the tables' recall allows."""
    bits = max(6, math.ceil(math.log2(n / BUCKET_MEAN + 1)))
    while bits > 1 and 1 - (1 - agree(bits, distance)) ** tables < MEET:
        bits -= 1
    return bits


def _drawn(fp: np.ndarray, free: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the fingerprints by `bits` bits drawn from the free ones, where its buckets begin and how large they are, and the bits."""
    pick = rng.choice(free, bits, replace=False)
    key = np.zeros(len(fp), np.uint32)
    for i, bit in enumerate(pick):
        key |= ((fp[:, bit >> 6] >> U(bit & 63)) & U(1)).astype(np.uint32) << np.uint32(i)
    order = np.argsort(key.astype(np.uint16) if bits <= 16 else key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return order, at, np.diff(np.r_[at, len(key)]), pick


def large_ties(fp: np.ndarray, free: np.ndarray, cap: int, distance: int, share: float, rng: np.random.Generator) -> Pair:
    """Places (i, j) that tie together fingerprints of one bucket over the cap at most `distance` bits apart.

    Tables of further bits, as many as find `share` of the pairs at `distance`. What the centres tie together needs no splitting: where they
    leave no more than the cap, or tables would compare more, all that is left is compared with the whole bucket.
    """
    m = len(fp)
    label = np.arange(m)
    left, right = [], []
    for c in rng.choice(m, min(CENTRES, m), replace=False):
        hit = np.flatnonzero(np.bitwise_count(fp ^ fp[c]).sum(1) <= distance)
        left.append(np.full(len(hit), c))
        right.append(hit)
        label[np.isin(label, label[hit])] = label[hit].min()
    most = np.bincount(label).argmax()
    rest = np.flatnonzero(label != most)
    bits = math.ceil(math.log2(m / BUCKET_MEAN + 1))
    spare = len(free) - distance
    count = 0
    if len(rest) > cap and bits <= spare:
        order, at, sizes, pick = _drawn(fp, free, bits, rng)
        while (sizes.astype(float) ** 2).sum() > 4 * BUCKET_MEAN * m and bits + 2 <= min(24, spare):  # bits that agree more often than fair ones
            bits += 2
            order, at, sizes, pick = _drawn(fp, free, bits, rng)
        count = tables_for(bits, distance, share, len(free))
    if 0 < count * 2 * BUCKET_MEAN < len(rest):
        for t in range(count):
            if t:
                order, at, sizes, pick = _drawn(fp, free, bits, rng)
            few = np.repeat(sizes <= cap, sizes)
            rows = order[few]
            i, j = bucket_pairs(np.repeat(np.arange(len(sizes)), sizes)[few], np.zeros(len(rows), U), fp[rows], 64, cap, distance)
            left.append(rows[i])
            right.append(rows[j])
            for b in np.flatnonzero(sizes > cap):
                rows = order[at[b] : at[b] + sizes[b]]
                i, j = large_ties(fp[rows], np.setdiff1d(free, pick), cap, distance, DEEPER, rng)
                left.append(rows[i])
                right.append(rows[j])
    else:
        for r in rest:
            hit = np.flatnonzero(np.bitwise_count(fp ^ fp[r]).sum(1) <= distance)
            hit = hit[np.unique(label[hit], return_index=True)[1]]
            left.append(np.full(len(hit), r))
            right.append(hit)
    pairs = tied(np.arange(m), np.concatenate(left), np.concatenate(right))
    return pairs[:, 0], pairs[:, 1]


def bucket_ties(table: np.ndarray, key: np.ndarray, fp: np.ndarray, bits: int, cap: int, distance: int, seed: int) -> Pair:
    """Places (i, j) that tie together fingerprints that share a bucket and differ in at most `distance` bits, each pair of a bucket up to the cap."""
    head = key >> U(64 - bits)
    order = np.lexsort((head, table))
    t, h = table[order], head[order]
    at = np.flatnonzero(np.r_[np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (h[1:] != h[:-1])])
    sizes = np.diff(np.r_[at, len(t)])
    few = order[np.repeat(sizes <= cap, sizes)]
    i, j = bucket_pairs(table[few], key[few], fp[few], bits, cap, distance)
    left, right = [few[i]], [few[j]]
    for b in np.flatnonzero(sizes > cap):
        rows = order[at[b] : at[b] + sizes[b]]
        same = np.bitwise_or.reduce(fp[rows] ^ fp[rows[0]], axis=0)  # bits in which the bucket differs
        free = np.flatnonzero((same[np.arange(BITS) >> 6] >> (np.arange(BITS) & 63).astype(U)) & U(1))
        i, j = large_ties(fp[rows], free, cap, distance, AGAIN, np.random.default_rng([seed, int(t[at[b]]), int(h[at[b]])]))
        left.append(rows[i])
        right.append(rows[j])
    return np.concatenate(left), np.concatenate(right)


def tied(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(m, 2): pairs that tie together the same ids as the pairs of places (i, j) do, one for each id but the least of its set."""
    names, at = np.unique(ids, return_inverse=True)
    i, j = at[i], at[j]
    low = np.arange(len(names))
    while len(i):
        was = low.copy()
        a, b = low[i], low[j]
        m = np.minimum(a, b)
        np.minimum.at(low, np.r_[a, b, i, j], np.r_[m, m, m, m])
        while (low[low] != low).any():
            low = low[low]
        if (low == was).all():
            break
        open_ = low[i] != low[j]
        i, j = i[open_], j[open_]
    other = np.flatnonzero(low != np.arange(len(names)))
    return np.stack([names[low[other]], names[other]], axis=1)


def buckets(fp: np.ndarray, tables: int, bits: int, distance: int, seed: int, large: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bucket, places, level): the bucket of each fingerprint in each table; one of large[level] gives way to those of further tables.

    A further table draws SPLIT bits of those that the tables above it have left, and there are as many as find DEEPER of a bucket's pairs.
    """
    stack = [(d, 0, bits, np.full(len(fp), U(t * 0x9E3779B97F4A7C15 & (2**64 - 1))), np.arange(len(fp))) for t, d in enumerate(draws(tables, seed))]
    while stack:
        order, level, n, above, rows = stack.pop()
        name = mix(above + picked(fp[rows], order[:n]) + U(1))
        big = np.isin(name, large[level]) if level < len(large) else np.zeros(len(name), bool)
        yield name[~big], rows[~big], level
        if big.any():
            left = order[n:]
            for t in range(tables_for(SPLIT, distance, DEEPER, len(left))):
                again = np.random.default_rng([seed, level, t, *order[:4].tolist()]).permutation(left)
                stack.append((again, level + 1, SPLIT, mix(name[big] ^ U(t + 1)), rows[big]))


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).view(U) for i in range(4)], axis=1)


def near_pairs(fps: DataFrame, *, distance: int = DISTANCE, tables: int = TABLES, cap: int = BUCKET_CAP, seed: int = 7) -> DataFrame:
    """Pairs (a, b) of ids, a < b, that tie together all distinct fingerprints (id, f0..f3) at most `distance` bits apart that share a bucket of some table.

    Buckets are of as many sampled bits as leave the tables' recall at MEET, whatever the count of all fingerprints. Those of more than HOLD
    are counted first and split by further tables before the shuffle, up to DEPTH times; those over the cap are gone through again, by
    tables of further bits, in the task that has them.
    """
    n = fps.count()
    bits = first_bits(n, tables, distance)
    session = fps.sparkSession
    fps = fps.select("id", *FP)
    large: list[np.ndarray] = []
    while n > HOLD and len(large) < DEPTH:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, sizes = np.zeros(0, U), np.zeros(0, np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 65536):
                    part = batch.slice(a, 65536)
                    new = [name for name, _, level in buckets(_fps(part), tables, bits, distance, seed, large) if level == len(large)]
                    names, at = np.unique(np.concatenate([names, *new]), return_inverse=True)
                    sizes = np.bincount(at, np.r_[sizes, np.ones(len(at) - len(sizes))], len(names)).astype(np.int64)
            yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(sizes)], ["bucket", "n"])

        over = fps.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > HOLD)
        found = np.array([r[0] for r in over.select("bucket").collect()], np.int64).view(U)
        if not len(found):
            break
        large = [*large, found]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                for name, rows, _ in buckets(_fps(part), tables, bits, distance, seed, large):
                    if len(rows):
                        cols = part.columns if len(rows) == part.num_rows else part.take(pa.array(rows)).columns
                        yield pa.record_batch([pa.array(name.view(np.int64)), *cols], ["bucket", "id", *FP])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        col = lambda i: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held])
        ids, bucket, fp = col(1), col(0).view(U), np.stack([col(2 + w).view(U) for w in range(4)], axis=1)
        held.clear()
        i, j = bucket_ties(np.zeros(len(ids), np.int8), bucket, fp, 64, cap, distance, seed)
        pairs = tied(ids, i, j)
        for a in range(0, len(pairs), 1 << 16):
            yield pa.record_batch([pa.array(pairs[a : a + (1 << 16), 0]), pa.array(pairs[a : a + (1 << 16), 1])], ["a", "b"])

    words = ", ".join(f"{f} bigint" for f in FP)
    rows = fps.mapInArrow(spread, f"bucket bigint, id bigint, {words}")
    parts = math.ceil(n * tables / HOLD)
    wide = rows.repartition(parts, "bucket") if parts > int(session.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("bucket")
    return wide.mapInArrow(compare, "a bigint, b bigint").filter("a < b").distinct()


def _grouped(docs: DataFrame, distance: int, tables: int, cap: int, seed: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of near_copies, and (doc_id, text_key) of what stands in more than one row."""
    fps = written(fingerprint_table(docs, text=text, key=key).groupBy("doc_id", "text_key", *FP).agg(F.count("*").alias("rows")), "fingerprints")
    repeated = written(fps.filter("rows > 1").select("doc_id", "text_key"), "repeated-rows")
    reps = written(fps.select(*FP).distinct().withColumn("id", F.monotonically_increasing_id()), "representatives")
    groups = components(near_pairs(reps, distance=distance, tables=tables, cap=cap, seed=seed), "a", "b")
    named = reps.join(groups.withColumnRenamed("node", "id"), "id", "left").select(*FP, F.coalesce("component", "id").alias("group"))
    members = fps.join(named, FP).select("group", "doc_id", "text_key")
    sizes = members.groupBy("group").agg(F.count("*").alias("group_size"), F.min(F.struct("doc_id", "text_key")).alias("least")).filter("group_size > 1")
    kept = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    out = written(members.join(sizes, "group").select("doc_id", "text_key", F.col("least.doc_id").alias("group_id"), "group_size", kept.alias("kept")), "near-copies")
    drop(fps, reps, groups)
    return out, repeated


def near_copies(docs: DataFrame, *, distance: int = DISTANCE, tables: int = TABLES, cap: int = BUCKET_CAP, seed: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, group_id, group_size, kept) of each document that has a near copy; one of each group, the least doc_id, is kept.

    Groups are the connected components of pairs of fingerprints at most `distance` bits apart, and group_id is their least doc_id. Equal
    fingerprints always meet; others meet by bit sampling, whose recall is under test. A document without a near copy, without text (null,
    empty, white space) or with a null key is in no row. The key may be of any type that can be ordered. Repeated rows are one document; a
    key with several texts has each of them looked at, with a row each, and of equal doc_ids that whose text hashes lowest is kept. Other
    columns play no part.
    """
    out, repeated = _grouped(docs, distance, tables, cap, seed, text, key)
    drop(repeated)
    return out.drop("text_key")


def drop_copies(docs: DataFrame, *, distance: int = DISTANCE, tables: int = TABLES, cap: int = BUCKET_CAP, seed: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` but for near copies of a kept document, with all their columns.

    It is decided by key and text: a text that is nobody's copy stays, whatever else its key has. Of rows that repeat both, one stays, that
    whose other columns hash lowest. Rows with a null key, and those without text, stay as they are.
    """
    found, repeated = _grouped(docs, distance, tables, cap, seed, text, key)
    gone = found.filter(~F.col("kept")).select("doc_id", "text_key")
    here = lambda df, of: (df[f"`{key}`"] == of["doc_id"]) & (text_key(df[f"`{text}`"]) == of["text_key"])
    left = docs.join(gone, here(docs, gone), "left_anti")
    if repeated.isEmpty():
        return left
    spot = next(f"_n{i}" for i in range(len(docs.columns) + 1) if f"_n{i}" not in docs.columns)
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy(F.col(f"`{key}`"), text_key(F.col(f"`{text}`"))).orderBy(F.xxhash64(*plain))
    more = left.join(repeated, here(left, repeated), "left_semi").withColumn(spot, F.row_number().over(order)).filter(F.col(spot) == 1).drop(spot)
    return left.join(repeated, here(left, repeated), "left_anti").union(more)
