"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every string of LENGTH bytes has an anchor: the position with the smallest hash among its first ones. Equal strings
have their anchors at the same place, so only suffixes at anchors need sorting, and only those whose first bytes occur
elsewhere. Tasks sort their suffixes into runs, send them front-coded (what a suffix shares with the one before it is a
number), and each range of the alphabet merges its runs with a loser tree that keeps, for every run, how many bytes its
next suffix shares with the last one put out: suffixes that differ there need no comparison, and shared prefixes are
never read twice. The common prefixes of neighbours in the merged order, and what stands before the anchors, tell which
strings repeat.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm.common import BYTE_KEYS, bitmap, byte_view, in_bitmap, mix, powers, slices, span_hashes, stash, text_of

LENGTH = 400
WINDOW = 200             # an anchor lies among a string's first WINDOW positions
PART = 100               # strings of one suffix start at most so many bytes before it
GRAM = 24                # bytes hashed at a position
CORE = LENGTH - PART + 1  # bytes that all strings of one suffix share after its start
BITS = 26
RUN = 20_000             # suffixes of one sorted run
RANGE = 30_000           # suffixes merged together, about
HEAD = 64                # bytes of a suffix that decide its range
SAMPLE = 8192            # heads from which the ranges are cut
BUCKET = 500_000         # hashes of suffix starts that are counted together

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM = 16 + 8 bytes from each position on (the last positions have none)."""
    h = BYTE_KEYS[data]
    width, eight = 1, None
    power = FACTOR
    while width < 16:
        h = h[:-width] * power + h[width:]
        power = (power.reshape(1) * power)[0]
        width *= 2
        if width == 8:
            eight = h
    return h[:-8] * np.uint64(pow(int(FACTOR), 8, 1 << 64)) + eight[16:]


def suffixes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, low, high): suffixes such that each string of LENGTH bytes within a text begins o bytes before exactly
    one of them, low <= o <= high < PART, wherever else it may stand."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none
    h = gram_hashes(data)
    best = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[:len(best) - (WINDOW - width)], best[WINDOW - width:])
    n = np.maximum(np.diff(off) - LENGTH + 1, 0)
    begin = np.cumsum(n) - n
    at = np.repeat(off[:-1] - begin, n) + np.arange(n.sum())
    if not len(at):
        return none, none, none
    anchor = (best[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    p, first, last = anchor[new], at[new], at[np.append(new[1:], len(at)) - 1]
    start, low, high = [], [], []
    for j in range(WINDOW // PART):
        lo, hi = np.maximum(p - last - j * PART, 0), np.minimum(p - first - j * PART, PART - 1)
        on = lo <= hi
        start.append((p - j * PART)[on]), low.append(lo[on]), high.append(hi[on])
    return np.concatenate(start), np.concatenate(low), np.concatenate(high)


def texts(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(docs["doc_id"].alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))


# ---------------------------------------------------------------- which suffix starts occur twice


def shared_cores(docs: DataFrame) -> tuple[np.ndarray, int, list[bytes]]:
    """A bitmap of the hashes of CORE bytes that occur more than once, how many suffixes have such a core, and heads that
    cut the suffixes into even ranges."""

    def run(batches):
        held, size = [], 0

        def flush():
            core, times = np.unique(np.concatenate(held), return_counts=True)
            core = np.repeat(core, np.minimum(times, 2))
            bucket = (core >> np.uint64(44)).astype(np.int64) % 4096
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            stops = np.append(cuts[1:], len(core))
            raw = core[order].tobytes()
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts]), pa.array([raw[8 * a:8 * b] for a, b in zip(cuts.tolist(), stops.tolist())], pa.binary()), pa.nulls(len(cuts), pa.int64())], names=["bucket", "blob", "rank"])

        for batch in batches:
            raw, ends = byte_view(batch.column(0))
            for lo, hi in slices(ends):
                data = raw[ends[lo]:ends[hi]]
                start, _, _ = suffixes(data, ends[lo:hi + 1] - ends[lo])
                if not len(start):
                    continue
                core = span_hashes(data, start, start + CORE)
                held.append(core)
                size += len(core)
                rank = mix(core ^ FACTOR)
                few = np.flatnonzero(rank < np.uint64((1 << 64) // 256))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(few), pa.int64()), pa.array([data[i:i + HEAD].tobytes() for i in start[few]], pa.binary()), pa.array((rank[few] >> np.uint64(1)).astype(np.int64))], names=["bucket", "blob", "rank"])
                if size >= 2 * BUCKET:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def twice(batches):
        now, held = None, []

        def count():
            core, times = np.unique(np.frombuffer(b"".join(held), np.uint64), return_counts=True)
            often = times > 1
            return pa.RecordBatch.from_arrays([pa.array(core[often].view(np.int64)), pa.array(times[often])], names=["core", "n"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and held:
                    yield count()
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield count()

    rows = stash(texts(docs).select("text").mapInArrow(run, "bucket long, blob binary, rank long"))
    cores = stash(rows.where("bucket is not null").select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(twice, "core long, n long"))
    heads = [bytes(r["blob"]) for r in rows.where("rank is not null").orderBy("rank", "blob").limit(SAMPLE).select("blob").collect()]
    return bitmap(cores, F.col("core"), BITS), int(cores.agg(F.sum("n")).first()[0] or 0), sorted(heads)


# ---------------------------------------------------------------- sorted runs and their merge


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share `known` bytes."""
    top = min(len(a), len(b))
    if a[known:top] == b[known:top]:
        return top
    low, high = known, top                      # they share low bytes, and differ before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


ROW = struct.Struct("<HHBB")


def front_coded(run: list[tuple[bytes, bytes, int]]) -> bytes:
    """Sorted (suffix, reversed left context, times): each suffix as what it doesn't share with the one before it."""
    out, last = [], b""
    for right, left, times in run:
        shared = common(last, right)
        out += (ROW.pack(shared, len(right), len(left), min(times, 2)), right[shared:], left)
        last = right
    return b"".join(out)


def read_run(blob: bytes):
    """(shared with the one before, suffix, left, times) of a front-coded run."""
    at, last = 0, b""
    while at < len(blob):
        shared, n, m, times = ROW.unpack_from(blob, at)
        at += ROW.size
        last = last[:shared] + blob[at:at + n - shared]
        at += n - shared
        yield shared, last, blob[at:at + m], times
        at += m


def merged(blobs: list[bytes]):
    """Merge runs: yields (shared with the one put out before, suffix, left, times) in order.

    shared[r] is what the next suffix of run r has in common with the last one put out. Of two suffixes the one that
    shares more is smaller; only where they share equally much are they read on, from there."""
    size = 1
    while size < len(blobs):
        size *= 2
    runs = [read_run(b) for b in blobs] + [iter(())] * (size - len(blobs))
    item = [next(r, None) for r in runs]
    shared = [0 if x else -1 for x in item]
    losers = [0] * size

    def play(a, b):
        """(winner, loser)"""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if shared[a] < 0:
            return a, b
        x, y = item[a][1], item[b][1]
        n = common(x, y, shared[a])
        if x[n:n + 1] <= y[n:n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        nxt = []
        for i in range(0, level, 2):
            w, lose = play(winners[i], winners[i + 1])
            losers[level // 2 + i // 2] = lose
            nxt.append(w)
        winners, level = nxt, level // 2
    top = winners[0]
    while item[top] is not None:
        yield (shared[top], *item[top][1:])
        nxt = item[top] = next(runs[top], None)
        shared[top] = nxt[0] if nxt else -1
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated(group: list[list]) -> list[list[int]]:
    """For each distinct (suffix, left, times, shared with the one before) of suffixes with one core: the o, as ranges
    [first, last, ...], whose string of LENGTH bytes from o before the suffix occurs more than once."""
    m = len(group)
    out: list[list[int]] = [[] for _ in group]
    if m <= 16:
        spans: list[list[tuple[int, int]]] = [[] for _ in group]
        for i, (right, left, times, _) in enumerate(group):
            if times > 1:
                spans[i].append((LENGTH - len(right), len(left)))
            reach = LENGTH
            for j in range(i + 1, m):
                reach = min(reach, group[j][3], len(group[j][0]), len(right))
                if reach < CORE:
                    break
                back = common(left, group[j][1])
                if LENGTH - reach <= back:
                    spans[i].append((LENGTH - reach, back))
                    spans[j].append((LENGTH - reach, back))
        for i, own in enumerate(spans):
            for a, b in sorted(own):
                if out[i] and a <= out[i][-1] + 1:
                    out[i][-1] = max(out[i][-1], b)
                else:
                    out[i] += [a, b]
        return out
    right = np.zeros((m, LENGTH), np.uint8)
    left = np.zeros((m, PART - 1), np.uint8)
    for i, (r, s, *_) in enumerate(group):
        right[i, :len(r)] = np.frombuffer(r, np.uint8)
        left[i, :len(s)] = np.frombuffer(s, np.uint8)
    low, high = LENGTH - np.array([len(g[0]) for g in group]), np.array([len(g[1]) for g in group])
    times = np.array([g[2] for g in group])
    ahead, behind = np.empty((m, PART), np.uint64), np.zeros((m, PART), np.uint64)
    scale = powers(FACTOR, LENGTH)
    for i in range(0, m, 2048):
        ahead[i:i + 2048] = np.cumsum(BYTE_KEYS[right[i:i + 2048]] * scale, axis=1)[:, CORE - 1:LENGTH]      # column c: of CORE + c bytes
        behind[i:i + 2048, 1:] = np.cumsum(BYTE_KEYS[left[i:i + 2048]] * scale[:PART - 1], axis=1)
    hit = np.zeros((m, PART), bool)
    for o in range(PART):
        on = np.flatnonzero((low <= o) & (o <= high))
        if len(on):
            key = mix(ahead[on, LENGTH - o - CORE] + FACTOR) * FACTOR + mix(behind[on, o])
            _, which, n = np.unique(key, return_inverse=True, return_counts=True)
            hit[on, o] = (n[which] > 1) | (times[on] > 1)
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for i in np.flatnonzero(hit.any(1)):
        first, last = np.flatnonzero(edges[i] == 1), np.flatnonzero(edges[i] == -1) - 1
        out[i] = np.stack([first, last], 1).ravel().tolist()
    return out


def digest(right: bytes, left: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(bytes([len(left)]) + left + right, digest_size=16).digest())


def repeated_rows(blobs: list[bytes]):
    """(h1, h2, ranges) of the suffixes of one range that have repeated strings."""
    group: dict[tuple[bytes, bytes], list] = {}

    def settle():
        rows = list(group.values())
        if len(rows) > 1 or rows and rows[0][2] > 1:
            for (right, left, _, _), own in zip(rows, repeated(rows)):
                if own:
                    yield (*digest(right, left), own)

    # what a suffix shares with the one before it in the group, over equal ones too
    for shared, right, left, times in merged(blobs):
        if shared < CORE and group:
            yield from settle()
            group = {}
        own = group.get((right, left))
        if own is None:
            group[(right, left)] = [right, left, times, shared]
        else:
            own[2] += times
    yield from settle()


def occurrences(docs: DataFrame, shared: np.ndarray, cuts: list[bytes]) -> DataFrame:
    """Runs (part, blob) for each range, and a row (id, k, h1, h2, start) for each place of a suffix."""

    def run(batches):
        held: dict[tuple[bytes, bytes], int] = {}

        def flush():
            rows = sorted((r, s, t) for (r, s), t in held.items())
            parts = [bisect_right(cuts, r[:HEAD]) for r, _, _ in rows]
            bounds = [0, *[i for i in range(1, len(rows)) if parts[i] != parts[i - 1]], len(rows)]
            blobs = [front_coded(rows[a:b]) for a, b in zip(bounds, bounds[1:])]
            k = len(blobs)
            return pa.RecordBatch.from_arrays([pa.array([parts[a] for a in bounds[:-1]], pa.int64()), pa.array(blobs, pa.binary()), *[pa.nulls(k, pa.int64()) for _ in range(5)]], schema=schema)

        for batch in batches:
            raw, ends = byte_view(batch.column(2))
            for lo, hi in slices(ends):
                data, off = raw[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo]
                start, low, high = suffixes(data, off)
                if not len(start):
                    continue
                on = in_bitmap(shared, span_hashes(data, start, start + CORE))
                start, low, high = start[on], low[on], high[on]
                doc = np.searchsorted(off, start, "right") - 1
                # a suffix may begin where its text's predecessor ends: its strings, not its start, lie within one text
                whole = data.tobytes()
                h1, h2 = [], []
                for p, a, b in zip(start.tolist(), low.tolist(), high.tolist()):
                    right, left = whole[p:p + LENGTH - a], whole[p - b:p][::-1]
                    held[(right, left)] = held.get((right, left), 0) + 1
                    x, y = digest(right, left)
                    h1.append(x)
                    h2.append(y)
                k = len(h1)
                row = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), batch.column(0).cast(pa.int64()).take(row), batch.column(1).take(row), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(start - off[doc])], schema=schema)
                if len(held) >= RUN:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int64()), ("blob", pa.binary()), ("id", pa.int64()), ("k", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int64())])
    return texts(docs).withColumn("id", F.col("id").cast("long")).mapInArrow(run, "part long, blob binary, id long, k long, h1 long, h2 long, start long")


def merge_ranges(runs: DataFrame) -> DataFrame:
    """(h1, h2, ranges) of every suffix with repeated strings."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now and held:
                    yield from out(held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield from out(held)

    def out(blobs):
        rows = list(repeated_rows(blobs))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["h1", "h2", "ranges"])

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "h1 long, h2 long, ranges array<int>")


# ---------------------------------------------------------------- the operator


def spans(docs: DataFrame) -> DataFrame:
    """(id, k, spans): per text with repeated strings the byte ranges [first, end, ...] they cover, merged."""
    shared, count, heads = shared_cores(docs)
    parts = 1 + count // RANGE
    cuts = sorted({heads[i * len(heads) // parts] for i in range(1, parts)}) if heads else []
    rows = stash(occurrences(docs, shared, cuts))
    found = stash(merge_ranges(rows.where("part is not null").select("part", "blob")))
    places = rows.where("part is null").select("id", "k", "h1", "h2", "start").join(found, ["h1", "h2"])
    # o in [first, last] before the start: bytes from start - last to start - first + LENGTH
    each = F.transform(F.sequence(F.lit(0), F.expr("cast(size(ranges) div 2 - 1 as int)")), lambda i: F.struct((F.col("start") - F.element_at("ranges", 2 * i + 2)).alias("a"), (F.col("start") - F.element_at("ranges", 2 * i + 1) + LENGTH).alias("b")))
    return places.select("id", "k", F.explode(each).alias("s")).groupBy("id", "k").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def cut(texts_: pa.Array, spans_: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts_.to_pylist(), spans_.to_pylist()):
        raw = text.encode("utf-8", "surrogatepass")
        kept, runs, gone, at = [], 0, 0, 0
        end = -1
        for s in own or ():
            a, b = s["a"], s["b"]
            if a > end:
                kept.append(raw[at:a])
                runs += 1
                gone += b - a
            elif b > end:
                gone += b - end
            end = max(end, b)
            at = end
        kept.append(raw[at:])
        left = b"".join(kept)
        out.append({"n_bytes": len(raw), "n_removed": gone, "n_spans": runs, "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left})
    return pa.array(out, CUT)


CUT = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_removed, n_spans (maximal removed runs), kept_sha256 and kept, the
    remaining bytes put together.

    A null text is empty; matches never cross documents; repeated rows repeat each other's strings and are cut alike;
    texts under LENGTH bytes stay whole; an empty table gives no rows; other columns are not looked at."""
    found = stash(spans(docs))
    rows = texts(docs).withColumn("id", F.col("id").cast("long"))
    of = found.select(F.col("id").alias("id_"), F.col("k").alias("k_"), "spans")
    joined = rows.join(of, F.col("id").eqNullSafe(F.col("id_")) & (F.col("k") == F.col("k_")), "left")
    return joined.select(F.col("id").alias("doc_id"), F.arrow_udf(cut, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>")("text", "spans").alias("c")).select("doc_id", "c.*")
