"""N-gram Jaccard join with a token-group matrix.

A document is the set of hashes of its five-word shingles. Similar sets are partitioned into groups first: of a few
minimum hashes of a set the one that most others share names its group, and large groups are dealt over blocks. Links
within a group are found there. The matrix then says which groups hold which token: any two sets that are similar share
a known number of tokens within a known part of each, in any order of the tokens that all follow, so only that part of
each set enters it. Two groups that share enough of it, and are not connected throughout already, are a candidate; then
each query set of one is held against the union of the other's tokens, its overlap with that bounds its overlap with
every member, and only if the bound reaches the threshold is the group opened and compared set by set. No link between
sets that are not connected otherwise is lost.

Whole sets are large, and sets that are alike but not similar grow with the square of a table. So sketches of sets meet
first, a few bits a token: of each bit the parity of the tokens that fall on it. Two sketches differ in no more bits than
the sets differ in tokens, so sets whose sketches lie further apart than similar sets do are told apart for certain, and
only sets with a partner that is left are sent whole.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upland.llm.common import bitmap, byte_view, components, in_bitmap, mix, slices, span_hashes, stash, text_of

WORDS = 5
TOP, BOTTOM = 80, 100            # similar: BOTTOM * intersection >= TOP * union
CELLS = 3                        # minimum hashes of a set, of which one names its group
MEMBERS = 1024                   # sets that a block of a group holds, about
QUERIES = 8192                   # queries that one copy of a group answers, about
HOT = 16                         # tokens counted at least so often go last in the order of tokens
HOT_MOST = 1 << 20               # hot tokens that tasks know, the commonest; which ones they know changes no result
COUNT_AT_ONCE = 2_000_000        # tokens a task counts together
BUCKET = 250_000                 # matrix entries that are sorted together

SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True
LOWER = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)
STEP = [np.uint64(x) for x in (0x9E6C63D0876A9A35, 0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]
SECOND = np.uint64(0xF1357AEA2E62A9C5)


def shingle_sets(raw: np.ndarray, ends: np.ndarray):
    """Per text the sorted, distinct 64-bit hashes of its shingles: yields (row, hashes). Fewer than WORDS words make
    one shingle of all of them; no words, none."""
    for lo, hi in slices(ends):
        data, off = LOWER[raw[ends[lo]:ends[hi]]], ends[lo:hi + 1] - ends[lo]
        word = ~SPACE[data]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        starts = np.flatnonzero((edge == 1) | cut & np.concatenate([word, [False]]))
        stops = np.flatnonzero((edge == -1) | cut & np.concatenate([[False], word]))
        h = span_hashes(data, starts, stops)
        first = np.searchsorted(starts, off)
        n = len(h) - WORDS + 1
        grams = mix(sum(h[i:n + i] * STEP[i] for i in range(WORDS))) if n > 0 else h[:0]
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= WORDS:
                yield lo + i, np.unique(grams[a:b - WORDS + 1])
            elif b > a:
                short = (h[a:b] * np.array(STEP[:b - a])).sum() + np.uint64(int(b - a))
                yield lo + i, mix(np.array([short ^ SECOND]))
            else:
                yield lo + i, h[:0]


def fingerprint(tokens: np.ndarray) -> int:
    """A hash of the set; 0 for the empty one."""
    if not len(tokens):
        return 0
    size = np.array([len(tokens)], np.uint64)
    return int(mix(mix(tokens ^ STEP[1]).sum(keepdims=True) + size * STEP[2]).view(np.int64)[0])


def minima(tokens: np.ndarray) -> list[int]:
    """CELLS minimum hashes, as cell numbers."""
    low = [mix(tokens ^ STEP[k]).min() ^ STEP[k] for k in range(CELLS)]
    return mix(np.array(low, np.uint64)).view(np.int64).tolist()


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each of a power of two of places, 64 or twice the tokens at least: whether an odd number of tokens fall on
    it. The upper 56 bits place a token, as they alone are compared."""
    places = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    at = (tokens >> np.uint64(8) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=places) & 1, bitorder="little").tobytes()


def packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens by their upper 56 bits, seven bytes each."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


# ---------------------------------------------------------------- passes over the texts


def sets_of(docs: DataFrame) -> DataFrame:
    """A row (id, fp, n, cells, sketch) for each document, and rows (token, times) for tokens that a task met often. Of
    equal sets that a task meets, not all need have a sketch."""

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0

        def frequent():
            token, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 4
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.binary()), pa.array(token[often].view(np.int64)), pa.array(times[often], pa.int64())], schema=schema)

        for batch in batches:
            fps, sizes, cells, sketches = [], [], [], []
            for _, tokens in shingle_sets(*byte_view(batch.column(1))):
                fp = fingerprint(tokens)
                fps.append(fp)
                sizes.append(len(tokens))
                cells.append(minima(tokens) if len(tokens) else [])
                sketches.append(sketch(tokens) if len(tokens) and fp not in seen else None)
                if len(tokens) and fp not in seen:
                    seen.add(fp)
                    held.append(tokens)
                    size += len(tokens)
                    if size >= COUNT_AT_ONCE:
                        yield frequent()
                        held, size = [], 0
                        seen.clear()
            k = len(fps)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=schema)
        if held:
            yield frequent()

    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(pa.int64())), ("sketch", pa.binary()), ("token", pa.int64()), ("times", pa.int64())])
    return texts(docs).mapInArrow(run, "id long, fp long, n long, cells array<long>, sketch binary, token long, times long")


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).alias("text"))


def wanted_sets(docs: DataFrame, rows_of, schema: str, fields: list[str]) -> DataFrame:
    """Rows made from the sets of a pass over the texts, equal sets of a task giving rows once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {f: [] for f in fields}
            for _, tokens in shingle_sets(*byte_view(batch.column(1))):
                if len(tokens):
                    fp = fingerprint(tokens)
                    if fp not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(fp)
                        for row in rows_of(fp, tokens):
                            for f, x in zip(fields, row):
                                out[f].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[f], pa.binary() if f == "tokens" else pa.int64()) for f in fields], names=fields)

    return texts(docs).mapInArrow(run, schema)


# ---------------------------------------------------------------- groups


def groups_of(distinct: DataFrame) -> DataFrame:
    """(fp, grp): the group of each set, its own number where it shares no minimum hash with another."""
    each = distinct.select("fp", F.explode("cells").alias("cell"))
    shared = stash(each.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    best = each.join(shared, "cell").groupBy("fp").agg(F.max(F.struct("n", "cell")).alias("b"))
    block = F.pmod(F.xxhash64("fp"), F.ceil(F.col("b.n") / MEMBERS))
    named = best.select("fp", F.xxhash64(F.col("b.cell"), block).alias("grp"))
    return stash(distinct.select("fp").join(named, "fp", "left").select("fp", F.coalesce("grp", "fp").alias("grp")))


def sets_for(docs: DataFrame, route: DataFrame) -> DataFrame:
    """The rows of a table with a column fp, each with its set's tokens. A bitmap of the numbers asked for keeps most other
    sets from being sent."""
    wanted = bitmap(route.select("fp").distinct(), F.col("fp"))

    def rows_of(fp, tokens):
        if in_bitmap(wanted, np.array([fp], np.int64).view(np.uint64))[0]:
            yield fp, packed(tokens)

    return route.join(wanted_sets(docs, rows_of, "fp long, tokens binary", ["fp", "tokens"]).dropDuplicates(["fp"]), "fp")


def sketches_for(sketches: DataFrame, route: DataFrame) -> DataFrame:
    """The rows of a table with a column fp, each with its set's size and sketch."""
    wanted = bitmap(route.select("fp").distinct(), F.col("fp"))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(wanted, batch.column(0).to_numpy().view(np.uint64))))

    return route.join(sketches.mapInArrow(keep, "fp long, n long, sketch binary").dropDuplicates(["fp"]), "fp")


class Sketches:
    """Sketches of a few sets, given by rising size."""

    def __init__(self, sizes: list[int], raw: list[bytes]):
        self.sizes = np.array(sizes, np.int64)
        width = np.array([len(r) // 8 for r in raw])
        cuts = np.append(np.flatnonzero(np.diff(width, prepend=0)), len(raw))
        self.blocks = [(a, b, np.frombuffer(b"".join(raw[a:b]), np.uint64).reshape(b - a, -1)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def near(self, size: int, raw: bytes, after: int = 0) -> np.ndarray:
        """Numbers, `after` at least, of the sets that a set may be similar to: all that are, and some that are not."""
        lo = max(after, int(np.searchsorted(self.sizes * BOTTOM, size * TOP, "left")))
        hi = int(np.searchsorted(self.sizes * TOP, size * BOTTOM, "right"))
        found = [np.zeros(0, np.int64)]
        for start, stop, words in self.blocks:
            a, b = max(lo, start), min(hi, stop)
            if a < b:
                own, rows = np.frombuffer(raw, np.uint64)[None], words[a - start:b - start]
                places = min(own.shape[1], rows.shape[1])
                apart = np.bitwise_count(folded(own, places) ^ folded(rows, places)).sum(axis=1, dtype=np.int64)
                found.append(a + np.flatnonzero(apart * (TOP + BOTTOM) <= (self.sizes[a:b] + size) * (BOTTOM - TOP)))
        return np.concatenate(found)


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches with fewer places, `words` times 64."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


class Matrix:
    """Which of a few sets hold which token: the union of their tokens, and for each the numbers of its holders."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in sets])
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owners = owners[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.first = np.append(self.first, len(tokens))

    def similar(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the sets that are similar to a query; the group is opened only if the query's overlap with the union
        leaves room for one."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if BOTTOM * len(at) < TOP * len(tokens):
            return at[:0]
        begin, n = self.first[at], self.first[at + 1] - self.first[at]
        holders = self.owners[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        shared = np.bincount(holders, minlength=len(self.sizes))
        return np.flatnonzero(BOTTOM * shared >= TOP * (self.sizes + len(tokens) - shared))


class Joined:
    """Which of a few numbers are connected."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


def edge_batch(edges) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


def doubtful(batches):
    """Rows (held, copy, query, fp, root, n, sketch), a group's members before its queries and by rising size: those that
    may be similar to one of the other kind that nothing known has connected with them. Rows that hang together so have
    a part in common."""
    now, members, queries, sketches, joined = None, [], [], None, Joined()

    def settle():
        out = [(*now, joined.root(x), int(x < 0), *(queries[-x - 1] if x < 0 else members[x])[:2]) for x in list(joined.up)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.nulls(0, pa.int64())] * 6, names=["held", "copy", "part", "query", "fp", "root"])

    for batch in batches:
        for held, copy, query, fp, root, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if (held, copy) != now:
                if joined.up:
                    yield settle()
                now, members, queries, sketches, joined = (held, copy), [], [], None, Joined()
            if not query:
                members.append((fp, root, n, raw))
            elif members:
                if sketches is None:
                    sketches, roots = Sketches([m[2] for m in members], [m[3] for m in members]), np.array([m[1] for m in members])
                found = sketches.near(n, raw)
                found = found[roots[found] != root]
                if len(found):
                    queries.append((fp, root))
                    for i in found.tolist():
                        joined.join(i, -len(queries))
    if joined.up:
        yield settle()


def answer(batches):
    """Rows (group, copy, part, query, fp, root, tokens), members of a part before its queries: an edge to a similar member
    for each query that nothing known has connected with it yet."""
    now, held, matrix, known = None, [], None, Joined()
    for batch in batches:
        out = []
        for grp, copy, part, query, fp, root, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if (grp, copy, part) != now:
                now, held, matrix, known = (grp, copy, part), [], None, Joined()
            tokens = unpacked(raw)
            if not query:
                held.append((fp, root, tokens))
            elif held:
                matrix = matrix or Matrix([t for _, _, t in held])
                for i in matrix.similar(tokens).tolist():
                    if known.root(root) != known.root(held[i][1]):
                        known.join(root, held[i][1])
                        out.append((fp, held[i][0]))
        yield edge_batch(out)


def group_edges(docs: DataFrame, sketches: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is similar within each group: its members are its queries too. Sketches part what is
    certainly not similar first, and members without a partner stay out."""
    several = groups.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    members = stash(groups.join(several, "grp"))

    def parted(batches):
        now, held = None, []

        def settle():
            part = np.arange(len(held))
            if len(held) > 1:
                near = Sketches([n for _, n, _ in held], [raw for _, _, raw in held])
                for i, (_, n, raw) in enumerate(held):
                    for other in np.unique(part[near.near(n, raw, i + 1)]).tolist():
                        part[part == other] = part[i]
            kept = np.flatnonzero(np.bincount(part, minlength=1)[part] > 1)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(kept), pa.int64()), pa.array(part[kept], pa.int64()), pa.array([held[i][0] for i in kept.tolist()], pa.int64())], names=["grp", "part", "fp"])

        for batch in batches:
            for grp, fp, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if grp != now:
                    yield settle()
                    now, held = grp, []
                held.append((fp, n, raw))
        yield settle()

    def within(batches):
        now, held = None, []

        def settle():
            known, out = Joined(), []
            matrix = Matrix([t for _, t in held]) if len(held) > 1 else None
            for fp, tokens in held if matrix else []:
                for i in matrix.similar(tokens).tolist():
                    if known.root(fp) != known.root(held[i][0]):
                        known.join(fp, held[i][0])
                        out.append((fp, held[i][0]))
            return out

        for batch in batches:
            out = []
            for grp, part, fp, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, part) != now:
                    out += settle()
                    now, held = (grp, part), []
                held.append((fp, unpacked(raw)))
            yield edge_batch(out)
        yield edge_batch(settle())

    near = sketches_for(sketches, members).select("grp", "fp", "n", "sketch").repartition("grp").sortWithinPartitions("grp", "n", "fp")
    rows = sets_for(docs, stash(near.mapInArrow(parted, "grp long, part long, fp long")))
    return rows.select("grp", "part", "fp", "tokens").repartition("grp", "part").sortWithinPartitions("grp", "part", "fp").mapInArrow(within, "a long, b long")


# ---------------------------------------------------------------- the matrix


def prefix(n: int) -> int:
    """How many of the first tokens of n enter the matrix. A similar set shares at least TOP / BOTTOM of the larger one,
    so the first tokens of both, in one order, cannot all miss."""
    return n + TOP * n // -BOTTOM + 1


def least_met(a, b):
    """How many tokens of the parts in the matrix a set of size a or less shares with a similar one of size b or more, at
    least, so the largest size and the smallest one of two groups bound it for their members. Of the parts one ends first
    in the order; what the sets share beyond lies in the rest of that set, so it is no more than the rest of the larger
    one. That rises with the smaller size; with the larger one it falls from any size to the one a step on, but may rise
    in between, so it is taken at all sizes of the last step."""
    step = BOTTOM // gcd(TOP, BOTTOM)
    of = lambda larger: F.ceil((larger + b) * TOP / (TOP + BOTTOM)) - F.ceil(larger * TOP / BOTTOM) + 1
    return F.least(*[of(F.greatest(a - i, b)) for i in range(step)])


def entries(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(token, fp, n) rows of the matrix, of tokens that two or more different sets of fitting sizes bring in; sets that no
    row of fitting sizes connects have numbers of their own for a token. A task sends its entries packed by bucket; each
    bucket is sorted on its own."""
    hot = np.sort(hot)

    def pack(batches):
        for batch in batches:
            token, fp, n_of, size = [], [], [], []
            seen: set[int] = set()
            count = 0

            def flush():
                t, f, m = np.concatenate(token), np.repeat(np.array(fp, np.int64), size), np.repeat(np.array(n_of, np.int32), size)
                t = mix(t)
                bucket = ((t & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                # half of a token's bits, besides its bucket: two tokens taken for one only add a candidate
                blob = np.empty(len(t), [("t", "<u4"), ("f", "<i8"), ("m", "<i4")])
                blob["t"], blob["f"], blob["m"] = (t >> np.uint64(32))[order], f[order], m[order]
                raw = blob.tobytes()
                stops = np.append(cuts[1:], len(t)) * blob.itemsize
                return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts]), pa.array([raw[a:b] for a, b in zip((cuts * blob.itemsize).tolist(), stops.tolist())], pa.binary())], names=["bucket", "blob"])

            for _, tokens in shingle_sets(*byte_view(batch.column(1))):
                n = len(tokens)
                own = fingerprint(tokens)
                if not n or own in seen:
                    continue
                seen.add(own)
                ask = prefix(n)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                    late = hot[at] == tokens
                    tokens = np.concatenate([tokens[~late], tokens[late]])
                token.append(tokens[:ask])
                fp.append(own)
                n_of.append(n)
                size.append(ask)
                count += ask
                if count >= 1_000_000:
                    yield flush()
                    token, fp, n_of, size, count = [], [], [], [], 0
            if count:
                yield flush()

    def meet(batches):
        held, now = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and held:
                    yield from met(now, held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from met(now, held)

    def met(bucket, blobs):
        x = np.frombuffer(b"".join(blobs), [("t", "<u4"), ("f", "<i8"), ("m", "<i4")])
        x = x[np.lexsort((x["f"], x["t"]))]
        x = x[np.append(True, (x["t"][1:] != x["t"][:-1]) | (x["f"][1:] != x["f"][:-1]))]
        x = x[np.lexsort((x["m"], x["t"]))]
        size = x["m"].astype(np.int64)
        fits = (x["t"][1:] == x["t"][:-1]) & (size[:-1] * BOTTOM >= size[1:] * TOP)
        kept = np.append(False, fits) | np.append(fits, False)
        x, size, token = x[kept], size[kept], np.cumsum(np.append(True, ~fits))[kept] + (np.int64(bucket % (1 << 31)) << np.int64(32))
        for i in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(token[i:i + 100_000]), pa.array(x["f"][i:i + 100_000].copy()), pa.array(size[i:i + 100_000])], names=["token", "fp", "n"])

    sent = texts(docs).mapInArrow(pack, "bucket long, blob binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "token long, fp long, n long")


def candidates(rows: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(ga, gb): two groups that share enough tokens of the matrix for members of fitting sizes to be similar, and have
    members that are not connected yet."""
    rooted = rows.join(groups, "fp").join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left").select("token", "n", "grp", F.coalesce("root", "fp").alias("root"))
    held = rooted.repartition("token").groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    token = Window.partitionBy("token")
    mixed = held.withColumns({"l": F.min("lo").over(token), "h": F.max("hi").over(token), "g": F.count("*").over(token)}).where("l <> h and g > 1")
    held = stash(mixed.drop("l", "h", "g"))
    other = held.select("token", *[F.col(c).alias(f"{c}_") for c in held.columns if c != "token"])
    both = held.join(other, "token").where("grp < grp_").where("lo <> hi or lo_ <> hi_ or lo <> lo_")
    both = both.where((F.col("most") * BOTTOM >= F.col("least_") * TOP) & (F.col("most_") * BOTTOM >= F.col("least") * TOP))
    met = both.groupBy("grp", "grp_").agg(F.count("*").alias("met"), F.max(F.greatest("most", "most_")).alias("most"), F.min(F.least("least", "least_")).alias("least"))
    return met.where(F.col("met") >= least_met(F.col("most"), F.col("least"))).select(F.col("grp").alias("ga"), F.col("grp_").alias("gb"))


def opened(docs: DataFrame, sketches: DataFrame, groups: DataFrame, roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between similar members of two groups that nothing connected before. Of a pair the larger group is held and the
    members of the smaller one are its queries; a group with many queries is held in several copies. They meet as sketches
    first, and those that may be similar as whole sets."""
    members = stash(groups.join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left").select("fp", "grp", F.coalesce("root", "fp").alias("root")))
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"))
    side = lambda c: sizes.select(F.col("grp").alias(c), F.col("n").alias(f"n{c}"))
    swap = F.col("nga") < F.col("ngb")
    both = pairs.join(side("ga"), "ga").join(side("gb"), "gb").select(F.when(swap, F.col("gb")).otherwise(F.col("ga")).alias("held"), F.when(swap, F.col("ga")).otherwise(F.col("gb")).alias("grp"))
    asked = stash(both.join(members, "grp").select("held", "fp", "root"))
    copies = stash(asked.groupBy("held").agg(F.ceil(F.count("*") / QUERIES).alias("copies")))
    queries = asked.join(copies, "held").select("held", F.pmod(F.xxhash64("fp"), F.col("copies")).alias("copy"), F.lit(1).alias("query"), "fp", "root")
    holders = members.join(copies, F.col("grp") == F.col("held")).select("held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("query"), "fp", "root")
    near = sketches_for(sketches, stash(holders.unionByName(queries))).select("held", "copy", "query", "fp", "root", "n", "sketch")
    near = near.repartition("held", "copy").sortWithinPartitions("held", "copy", "query", "n", "fp")
    left = stash(near.mapInArrow(doubtful, "held long, copy long, part long, query long, fp long, root long"))
    rows = sets_for(docs, left).select("held", "copy", "part", "query", "fp", "root", "tokens")
    return rows.repartition("held", "copy", "part").sortWithinPartitions("held", "copy", "part", "query", "fp").mapInArrow(answer, "a long, b long")


# ---------------------------------------------------------------- the operator


def similar(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links of
    similarity TOP / BOTTOM or more, itself included).

    Null and empty texts have no shingles and link with nothing; a document without an id links others but is no
    component's name (where no member has an id, the name is null); repeated rows are equal sets and link; an empty table
    gives no rows; other columns are not looked at. Sets are 64-bit hashes of shingles, compared by 56 of their bits;
    equal sets are known by a 64-bit hash of the set."""
    rows = stash(sets_of(docs))
    sets = rows.where("fp is not null").select("id", "fp", "n", "cells")
    distinct = stash(sets.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("cells").alias("cells")))
    common = rows.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT)
    hot = common.orderBy(F.desc("times"), "token").limit(HOT_MOST).select("token").toArrow()["token"].to_numpy().view(np.uint64)
    groups = groups_of(distinct)
    sketches = rows.where("sketch is not null").select("fp", "n", "sketch")
    first = stash(group_edges(docs, sketches, groups))
    roots = components(first)
    total = distinct.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    pairs = stash(candidates(entries(docs, hot, 1 + int(total) // BUCKET), groups, roots))
    edges = first if pairs.isEmpty() else first.unionByName(opened(docs, sketches, groups, roots, pairs))
    final = components(edges)
    own = stash(sets.join(final.select(F.col("id").alias("fp"), "root"), "fp", "left").select("id", "n", "fp", F.when(F.col("n") > 0, F.coalesce("root", "fp")).alias("root")))
    names = own.where("n > 0").groupBy("root").agg(F.min("id").alias("name"))
    named = own.join(names, "root", "left")
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are the first of their component; documents without shingles or
    without an id stay. Rows that repeat an id stay or go together."""
    gone = similar(docs).where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("id_")).distinct()
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("id") == F.col("id_"), "left_anti").select("row.*")
