"""SentencePiece encoding by sampling without replacement, and decoding.

A text's segmentations are the paths of a lattice of pieces. Every path has its log-probability plus Gumbel noise, and
the k paths with the largest sums are a sample without replacement. They are found from the top: a set of paths has one
Gumbel maximum, which is drawn first; the path that attains it is then drawn piece by piece, and what remains of the set
falls into the sets of paths that leave it at some piece, each with a maximum truncated to what lies above. Popping the
largest bound again gives the next path, so nothing beyond the k paths and their side branches is ever looked at.

Pieces never cross a word (white space and what follows it; where the model has no piece for it, also a letter and the mark
behind it), so lattices are made once for each different word of a block of texts, for all words together, and paths are
drawn for all words of the block together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm.common import byte_view, mix, slices, text_of
from upland.llm.words import JOINS, STOPS, different

SPACE = "▁"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FILTER = 20
BYTE_COST = 12.0             # -log probability of one byte of a character without a piece


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model file with a log-probability each. Unigram models state it; of a merge-ranked model the r-th
    piece gets probability in proportion to 1 / (r + 1)."""

    def __init__(self, model: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        byte = np.array([sp.is_byte(i) for i in range(n)])
        names = [sp.id_to_piece(i) for i in range(n)]
        self.fine = not any(JOINS.search(s) for i, s in enumerate(names) if not (special[i] or byte[i]))
        scores = np.array([sp.get_score(i) for i in range(n)])
        usable = np.flatnonzero(~special & ~byte)
        ranked = bool(np.all(scores[usable] == np.round(scores[usable])))
        lp = -np.log(1 - scores[usable]) if ranked else scores[usable]
        self.longest = max(len(names[i]) for i in usable)
        hashes = np.array([piece_hash(names[i]) for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.lp = hashes[order], usable[order], (lp - np.log(np.exp(lp - lp.max()).sum()) - lp.max())[order]
        self.table = np.full(1 << FILTER, -1, np.int32)        # a piece for each slot; pieces that share one are looked up
        self.table[slot(self.hashes)] = np.arange(len(order))
        self.shared = np.zeros(1 << FILTER, bool)
        self.shared[slot(self.hashes[self.table[slot(self.hashes)] != np.arange(len(order))])] = True
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(byte):
            self.byte_ids[int(names[i][3:5], 16)] = i
        plain = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.piece_len = np.array([len(p) for p in plain])
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(plain), np.uint8)


def piece_hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(FACTOR) + ord(c) + 1) % (1 << 64)
    return h


def slot(h: np.ndarray) -> np.ndarray:
    return (h * FACTOR) >> np.uint64(64 - FILTER)


@lru_cache(maxsize=4)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


class Lattice:
    """All pieces of many words: states are the characters of the words put end to end, edges are pieces."""

    def __init__(self, chars: np.ndarray, length: np.ndarray, v: Vocabulary):
        n = len(chars)
        self.end = np.cumsum(length)
        self.start = self.end - length
        left = np.repeat(self.end, length) - np.arange(n)     # characters from here to the word's end
        h = np.zeros(n, np.uint64)
        at, size, piece, lp = [], [], [], []
        one = np.zeros(n, bool)
        live = np.arange(n)
        for k in range(1, v.longest + 1):
            live = live[left[live] >= k]
            if not len(live):
                break
            h[live] = h[live] * FACTOR + (chars[live + k - 1] + 1).astype(np.uint64)
            at_slot = slot(h[live])
            found = v.table[at_slot]
            some = found >= 0
            hit, found, at_slot = live[some], found[some], at_slot[some]
            twice = np.flatnonzero(v.shared[at_slot])
            found[twice] = np.minimum(np.searchsorted(v.hashes, h[hit[twice]]), len(v.hashes) - 1)
            good = v.hashes[found] == h[hit]
            hit, found = hit[good], found[good]
            at.append(hit), size.append(np.full(len(hit), k)), piece.append(v.ids[found]), lp.append(v.lp[found])
            if k == 1:
                one[hit] = True
        bare = np.flatnonzero(~one)                            # characters that only their bytes can spell
        c = chars[bare]
        n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        at.append(bare), size.append(np.ones(len(bare), np.int64)), lp.append(-BYTE_COST * n_bytes)
        piece.append(np.where(c < 0x80, v.byte_ids[np.minimum(c, 127)], -c))
        at, size, piece, lp = (np.concatenate(x) for x in (at, size, piece, lp))
        order = np.argsort(at, kind="stable")
        at, self.size, self.piece, lp = at[order], size[order], piece[order], lp[order]
        first = np.searchsorted(at, np.arange(n + 1))
        beta = np.zeros(n + 1)
        self.n = n
        by_left = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, left.max() + 2 if n else 1))
        to_end = np.zeros(n + 1, bool)
        to_end[self.end] = True
        after = at + self.size
        ends_word = left[at] == self.size
        for r in range(len(cuts) - 1):
            states = by_left[cuts[r]:cuts[r + 1]]
            if len(states):
                counts = first[states + 1] - first[states]
                begin = np.cumsum(counts) - counts
                e = np.repeat(first[states] - begin, counts) + np.arange(counts.sum())
                value = lp[e] + np.where(ends_word[e], 0.0, beta[after[e]])
                top = np.maximum.reduceat(value, begin)
                beta[states] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), begin))
        self.log_p = np.minimum(lp + np.where(ends_word, 0.0, beta[after]) - beta[at], 0.0)
        best = np.flatnonzero(self.log_p == np.maximum.reduceat(self.log_p, first[:-1])[at])
        best = best[np.diff(at[best], prepend=-1) > 0]
        order = np.arange(len(at))                             # the likeliest edge of a state comes first
        order[first[:-1]], order[best] = best, first[:-1]
        self.log_p, self.size, self.piece, ends_word = self.log_p[order], self.size[order], self.piece[order], ends_word[order]
        p = np.exp(self.log_p)
        total = np.cumsum(p)
        base = np.concatenate([[0.0], total])[first[:-1]]
        share = (total - base[at]) / np.maximum((np.concatenate([[0.0], total])[first[1:]] - base)[at], 1e-300)
        share[first[1:] - 1] = 2.0
        self.upto = at + np.clip(share, 0.0, 2.0)              # of edge e, its state plus the cumulated share
        self.first, self.at, self.ends_word = first, at, ends_word

    def draw(self, states: np.ndarray, u: np.ndarray) -> np.ndarray:
        """One edge out of each state, by its conditional probability."""
        e = self.first[states]
        goal = states + u
        on = np.flatnonzero(self.upto[e] <= goal)
        while len(on):
            e[on] += 1
            on = on[self.upto[e[on]] <= goal[on]]
        return e

    def walk(self, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths from states to their words' ends: (number of the start, edge), in order."""
        who, out = np.arange(len(states)), []
        step = 0
        while len(who):
            e = self.draw(states, uniform(keys[who], step))
            out.append((who, e))
            on = ~self.ends_word[e]
            who, states = who[on], (self.at[e] + self.size[e])[on]
            step += 1
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, e = np.concatenate([w for w, _ in out]), np.concatenate([e for _, e in out])
        order = np.argsort(who, kind="stable")
        return who[order], e[order]


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from keys."""
    return (mix(keys + np.uint64((salt + 1) * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def exponential(keys: np.ndarray, salt: int) -> np.ndarray:
    return -np.log1p(-uniform(keys, salt) * (1 - 1e-16)) + 1e-300


class Path:
    """One drawn segmentation of a text, and for each piece the bound of the paths that leave it there."""

    def __init__(self, edges, words, value, log_p, own_from, bounds):
        self.edges, self.words, self.value = edges, words, value
        self.before = np.cumsum(log_p) - log_p
        self.log_prob = float(log_p.sum())
        self.bounds = bounds
        self.bounds[:own_from] = -np.inf
        self.taken: dict[int, list[int]] = {}


def truncated(mass, top, e):
    """Gumbel variables of location mass, truncated to at most top; -inf where there is no mass."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isfinite(mass), -np.logaddexp(-top, np.log(e) - mass), -np.inf)


def words_of(texts: list[str], fine: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The characters of the different words of texts, word after word, how many each word has, and each text's words by
    number. A word is spaces and what follows them; with `fine` words also end before a mark after a letter and around line
    ends."""
    raw = [(" " + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([0, *map(len, raw)])
    space = data == 32
    new = space.copy()
    new[1:] &= ~space[:-1]
    new[ends[:-1][np.diff(ends) > 0]] = True
    if fine:
        letter, line = ((data | 32) >= 97) & ((data | 32) <= 122), data == 10
        new |= line
        new[1:] |= line[:-1] | letter[:-1] & STOPS[data[1:]]
    starts = np.flatnonzero(new)
    first, which = different(data, starts)
    size = np.append(starts[1:], len(data))[first] - starts[first]
    own = data[np.repeat(starts[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    chars = np.frombuffer(own.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.add.reduceat((own & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64) if len(first) else size
    at = np.searchsorted(starts, ends)
    return np.where(chars == 32, ord(SPACE), chars), length, [which[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def sampled(texts: list[str], keys: np.ndarray, k: int, v: Vocabulary) -> list[list[tuple]]:
    """Per text, up to k (piece ids, log probability, perturbed value, inclusion probability), largest value first."""
    chars, length, rows = words_of(texts, v.fine)
    if not len(chars):
        return [[(np.zeros(0, np.int64), 0.0, 0.0, 1.0)] for _ in texts]
    lat = Lattice(chars, length, v)
    gone = np.log(1e-13)
    live = [i for i, r in enumerate(rows) if len(r)]
    paths: list[list[Path]] = [[] for _ in texts]
    left: list[float] = [-np.inf] * len(texts)

    # per round: (text, value, first word drawn anew, its state, edges kept in front, path left)
    turn = [(i, float(-np.log(exponential(keys[i:i + 1], -7)[0])), 0, None, None) for i in live]
    for j in range(k):
        states, word_keys, sizes = [], [], []
        for i, value, w0, head, _ in turn:
            own = lat.start[rows[i][w0:]].copy()
            skip = 0
            if head is not None:                                # the word in which the path leaves the older one
                e = head[-1]
                if lat.ends_word[e]:
                    skip = 1
                else:
                    own[0] = lat.at[e] + lat.size[e]
            states.append(own[skip:])
            salt = np.uint64((j + 1) * 0xD1B54A32D192ED03 % (1 << 64))
            word_keys.append(mix(keys[i:i + 1] + salt + (np.arange(w0 + skip, len(rows[i])) + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
            sizes.append((len(own) - skip, w0 + skip))
        who, edge = lat.walk(np.concatenate(states), np.concatenate(word_keys)) if states else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        cut = np.searchsorted(who, np.cumsum([0] + [s for s, _ in sizes]))
        begin = np.cumsum([0] + [s for s, _ in sizes])
        for (i, value, w0, head, parent), (_, w1), a, b, off in zip(turn, sizes, cut[:-1], cut[1:], begin):
            edges, words = edge[a:b], who[a:b] - off + w1
            if head is not None:
                edges = np.concatenate([head, edges])
                words = np.concatenate([parent.words[:len(head)], words])
            log_p = lat.log_p[edges]
            at = 0 if head is None else len(head)
            with np.errstate(divide="ignore"):
                rest = np.log(-np.expm1(np.minimum(log_p, -1e-300)))
            mass = np.cumsum(log_p) - log_p + np.where(rest > gone, rest, -np.inf)
            noise = exponential(mix(np.full(len(edges), keys[i] + np.uint64(j + 1), np.uint64)) + np.arange(len(edges)).astype(np.uint64), -11)
            paths[i].append(Path(edges, words, value, log_p, at, truncated(mass, value, noise)))
        turn = []
        for i in live:
            if len(paths[i]) <= j:
                continue
            p = max(paths[i], key=lambda q: q.bounds.max())
            t = int(p.bounds.argmax())
            value = float(p.bounds[t])
            left[i] = value
            if not np.isfinite(value) or j + 1 == k:
                continue
            taken = p.taken.setdefault(t, [int(p.edges[t])])
            state = lat.at[p.edges[t]]
            own = np.arange(lat.first[state], lat.first[state + 1])
            odds = np.exp(lat.log_p[own])
            odds[np.array(taken) - own[0]] = 0
            salted = mix(np.array([keys[i] + np.uint64(j * 977 + 13)], np.uint64))
            e = int(own[min(int(np.searchsorted(np.cumsum(odds), uniform(salted, -3)[0] * odds.sum(), "right")), len(own) - 1)])
            while odds[e - own[0]] == 0:                         # rounding at the upper end
                e -= 1
            taken.append(e)
            odds[e - own[0]] = 0
            rest = odds.sum()
            p.bounds[t] = truncated(p.before[t] + (np.log(rest) if rest > 1e-13 else -np.inf), value, exponential(salted, -5)[0])
            turn.append((i, value, int(p.words[t]), np.concatenate([p.edges[:t], [e]]), p))
    out = []
    for i, own in enumerate(paths):
        got = []
        for p in own:
            ids = spell(lat.piece[p.edges], v)
            got.append((ids, p.log_prob, p.value, float(-np.expm1(-np.exp(min(p.log_prob - left[i], 700.0)))) if np.isfinite(left[i]) else 1.0))
        out.append(got or [(np.zeros(0, np.int64), 0.0, 0.0, 1.0)])
    return out


def spell(pieces: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Piece ids; a character that has no piece (a negative number) becomes its bytes."""
    if not (pieces < 0).any():
        return pieces
    parts, last = [], 0
    for i in np.flatnonzero(pieces < 0):
        raw = chr(-int(pieces[i])).encode("utf-8", "surrogatepass")
        parts += [pieces[last:i], v.byte_ids[np.frombuffer(raw, np.uint8)]]
        last = i + 1
    return np.concatenate([*parts, pieces[last:]])


def decoded(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The text's bytes: pieces put together, without the space added in front."""
    size = v.piece_len[ids]
    begin = np.cumsum(size) - size
    raw = v.piece_bytes[np.repeat(v.piece_start[ids] - begin, size) + np.arange(size.sum())].tobytes()
    return raw[1:] if raw[:1] == b" " else raw


FIELDS = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("exact", pa.bool_()), ("pieces", pa.list_(pa.int32()))])
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, exact boolean, pieces array<int>"


def encode(docs: DataFrame, k: int = 2, seed: int = 1, model: str | None = None) -> DataFrame:
    """One row per document and sample: doc_id, sample (from 1), n_pieces, log_prob, perturbed (its Gumbel value),
    inclusion (the probability that a sample of k holds it, given the next value), exact (decoding gives the text back)
    and pieces (ids). A document with fewer than k segmentations has fewer rows, with
    inclusion 1 each; what is left counts as none when its probability is under 1e-13.

    Null and empty texts have one row without pieces; repeated rows are sampled alike, since the seed of a row is its
    doc_id (a null id is one seed of its own); an empty table gives no rows; other columns are not looked at. The sign
    U+2581 in a text is read as a space, as in the model's own decoder, and exact is then false."""
    path = model or default_model()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            _, ends = byte_view(batch.column(1))
            keys = mix(ids.astype(np.uint64) * np.uint64(2) + np.uint64(seed) * FACTOR)
            for lo, hi in slices(ends):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                cols: list[list] = [[] for _ in FIELDS.names]
                offsets, flat = [0], []
                for i, (text, got) in enumerate(zip(texts, sampled(texts, keys[lo:hi], k, v))):
                    plain = text.encode("utf-8", "surrogatepass")
                    for j, (pieces, log_prob, value, inclusion) in enumerate(got):
                        row = (lo + i, j + 1, len(pieces), log_prob, value, inclusion, decoded(pieces, v) == plain)
                        for c, x in zip(cols, row):
                            c.append(x)
                        flat.append(pieces)
                        offsets.append(offsets[-1] + len(pieces))
                values = pa.array(np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32))
                arrays = [batch.column(0).cast(pa.int64()).take(pa.array(cols[0], pa.int64())), *[pa.array(c, f.type) for c, f in zip(cols[1:-1], list(FIELDS)[1:-1])]]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], schema=FIELDS)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, column: str = "pieces", model: str | None = None) -> DataFrame:
    """Add a column `decoded`, the text that a column of piece ids spells; null ids give null."""
    path = model or default_model()

    def run(pieces: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([None if p is None else decoded(np.array(p, np.int64), v).decode("utf-8", "replace") for p in pieces.to_pylist()], pa.string())

    return encoded.withColumn("decoded", F.arrow_udf(run, "string")(F.col(column)))
