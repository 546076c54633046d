"""N-gram Jaccard join: documents linked by the overlap of their word shingles, with set-relation skipping.

1. *Classes.* Documents with one shingle set are one class (by a 64-bit hash of the set's shingle hashes and its
   size), so copies never become pairs. A shingle is a hash of 40 bits and its bucket's number (44 bits or more, 62 on a
   large corpus); two sets of a thousand shingles seem to share one too many with a chance of 1e-7 or less.
2. *Index.* Each class's shingles go to buckets by hash; a bucket counts the classes of each shingle, one sub-range
   of hashes after the other, and returns the shared ones (two classes or more). Buckets are large, as each repeats the class ids. A class with fewer than 85 % shared shingles has no partner and leaves.
   The rest order their shingles rarest first. Only a prefix of that order is indexed: two sets with the
   required overlap meet there.
3. *Skipping.* A posting list is sorted by size and position of the token in its set; the sets of one size are a block. A set reads of a
   block only the places where enough of both sets is left to reach the overlap; the rest of the block, or all of it, is skipped.
4. *Answers.* In each reach of sizes that can link at all, the first set of a list is its leader; others are compared with the leader only. A
   set that links takes over the leader's component, which is its answer as far as components go; it is not compared within its component again.
   A list with more than one component goes on to the next round, where each set outside the largest one meets TRIES others (twice as many each round): those most like their leader, and any; after ROUNDS rounds
   what is left is compared in full, but for pairs whose tokens before are the same too: they meet in that token's list, which
   fits them as well. Two sets that were compared with the same set y have answers that follow from y's: their overlap is
   |x & y| + |z & y| - |y| at least and min(|x & y|, |z & y|) + min(|x - y|, |z - y|) at most. Where a bound decides, the link is given, or the
   pair is left out, without a look at the sets. Lists end when they lie in one component or all such pairs across components were decided, so no link is lost.

Skew. Equal sets of a block of rows are sent once. Postings are numbers, sorted in bounded buckets. A group of copies has
one class; a group of near copies gives about as many pairs as sets in each round.

Defined results: null or empty text has no shingle and links with nothing; a text of any length gives all its shingles; sets at the limit itself link; fewer words than a shingle are one shingle;
a null doc_id is smaller than none (it is never a component_id unless all are null); repeated rows are returned each; empty
table, empty result. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from .components import components

SHINGLE, PERCENT = 5, 80
#: The query's own measure.
OP6_SHINGLE, OP6_PERCENT = 4, 85
#: Shingles that one bucket of the index holds on average (packed), and shared ones that it returns at once.
BUCKET_SHINGLES, SHARED_ROWS = 3_000_000, 1_000_000
_LOWER = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lists with at most so many pairs across components are compared in full at once.
FULL = 64
#: Sets that one outside the largest component of a list meets in a round; full comparison follows after ROUNDS.
TRIES, ROUNDS = 2, 4


def _sets(texts, k: int):
    """For each text its sorted distinct shingle hashes."""
    own = [B.spaced(t, _LOWER) if t else b"" for t in texts]
    whole = b" ".join([t for t in own if t])
    h = B.words_of(whole)[2] if whole else np.empty(0, np.uint64)
    g = B.grams(h, k)
    at = 0
    for t in own:
        n = t.count(b" ") + 1 if t else 0
        if n >= k:
            yield np.unique(g[at : at + n - k + 1])
        elif n:
            yield np.array([xxhash.xxh3_64_intdigest(h[at : at + n].tobytes(), seed=n)], np.uint64)
        else:
            yield np.empty(0, np.uint64)
        at += n


def _spread(k: int, buckets: int):
    """Kind 0: shingles of this block's classes by bucket of shingle; kind 1: its documents, by any bucket."""

    def run(batches):
        step = -(-(1 << 64) // buckets)
        for columns, texts in B.blocks(batches):
            ids = columns["doc_id"].cast(pa.int64())
            known, owner, sizes, sets = {}, [], [], []
            for s in _sets(texts, k):
                c = int(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) >> 1) if len(s) else -1
                if c not in known:
                    known[c] = len(s)
                    if len(s):
                        sets.append(s)
                owner.append(c)
                sizes.append(len(s))
            null = np.array([not v for v in ids.is_valid().to_pylist()], np.uint8)
            out = [(int(xxhash.xxh3_64_intdigest(np.array(owner).tobytes()) % buckets), B.pack(np.zeros(1, np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False), null, np.array(owner, np.int64), np.array(sizes, np.int32)))]
            if sets:
                tokens = np.concatenate(sets)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                of = np.repeat(np.arange(len(sets)), n)
                classes = np.array([c for c in known if c >= 0], np.int64)
                bucket = (tokens // np.uint64(step)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                rest = (tokens - bucket.astype(np.uint64) * np.uint64(step)) >> np.uint64(max(0, step.bit_length() - 40))
                low, high = rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    rows = by[cuts[b] : cuts[b + 1]]
                    who, many = np.unique(of[rows], return_counts=True)
                    out.append((b, B.pack(np.ones(1, np.uint8), classes[who], n[who].astype(np.int32), many.astype(np.int32), low[rows], high[rows])))
            for a in range(0, len(out), 64):
                z = out[a : a + 64]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in z], pa.int32()), "blob": pa.array([x[1] for x in z], pa.binary())})

    return run


def _shared(blobs, r: int):
    """tok, cls, n, df of the shingles in sub-range r (of 16) that two classes or more have; None without one."""
    parts = []
    for blob in blobs:
        _, who, sizes, many, low, high = (np.frombuffer(x, k) for x, k in zip(B.unpack(blob), (np.uint8, np.int64, np.int32, np.int32, np.uint32, np.uint8), strict=True))
        at = np.flatnonzero(high >> 4 == r)
        of = np.searchsorted(np.cumsum(many), at, side="right")
        parts.append((low[at].astype(np.uint64) | (high[at].astype(np.uint64) << np.uint64(32)), who[of], sizes[of]))
    if not parts:
        return None
    tok, cls, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    by = np.argsort(tok, kind="stable")
    first = np.ones(len(by), bool)
    first[1:] = tok[by][1:] != tok[by][:-1]
    size = np.diff(np.append(np.flatnonzero(first), len(by)))
    by = by[np.repeat(size > 1, size)]
    tok, cls, n = tok[by], cls[by], n[by]
    by = np.lexsort((cls, tok))
    tok, cls, n = tok[by], cls[by], n[by]
    one = np.ones(len(tok), bool)
    one[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])  # a class of several blocks counts once
    tok, cls, n = tok[one], cls[one], n[one]
    first = np.ones(len(tok), bool)
    first[1:] = tok[1:] != tok[:-1]
    size = np.diff(np.append(np.flatnonzero(first), len(tok)))
    df = np.repeat(size, size)
    keep = df > 1
    return (tok[keep], cls[keep], n[keep], df[keep]) if keep.any() else None


def _by_class(tok, cls, n, df, buckets: int):
    """Batches of shared shingles packed by bucket of class."""
    to = (B.mix(cls.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((cls, to))
    cuts = np.searchsorted(to[by], np.arange(buckets + 1))
    out = []
    for t in np.flatnonzero(np.diff(cuts)).tolist():
        rows = by[cuts[t] : cuts[t + 1]]
        who, at, times = np.unique(cls[rows], return_index=True, return_counts=True)
        out.append((t, B.pack(np.ones(1, np.uint8), who, n[rows][at], times.astype(np.int32), tok[rows], np.minimum(df[rows], 2**32 - 1).astype(np.uint32))))
    for a in range(0, len(out), 64):
        z = out[a : a + 64]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in z], pa.int32()), "blob": pa.array([x[1] for x in z], pa.binary())})


def _count(buckets: int):
    """Shared shingles of each bucket, by bucket of class; documents pass."""

    def run(batches):
        for b, blobs in B.by_key(batches):
            parts, docs = [], []
            for blob in blobs:
                (parts if B.unpack(blob)[0][0] else docs).append(blob)
            for a in range(0, len(docs), 64):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1 - b] * len(docs[a : a + 64]), pa.int32()), "blob": pa.array(docs[a : a + 64], pa.binary())})
            rows, held = [], 0
            for r in range(16):
                found = _shared(parts, r)
                if found is not None:
                    tok, cls, n, df = found
                    rows.append((tok | (np.uint64(b % (1 << 22)) << np.uint64(40)), cls, n, df))
                    held += len(tok)
                if rows and (held > SHARED_ROWS or r == 15):
                    yield from _by_class(*(np.concatenate(x) for x in zip(*rows, strict=True)), buckets)
                    rows, held = [], 0

    return run


def _need(n, percent: int):
    """Least overlap of a set of n with any set that it links to."""
    return -(-n * percent // 100)


_STATE = "cls long, n int, doc_id long, held boolean, shared int, tokens binary"


def _gather(percent: int):
    """Documents (cls, n, doc_id), and classes with enough shared shingles, in order of rarity (tokens)."""

    def empty(k, kind):
        return pa.nulls(k, kind)

    def run(batches):
        for b, blobs in B.by_key(batches):
            if b < 0:
                for blob in blobs:
                    p = B.unpack(blob)
                    doc, null, cls, n = (np.frombuffer(p[i], k) for i, k in ((1, np.int64), (2, np.uint8), (3, np.int64), (4, np.int32)))
                    k = len(doc)
                    yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "n": pa.array(n, pa.int32()), "doc_id": pa.array(doc, pa.int64(), mask=null.astype(bool)), "held": pa.array([True] * k), "shared": empty(k, pa.int32()), "tokens": empty(k, pa.binary())})
                continue
            parts = [B.unpack(x) for x in blobs]
            column = lambda i, kind: np.concatenate([np.frombuffer(p[i], kind) for p in parts])  # noqa: B023, E731
            who, n, many = column(1, np.int64), column(2, np.int32), column(3, np.int32)
            classes, at = np.unique(who, return_index=True)
            size, shared = n[at], np.zeros(len(classes), np.int64)
            np.add.at(shared, np.searchsorted(classes, who), many)
            good = shared * 100 >= size.astype(np.int64) * percent
            if not good.any():
                continue
            of = np.searchsorted(classes, np.repeat(who, many))
            keep = good[of]
            of, tok, df = of[keep], column(4, np.uint64)[keep], column(5, np.uint32)[keep]
            by = np.lexsort((tok, df, of))
            tok, cuts = tok[by], np.searchsorted(of[by], np.arange(len(classes) + 1))
            rows = np.flatnonzero(good).tolist()
            for a in range(0, len(rows), 500):
                z = rows[a : a + 500]
                yield pa.RecordBatch.from_pydict({"cls": pa.array(classes[z], pa.int64()), "n": pa.array(size[z], pa.int32()), "doc_id": empty(len(z), pa.int64()), "held": pa.array([False] * len(z)), "shared": pa.array(shared[z], pa.int32()), "tokens": pa.array([tok[cuts[i] : cuts[i + 1]].tobytes() for i in z], pa.binary())})

    return run


def _postings(percent: int):
    """The prefix of each set: token, the token before it (-1: none), cls, n, pos. Unshared shingles come first in the order and meet nothing."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for c, n, shared, t in zip(*(batch.column(x).to_pylist() for x in ("cls", "n", "shared", "tokens")), strict=True):
                alone = n - shared
                tok = np.frombuffer(t, np.int64)[: max(0, n - int(_need(n, percent)) + 1 - alone)]
                for x, v in zip(out, (tok, np.append(-1, tok[:-1])[: len(tok)], np.full(len(tok), c), np.full(len(tok), n), np.arange(alone, alone + len(tok))), strict=True):
                    x.append(v)
            if out[0]:
                a = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_pydict({"token": pa.array(a[0], pa.int64()), "before": pa.array(a[1], pa.int64()), "cls": pa.array(a[2], pa.int64()), "n": pa.array(a[3], pa.int32()), "pos": pa.array(a[4], pa.int32())})

    return run


_COLUMNS = ("token", "before", "cls", "n", "pos", "root", "lead", "lead_n", "over")


def _lists(batches):
    """(columns as numpy arrays, as Python lists, first, last + 1) of each token's postings, which come sorted by token, n and pos."""
    held = None
    for batch in batches:
        a = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in _COLUMNS}
        if held is not None:
            a = {x: np.concatenate([held[x], a[x]]) for x in a}
        cuts = np.append(np.flatnonzero(np.append(True, a["token"][1:] != a["token"][:-1])), len(a["token"])).tolist()
        plain = {x: a[x][: cuts[-2]].tolist() for x in _COLUMNS[:6]} if len(cuts) > 2 else None
        for s, z in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield a, plain, s, z
        held = {x: v[cuts[-2] :] for x, v in a.items()} if len(cuts) > 1 else None
    if held is not None and len(held["token"]):
        yield held, {x: held[x].tolist() for x in _COLUMNS[:6]}, 0, len(held["token"])


#: Lists of at most so many sets are compared in full, one pair after the other.
SHORT = 8


def _short(x, s: int, z: int, percent: int):
    """Pairs of a short list."""
    before, cls, n, pos, root = (x[c] for c in _COLUMNS[1:6])
    for i in range(s, z):
        for j in range(i + 1, z):
            if root[i] != root[j] and (before[i] < 0 or before[i] != before[j]) and n[i] * 100 >= n[j] * percent and (100 + percent) * min(n[i] - pos[i], n[j] - pos[j]) >= percent * (n[i] + n[j]):
                yield (cls[i], cls[j]) if cls[i] < cls[j] else (cls[j], cls[i])


class PostingList:
    """The sets that have one token in their prefix, in blocks of one size, each sorted by the token's position.

    over: overlap with the set lead of lead_n shingles, with which this one was compared; below 0 if with none.
    """

    def __init__(self, columns: dict[str, np.ndarray]):
        self.token, self.before, self.cls, self.n, self.pos, self.root, self.lead, self.lead_n, self.over = (columns[x].astype(np.int64, copy=False) for x in _COLUMNS)
        self.key = self.n << 32 | self.pos
        self.first = np.flatnonzero(np.append(True, self.n[1:] != self.n[:-1]))  # of each block
        self.sizes = self.n[self.first]
        self.read = self.skipped = 0  # postings

    def reach(self, i: int, percent: int, low: int = 0, high: int = 1 << 62) -> np.ndarray:
        """Places low to high of sets in other components that set i can link to by size and position; blocks are skipped past the last position that will do."""
        n, left = int(self.n[i]), int(self.n[i] - self.pos[i])
        need = -(-(n + self.sizes) * percent // (100 + percent))
        blocks = np.flatnonzero((np.minimum(n, self.sizes) * 100 >= np.maximum(n, self.sizes) * percent) & (need <= left))
        start = np.maximum(self.first[blocks], low)
        stop = np.minimum(np.searchsorted(self.key, self.sizes[blocks] << 32 | np.maximum(self.sizes[blocks] - need[blocks], 0), side="right"), high)
        many = np.maximum(stop - start, 0)
        out = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.read, self.skipped = self.read + len(out), self.skipped + len(self.n) - len(out)
        return out[self.root[out] != self.root[i]]

    def known(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """For each of others: 1 if the answers of the set that it and i were compared with tell that it links to i, -1 if that it doesn't, else 0."""
        if self.over[i] < 0:
            return np.zeros(len(others), np.int8)
        a, b, n, m = self.over[i], self.over[others], self.n[i], self.n[others]
        same = (b >= 0) & (self.lead[others] == self.lead[i])
        enough = percent * (n + m)
        least, most = a + b - self.lead_n[i], np.minimum(a, b) + np.minimum(n - a, m - b)
        return np.where(same, ((100 + percent) * least >= enough).astype(np.int8) - ((100 + percent) * most < enough), 0)


def _pairs(percent: int, turn: int, last: bool):
    """Pairs to compare (linked: those known to link), and (b null) the tokens whose lists go on."""

    def first(x, i, others):
        """others that i doesn't meet in the list of the token before as well: that one is compared in full, then or later."""
        return others[(x.before[i] < 0) | (x.before[others] != x.before[i])]

    def run(batches):
        out, told = [], set()  # told: pairs that this task has given
        for columns, plain, s, z in _lists(batches):
            size = z - s
            if size <= SHORT:
                for pair in _short(plain, s, z, percent):
                    if pair not in told:
                        told.add(pair)
                        out.append((*pair, False))
                continue
            x = PostingList({c: v[s:z] for c, v in columns.items()})
            if (x.root == x.root[0]).all():
                continue
            roots, number, many = np.unique(x.root, return_inverse=True, return_counts=True)
            small = np.flatnonzero(number != many.argmax())
            pairs, links = [], []

            def undecided(i, others):
                tell = x.known(i, others, percent)  # noqa: B023
                mine = others[tell == 1]
                links.extend((i, j) for j in mine[np.unique(x.root[mine], return_index=True)[1]].tolist())  # noqa: B023  one of each component will do
                return others[tell == 0], len(mine) and (number[mine] == many.argmax()).any()  # noqa: B023

            if last or len(small) * size <= FULL:
                for i in small.tolist():
                    others = x.reach(i, percent)
                    others, _ = undecided(i, others[(number[others] == many.argmax()) | (others > i)])
                    pairs += [(i, j) for j in first(x, i, others).tolist()]
            elif turn:  # each set outside the largest component meets some others, of which most have many answers
                for i in small.tolist():
                    others, joined = undecided(i, x.reach(i, percent))
                    if len(others) and not joined:
                        many_tries = min(TRIES << (turn - 1), len(others))
                        central = np.argsort(-x.over[others] / x.n[others], kind="stable")[many_tries - TRIES : 2 * many_tries - TRIES]
                        any_ = (int(x.cls[i] ^ x.token[0]) + turn + np.arange(many_tries)) % len(others)
                        pairs += [(i, j) for j in np.unique(others[np.concatenate([central, any_])]).tolist()]
                out.append((int(x.token[0]), None, False))
            else:
                lead = 0
                while lead < size:  # one leader for each reach of sizes
                    stop = int(np.searchsorted(x.n, int(x.n[lead]) * 100 // percent, side="right"))
                    pairs += [(lead, j) for j in x.reach(lead, percent, lead + 1, stop).tolist()]
                    lead = max(stop, lead + 1)
                out.append((int(x.token[0]), None, False))
            for linked, found in ((True, links), (False, pairs)):
                for i, j in found:
                    pair = int(min(x.cls[i], x.cls[j])), int(max(x.cls[i], x.cls[j]))
                    if pair not in told:
                        told.add(pair)
                        out.append((*pair, linked))
            if len(told) > 500_000:
                told.clear()
            if len(out) > 20_000:
                yield _found(out)
                out = []
        yield _found(out)

    return run


def _found(rows):
    return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in rows], pa.int64()), "b": pa.array([x[1] for x in rows], pa.int64()), "linked": pa.array([x[2] for x in rows], pa.bool_())})


def _verify(percent: int):
    """Each pair with its overlap."""

    def run(batches):
        for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            a, b, na, nb, x, y = (batch.column(i).to_pylist() for i in ("a", "b", "n_a", "n_b", "t_a", "t_b"))
            both = [len(np.intersect1d(np.frombuffer(p, np.int64), np.frombuffer(q, np.int64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
            linked = [100 * o >= percent * (p + q - o) for o, p, q in zip(both, na, nb, strict=True)]
            yield pa.RecordBatch.from_pydict({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64()), "n_u": pa.array(na, pa.int32()), "n_v": pa.array(nb, pa.int32()), "both": pa.array(both, pa.int32()), "linked": pa.array(linked, pa.bool_())})

    return run


def linked_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs: doc_id, text. One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct k-word shingles
    (words cut at 0x20 and 0x09-0x0D, A-Z lower-cased).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = rows.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(16, words // 6 // BUCKET_SHINGLES)
    counted = rows.mapInArrow(_spread(k, buckets), "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(8 * buckets), "bucket int, blob binary")
    state = checkpointed_state(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_gather(percent), _STATE))
    held = state.filter("held").select("cls", "n", "doc_id")
    sets = state.filter("not held").select("cls", "n", "shared", "tokens")
    roots = _answers(sets, percent)
    labelled = held if roots is None else held.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    labelled = labelled.withColumn("at", F.coalesce(F.col("root"), F.col("cls")) if roots is not None else F.col("cls"))
    #: Settled, so that both sides of the join are plain exchanges, of which a hot component's can be split.
    least = B.settled(labelled.filter("cls >= 0").groupBy("at").agg(F.min("doc_id").alias("least")))
    out = labelled.join(least, "at", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def checkpointed_state(df: DataFrame) -> DataFrame:
    return B.checkpointed(df)


def _answers(sets: DataFrame, percent: int) -> DataFrame | None:
    """node, root of the classes that link; None where none does."""
    lists = sets.mapInArrow(_postings(percent), "token long, before long, cls long, n int, pos int")
    shared = lists.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1").select("token")
    lists = B.settled(lists.join(shared, "token"))
    roots = done = compared = None
    turn = 0
    while True:
        now = lists.withColumns({"root": F.col("cls"), "lead": F.lit(0).cast("long"), "lead_n": F.lit(0), "over": F.lit(-1)})
        if compared is not None:
            known = _leads(compared).join(roots.withColumnRenamed("node", "cls"), "cls", "full") if roots is not None else _leads(compared).withColumn("root", F.col("cls"))
            known = B.settled(known.withColumnRenamed("root", "r"))
            now = lists.join(known, "cls", "left").select("token", "before", "cls", "n", "pos", F.coalesce("r", "cls").alias("root"), F.coalesce("lead", F.lit(0)).alias("lead"), F.coalesce("lead_n", F.lit(0)).alias("lead_n"), F.coalesce("over", F.lit(-1)).alias("over"))
        found = now.repartition("token").sortWithinPartitions("token", "n", "pos", "cls").mapInArrow(_pairs(percent, turn, turn >= ROUNDS), "a long, b long, linked boolean")
        found = B.settled(found.distinct())
        pairs = found.filter("b is not null and not linked").select("a", "b")
        if done is not None:
            pairs = B.settled(pairs.join(done, ["a", "b"], "left_anti"))
        checked = B.settled(_compare(pairs, sets, percent))
        new = checked.filter("linked").select("u", "v").union(found.filter("linked").select("a", "b"))
        if not new.isEmpty():  # earlier links are held by the stars that they left
            roots = components(new if roots is None else roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(new))
        rest = found.filter("b is null").select(F.col("a").alias("token"))
        if rest.isEmpty():
            return roots
        done = pairs if done is None else done.union(pairs)
        compared = checked if compared is None else compared.union(checked)
        lists = B.settled(lists.join(rest, "token", "left_semi"))
        turn += 1


def _leads(compared: DataFrame) -> DataFrame:
    """cls, lead, lead_n, over: for each compared set the one of most comparisons that it was compared with."""
    side = lambda x, y: compared.select(F.col(x).alias("cls"), F.col(f"n_{x}").alias("n"), F.col(y).alias("lead"), F.col(f"n_{y}").alias("lead_n"), F.col("both").alias("over"))
    both = side("u", "v").union(side("v", "u"))
    often = both.groupBy("lead", "lead_n").agg(F.count("*").alias("often"))
    itself = often.select(F.col("lead").alias("cls"), "lead", "lead_n", F.col("lead_n").alias("over"), "often")  # a set's overlap with itself
    every = both.select("cls", "lead", "over").join(often, "lead").select("cls", "lead", "lead_n", "over", "often").union(itself)
    best = every.groupBy("cls").agg(F.max(F.struct("often", "lead", "over", "lead_n")).alias("x"))
    return best.select("cls", "x.lead", "x.lead_n", "x.over")


#: Ids of sets that are sent to all tasks at most, to leave other sets out before the shuffle.
SENT_IDS = 300_000


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v, their sizes, both, linked: the pairs with the size of their sets' intersection."""
    ids = B.settled(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    few = ids.count() <= SENT_IDS
    own = sets.join(F.broadcast(ids) if few else ids, "cls", "left_semi")
    side = lambda x: own.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(percent), "u long, v long, n_u int, n_v int, both int, linked boolean")


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that are linked to an earlier one (by doc_id, null last, then by a hash of the text); columns stay.

    A row's key is a 64-bit hash of doc_id and text, so rows that share a doc_id, or have none, go or stay by their own text. Of
    rows with one key the least by the other columns stays. Rows without a word all stay.
    """
    (k_,) = B.unused(docs, "key")
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    found = linked_documents(docs.select(key.alias("doc_id"), "text"), k, percent).filter("n_shingles > 0")
    found = B.settled(found.groupBy(F.col("doc_id").alias(k_), F.col("component_id").alias("at")).agg(F.count("*").alias("many")))
    own = docs.select(key.alias(k_), F.col("doc_id").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", k_)).alias("first")
    kept = found.join(own, k_).groupBy("at").agg(first).select(f"first.{k_}")
    gone = B.settled(found.select(k_).join(kept, k_, "left_anti"))
    again = B.settled(found.filter("many > 1").select(k_).join(gone, k_, "left_anti"))
    rest = docs.withColumn(k_, key).join(gone, k_, "left_anti")
    if again.isEmpty():
        return B.own(rest, *docs.columns)
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    one = rest.join(again, k_, "left_semi").groupBy(k_).agg(F.min(F.struct(*names, "doc_id", "text")).alias("row"))
    return B.own(rest.join(again, k_, "left_anti"), *docs.columns).unionByName(one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document with its component of links at 4-word shingles and a similarity of 0.85."""
    return linked_documents(B.table(spark, sf_dir, "documents"), OP6_SHINGLE, OP6_PERCENT)


OP6_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[s:s+3], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS s FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY 1) m USING (doc_id)
"""
