"""Byte-level BPE encoding and decoding.

Distinct words are encoded by Spark higher-order functions that fold ranked merges over the array of a word's bytes; the rank map
is a literal (``encode_words``). Which words: ``frequent_words`` counts the pieces of all texts and takes the most frequent
``FREQUENT`` (a bound on what is sent to tasks), which make up nearly all occurrences; their ids go to each task. A word that is not
among them is folded by the same rule where it is met, so results don't depend on which words are frequent. A map literal of
50,000 entries is searched from its start at each look-up in Spark, so the rank map is arrays of
slots by the ids of the two pieces, which give the same answer in one step.

Text is cut into pieces before single spaces that stand between other characters; the public pattern never matches across
such a place, so a piece can be encoded, and remembered, by itself.

Defined results: null text is encoded as empty (no ids); a null doc_id stays null; repeated rows are encoded each; a text of any length is
encoded whole, words of over 200 bytes with a heap; other columns are not read; an empty table gives an empty result; null ids
decode to null, and an id that the ranks do not have raises ValueError.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B

#: Words whose ids are made by higher-order functions and sent to tasks, at most.
FREQUENT = 65_536
#: Longest of these words in bytes: the fold's steps grow with the square.
FREQUENT_BYTES = 32
#: Bytes of a block: its distinct pieces are looked up once.
BLOCK_BYTES = 4 << 20
#: Times that a task meets a piece whose words are counted.
LEAST = 6
#: Pieces, and words, that a task remembers.
CACHE = 320_000
_NO_RANK = 2**31 - 1
_PLAN_TEXT = "spark.sql.maxPlanStringLength"


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@functools.cache
def merges_of(path: str) -> tuple[dict[int, int], list[int]]:
    """(rank of the joined bytes of two ids a and b by key a * 2**17 + b, the ids of the 256 bytes) of a file of ranks."""
    ranks = ranks_of(path)
    if len(set(ranks.values())) < len(ranks) or max(ranks.values()) >> 17 or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError(f"{path}: ids are to be distinct and below {1 << 17}, and each byte is to have one")
    get = ranks.get
    pairs = {a << 17 | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None}
    return pairs, [ranks[bytes([i])] for i in range(256)]


def fold(word: bytes, path: str, whole: bool = True) -> list[int]:
    """Ids of one pre-token: its own (if whole), or the adjacent pair of least rank merges (the leftmost of equals) until none has a rank."""
    ranks = ranks_of(path)
    if whole and word in ranks:
        return [ranks[word]]
    if len(word) > 200:
        return _fold_long(word, ranks)
    pairs, single = merges_of(path)
    return _merged([single[b] for b in word], pairs.get)


def _merged(ids: list[int], get) -> list[int]:
    rank = [get(a << 17 | b, _NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
    while rank:
        new = min(rank)
        if new == _NO_RANK:
            break
        i = rank.index(new)
        ids[i] = new
        del ids[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(new << 17 | ids[i + 1], _NO_RANK)
        if i:
            rank[i - 1] = get(ids[i - 1] << 17 | new, _NO_RANK)
    return ids


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and linked pieces, for words of any length."""
    import heapq

    n = len(word)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, z = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != z or not alive[j]:
            continue
        end[i], after[i], alive[j] = z, after[j], False
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(word[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : z])) is not None:
            heapq.heappush(heap, (r, before[i], z))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


@functools.cache
def _pairs_of(path: str) -> tuple[int, str, str, str, str]:
    """The ranked merges of a file as literals: slots, then (comma-separated) slot starts, keys, ranks, and the ids of the 256 bytes.

    The key of two adjacent ids a and b is a * 2**17 + b; it stands in slot key mod slots, with the rank of their joined bytes.
    """
    pairs, single = merges_of(path)
    keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
    slots = len(keys) // 2 | 1
    by = np.argsort(keys % slots, kind="stable")
    starts = np.searchsorted(keys[by] % slots, np.arange(slots + 1))
    text = lambda x: ",".join(map(str, x))
    return slots, text(starts.tolist()), text(keys[by].tolist()), text(values[by].tolist()), text(single)


@functools.cache
def _unreached(path: str) -> dict[str, int]:
    """Tokens (hex) that merging does not lead to; such a word has its own id all the same."""
    ranks = ranks_of(path)
    return {t.hex().upper(): r for t, r in ranks.items() if fold(t, path, whole=False) != [r]}


def encode_words(words: DataFrame, path: str, column: str = "word") -> DataFrame:
    """words with a column ids array<int>: ranked merges of the words' UTF-8 bytes, folded by higher-order functions.

    column: string or binary. A null word has null ids, an empty one none. Any word is folded whole; cost grows with the square of its
    length. The fold holds the ids of a word's pieces and the rank of each adjacent pair; a step merges the leftmost pair of least rank
    and looks up its two new pairs in the rank map, a literal.
    """
    slots, *texts = _pairs_of(path)
    array = lambda text, kind: F.split(F.lit(text), ",").cast(f"array<{kind}>")  # noqa: E731  folded to one literal
    literal = F.struct(*(array(t, k).alias(n) for n, t, k in zip(("starts", "keys", "ranks", "bytes"), texts, ("int", "bigint", "int", "int"), strict=True)))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  value is computed once
    none = F.array().cast("array<int>")
    word = F.col(column).cast("binary")
    n = F.length(word)

    def folded(m):
        def rank(a, b):
            def found(k):
                at = lambda i: F.get(m["starts"], (k % slots).cast("int") + i)
                return let(at(0), lambda s: F.when(F.get(m["keys"], s) == k, F.get(m["ranks"], s)).otherwise(
                    let(F.array_position(F.slice(m["keys"], s + 1, at(1) - s), k).cast("int"), lambda q: F.when(q > 0, F.get(m["ranks"], s + q - 1)).otherwise(_NO_RANK))))

            return let(F.shiftleft(a.cast("long"), 17) + b, found)

        def merge(acc, _):
            p, r = acc["p"], acc["r"]

            def joined(new):
                return let(F.array_position(r, new).cast("int"), lambda i: F.struct(
                    F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
                    F.concat(
                        F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), F.when(i > 1, F.array(rank(F.get(p, i - 2), new))).otherwise(none),
                        F.when(i < F.size(r), F.array(rank(new, F.get(p, i + 1)))).otherwise(none), F.slice(r, i + 2, F.size(r))).alias("r")))

            return let(F.coalesce(F.array_min(r), F.lit(_NO_RANK)), lambda new: F.when(new == _NO_RANK, acc).otherwise(joined(new)))

        chars = F.decode(word, "ISO-8859-1")  # a character for each byte
        steps = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        single = F.transform(steps, lambda i: F.get(m["bytes"], F.ascii(F.substr(chars, i, F.lit(1)))))
        start = let(single, lambda p: F.struct(p.alias("p"), F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), rank).alias("r")))
        return F.aggregate(steps, start, merge, lambda acc: acc["p"])

    ids = let(literal, folded)
    if whole := _unreached(path):
        at = F.array_position(F.split(F.lit(",".join(whole)), ","), F.hex(word)).cast("int")
        ids = F.when(at > 0, F.array(F.get(F.split(F.lit(",".join(map(str, whole.values()))), ",").cast("array<int>"), at - 1))).otherwise(ids)
    return words.withColumn("ids", F.when(n.isNull(), F.lit(None)).when(n == 0, none).otherwise(ids))


#: White space after, or before, a single space: there the pattern may match across the space.
_WHITE = rb"(?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_ACROSS = re.compile(rb"\A | \Z| " + _WHITE + rb"|" + _WHITE + rb" ")
_PLAIN_WHITE = np.zeros(256, bool)
_PLAIN_WHITE[[*range(9, 14), *range(28, 33)]] = True
_LEADS = np.zeros(256, bool)  # first bytes of longer white space
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Codec(dict):
    """Ids of texts as bytes of decimal numbers, and their decoding by the ids' own bytes.

    A block of texts is cut into pieces at single spaces; its distinct pieces are found by hash, encoded and decoded once, and laid out
    again. That the decoded block equals the texts shows that no two pieces share a hash. Pieces are remembered: (ids, number of
    them, decoded bytes). known: ids of some words, made by encode_words, as decimal bytes.
    """

    def __init__(self, pattern: str, path: str, known: dict[str, bytes] | None = None, most: int = CACHE):
        self.find = regex.compile(pattern).findall
        self.path, self.known, self.most = path, known or {}, most
        self.words: dict[str, tuple[bytes, int, bytes]] = {}
        self.bytes_of = {b"%d" % v: k for k, v in ranks_of(path).items()}

    def word(self, w: str) -> tuple[bytes, int, bytes]:
        if (got := self.words.get(w)) is None:
            ids = self.known.get(w) or " ".join(map(str, fold(w.encode(), self.path))).encode()
            each = ids.split()
            got = self.words[w] = ids, len(each), b"".join(map(self.bytes_of.__getitem__, each))
        return got

    def plain(self, text: bytes) -> tuple[bytes, int, bytes]:
        """(ids, number of them, decoded bytes) of a text by itself."""
        found = self.find(text.decode())
        if len(found) == 1:
            return self.word(found[0])
        each = [self.word(w) for w in found]
        return b" ".join([x[0] for x in each]), sum([x[1] for x in each]), b"".join([x[2] for x in each])

    def __missing__(self, piece: bytes) -> tuple[bytes, int, bytes]:
        got = self[piece] = self.plain(b" " + piece)
        return got

    def block(self, texts: list[bytes]):
        """(ids, number of them, decoded bytes) of each text."""
        for cache in (self, self.words):
            if len(cache) > self.most:
                cache.clear()
        can = _separable(texts)
        good = [t for t, c in zip(texts, can, strict=True) if c]
        found = iter(self._laid_out(good) if good else ())
        for t, c in zip(texts, can, strict=True):
            yield next(found) if c else self.plain(t)

    def _laid_out(self, texts: list[bytes]):
        whole = b" ".join(texts)
        start, end, h = B.words_of(whole, lines=False)
        by = np.argsort(h)
        new = np.ones(len(by), bool)
        new[1:] = h[by[1:]] != h[by[:-1]]
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        first = by[new]
        entries = [self[whole[a:z]] for a, z in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        many = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
        at = np.cumsum(many) - many
        which[at] = np.arange(len(texts)) + len(entries)  # a text's first piece has no space before it
        entries += [self.plain(whole[a:z]) for a, z in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        decoded, places = B.gathered([e[2] for e in entries], which)
        if decoded != b"".join(texts):
            return [self.plain(t) for t in texts]  # two hashes coincide
        ids, spots = B.gathered([e[0] + b" " for e in entries], which)
        number = np.add.reduceat(np.fromiter((e[1] for e in entries), np.int64, len(entries))[which], at).tolist()
        cuts, cuts_ids = np.append(places[at], places[-1]).tolist(), np.append(spots[at], spots[-1]).tolist()
        return [(ids[a : z - 1], n, decoded[b:y]) for a, z, n, b, y in zip(cuts_ids, cuts_ids[1:], number, cuts, cuts[1:], strict=False)]


def _separable(texts: list[bytes]) -> list[bool]:
    """Which texts can be cut at their single spaces: no white space stands on either side of one, and none at an end."""
    whole = b"".join(texts)
    data = np.frombuffer(b"\0\0\0" + whole + b"\0", np.uint8)
    at = np.flatnonzero(data == 32)
    before, after = data[at - 1], data[at + 1]
    odd = _PLAIN_WHITE[before] | _PLAIN_WHITE[after] | _LEADS[after] | ((before >= 0x80) & ((data[at - 2] == 0xC2) | _LEADS[data[at - 3]]))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size) + 3
    doubt = np.zeros(len(texts), bool)
    doubt[np.searchsorted(ends, at[odd], side="right")] = True
    return [bool(t) and t[:1] != b" " and t[-1:] != b" " and not (d and _ACROSS.search(t)) for t, d in zip(texts, doubt.tolist(), strict=True)]


def _frequent(pattern: str):
    """Words of a task's pieces that occur LEAST times in it, with counts."""

    def run(batches):
        find = regex.compile(pattern).findall

        def told(count):
            words: Counter = Counter()
            for piece, n in count.items():
                if n >= LEAST:
                    for w in find(" " + piece.decode()):
                        words[w] += n
            return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

        count: Counter = Counter()
        for _, texts in B.blocks(batches, limit=BLOCK_BYTES):
            for t in texts:
                if t:
                    count.update(t.split(b" "))
            if len(count) > CACHE:
                yield told(count)
                count.clear()
        yield told(count)

    return run


def frequent_words(docs: DataFrame, pattern: str, most: int = FREQUENT) -> DataFrame:
    """word, n: the most frequent pre-tokens of docs.text, ties by word; n counts those in pieces that a task meets LEAST times or more."""
    words = docs.select("text").filter("text is not null").mapInArrow(_frequent(pattern), "word string, n long")
    return words.filter(F.octet_length("word") <= FREQUENT_BYTES).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def known_words(docs: DataFrame, pattern: str, path: str) -> dict[str, bytes]:
    """Ids (decimal, joined by a space) of frequent words, at most FREQUENT of FREQUENT_BYTES each."""
    spark = docs.sparkSession
    parts = spark.sparkContext.defaultParallelism
    #: Dealt out before they are encoded, so that the plan that holds the literal is one stage, which is not described again.
    words = B.checkpointed(frequent_words(docs, pattern).select("word").repartition(parts, "word"))
    rows = encode_words(words, path).select("word", F.concat_ws(" ", F.col("ids").cast("array<string>")).alias("ids"))
    before = spark.conf.get(_PLAN_TEXT)
    spark.conf.set(_PLAN_TEXT, "10000")  # the literal would be written out in each description of the plan
    try:
        got = rows.toArrow()
    finally:
        spark.conf.set(_PLAN_TEXT, before)
    known = {w: i.encode() for w, i in zip(got["word"].to_pylist(), got["ids"].to_pylist(), strict=True)}
    del got
    B.released()
    return known


def _digest(pattern, path, known, most):
    def run(batches):
        codec = Codec(pattern, path, known, most)
        for columns, texts in B.blocks(batches, limit=BLOCK_BYTES):
            n, ids_sha, text_sha = [], [], []
            for ids, many, text in codec.block([t or b"" for t in texts]):
                n.append(many)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": columns["doc_id"].cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return run


def _ids(pattern, path, known):
    def run(batches):
        codec = Codec(pattern, path, known)
        for columns, texts in B.blocks(batches, limit=BLOCK_BYTES):
            ids = [np.array(x.split(), np.int32) for x, _, _ in codec.block([t or b"" for t in texts])]
            yield pa.RecordBatch.from_pydict({"doc_id": columns["doc_id"].cast(pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def encode_documents(docs: DataFrame, pattern: str, path: str) -> DataFrame:
    """doc_id, ids array<int> of each row of docs (doc_id, text)."""
    return B.own(docs, "doc_id", "text").mapInArrow(_ids(pattern, path, known_words(docs, pattern, path)), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: UTF-8 of the ids' concatenated bytes (invalid sequences replaced)."""
    pieces = {v: k for k, v in ranks_of(path).items()}

    def joined(ids):
        try:
            return b"".join(map(pieces.__getitem__, ids)).decode(errors="replace")
        except KeyError as e:
            raise ValueError(f"id {e.args[0]} is not in the ranks") from None

    def run(batches):
        for b in batches:
            texts = [None if ids is None else joined(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, pattern: str, path: str, remembered: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs: encoded, then decoded, whole.

    remembered: pieces, and words, that a task keeps; fewer take less memory and more time.
    """
    return B.own(docs, "doc_id", "text").mapInArrow(_digest(pattern, path, known_words(docs, pattern, path), remembered), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_level_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded by the public ranks and decoded again."""
    import public_tokenizers

    return digest(B.table(spark, sf_dir, "documents"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.tiktoken"))
