"""Token-ID output: best-fit-decreasing packing into id matrices.

Every block of rows (at most ``_blocks.BLOCK_BYTES`` of text) is packed by itself, without a shuffle: documents longer than a
row of the matrix are cut into chunks of its width without loss, chunks go by decreasing length to the open row whose free
place is the least that holds them, and a segment tree over free places finds that row in log2(width) steps. So memory and time
of a task are bounded by the block, and the fill of rows does not depend on the size of the corpus.

Result, one row for each row of a matrix: seq_id (document:chunk of its first segment), n_tokens, ids (binary,
little-endian uint16, width entries, padded), cu_seqlens (0 and the ends of segments), position_resets (where
position ids start again from position_starts), doc_ids and chunks of the segments. unpack_documents restores the ids.

Tokens: byte tokens (byte + 3; 0 pads, 1 ends a document), or any ids below 65,536 given as a column ids.
Defined results: null or empty text is a document of the end token alone; null or empty ids without an end are an empty segment, so that no
document is lost; a null doc_id stays null; equal lengths go by the order of rows; repeated rows are packed each; a text of any length is cut into chunks; an id of 65,536 or
more is an error; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B

WIDTH = 8192
PAD, END, FIRST = 0, 1, 3
#: Ids that one block holds at most (a longer document is a block of its own).
BLOCK_IDS = 4 << 20

SCHEMA = "seq_id string, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, position_starts array<long>, doc_ids array<long>, chunks array<int>"


class Places:
    """Open rows by free place: a segment tree of counts over 0..width."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.leaves
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(free, row) of the least free place that is at least least; it is taken out."""
        tree, i = self.tree, least + self.leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up, until a right sibling holds a row
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        free = i - self.leaves
        while i:
            tree[i] -= 1
            i >>= 1
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Items (indexes of lengths, each 1..width) of each row, longest first; ties by index."""
    rows: list[list[int]] = []
    places = Places(width)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        free, row = (n < width and places.take(n)) or (width, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(item)
        if free > n:
            places.put(free - n, row)
    return rows


def _byte_ids(texts) -> list[np.ndarray]:
    end = np.array([END], np.uint16)
    return [np.concatenate([np.frombuffer(t or b"", np.uint8).astype(np.uint16) + FIRST, end]) for t in texts]


def _pack_block(docs: list, ids: list[np.ndarray], width: int):
    chunks = [(i, a) for i, x in enumerate(ids) for a in range(0, max(1, len(x)), width)]
    lengths = [min(width, len(ids[i]) - a) for i, a in chunks]
    keep = [j for j, n in enumerate(lengths) if n]
    empty = [chunks[j] for j, n in enumerate(lengths) if not n]  # documents without an id: empty segments of the first row
    out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
    rows = best_fit_decreasing([lengths[j] for j in keep], width) or ([[]] if empty else [])
    for at_row, row in enumerate(rows):
        parts = [chunks[keep[r]] for r in row] + (empty if at_row == 0 else [])
        sizes = [lengths[keep[r]] for r in row] + ([0] * len(empty) if at_row == 0 else [])
        matrix = np.full(width, PAD, "<u2")
        at = np.cumsum([0, *sizes]).tolist()
        for (i, a), s, n in zip(parts, at, sizes, strict=False):
            matrix[s : s + n] = ids[i][a : a + n]
        out["seq_id"].append(f"{docs[parts[0][0]]}:{parts[0][1] // width}")
        out["n_tokens"].append(at[-1])
        out["ids"].append(matrix.tobytes())
        out["cu_seqlens"].append(at)
        out["position_resets"].append(at[:-1])
        out["position_starts"].append([a for _, a in parts])
        out["doc_ids"].append([docs[i] for i, _ in parts])
        out["chunks"].append([a // width for _, a in parts])
    return out


_TYPES = {"seq_id": pa.string(), "n_tokens": pa.int32(), "ids": pa.binary(), "cu_seqlens": pa.list_(pa.int32()), "position_resets": pa.list_(pa.int32()), "position_starts": pa.list_(pa.int64()), "doc_ids": pa.list_(pa.int64()), "chunks": pa.list_(pa.int32())}


def _batches(out: dict[str, list]):
    for a in range(0, len(out["seq_id"]), 256):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[a : a + 256], _TYPES[k]) for k, v in out.items()})


def pack_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Matrices of the byte tokens of docs (doc_id, text)."""

    def run(batches):
        for columns, texts in B.blocks(batches):
            yield from _batches(_pack_block(columns["doc_id"].cast(pa.int64()).to_pylist(), _byte_ids(texts), width))

    return B.own(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def pack_ids(encoded: DataFrame, width: int = WIDTH, end: int | None = None) -> DataFrame:
    """Matrices of documents that are encoded already: doc_id, ids array<int> (each below 65,536); end is appended if given."""

    tail = np.array([] if end is None else [end], np.uint16)

    def run(batches):
        docs, ids, held = [], [], 0
        for b in batches:
            lists = b.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for doc, a, z, known in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), offsets, offsets[1:], lists.is_valid().to_pylist(), strict=False):
                own = flat[a:z] if known else flat[:0]
                if len(own) and not 0 <= own.min() <= own.max() < 1 << 16:
                    raise ValueError("ids are to be below 65,536")
                docs.append(doc)
                ids.append(np.concatenate([own.astype(np.uint16), tail]))
                held += len(own) + 1
                if held > BLOCK_IDS:
                    yield from _batches(_pack_block(docs, ids, width))
                    docs, ids, held = [], [], 0
        if docs:
            yield from _batches(_pack_block(docs, ids, width))

    return encoded.select("doc_id", "ids").mapInArrow(run, SCHEMA)


def unpack_documents(packed: DataFrame) -> DataFrame:
    """doc_id, chunk, ids array<int>: the segments of matrices."""

    def run(batches):
        for b in batches:
            docs, chunks, ids = [], [], []
            for m, cu, d, c in zip(*(b.column(x).to_pylist() for x in ("ids", "cu_seqlens", "doc_ids", "chunks")), strict=True):
                row = np.frombuffer(m, "<u2").astype(np.int32)
                for s, e, doc, chunk in zip(cu, cu[1:], d, c, strict=False):
                    docs.append(doc)
                    chunks.append(chunk)
                    ids.append(row[s:e])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "chunk": pa.array(chunks, pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return packed.select("ids", "cu_seqlens", "doc_ids", "chunks").mapInArrow(run, "doc_id long, chunk int, ids array<int>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Matrices as Parquet files that can be split and read again in parallel."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def op1_token_packing(spark, sf_dir: str) -> DataFrame:
    """Every text of documents as byte tokens in packed matrices."""
    return pack_texts(B.table(spark, sf_dir, "documents"))
