"""Shared pieces: words of whole texts, bounded blocks of rows, packed blobs, checkpoints."""
from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces that separate words: 0x20 and 0x09-0x0D, which is what bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one block of rows holds at most (a longer text is a block of its own).
BLOCK_BYTES = 2 << 20
BATCH_BYTES = 8 << 20

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> None:
    """Arrow batches of at most BATCH_BYTES in this session: a task holds one in the JVM, in Python, and as objects."""
    conf = df.sparkSession.conf
    if int(str(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")).lower().replace("m", "000000").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder named by spark.checkpoint.dir.

    The session's folder is used where one is set. Only a single-machine session without one makes a temporary folder; others
    raise RuntimeError.
    """
    sc = df.sparkSession.sparkContext
    small_batches(df)
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all machines share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="factloom-checkpoint-", dir=os.environ.get("TMPDIR")))
    return df.checkpoint(eager=True)


#: Rows of a narrow table that are worth a partition of their own, and partitions that a small one keeps.
PART_ROWS, PARTS = 20_000, 12


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed, in partitions of about PART_ROWS rows: a shuffle writes a block for each pair of partitions, however few rows they hold."""
    df = checkpointed(df)
    return df.coalesce(max(PARTS, df.count() // PART_ROWS))


_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
#: Bytes that are hashed at once, and a value for each byte.
_HASH_BYTES = 1 << 18
_OF_BYTE = np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers (from 0) of an odd number, or of its inverse, modulo 2**64."""
    if inverse not in _powers or len(_powers[inverse]) < n:
        base = np.full(max(n, _HASH_BYTES + 1), pow(_STEP, -1, 1 << 64) if inverse else _STEP, np.uint64)
        base[0] = 1
        _powers[inverse] = np.cumprod(base)
    return _powers[inverse][:n]


def spaced(text: bytes, table: bytes = _SPACES) -> bytes:
    """The text's words joined by single spaces; table may also change other bytes."""
    t = text.translate(table)
    return b" ".join(t.split()) if b"  " in t or t[:1] == b" " or t[-1:] == b" " else t


def words_of(whole: bytes, lines: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word of a text whose words stand between single spaces (or, with lines, line ends).

    A hash is a polynomial of the word's bytes, taken from running sums, so that no word is an object.
    """
    data = np.frombuffer(whole, np.uint8)
    gaps = np.flatnonzero((data == 32) | (data == 10) if lines else data == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        at = start[a]
        z = max(a + 1, int(np.searchsorted(end, at + _HASH_BYTES, side="right")))
        part = data[at : end[z - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_OF_BYTE[part] * powers(len(part)), out=sums[1:])
        low = start[a:z] - at
        out[a:z] = (sums[end[a:z] - at] - sums[low]) * powers(len(part) + 1, True)[low]
        a = z
    return start, end, mix(out)


def runs_hash(h: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of each run of count values of h from start on."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    return mix((sums[start + count] - sums[start]) * powers(len(h) + 1, True)[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * M2
    x = x ^ (x >> np.uint64(27))
    x = x * M3
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values; empty where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * M1 + h[i : i + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


def binary(column: pa.ChunkedArray | pa.Array):
    """A string column as one of bytes (null stays), without a copy."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def released() -> None:
    """Freed memory goes back to the system: workers live on between tasks, also while a stage has no Python."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call everywhere
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES):
    """Rows of Arrow batches as (columns by name, texts as bytes), at most limit bytes of text each; only a block's texts are copied at a time."""
    released()
    for batch in batches:
        texts, names = binary(batch.column(text)), [n for n in batch.schema.names if n != text]
        start = held = 0
        cuts = []
        for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if held and held + size > limit:
                cuts.append((start, i))
                start, held = i, 0
            held += size
        for a, z in [*cuts, (start, batch.num_rows)]:
            if a < z:
                part = batch.slice(a, z - a)
                yield {n: part.column(n) for n in names}, texts.slice(a, z - a).to_pylist()
        del batch, texts
    released()


def gathered(pool: list[bytes], which: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entries of pool that which names, one after the other, and where each starts (and the last one ends)."""
    size = np.fromiter(map(len, pool), np.int64, len(pool))
    many = size[which]
    at = np.zeros(len(which) + 1, np.int64)
    np.cumsum(many, out=at[1:])
    data, first = np.frombuffer(b"".join(pool), np.uint8), np.cumsum(size) - size
    out = np.empty(at[-1], np.uint8)
    for a in range(0, len(which), 1 << 16):  # in parts, as places take eight times the bytes
        z = min(a + (1 << 16), len(which))
        places = np.repeat(first[which[a:z]] - at[a:z], many[a:z])
        places += np.arange(at[a], at[z])
        np.take(data, places, out=out[at[a] : at[z]])
    return out.tobytes(), at


def pack(*parts: bytes | np.ndarray) -> bytes:
    """Parts as one compressed blob."""
    raw = [p.tobytes() if isinstance(p, np.ndarray) else p for p in parts]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=5).compress(b"".join([head, *raw]))


def unpack(blob: bytes) -> list[memoryview]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int(np.frombuffer(data[:8], np.int64)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(data[8:at], np.int64):
        out.append(data[at : at + int(size)])
        at += int(size)
    return out


def by_key(batches, key: str = "bucket", value: str = "blob"):
    """(key, values) of rows that come sorted by key."""
    released()
    now, held = None, []
    for batch in batches:
        for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(v)
    if held:
        yield now, held
    del held
    released()


def heavy(keys: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys that hold at least half of share of these keys, with their counts."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    values, counts = np.unique(keys, return_counts=True)
    keep = counts >= max(2, share / 2 * len(keys))
    return values[keep], counts[keep]


def is_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """among is sorted."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return among[at] == x


def own(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that other columns of any name do no harm."""
    small_batches(df)
    return df.select(*(F.col(f"`{c}`") for c in columns))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made of names that df does not have (case is ignored, as Spark ignores it)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while (n := f"_{n}").lower() in taken:
            pass
        out.append(n)
    return out
