"""Token ids in range-coded files: static asymmetric numeral system with interleaved lanes.

A segment is a run of whole documents in ascending doc_id order. It holds one frequency table, shared by its blocks; a block is a
fixed number of ids, coded by itself in 2,048 interleaved lanes, with the lanes' states at checkpoints and a checksum of its ids, so
blocks and the parts between checkpoints decode in parallel. Segments are rows of a Parquet table in the shared folder: Spark commits
them whole, and a lost executor's segments are written again.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import process_cache, stored, text_of

MAGIC = b"TWA1"
SCALE = 18
LANES = 2048
BLOCK = 1 << 19
SEGMENT = 1 << 21
EVERY = 128
LOW = np.uint64(1 << 31)
#: Runs in each of the two generations that a Python worker remembers, and their most characters: some 150 MB together.
MEMO = 400_000
LONGEST = 48
#: Stand between runs that are encoded together: one between those without numerals, one between those with. So many runs at once.
MARKS = ("0", "|")
GROUP = 256
#: Bytes of text that are encoded together (a longer text is encoded alone).
PIECE = 8 << 20
END_ID = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- the coder ---------------------------------------------------------------------------------------------------------------


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and their frequencies scaled to a sum of 2**SCALE, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.float64)
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError(f"more than {total} different ids")
    freq = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - total
    if over < 0:
        freq[np.argmax(counts)] -= over
    while over > 0:
        order = np.argsort(-freq, kind="stable")
        take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // total))
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[order] -= take
        over -= int(take.sum())
    return symbols.astype(np.uint32), freq


def pack_table(symbols: np.ndarray, freq: np.ndarray) -> bytes:
    return zlib.compress(np.diff(symbols.astype(np.int64), prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)


def unpack_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), "<u4")
    n = len(raw) // 2
    return np.cumsum(raw[:n].astype(np.int64)).astype(np.uint32), raw[n:].astype(np.int64)


def encode_block(dense: np.ndarray, freq: np.ndarray, cum: np.ndarray, crc: int, lanes: int = LANES, every: int = EVERY) -> bytes:
    """dense: the ids' places in the table. Header, checkpoints (step, words before it, states), words."""
    n = len(dense)
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    f_all, c_all = freq.astype(np.uint64), cum.astype(np.uint64)
    shift, word = np.uint64(63 - SCALE), np.uint64(32)
    out: list[np.ndarray] = []
    emitted, checks = 0, []
    for s in range(steps - 1, -1, -1):
        symbols = dense[s * lanes : (s + 1) * lanes]
        k = len(symbols)
        f = f_all[symbols]
        y = x[:k]
        full = np.flatnonzero(y >= (f << shift))
        if len(full):
            high = y[full]
            out.append(high.astype(np.uint32))
            y[full] = high >> word
            emitted += len(full)
        q = y // f
        x[:k] = (q << np.uint64(SCALE)) + (y - q * f) + c_all[symbols]
        if s % every == 0:
            checks.append((s, emitted, x.copy()))
    head = struct.pack("<4sIIIIII", MAGIC, n, lanes, every, len(checks), emitted, crc)
    body = b"".join(struct.pack("<II", s, emitted - e) + state.astype("<u8").tobytes() for s, e, state in reversed(checks))
    return head + body + (np.concatenate(out[::-1]).astype("<u4").tobytes() if out else b"")


def decode_block(data: bytes, symbols: np.ndarray, freq: np.ndarray, part: int | None = None, slots: np.ndarray | None = None) -> np.ndarray:
    """The block's ids, or those from one checkpoint to the next. Raises if the whole block's checksum doesn't fit."""
    magic, n, lanes, every, n_checks, words, crc = struct.unpack_from("<4sIIIIII", data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    steps, size = -(-n // lanes), 8 + 8 * lanes
    at = struct.calcsize("<4sIIIIII")
    stream = np.frombuffer(data, "<u4", words, at + n_checks * size)
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq) if slots is None else slots
    f_all, c_all = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    first, last = (0, steps) if part is None else (part * every, min(steps, (part + 1) * every))
    out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
    if n_checks:
        step, pos = struct.unpack_from("<II", data, at + (part or 0) * size)
        x = np.frombuffer(data, "<u8", lanes, at + (part or 0) * size + 8).astype(np.uint64)
    mask, scale, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for s in range(first, last):
        k = min(lanes, n - s * lanes)
        y = x[:k]
        slot = y & mask
        found = slots[slot]
        out[(s - first) * lanes : (s - first) * lanes + k] = found
        y = f_all[found] * (y >> scale) + slot - c_all[found]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << word) | stream[pos : pos + len(low)]
        pos += len(low)
        x[:k] = y
    ids = symbols[out]
    if part is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block doesn't fit")
    return ids


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The segment's bytes: header, documents, table, blocks."""
    symbols, freq = frequency_table(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    places = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    places[symbols] = np.arange(len(symbols))
    dense = places[ids]
    cum = np.cumsum(freq) - freq
    table = pack_table(symbols, freq)
    named = np.array([x is not None for x in doc_ids], np.uint8)
    docs = zlib.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + named.tobytes(), 1)
    blocks = [encode_block(dense[i : i + block], freq, cum, zlib.crc32(ids[i : i + block].astype("<u4").tobytes())) for i in range(0, len(ids), block)]
    head = struct.pack("<4sIQIII", MAGIC, len(doc_ids), len(ids), len(docs), len(table), len(blocks))
    return head + struct.pack(f"<{len(blocks)}I", *map(len, blocks)) + docs + table + b"".join(blocks)


def decode_segment(data: bytes):
    """doc_ids, lengths and an iterator over the blocks' ids, one block in memory at a time."""
    magic, n_docs, _, docs_len, table_len, n_blocks = struct.unpack_from("<4sIQIII", data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = struct.calcsize("<4sIQIII")
    sizes = struct.unpack_from(f"<{n_blocks}I", data, at)
    at += 4 * n_blocks
    raw = zlib.decompress(data[at : at + docs_len])
    numbers, named = np.frombuffer(raw, "<i8", 2 * n_docs), np.frombuffer(raw, np.uint8, n_docs, 16 * n_docs)
    doc_ids = [x if ok else None for x, ok in zip(numbers[:n_docs].tolist(), named.tolist(), strict=True)]
    at += docs_len
    symbols, freq = unpack_table(data[at : at + table_len])
    at += table_len
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def blocks(at=at):
        for size in sizes:
            yield decode_block(data[at : at + size], symbols, freq, slots=slots)
            at += size

    return doc_ids, numbers[n_docs:].tolist(), blocks()


# -- the tokenizer -----------------------------------------------------------------------------------------------------------


class WordCoder:
    """Ids of whole texts by the tokenizers library, which never joins characters across ASCII white space: each different run without it is encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = [self.library.encode(m, add_special_tokens=False).ids for m in MARKS]

    def _each(self, runs: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]

    def _fresh(self, runs: list[str]) -> list[bytes]:
        """Each run's ids from the library, which takes many at once: they are joined with a mark between them. A group in which a run's ids hold the mark's too is encoded one by one."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[bytes] = [b""] * len(runs)
        numerals = pc.match_substring_regex(pa.array(runs, pa.string()), r"\pN").to_numpy(zero_copy_only=False)
        for mark, ids_of_mark, mine in zip(MARKS, self.marks, (np.flatnonzero(~numerals), np.flatnonzero(numerals)), strict=True):
            groups = [mine[at : at + GROUP].tolist() for at in range(0, len(mine), GROUP)]
            for group, e in zip(groups, self.library.encode_batch_fast([f" {mark} ".join([runs[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = [*(4 * np.flatnonzero(ids == ids_of_mark[0])).tolist(), 4 * len(ids)]
                if len(ids_of_mark) != 1 or len(ends) != len(group):
                    for i, x in zip(group, self._each([runs[i] for i in group]), strict=True):
                        out[i] = x
                    continue
                raw, at = ids.tobytes(), 0
                for i, end in zip(group, ends, strict=True):
                    out[i] = raw[at:end]
                    at = end + 4
        return out

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Each run's ids. Runs of up to LONGEST characters are remembered in two generations of up to MEMO; what isn't met within a generation is forgotten, so the memory is bounded by bytes."""
        memo, older = self.memo, self.older
        got = [memo.get(r) for r in runs]
        missing = [i for i, x in enumerate(got) if x is None]
        new = []
        for i in missing:
            x = older.get(runs[i])
            if x is None:
                new.append(i)
            else:
                got[i] = memo[runs[i]] = x
        for i, x in zip(new, self._fresh([runs[i] for i in new]), strict=True):
            got[i] = x
            if len(runs[i]) <= LONGEST:
                memo[runs[i]] = x
        if len(memo) > MEMO:
            self.memo, self.older = {}, memo
        return got

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts, each text's followed by end_id, and each text's number of ids with that."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        runs = split.flatten().dictionary_encode()
        of, ends = runs.indices.to_numpy(), split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        coded = [*self._runs(runs.dictionary.to_numpy(zero_copy_only=False).tolist()), struct.pack("<I", end_id)]
        sizes = np.array([len(x) // 4 for x in coded], np.int32)
        pool = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.frombuffer(b"".join(coded), np.uint32)))
        of = np.insert(of, ends, len(coded) - 1)
        before = np.concatenate([[0], np.cumsum(sizes[of], dtype=np.int64)])
        lengths = np.diff(before[ends + np.arange(1, len(ends) + 1)], prepend=0)
        return pool.take(pa.array(of)).flatten().to_numpy(), lengths


def word_coder(path: str) -> WordCoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    cache = process_cache()
    if ("word_coder", path) not in cache:
        cache["word_coder", path] = WordCoder(path)
    return cache["word_coder", path]


# -- over a table ------------------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, segment: int = SEGMENT) -> DataFrame:
    """Encodes every whole text and writes the segments. Returns the written table: part, segment, n_docs, n_tokens, data; (part, segment) ascend with doc_id.

    One range shuffle of (doc_id, text) orders the documents; a task tokenizes, counts and codes one segment at a time. A null text is
    empty and has the end id alone. A null doc_id comes first; repeated doc_ids stay apart, in the order of their texts. A document longer than a
    segment makes a longer segment, whose blocks stay as small as all others. No rows make no segment. Other columns are not read, so their names can't clash.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        coder = word_coder(path)
        names, lengths, parts, held, number = [], [], [], 0, 0
        me = TaskContext.get().partitionId()

        def flush():
            nonlocal names, lengths, parts, held, number
            data = encode_segment(names, lengths, np.concatenate(parts))
            out = pa.RecordBatch.from_pydict({"part": pa.array([me], pa.int32()), "segment": pa.array([number], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())})
            names, lengths, parts, held, number = [], [], [], 0, number + 1
            return out

        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
                piece = batch.slice(at, to - at)
                ids, many = coder.encode(piece.column(1), end_id)
                names += piece.column(0).to_pylist()
                lengths += many.tolist()
                parts.append(ids)
                held += len(ids)
                at = to
                if held >= segment:
                    yield flush()
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "part int, segment int, n_docs bigint, n_tokens bigint, data binary"), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """Decodes written segments: doc_id, start, n_tokens, ids_crc32, one row per document, from the decoded ids."""
    index = segments.select("part", "segment", "n_tokens")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each task that wrote, so the window over all of them is small
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = index.select("part", "segment", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("within"))
    starts = within.join(before, "part").select("part", "segment", (F.col("within") + F.col("before")).alias("start"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column(1)[i].as_py()
                doc_ids, lengths, blocks = decode_segment(batch.column(0)[i].as_py())
                crcs, left, rest = [], iter(lengths), None
                crc, want = 0, next(left, None)
                for rest in blocks:
                    raw = rest.astype("<u4").tobytes()
                    at = 0
                    while want is not None and len(raw) - at >= 4 * want:
                        crcs.append(zlib.crc32(raw[at : at + 4 * want], crc))
                        at += 4 * want
                        crc, want = 0, next(left, None)
                    if want is not None:
                        crc = zlib.crc32(raw[at:], crc)
                        want -= (len(raw) - at) // 4
                ends = start + np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(ends - np.array(lengths), pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return segments.join(starts, ["part", "segment"]).select("data", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
