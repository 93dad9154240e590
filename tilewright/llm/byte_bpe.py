"""Byte-level BPE with the tokenizers library over Arrow batches, and decoding through the reversed byte table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import process_cache

#: Pieces remembered by a Python worker; the memory is dropped and begun anew beyond it.
MEMO = 400_000
#: Unicode's White_Space, as the ranks' own library takes \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def library_tokenizer(ranks: dict[bytes, int]):
    """A BPE model of the tokenizers library that merges by these ranks: every pair that makes a ranked token, in the order of that token's rank."""
    from tokenizers import Tokenizer, models

    chars = byte_chars()
    spelled = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            merges += [(spelled[token[:i]], spelled[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))


class ByteBpe:
    """Encodes whole texts piece by piece, with a memory of pieces; decodes ids to bytes or, from a stream, to text."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        ranks = read_ranks(ranks_path)
        self.chars = byte_chars()
        self.library = library_tokenizer(ranks)
        back = {c: b for b, c in enumerate(self.chars)}
        size = max(ranks.values()) + 1
        self.table = [b""] * size
        for spelled, i in self.library.get_vocab().items():
            self.table[i] = bytes(back[c] for c in spelled)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.memo: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        import struct

        ids = self.library.encode("".join([self.chars[b] for b in piece.encode()]), add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        memo, piece = self.memo, self._piece
        return b"".join([memo.get(p) or piece(p) for p in self.split(text)])

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """Each id with the first and the next byte of the text's UTF-8 that it stands for."""
        import struct

        out, at = [], 0
        for (i,) in struct.iter_unpack("<I", self.encode(text)):
            out.append((i, at, at + len(self.table[i])))
            at = out[-1][2]
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, ids):
        """Text as ids arrive: a character whose bytes are split over tokens comes out with its last byte; bytes that are no UTF-8 give U+FFFD."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := decoder.decode(self.table[i]):
                yield out
        if out := decoder.decode(b"", True):
            yield out


def bpe(ranks_path: str, pattern: str) -> ByteBpe:
    cache = process_cache()
    key = ("byte_bpe", ranks_path, pattern)
    if key not in cache:
        cache[key] = ByteBpe(ranks_path, pattern)
    return cache[key]


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text. Returns the kept columns, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids (binary).

    A null text counts as empty: no tokens and the digests of no bytes. Rows are taken one by one, so ties, repeats and null ids
    stay as they are; columns that are neither kept nor the text are not read, and kept ones may have any name but those of the results. A very long text is encoded
    whole, piece by piece; no rows give no rows. No shuffle: each scan task encodes what it reads.
    """
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    fields += ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids binary"] * with_ids

    def run(batches):
        import hashlib

        import pyarrow as pa

        coder = bpe(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, sha, back, raw = [], [], [], []
                for text in part.column(len(keep)).to_pylist():
                    ids = coder.encode(text or "")
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
                    if with_ids:
                        raw.append(ids)
                columns = [*(part.column(i) for i in range(len(keep))), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, ", ".join(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
