"""Token ids in a succinct binary form: one wavelet matrix for each shard.

Texts are encoded whole, an end id is appended to each, and the documents are laid out in
ascending order of their ids. A shard is a run of whole documents of about SHARD_TOKENS ids. Its
file is a Parquet file with one row:

    shard int         place of the shard in the order
    n long            number of ids
    doc_ids, lengths  the documents in order and how many ids each has
    alphabet          the shard's distinct ids, ascending; an id's code is its place here
    zeros             per bit plane, the number of zero bits
    planes            per bit plane, highest bit first, the bits of the codes in the order that
                      stable partition by all higher bits gives
    ranks             per bit plane, the ones before each block of BLOCK_BITS bits, 32-bit

With the rank directory, access, counting and occurrence look-up (rank, select) take one step a
plane and touch one block each; see WaveletMatrix. The planes are compressed by Parquet's zstd.
Spark writes and reads the files, so a lost task leaves no partial shard and any file system
that Spark knows will do.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from mvspark.llm.common import text_batches

SHARD_TOKENS, BLOCK_BITS, END = 1 << 21, 512, 2
#: Most distinct pieces a worker remembers, the longest ones it does (longer ones seldom come again), the
#: longest ones that stay when it is full, and how many texts it encodes at a time.
MEMO, LONGEST, SHORT, BATCH = 650_000, 12, 7, 128
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: Pieces of a text at whose ends byte-level BPE's own pattern always splits: a word with the space
#: before it, before white space or common marks; such marks before white space; a line break before
#: a word; and all else up to the next ASCII white space.
_PIECE = re.compile(rf" ?[{_LATIN}]+(?![^ ,.;:!?\n])|[,.;:!?]+(?![^ \n])|\n(?=[{_LATIN}])|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_WORD = re.compile(rf" ?[{_LATIN}]+")
#: White space beyond ASCII and separators that regular expressions disagree on: encoded whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_sizes(tokenizer) -> np.ndarray:
    """Bytes of each token id of a byte-level vocabulary, in which one character stands for one byte; added tokens are plain text."""
    vocab = tokenizer.get_vocab()
    sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    for token, k in vocab.items():
        sizes[k] = len(token)
    for k, token in tokenizer.get_added_tokens_decoder().items():
        sizes[k] = len(token.content.encode())
    return sizes


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class Encoder(dict):
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct piece once: piece to ids as bytes.

    Ids are those of the library's encode(text, add_special_tokens=False): where a text holds the
    text of an added token (like "<|endoftext|>"), that is one id and the text is cut there. What is
    remembered is bounded.
    """

    def __init__(self, path: str, most: int = MEMO) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own only cost memory
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: False if an added token looks at the text around it: texts that hold one are encoded whole then
        self._plain = not any(t.lstrip or t.rstrip or t.single_word for t in added)
        texts = sorted((t.content for t in added), key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, texts)) + ")") if texts else None
        self.sizes = token_sizes(self.tokenizer)
        self.type = np.dtype("<u4" if len(self.sizes) > 1 << 16 else "<u2")
        self._merge, self._letters = self.tokenizer.model.tokenize, _byte_letters()
        self._space = chr(self._letters[32])

    def __missing__(self, piece: str) -> bytes:
        if _WORD.fullmatch(piece):  # the pattern leaves it whole: merges only
            if piece.isascii():  # of its characters only the space has another letter
                letters = piece if piece[0] != " " else self._space + piece[1:]
            else:
                letters = piece.encode().decode("latin-1").translate(self._letters)
            ids = [t.id for t in self._merge(letters)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        found = array(self.type.char, ids).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > self.most:
            short = {p: ids for p, ids in self.items() if len(p) <= SHORT}
            self.clear()
            if len(short) <= self.most // 2:
                self.update(short)
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, self._pieces(t))), dtype=self.type) for t in texts]

    def _pieces(self, text: str) -> list[str]:
        if self._added and self._added.search(text):
            if not self._plain:
                return [text]
            # the library encodes what stands between added tokens as texts of their own
            return [p for k, part in enumerate(self._added.split(text)) if part for p in ([part] if k % 2 else self._cut(part))]
        return self._cut(text)

    @staticmethod
    def _cut(text: str) -> list[str]:
        return [text] if _OTHER_SPACE.search(text) else _PIECE.findall(text)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this process: a worker keeps it, with what it remembers, from task to task."""
    return Encoder(path)


class WaveletMatrix:
    """Access, rank and select over a sequence of ids stored as bit planes."""

    def __init__(self, n: int, alphabet: list[int], zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros, self.planes = n, zeros, [np.frombuffer(p, dtype=np.uint8) for p in planes]
        self.alphabet = np.array(alphabet, dtype=np.uint32)
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    @staticmethod
    def build(ids: np.ndarray) -> tuple[np.ndarray, list[int], list[bytes], list[bytes]]:
        """Alphabet, zeros, planes and ranks of a sequence of ids."""
        seen = np.bincount(ids) > 0
        alphabet = np.flatnonzero(seen)
        codes = (np.cumsum(seen) - 1).astype(np.uint32 if len(alphabet) > 1 << 16 else np.uint16)[ids]
        zeros, planes, ranks = [], [], []
        for k in range(max(1, int(len(alphabet) - 1).bit_length()) - 1, -1, -1):
            one = (codes & codes.dtype.type(1 << k)) != 0
            plane = np.packbits(one, bitorder="little")
            low, high = codes.compress(~one), codes.compress(one)
            zeros.append(len(low))
            planes.append(plane.tobytes())
            padded = np.zeros(-(-len(plane) // (BLOCK_BITS // 8)) * (BLOCK_BITS // 8), dtype=np.uint8)
            padded[: len(plane)] = plane
            per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(1, dtype=np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(per)]).astype("<u4").tobytes())
            codes = np.concatenate([low, high])
        return alphabet, zeros, planes, ranks

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block = i // BLOCK_BITS
        part = self.planes[k][block * BLOCK_BITS // 8 : i // 8]
        rest = int(self.planes[k][i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self.ranks[k][block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return int(self.alphabet[value])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _range(self, code: int, i: int) -> tuple[int, int]:
        start = 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, start), self._ones(k, i)
            start, i = (self.zeros[k] + a, self.zeros[k] + b) if code >> len(self.planes) - 1 - k & 1 else (start - a, i - b)
        return start, i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before position i."""
        code = self._code(token)
        if code is None:
            return 0
        start, end = self._range(code, i)
        return end - start

    def select(self, token: int, j: int) -> int:
        """Position of the token's occurrence number j, from 0; -1 if there are fewer."""
        code = self._code(token)
        if code is None:
            return -1
        start, end = self._range(code, self.n)
        if not 0 <= j < end - start:
            return -1
        at = start + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = code >> len(self.planes) - 1 - k & 1
            want = at - self.zeros[k] if bit else at
            low, high = 0, self.n  # the smallest end before which want + 1 such bits stand
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(k, mid)
                low, high = (low, mid) if (ones if bit else mid - ones) > want else (mid + 1, high)
            at = low - 1
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        codes = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(codes)
            back[np.flatnonzero(~one)] = codes[: self.zeros[k]]
            back[np.flatnonzero(one)] = codes[self.zeros[k] :] | codes.dtype.type(1 << len(self.planes) - 1 - k)
            codes = back
        return self.alphabet[codes]

    @staticmethod
    def of(row: dict) -> "WaveletMatrix":
        """From one row of a shard's file."""
        return WaveletMatrix(row["n"], row["alphabet"], row["zeros"], row["planes"], row["ranks"])


def shard_schema(id_type: T.DataType) -> T.StructType:
    """Columns of a shard's file for ids of a type."""
    return T.StructType.fromDDL(
        f"part int, seq int, n long, doc_ids array<{id_type.simpleString()}>, lengths array<long>, alphabet array<int>, zeros array<long>, planes array<binary>, ranks array<binary>"
    )


def _id_type(shards: DataFrame) -> T.DataType:
    return shards.schema["doc_ids"].dataType.elementType


def _encode_shards(path: str, end: int, shard_tokens: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part = encoder(path), TaskContext.get().partitionId()
        stop = np.array([end], dtype=bpe.type).tobytes()
        ids, docs, lengths, held, seq = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), dtype=bpe.type)
            row = (part, seq, len(flat), docs, lengths, *WaveletMatrix.build(flat))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a in range(0, len(keys), BATCH):
                texts = [t or "" for t in batch.column(1).slice(a, BATCH).to_pylist()]
                for key, found in zip(keys[a : a + BATCH], bpe.encode(texts)):
                    ids += [found.tobytes(), stop]
                    docs.append(key)
                    lengths.append(len(found) + 1)
                    held += len(found) + 1
                    if held >= shard_tokens:
                        yield shard()
                        ids, docs, lengths, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, out_path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes docs and writes shards in ascending order of id (null ids first, equal ids by text); one file a shard.

    Ids may be of any type that Spark can sort. Null texts count as empty: the end id alone. Repeated
    rows are written as often as they come; a text of any length is one document of one shard. An
    empty table writes no shard. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    schema = shard_schema(rows.schema["id"].dataType)
    shards = rows.mapInArrow(_encode_shards(tokenizer or tokenizer_path(), end, shard_tokens, to_arrow_schema(schema)), schema)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(out_path)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id_col, start, n_tokens, ids_crc32, shard) from the shards' files: one for each document.

    Null ids and repeated rows come back as they were written; an empty store gives no rows.
    """
    shards = spark.read.parquet(path)
    id_type = _id_type(shards)
    id_arrow = to_arrow_type(id_type)
    w = Window.orderBy("part", "seq")  # one row of three numbers for each shard
    starts = shards.select("part", "seq", "n").withColumn("base", F.sum("n").over(w) - F.col("n")).withColumn("shard", F.row_number().over(w) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                ids = WaveletMatrix.of(one).decode().astype("<u4")
                lengths = np.array(one["lengths"], dtype=np.int64)
                at = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), lengths.tolist())]
                fill = lambda x: pa.array(np.full(len(at), x, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([fill(one["part"]), fill(one["seq"]), pa.array(one["doc_ids"], id_arrow), pa.array(at), pa.array(lengths), pa.array(crc, pa.int64())], ["part", "seq", "id", "at", "n_tokens", "ids_crc32"])

    found = shards.mapInArrow(run, f"part int, seq int, id {id_type.simpleString()}, at long, n_tokens long, ids_crc32 long")
    out = found.join(starts.select("part", "seq", "base", "shard"), ["part", "seq"])
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id_col, ids): the ids of each document, end id included; an empty text has that alone, an empty store no rows."""
    shards = spark.read.parquet(path)
    id_type = _id_type(shards)
    id_arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                ids = WaveletMatrix.of(one).decode().astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(one["lengths"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(one["doc_ids"], id_arrow), pa.ListArray.from_arrays(ends, ids)], ["id", "ids"])

    return shards.mapInArrow(run, f"id {id_type.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Rows (shard part, seq, occurrences, first) of one token id, by rank and select on each shard's file; first is -1 where it doesn't occur."""
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                m = WaveletMatrix.of(one)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((one["part"], pa.int32()), (one["seq"], pa.int32()), (m.rank(token, m.n), pa.int64()), (m.select(token, 0), pa.int64()))], ["part", "seq", "occurrences", "first"])

    return shards.drop("doc_ids", "lengths").mapInArrow(run, "part int, seq int, occurrences long, first long")
