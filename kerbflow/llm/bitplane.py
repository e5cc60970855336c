"""Token ids as compressed bit or byte planes.

Documents are range-partitioned by ``doc_id``, then a hash of the text, so that rows without an id or with one id are split; each partition is a shard, whose documents are encoded in order and
whose ids, each document followed by the end id, form one stream. The stream is cut into chunks of a fixed number of
ids. Of a chunk the ids are transposed into planes (byte k, or bit k, of every id together) and each plane is
compressed alone, so the planes of high bits, which are nearly constant, shrink to almost nothing.

File format: a Parquet dataset with one row per chunk. ``shard, chunk, first, n_ids`` (position in the shard's stream)
and the slices ``doc_ids, seqs, firsts, totals, counts`` (whose documents the chunk holds, and how much of each) are the
chunk index; reading the index alone skips the ``planes`` column. A document of any length is spread over as many chunks
as it needs, and a reader needs one chunk at a time.

Defined results: NULL text is empty (the end id alone); NULL ids come first; equal ids are ordered by a hash of the text, then the text; an empty
table gives an empty dataset. Other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import as_list, bounded_batches, numbered_words, stored, worker_state

CHUNKS = ("shard int, chunk int, first bigint, n_ids int, doc_ids array<bigint>, seqs array<bigint>, "
          "firsts array<bigint>, totals array<bigint>, counts array<bigint>, layout string, planes array<binary>")
PIECES = "shard int, seq bigint, doc_id bigint, first bigint, total bigint, chunk int, n bigint, crc bigint"


def to_planes(ids: np.ndarray, layout: str, level: int = 3) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids, lowest first; a plane of zeros only is empty."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if layout == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    squeeze = zstandard.ZstdCompressor(level=level).compress
    return [squeeze(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    """The ids again."""
    width = (n + 7) // 8 if layout == "bit" else n
    expand = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(expand(p), np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if layout == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1)[:, :n].T, axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(rows.T)
    return rows.reshape(-1).view("<u4")


#: Stands between words that are encoded in one call; a word with this character is encoded by itself.
BREAK = "\x01"
#: Words of these characters, which no normal form changes, and the vocabulary's pattern for their pieces in lower case.
SIMPLE = re.compile("[\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
WORD_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFF]+")
#: The character by which the vocabulary names each byte: itself if it can be seen, else one from 256 on.
SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
NAMED = {b: b for b in SEEN} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*SEEN}))}


class WordEncoder:
    """Ids of a text as bytes. Each word between ASCII white space is encoded by the library once and remembered.

    The vocabulary lowers case, drops white space and never joins anything across it, so the ids of a text are those
    of its words; words of Latin-1 letters and ASCII are also taken apart into the pieces that the vocabulary encodes alone,
    which go straight to the library's model. Of other words the library gets many in one call.

    Words and their ids are remembered in Arrow arrays, which take a fifth of the memory of a dictionary; when there are too many,
    those stay that a later group of texts asked for. Pieces lie in two dictionaries: a full one takes the place of the older.
    """

    def __init__(self, path: str, words: int = 250_000, pieces: int = 50_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # at most so many words and, in each dictionary, pieces; a piece costs the library far more than a word costs to put together
        self.tokenizer, self.most_words, self.most_pieces = Tokenizer.from_file(path), words, pieces
        self.model = self.tokenizer.model
        self.words = self.ids = pa.array([], pa.large_binary())
        self.asked = np.zeros(0, bool)  # by a group of texts after the one that brought the word
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.id_bytes = [k.to_bytes(4, "little") for k in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.stop = self.library([BREAK])[0]
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, [BREAK, *marks])))
        # no special token stands inside a word of letters then, and such a word is one piece
        self.plain_letters = not any(t.isalpha() for t in marks)

    def library(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def each(self, parts: list[str]) -> list[bytes]:
        """The ids of every part; none has a BREAK."""
        out = []
        for k in range(0, len(parts), 1000):
            some = parts[k:k + 1000]
            data = self.library([f" {BREAK} ".join(some)])[0]
            cuts = np.flatnonzero(np.frombuffer(data, "<u4") == np.frombuffer(self.stop, "<u4")[0]) * 4
            out += [data[a:b] for a, b in zip([0, *(cuts + 4)], [*cuts, len(data)])]
        return out

    def piece(self, text: str) -> bytes:
        """The ids of one piece, in lower case."""
        ids = self.pieces.get(text)
        if ids is None:
            ids = self.older_pieces.get(text)
            if ids is None:
                named = text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(NAMED)
                ids = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(named)])
            if len(self.pieces) >= self.most_pieces:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[text] = ids
        return ids

    def made(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, put together from their pieces or by the library."""
        out: list[bytes] = [b""] * len(words)
        whole, alone = [], []
        piece = self.piece
        for k, w in enumerate(words):
            if self.plain_letters and w.isalpha():
                out[k] = piece(w.decode().lower())
                continue
            text = w.decode()
            if BREAK in text:
                alone.append((k, text))
            elif SIMPLE.fullmatch(text) and not self.special.search(text):
                out[k] = b"".join([piece(p) for p in WORD_PIECES.findall(text.lower())])
            else:
                whole.append((k, text))
        for some, ids in ((alone, self.library([t for _, t in alone])), (whole, self.each([t for _, t in whole]))):
            for (k, _), x in zip(some, ids):
                out[k] = x
        return out

    def places(self, words: pa.Array) -> np.ndarray:
        """Where in ``self.ids`` the ids of distinct words stand, which are made and added if they are not there."""
        found = pc.index_in(words, value_set=self.words)
        self.asked[found.drop_null().to_numpy()] = True
        missing = words.filter(found.is_null())
        if len(self.words) and len(self.words) + len(missing) > self.most_words:
            kept = pa.array(np.flatnonzero(self.asked))
            if len(kept) + len(missing) > self.most_words:
                kept = kept[:0]
            self.words, self.ids, self.asked = self.words.take(kept), self.ids.take(kept), np.zeros(len(kept), bool)
            return self.places(words)
        places, held = found.fill_null(-1).to_numpy().copy(), len(self.words)
        if len(missing):
            made = pa.array(self.made(as_list(missing)), pa.large_binary())
            self.words, self.ids = pa.concat_arrays([self.words, missing]), pa.concat_arrays([self.ids, made])
            self.asked = np.concatenate([self.asked, np.zeros(len(missing), bool)])
            places[places < 0] = np.arange(held, held + len(missing))
        return places

    def __call__(self, text: str) -> bytes:
        return self.all_of(pa.array([text]))[0]

    def all_of(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text. Every distinct word of the texts is looked up once; Arrow puts the ids in order."""
        distinct, numbers, begins = numbered_words(texts)
        places = self.places(distinct)
        ids = self.ids.take(pa.array(places[numbers]))
        if not len(numbers):
            return [b""] * len(texts)
        _, places, data = ids.buffers()
        cuts = np.frombuffer(places, np.int64)[begins].tolist()
        data = memoryview(data)
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]


def in_groups(encoder: WordEncoder, texts: list[str] | pa.Array, most: int = 2_000_000) -> Iterator[bytes]:
    """The ids of every text, encoded in groups of about ``most`` bytes."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    size = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(size // most)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        if lo < hi:
            yield from encoder.all_of(texts.slice(lo, hi - lo))


def write_planes(docs: DataFrame, tokenizer: str, end_id: int, chunk_ids: int = 65_536, layout: str = "byte") -> DataFrame:
    """Encode ``docs`` (doc_id, text) in doc_id order into a new dataset of chunks; returns that dataset, read back."""
    # by bytes, as what is remembered is searched once for a batch, however short its texts are
    bounded_batches(docs.sparkSession, rows=10_000, size=2 ** 22)
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([
        ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
        *[(c, pa.list_(pa.int64())) for c in ("doc_ids", "seqs", "firsts", "totals", "counts")],
        ("layout", pa.string()), ("planes", pa.list_(pa.binary()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        ids_of = worker_state(f"ids {tokenizer}", lambda: WordEncoder(tokenizer))
        parts: list[bytes] = []
        slices: list[tuple] = []
        held = first = chunk = seq = at = 0

        def full() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [shard, chunk, first, held, *map(list, zip(*slices)), layout, to_planes(ids, layout)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), in_groups(ids_of, batch.column(1))):
                data = ids + end
                total, done = len(data) // 4, 0
                while done < total:
                    n = min(total - done, chunk_ids - held)
                    parts.append(data[4 * done:4 * (done + n)])
                    slices.append((doc_id, seq, at, total, n))
                    held, done = held + n, done + n
                    if held == chunk_ids:
                        yield full()
                        first, chunk, held, parts, slices = first + held, chunk + 1, 0, [], []
                seq, at = seq + 1, at + total
        if held:
            yield full()

    ordered = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
               .withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text"))
    return stored(ordered.mapInArrow(encode, CHUNKS), "id-planes")


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from their crc32s and the length of the second."""
    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if not vector:
                break
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    # the operator that appends one zero bit, squared until it appends a byte, then 2, 4, ... bytes
    matrix = [0xEDB88320, *[1 << i for i in range(31)]]
    for _ in range(3):
        matrix = [times(matrix, row) for row in matrix]
    while length:
        if length & 1:
            first = times(matrix, first)
        matrix = [times(matrix, row) for row in matrix]
        length >>= 1
    return first ^ second


def read_documents(chunks: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start in the whole stream, n_tokens, ids_crc32, and its shard.

    Chunks are decoded independently. A document that spans chunks is put together from the crc32s of its parts.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                data = memoryview(from_planes(row["planes"], row["n_ids"], row["layout"]).tobytes())
                crcs, at = [], 0
                for n in row["counts"]:
                    crcs.append(zlib.crc32(data[at:at + 4 * n]))
                    at += 4 * n
                size = len(crcs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * size, pa.int32()), pa.array(row["seqs"], pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["firsts"], pa.int64()),
                    pa.array(row["totals"], pa.int64()), pa.array([row["chunk"]] * size, pa.int32()),
                    pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())], names=names)

    @F.udf("bigint")
    def joined(parts):
        if parts is None:
            return None
        crc = parts[0]["crc"]
        for part in parts[1:]:
            crc = crc32_join(crc, part["crc"], 4 * part["n"])
        return crc

    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offsets = stored(shards, "shard-sizes").selectExpr(
        "shard", "coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    pieces = chunks.mapInArrow(decode, PIECES)
    docs = pieces.groupBy("shard", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.first("first").alias("first"), F.first("total").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("chunk", "crc", "n"))).alias("parts"))
    # Spark calls a Python function for every row, so it gets only what spans chunks
    crc = F.coalesce(joined(F.when(F.size("parts") > 1, F.col("parts"))), F.col("parts")[0]["crc"])
    return docs.join(offsets, "shard").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", crc.alias("ids_crc32"), "shard")
