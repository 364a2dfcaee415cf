"""Token ids in compressed files: one wavelet matrix a shard, with access, counting and lookup of occurrences."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.bpe import byte_names
from tidewater.llm import common
from tidewater.llm.common import partitions, shared_dir, tidied, written

MAGIC = b"TWWM1\n"
#: Bits between two entries of a plane's rank directory.
STRIDE = 512
#: Ids after which a shard file ends with the document at hand.
SHARD_IDS = 4_000_000
#: Pieces of text whose ids a Python worker keeps before those that weren't used since the last time go; it holds about twice as many at most.
KEPT = 400_000
#: Characters of the texts that are encoded at once.
CHARS = 4_000_000


class WaveletMatrix:
    """The sequence as bit-planes, most significant first; each plane is stably sorted by the bit before.

    Plane p holds bit p of every id in the order that the planes above leave, zeros first. ``ranks`` counts
    the ones before every ``STRIDE``-th place.
    """

    def __init__(self, n: int, width: int, planes: list[np.ndarray]):
        self.n, self.width, self.planes = n, width, planes
        self.ranks, self.zeros = [], []
        for plane in planes:
            ones = np.bitwise_count(plane).reshape(-1, STRIDE // 8).sum(axis=1, dtype=np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        x, planes = np.ascontiguousarray(ids, dtype=np.uint32), []
        width = max(1, int(x.max(initial=0)).bit_length())
        if width <= 16:
            x = x.astype(np.uint16)
        for p in reversed(range(width)):
            bit = (x >> p & 1).astype(bool)
            planes.append(np.packbits(np.pad(bit, (0, -len(bit) % STRIDE)), bitorder="little"))
            x = np.concatenate([x[np.flatnonzero(~bit)], x[np.flatnonzero(bit)]])  # by places: masks of random bits are slow
        return cls(len(ids), width, planes)

    def ids(self) -> np.ndarray:
        """The whole sequence: the sort of each plane undone, from the last plane up."""
        out = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for p, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above, zeros = np.empty_like(out), self.zeros[self.width - 1 - p]
            above[np.flatnonzero(~bit)] = out[:zeros]
            above[np.flatnonzero(bit)] = out[zeros:] | out.dtype.type(1 << p)
            out = above
        return out

    def ones(self, p: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``p``."""
        block = i // STRIDE
        rest = np.unpackbits(self.planes[p][block * STRIDE // 8 : (i + 7) // 8], bitorder="little")
        return int(self.ranks[p][block]) + int(rest[: i - block * STRIDE].sum())

    def bit(self, p: int, i: int) -> int:
        return int(self.planes[p][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.width):
            b = self.bit(p, i)
            i = self.zeros[p] + self.ones(p, i) if b else i - self.ones(p, i)
            out = out << 1 | b
        return out

    def bounds(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for p in range(self.width):
            a, b = self.ones(p, start), self.ones(p, stop)
            start, stop = (self.zeros[p] + a, self.zeros[p] + b) if token >> self.width - 1 - p & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often ``token`` occurs at places ``start`` to ``stop``, end exclusive."""
        if token < 0 or token >> self.width:
            return 0
        a, b = self.bounds(token, start, self.n if stop is None else stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence of ``token``, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self.bounds(token, 0, self.n)[0] + k
        for p in reversed(range(self.width)):
            one = token >> self.width - 1 - p & 1
            at = self.nth(p, one, at - self.zeros[p] if one else at)
        return at

    def nth(self, p: int, one: int, k: int) -> int:
        """The place of the ``k``-th bit ``one`` of plane ``p``."""
        before = self.ranks[p] if one else np.minimum(np.arange(len(self.ranks[p])) * STRIDE, self.n) - self.ranks[p]
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[p][block * STRIDE // 8 : (block + 1) * STRIDE // 8], bitorder="little")[: self.n - block * STRIDE]
        return block * STRIDE + int(np.flatnonzero(bits == one)[k - int(before[block])])


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """One file: magic, header length, header, then the compressed documents table and bit-planes.

    The header (JSON) has the counts of ids and documents, the bits of an id, and the parts' lengths. The
    documents table is three arrays: ids (int64), whether an id is there (uint8), and lengths (int64).
    """
    matrix, squeeze = WaveletMatrix.of(ids), zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    table = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes() + np.array(lengths, dtype="<i8").tobytes()
    parts = [squeeze.compress(table), *(squeeze.compress(p.tobytes()) for p in matrix.planes)]
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "width": matrix.width, "parts": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def unpack(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """A file's matrix, its documents' ids and their lengths."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    at = len(MAGIC) + 4
    size = struct.unpack("<I", data[len(MAGIC) : at])[0]
    head, at, parts, loosen = json.loads(data[at : at + size]), at + size, [], zstandard.ZstdDecompressor()
    for n in head["parts"]:
        parts.append(loosen.decompress(data[at : at + n]))
        at += n
    d = head["docs"]
    ids, known = np.frombuffer(parts[0], "<i8", d), np.frombuffer(parts[0], np.uint8, d, 8 * d)
    lengths = np.frombuffer(parts[0], "<i8", d, 9 * d)
    matrix = WaveletMatrix(head["n"], head["width"], [np.frombuffer(p, np.uint8) for p in parts[1:]])
    return matrix, [int(i) if k else None for i, k in zip(ids, known)], lengths


#: An ASCII symbol after a letter below U+0130; the apostrophe may begin a suffix.
ENDED = re.compile(r"[!-&(-/:-@\[-^`{-~](?<=[^\W\d_\u0130-\U0010ffff].)")
#: A character that isn't sure to be in normal form, nor to lower to one letter.
UNSURE = re.compile("[^\0-\u012f]")


class Encoder:
    """A vocabulary that drops white space, applied to pieces between spaces and newlines, whose ids are kept.

    White space only separates, so pieces can be encoded apart; letters and a run of symbols after them are two
    pre-split words, so they are two pieces, unless the text may hold a special token. A word of letters below U+0130
    is in normal form and lowers letter by letter. Such words, written in the vocabulary's byte alphabet, go many at once
    to the merges; each ends where an id ends a word. All else goes through the whole tokenizer. Ids are kept as
    little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.merges = Tokenizer(self.tool.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        names = self.tool.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith(self.tool.model.end_of_word_suffix)]] = True
        self.alphabet = str.maketrans({b: c for c, b in byte_names().items() if b != 32})
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word of letters below U+0130."""
        named = " ".join(words).lower()
        if not named.isascii():
            named = named.encode().decode("latin-1").translate(self.alphabet)
        ids = np.array(self.merges.encode_batch_fast([named], add_special_tokens=False)[0].ids, dtype="<u4")
        stops, content = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
        if len(stops) != len(words):
            raise ValueError("the vocabulary has words that don't end with its suffix")
        return [content[a:b] for a, b in zip([0, *stops], stops)]

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; those that aren't kept are encoded, words together."""
        found = list(map(self.kept.get, pieces))
        plain = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[i]
            ids = self.older.get(piece)
            if ids is None and piece.isalpha() and (piece.isascii() or not UNSURE.search(piece)):
                plain.append(i)
                continue
            if ids is None:
                ids = np.array(self.tool.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
            found[i] = self.kept[piece] = ids
        for i, ids in zip(plain, self.words([pieces[i] for i in plain]) if plain else []):
            found[i] = self.kept[pieces[i]] = ids
        if len(self.kept) > KEPT:
            self.kept, self.older = {}, self.kept
        return found

    def cut(self, text: str) -> str:
        """The text with a space between all pieces."""
        if "<|" not in text:
            text = ENDED.sub(r" \g<0>", text.lower() if text.isascii() or not UNSURE.search(text) else text)
        return text.replace("\n", " ")

    def group(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text: each distinct piece is looked up once, and its ids are laid wherever it is."""
        pieces = pc.split_pattern(pa.array([self.cut(t) for t in texts], pa.string()), " ")
        coded = pieces.values.dictionary_encode()
        found = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        place, starts = coded.indices.to_numpy(), np.cumsum(sizes) - sizes
        sizes = sizes[place]
        stops = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(starts[place] - (stops - sizes), sizes) + np.arange(stops[-1])]
        ends = stops[pieces.offsets.to_numpy()[1:] - 1].tolist()
        return (ids[a:b] for a, b in zip([0, *ends], ends))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, by groups of texts of ``CHARS`` characters or one more text."""
        waiting, held = [], 0
        for text in texts:
            waiting.append(text)
            held += len(text)
            if held >= CHARS:
                yield from self.group(waiting)
                waiting, held = [], 0
        if waiting:
            yield from self.group(waiting)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def store(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so that a lost or repeated task leaves no partial file."""
    import pyarrow.fs as fs

    system, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(at, recursive=True)
    draft = f"{at}/_draft-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, f"{at}/{name}")


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Encodes every text, ends it with ``end_id``, and writes shard files in ascending doc_id order to ``folder``.

    One range exchange sorts the documents (nulls first, then by the text's hash); a partition's documents go
    to files ``part-seq``, each ended after ``SHARD_IDS`` ids, so a task holds one shard and one batch. Returns
    (file, ids) per file. A repeated task writes the same bytes under the same names.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), "doc_id", "tie")
    source = source.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        common.KEPT["wavelet"] = encoder.cache_clear
        names: list[int | None] = []
        lengths, blocks, held = [], [], 0

        def flush():
            nonlocal seq, names, lengths, blocks, held
            name = f"{part:08d}-{seq:06d}.twwm"
            store(folder, name, pack(np.concatenate(blocks), names, lengths))
            out = pa.RecordBatch.from_pydict({"file": [name], "ids": [held]}, schema=pa.schema([("file", pa.string()), ("ids", pa.int64())]))
            seq, names, lengths, blocks, held = seq + 1, [], [], [], 0
            return out

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), tool.encode(text.as_py() for text in batch.column(1))):
                ids = np.append(found, np.uint32(end_id))
                blocks.append(ids)
                names.append(doc_id)
                lengths.append(len(ids))
                held += len(ids)
                if held >= SHARD_IDS:
                    yield flush()
        if names:
            yield flush()

    return source.mapInArrow(tidied(run, "wavelet"), "file string, ids long")


def read_shards(folder: str, files: DataFrame) -> DataFrame:
    """Each document's first place among all ids, id count and checksum, from the files in ``folder``.

    ``files`` (file, ids) gives the files that count and their order by name. Prefix sums place a file: over the totals of
    the partitions that wrote them, one row each, and inside each partition.
    """
    cut = files.withColumn("part", F.substring_index("file", "-", 1))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("part").agg(F.sum("ids").alias("all")).select("part", F.coalesce(F.sum("all").over(upto(Window.orderBy("part"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("ids").over(upto(Window.partitionBy("part").orderBy("file"))), F.lit(0))
    starts = cut.withColumn("inside", inside).join(F.broadcast(parts), "part").select("file", (F.col("before") + F.col("inside")).alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ahead in zip(batch.column(0), batch.column(1).to_pylist()):
                matrix, names, lengths = unpack(data.as_py())
                stops = np.cumsum(lengths)
                wide = matrix.ids().astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip((stops - lengths).tolist(), stops.tolist())]
                cols = [pa.array(names, pa.int64()), pa.array(stops - lengths + ahead, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    content = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.twwm").load(folder)
    named = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    placed = named.join(F.broadcast(starts) if files.count() <= 100_000 else starts, "file")
    return placed.select("content", "ahead").mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Encodes, writes the files, and reads every document's row back from them. A null text has only the end id.

    Repeated doc_ids are separate documents, next to each other; an empty table gives no files and no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/ids"
    files = written(write_shards(docs, path, folder, end_id))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(folder, files)
