"""Operator 4, token-id output: canonical length-limited Huffman coding in independent blocks.

Encoding: texts go through the tokenizers library (this vocabulary splits at white space, so a text's
ids are those of its words, and a slab of texts asks for its distinct words only), every document
ends with an end id, and global id counts, summed by Spark, give code lengths of at most
``MAX_BITS`` by the package-merge algorithm; codes are canonical, so the lengths alone are the
table. Documents are range-partitioned and sorted by doc_id, and each run of about
``SHARD_IDS`` ids becomes one shard: a header, the lengths of the ids that occur, the documents'
numbers of ids, the bit offset of every block of ``BLOCK_IDS`` ids, and the bit string. Blocks
decode on their own by a table of ``2**MAX_BITS`` entries; all blocks of a shard step together.

Shards are rows of a Parquet table in the shared folder (its writer commits tasks that are run
again), and are read back from there.

Edge cases: null and empty texts have the end id alone; equal doc_ids stand next to each other
in the order of their crc32 and length; null doc_ids come first; an empty table writes no
shard; a table of one distinct id gets codes of one bit; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm.common import stored

MAX_BITS, BLOCK_IDS, SHARD_IDS, END_ID = 16, 256, 1 << 19, 1
#: Cores and marks of one generation of the cache; bytes of text whose words are looked up together.
CACHE_WORDS, SLAB_BYTES = 400_000, 16 << 20
#: Rows of an Arrow batch of texts: their words are looked up together.
TEXT_ROWS = 12_000
MAGIC = b"TLHF\2\0\0\0"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Package-merge: the best code lengths of at most ``limit`` bits; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # each level's list is the leaves merged with pairs of the level below; only which entries are leaves is kept
    levels, previous = [], np.zeros(0)
    for _ in range(limit):
        pairs = previous[: len(previous) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weight, pairs])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        previous = merged[by]
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Coder:
    """Encoder and table-driven decoder of one set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical(lengths)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (MAX_BITS - self.lengths[order])
        self.id_of = np.zeros(1 << MAX_BITS, np.int64)
        self.bits_of = np.zeros(1 << MAX_BITS, np.int64)
        self.id_of[: spans.sum()] = np.repeat(order, spans)
        self.bits_of[: spans.sum()] = np.repeat(self.lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string (padded by 8 bytes) and the bit offset of each block."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        begin = end - size
        word = begin >> 5
        # a code of at most 16 bits, put at its place in 64 bits from its 32-bit word on
        value = self.codes[ids] << (64 - size - (begin & 31)).astype(np.uint64)
        n_words = (int(end[-1]) + 31) // 32 + 2 if len(ids) else 2
        out = np.zeros(n_words + 1, np.uint32)
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            merged = np.bitwise_or.reduceat(value, first)
            out[word[first]] |= (merged >> np.uint64(32)).astype(np.uint32)
            out[word[first] + 1] |= (merged & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out.astype(">u4").tobytes(), begin[::BLOCK_IDS].astype(np.uint64)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """All blocks step together: each step reads MAX_BITS bits a block and looks up id and length."""
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        pair = (words[:-1] << np.uint64(32)) | words[1:]
        at = offsets.astype(np.int64)
        out = np.zeros((len(at), BLOCK_IDS), np.int64)
        for k in range(BLOCK_IDS):
            live = len(at) if k < (n - 1) % BLOCK_IDS + 1 else len(at) - 1  # the last block may be short
            if live <= 0:
                break
            a = at[:live]
            peek = ((pair[a >> 5] >> (48 - (a & 31)).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)
            out[:live, k] = self.id_of[peek]
            at[:live] = a + self.bits_of[peek]
        return out.reshape(-1)[:n]


def pack(ids: np.ndarray, document_sizes: np.ndarray, coder: Coder) -> bytes:
    """A shard: header, code length of every id (0: unused; the codes follow from them), sizes of documents, block offsets, bits."""
    bits, offsets = coder.encode(ids)
    sizes = document_sizes.astype("<u8").tobytes()
    head = MAGIC + struct.pack("<6Q", len(coder.lengths), 0, len(document_sizes), len(ids), len(offsets), len(bits))
    packed = zlib.compress(coder.lengths.astype(np.uint8).tobytes(), 6)
    return head + struct.pack("<Q", len(packed)) + packed + sizes + offsets.astype("<u8").tobytes() + bits


_CODERS: dict[bytes, Coder] = {}


def unpack(shard: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a shard and its documents' sizes."""
    if shard[:8] != MAGIC:
        raise ValueError("not a shard")
    vocabulary, _, n_docs, n, n_blocks, n_bits = struct.unpack_from("<6Q", shard, 8)
    at = 8 + 48
    (size,) = struct.unpack_from("<Q", shard, at)
    packed = shard[at + 8 : at + 8 + size]
    at += 8 + size
    coder = _CODERS.get(packed)
    if coder is None:
        _CODERS.clear()
        coder = _CODERS[packed] = Coder(np.frombuffer(zlib.decompress(packed), np.uint8, vocabulary))
    sizes = np.frombuffer(shard, "<u8", n_docs, at).astype(np.int64)
    offsets = np.frombuffer(shard, "<u8", n_blocks, at + 8 * n_docs)
    bits = shard[at + 8 * n_docs + 8 * n_blocks :][:n_bits]
    return coder.decode(bits, offsets, n), sizes


#: Marks that end a word as a piece of their own, whatever stands before; fixed values.
_MARKS = ".,;:!?#*$%&|+=()[]{}\"/"
_TAIL = "(?P<tail>[" + "".join(f"\\x{ord(c):02x}" for c in _MARKS) + "]*)$"


class WordTokenizer:
    """Ids of texts by the tokenizers library, word by word where the vocabulary drops white space.

    Arrow finds the distinct words of a slab of texts; each is a core and closing marks, the core in
    lower case if it is ASCII (the vocabulary splits marks off and has no case). Distinct cores and
    marks that two generations of a bounded cache don't know go to the library, many a call, told
    apart by offsets.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for piece, i in self.library.get_vocab().items() if piece.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ask(self, words: list[str]) -> list[bytes]:
        """Ids of each word: runs of letters, which are one piece of text to the library, are told apart by ids that end a word, others by offsets."""
        got = self.library.encode(" ".join(words), add_special_tokens=False)
        ids, width = np.array(got.ids, self.kind), self.kind.itemsize
        after = np.flatnonzero(self.ends[ids]) + 1
        if all(map(str.isalpha, words)) and len(after) == len(words):
            cuts = [0, *after.tolist()]
        else:
            size = np.array([len(w) + 1 for w in words])
            cuts = [*np.searchsorted(np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0], np.cumsum(size) - size).tolist(), len(ids)]
        flat = ids.tobytes()
        return [flat[width * a : width * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _known(self, parts: list[str]) -> list[bytes]:
        if len(self.young) + len(parts) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, parts))
        new = []
        for i, got in enumerate(out):
            if got is None:
                got = old.get(parts[i]) if parts[i] else b""
                if got is None:
                    new.append(i)
                else:
                    out[i] = young[parts[i]] = got
        letters = [i for i in new if parts[i].isalpha()]
        for some in (letters, [i for i in new if not parts[i].isalpha()] if len(letters) < len(new) else []):
            for k in range(0, len(some), 4096):
                at = some[k : k + 4096]
                for i, got in zip(at, self._ask([parts[i] for i in at]), strict=True):
                    out[i] = young[parts[i]] = got
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        special = pc.match_substring(words, "<|")
        tail = pc.struct_field(pc.extract_regex(words, _TAIL), "tail")
        core = pc.utf8_rtrim(words, characters=_MARKS)
        whole = pc.or_(special, pc.invert(pc.match_substring_regex(core, r"[\p{L}\p{Nd}]$")))
        core, tail = pc.if_else(whole, words, core), pc.if_else(whole, "", tail)
        core = pc.if_else(pc.and_not(pc.string_is_ascii(core), special), pc.ascii_lower(core), core)
        parts = pa.concat_arrays([core, tail]).dictionary_encode()
        blobs = self._known(parts.dictionary.to_pylist())
        size = np.array([len(b) for b in blobs], np.int64) // self.kind.itemsize
        at = np.ascontiguousarray(parts.indices.to_numpy().reshape(2, -1).T).ravel()
        flat = _gathered(np.frombuffer(b"".join(blobs), self.kind), size, at)
        return flat, size[at].reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; null texts have none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = lists.offsets.to_numpy()
        words = lists.values.dictionary_encode()
        flat, size = self._words(words.dictionary)
        at = words.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[at])])
        return _gathered(flat, size, at), np.diff(upto[bounds])


def _gathered(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``flat``, which holds runs of the given sizes, one after the other."""
    n = size[at]
    begin = (np.cumsum(size) - size)[at] - (np.cumsum(n) - n)
    total = int(n.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.arange(total, dtype=kind) + np.repeat(begin.astype(kind), n)]


_LOADED: dict[str, WordTokenizer] = {}


def loaded(vocabulary: str) -> WordTokenizer:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = WordTokenizer(public_tokenizers.path(vocabulary))
    return _LOADED[vocabulary]


def tokenised(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID) -> DataFrame:
    """doc_id, n (ids with the end id) and ids (binary: uint16 or uint32, little-endian) of every document; and a row a task with ``counts`` alone, of every id (uint64)."""

    def run(batches):
        tokenizer = loaded(vocabulary)
        end = np.array([end_id], tokenizer.kind).tobytes()
        counts = np.zeros(tokenizer.size, np.int64)
        names = ["doc_id", "n", "ids", "counts"]
        kind = None
        for batch in batches:
            texts, kind = batch.column(1), batch.column(0).type
            length = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            n, kept = [np.zeros(0, np.int64)], []
            for a, b in slabs(length):
                ids, size = tokenizer.encode(texts.slice(a, b - a))
                cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
                n.append(size + 1)
                kept += [ids[x:y].tobytes() + end for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                counts += np.bincount(ids, minlength=tokenizer.size)
            counts[end_id] += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(kept, pa.binary()), pa.nulls(batch.num_rows, pa.binary())], names=names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ids binary, counts binary")


def slabs(length: np.ndarray, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes, of one text at least."""
    end = np.cumsum(length)
    a = 0
    while a < len(end):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def write_shards(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """The table written to ``path`` (none: the shared folder) and read back: part, shard (of the part), n_ids, doc_ids and the shard's bytes, in doc_id order."""
    spark = docs.sparkSession
    written = stored(tokenised(docs, vocabulary), "ids", TEXT_ROWS)
    ids = written.where("n IS NOT NULL").drop("counts")
    size = loaded(vocabulary).size
    kind = loaded(vocabulary).kind

    def count(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                sums += np.frombuffer(blob, np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["id", "c"])

    got = written.select("counts").where("counts IS NOT NULL").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()  # a row an id of the vocabulary
    counts = np.zeros(size, np.int64)
    counts[got["id"].to_numpy()] = got["c"].to_numpy()
    lengths = spark.sparkContext.broadcast(code_lengths(counts))
    total = int(counts.sum())
    parts = max(1, min(100_000, -(-total // (4 * SHARD_IDS))))
    tie = [F.col("n"), F.crc32("ids")]
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), *tie).withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), *tie)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def write(batches):
        coder = Coder(lengths.value)
        buffer, names, ids_in, shard, part = [], [], 0, 0, 0

        def flush():
            all_ids = np.concatenate(buffer)
            data = pack(all_ids, np.array([len(b) for b in buffer]), coder)
            cols = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(all_ids)], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "shard", "n_ids", "doc_ids", "bytes"])

        for batch in batches:
            for p, doc, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                part = p
                buffer.append(np.frombuffer(blob, kind).astype(np.int64))
                names.append(doc)
                ids_in += len(buffer[-1])
                if ids_in >= SHARD_IDS:
                    yield flush()
                    buffer, names, ids_in, shard = [], [], 0, shard + 1
        if buffer:
            yield flush()

    schema = f"part int, shard int, n_ids long, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, bytes binary"
    shards = ordered.select("part", "doc_id", "ids").mapInArrow(write, schema)
    if path is None:
        return stored(shards, "shards")
    shards.write.mode("error").parquet(path)
    return spark.read.schema(shards.schema).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32 of every document of the written shards."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    heads = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("head"))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.select("part", "shard", "n_ids").withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(heads, F.col("part") == F.col("p")).select("part", "shard", (F.col("head") + F.col("own")).alias("start"))
    placed = shards.drop("n_ids").join(F.broadcast(starts) if starts.count() <= 1_000_000 else starts, ["part", "shard"])
    schema = f"doc_id {shards.schema['doc_ids'].dataType.elementType.simpleString()}, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names, data, start = (batch.column(c)[i] for c in range(3))
                ids, sizes = unpack(data.as_py())
                end = np.cumsum(sizes)
                flat = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(flat[4 * (b - s) : 4 * b]) for b, s in zip(end.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(start.as_py() + end - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("doc_ids", "bytes", "start").mapInArrow(read, schema)


def op4_huffman_ids(docs: DataFrame) -> DataFrame:
    """The thin query: every document's place and digest, read back from the written shards."""
    return read_shards(write_shards(docs))
