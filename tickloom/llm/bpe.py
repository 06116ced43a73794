"""Operator 3, byte-level BPE encoding and decoding by a segment tree.

A segment tree over the byte positions of a piece holds, at its root, the leftmost smallest
rank of a pair of neighbours. Each merge takes the root's pair, joins it to its live left
neighbour, and rewrites three leaves, each with its logarithmic path to the root. Short pieces
run as rows of one matrix, all their trees at once (``_merge_many``); a long piece has a tree
of its own (``_merge_one``), so a text without any split costs n log n.

A text is cut into chunks (a white-space run and what follows up to the next one) where no
match of the pattern can cross; chunks met before come from a bounded cache, others are
matched by the pattern and merged.

Edge cases: null and empty texts have no ids (both digests are those of no bytes); repeated
rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import map_batches

#: Pieces longer than this get a tree of their own.
LONGEST_ROW = 64
#: Bytes of the chunks that each of a worker's two caches remembers, about: a chunk, its ids and its place.
CACHE_BYTES = 128 << 20
_NONE = np.int64(1 << 60)
_RUN = re.compile(r"\s\s|\A\s|\s\Z")


class ByteBpe:
    """Encoder and decoder for a tiktoken rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        key = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], np.array(merged, np.int64)[order]
        self.pairs = dict(zip(self.pair_key.tolist(), self.pair_rank.tolist(), strict=True))
        self.lead: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.held = {" ": 0, "": 0}

    # merging ---------------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def _merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (uint32, little-endian) of pieces of at most ``width`` bytes, a power of two."""
        n, bits = len(pieces), width.bit_length() - 1
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = self.byte[raw]
        col = np.arange(width)
        inside = col[None, :] < size[:, None]
        nxt = np.where(inside, col + 1, width)
        nxt = np.where(nxt >= size[:, None], width, nxt)  # width: none follows
        prv = np.tile(col - 1, (n, 1))
        prv = np.concatenate([prv, np.full((n, 1), -1)], axis=1)
        tree = np.full((n, 2 * width), _NONE)
        r = self._rank(token[:, :-1], token[:, 1:])
        ok = (r >= 0) & inside[:, 1:]
        tree[:, width : 2 * width - 1] = np.where(ok, (r << bits) | col[:-1], _NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            at = leaf + width
            tree[rows, at] = value
            for _ in range(bits):
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        alive = inside
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root & (width - 1)
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            token[rows, at] = root >> bits
            alive[rows, gone] = False
            nxt[rows, at] = after
            prv[rows, after] = at
            put(rows, gone.copy(), np.full(len(rows), _NONE))
            has = after < width
            follow = np.where(has, after, 0)
            r = self._rank(token[rows, at], token[rows, follow])
            put(rows, at.copy(), np.where(has & (r >= 0), (r << bits) | at, _NONE))
            before = prv[rows, at]
            some = before >= 0
            if some.any():
                rs, b = rows[some], before[some]
                r = self._rank(token[rs, b], token[rs, at[some]])
                put(rs, b.copy(), np.where(r >= 0, (r << bits) | b, _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        flat = token[alive].astype("<u4").tobytes()
        end = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)]

    def _merge_one(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none = 1 << 62
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        pairs = self.pairs
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get((token[i] << 20) | token[i + 1])
            if r is not None:
                tree[width + i] = (r << 32) | i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

        def put(leaf: int, value: int) -> None:
            k = leaf + width
            tree[k] = value
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        while tree[1] < none:
            at, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = nxt[at]
            after = nxt[gone]
            token[at], alive[gone], nxt[at] = rank, 0, after
            put(gone, none)
            r = None
            if after < n:
                prv[after] = at
                r = pairs.get((rank << 20) | token[after])
            put(at, none if r is None else (r << 32) | at)
            before = prv[at]
            if before >= 0:
                r = pairs.get((token[before] << 20) | rank)
                put(before, none if r is None else (r << 32) | before)
        return np.array([t for t, live in zip(token, alive, strict=True) if live], "<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (one match of the pattern), as little-endian uint32."""
        out: list[bytes] = [b""] * len(pieces)
        rows: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > LONGEST_ROW:
                out[i] = self._merge_one(p)
            elif p:
                rows.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, at in rows.items():
            for k in range(0, len(at), 16_384):
                part = at[k : k + 16_384]
                for i, ids in zip(part, self._merge_many([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    # texts -----------------------------------------------------------------

    def _learn(self, lead: set[str], bare: set[str]) -> None:
        for cache, chunks, prefix in ((self.lead, list(lead), " "), (self.bare, list(bare), "")):
            cost = sum(map(len, chunks)) * 5 + 250 * len(chunks)
            if self.held[prefix] + cost > CACHE_BYTES:
                cache.clear()
                self.held[prefix] = 0
            self.held[prefix] += cost
            pieces, ends = [], []
            for c in chunks:
                pieces += [m.encode() for m in self.pattern.findall(prefix + c)]
                ends.append(len(pieces))
            ids = self.merge(pieces)
            begin = 0
            for c, end in zip(chunks, ends, strict=True):
                cache[c] = b"".join(ids[begin:end])
                begin = end

    @staticmethod
    def _cut(text: str) -> tuple[list[str], list[str]]:
        """Chunks of a text: (without a leading blank: none or the first; the others, of which those with a leading newline have no blank)."""
        if not _RUN.search(text):
            parts = text.replace("\n", " \n").split(" ")
            return parts[:1], parts[1:]
        chunks, own = [], ""
        for i, p in enumerate(text.split(" ")):
            if i and own and not own[-1].isspace():
                chunks.append(own)
                own = " " + p
            else:
                own = own + " " + p if i else p
        chunks.append(own)
        return chunks, []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32, as encode_ordinary gives them."""
        cut = []
        for t in texts:
            head, rest = self._cut(t) if t else ([], [])
            cut.append((head, rest))
        got = self._look(cut)
        for part in range(0, len(cut), 1):  # a text that the cache was cleared under is looked up alone
            if got[part] is None:
                got[part] = self._look(cut[part : part + 1], True)[0]
        return got  # type: ignore[return-value]

    def _look(self, cut: list[tuple[list[str], list[str]]], sure: bool = False) -> list[bytes | None]:
        lead, bare = set(), set()
        found = []
        for head, rest in cut:
            a, b = list(map(self.bare.get, head)), list(map(self.lead.get, rest))
            if None in a:
                bare.update(c for c, x in zip(head, a, strict=True) if x is None)
            if None in b:
                for c, x in zip(rest, b, strict=True):
                    if x is None:
                        if c[:1] == "\n":
                            bare.add(c)
                        else:
                            lead.add(c)
            found.append((a, b))
        if lead or bare:
            self._learn(lead, bare)
        out: list[bytes | None] = []
        for (head, rest), (a, b) in zip(cut, found, strict=True):
            if None in a:
                a = [self.bare.get(c) if x is None else x for c, x in zip(head, a, strict=True)]
            if None in b:
                b = [(self.bare if c[:1] == "\n" else self.lead).get(c) if x is None else x for c, x in zip(rest, b, strict=True)]
            if None in a or None in b:
                assert not sure
                out.append(None)
            else:
                out.append(b"".join(a) + b"".join(b))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(vocabulary: str, pattern: str | None = None) -> ByteBpe:
    """The worker's encoder for a rank file of public_tokenizers."""
    import public_tokenizers

    key = (vocabulary, pattern or public_tokenizers.PATTERN)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(public_tokenizers.path(vocabulary), key[1])
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, both digests and, with ``ids``, the ids themselves (binary, little-endian uint32)."""
    from tickloom.llm.common import steps

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    schema = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string{}".format(docs.schema["doc_id"].dataType.simpleString(), ", ids binary" if ids else "")

    def make():
        bpe = loaded(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, a, b, kept = [], [], [], []
            for s in steps(texts):
                for got in bpe.encode(texts[s]):
                    n.append(len(got) // 4)
                    a.append(hashlib.sha256(got).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                    if ids:
                        kept.append(got)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())] + [pa.array(kept, pa.binary())] * ids
            return pa.RecordBatch.from_arrays(cols, names=names)

        return step

    return map_batches(docs.select(F.col("doc_id"), F.col("text")), make, schema)


def op3_byte_bpe(docs: DataFrame) -> DataFrame:
    """The thin query: counts and digests of every whole text."""
    return encode_documents(docs, ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every document's ids and digests."""
    return encode_documents(docs)
