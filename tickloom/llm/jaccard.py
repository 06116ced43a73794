"""Operator 10, n-gram Jaccard join: universe partition by pigeonhole, exact.

A document's set is its distinct word shingles (4 words in the query); sets link at a Jaccard
similarity of ``percent`` in 100 or more (85 in the query). Then their symmetric difference has at
most H = floor((100 - percent) a / percent) members, a being the smaller size. Sizes fall in bands,
each reaching to 100 / percent of its start, so linked sets lie in one band or in neighbours, and
each set is indexed under its own band and the one below.

Under a band, the universe of shingles is cut by hash into segments of weight 1 (matched if
equal) or 2 (matched if at most one deletion apart: the segment and all its one-deletion
neighbours are indexed). With weights summing to H + 1 + e, linked sets match in segments of
weight e + 1 at least. Costs decide: from the band's number of sets, the allocation of weights
and of e that costs least in signatures and expected chance collisions is taken, and a set
whose frequent signatures (more than FREQUENT sets) weigh e at most leaves those out.

Signatures travel in packed blocks, sorted and delta-coded. A bucket never emits its pairs. Its
centre (the set that most buckets hold) is paired with the others; sizes, then sketches, then the
words decide, and components are formed. A bucket that then has no more than ``SMALL`` sets outside its
largest component is settled pair by pair, and so are all buckets of a centre if that makes no more pairs than
indexing their distinct sets anew makes rows. Any other is indexed anew by what its sets don't share with
the centre c: for sets x and m with differences X and M from c, |x ^ m| = |X ^ M|, so a link of
sets that are not both linked with c needs |X & M| >= t = (|X| + |M| - H) / 2 >= 1, and a prefix of
|X| - t + 1 members of X (rare ones first) holds one of M's. So sets that share only what the
centre has too, however many, never meet. The new buckets go the same way with centres of their
own, until all pairs across components that are left are at most ``SMALL`` times the members of
the first buckets and no more than such rows (or ``LEVELS`` times); these are verified. Nothing is capped.

Sets are known by a 64-bit hash of their shingles' hashes, so exact copies meet first, whatever
their number. Texts are moved only for sets that share a bucket, one text a set.

Edge cases: no words or a null text: an empty set (n_shingles 0), linked with nothing, its
component its own id; under ``shingle`` words: the whole sequence is the one shingle; equal doc_ids
with different texts are different documents whose component may have the same id; a null
doc_id never names a component; an empty table gives an empty result; other columns are ignored,
whatever their names. The stage keeps the row with the smallest doc_id (nulls last, then the row's
place) of each component, so one row of repeated ones, and all rows without words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ASCII_LOWER, SPACE_BYTES, map_batches, mix64, placed, span_hashes, steps, stored, utf8
from tickloom.llm.components import components



@dataclass(frozen=True)
class Rule:
    """Sets of ``shingle`` words link if 100 * intersection >= percent * union."""

    shingle: int = 4
    percent: int = 85

    def differences(self, size: int) -> int:
        """Most members of the symmetric difference of linked sets, the smaller of this size."""
        return (100 - self.percent) * size // self.percent

    def links(self, both: int, sizes: int) -> bool:
        return 100 * both >= self.percent * (sizes - both)


#: The query's rule, and that of the stage.
QUERY, STAGE = Rule(4, 85), Rule(5, 80)
#: Sets that share a signature from which it counts as frequent.
FREQUENT = 64
#: Signatures a partition of the index holds, about; documents of one packed block.
PARTITION_ROWS, BLOCK_DOCS = 400_000, 4096
#: Sets outside the largest component of a bucket that is settled pair by pair, at least (more if its centre's buckets make no more pairs than rows that index their sets anew); how often others are indexed anew.
SMALL, LEVELS = 4, 6
#: Sets of a centre by which the order of their differences from it is made, and members it knows (any order gives the same result).
SAMPLE, COMMON = 48, 1024
#: What verifying a chance pair costs, in signatures.
PAIR_COST = 40
#: Text of centres that is broadcast, at most.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch that hold two texts or a packed block; signatures of the blocks that a task makes at once; sets it remembers to have sent.
WIDE_ROWS, FLUSH, REMEMBERED = 200, 1 << 19, 200_000
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
#: Multipliers of a shingle's words, by place; shingles of up to as many words.
_ORDER = np.random.default_rng(21).integers(1, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = QUERY.shingle) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data = np.frombuffer(b"\n".join(t.translate(ASCII_LOWER) for t in texts) + b"\n", np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    start = np.cumsum(size) - size
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    word = span_hashes(data, begin, end)
    first = np.searchsorted(begin, start)
    last = np.append(first[1:], len(begin))
    with np.errstate(over="ignore"):
        m = max(0, len(word) - shingle + 1)
        full = mix64(sum((word[k : k + m] * _ORDER[k] for k in range(shingle)), np.zeros(m, np.uint64)))
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= shingle:
                out.append(np.unique(full[a : b - shingle + 1]))
            elif b > a:
                out.append(mix64(np.array([(word[a:b] * _ORDER[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


@dataclass(frozen=True)
class Band:
    """Sizes low..high; under it, ``double`` segments of weight 2, ``single`` ones of weight 1, of which e + 1 match."""

    low: int
    high: int
    single: int
    double: int
    slack: int

    @property
    def units(self) -> int:
        return self.single + 2 * self.double

    @property
    def signatures(self) -> float:
        return self.single + self.double * (2 * self.high / max(1, self.units) + 1)


def _poisson_above(mean: float, k: int) -> float:
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def allocate(low: int, high: int, n_sets: int, rule: Rule = QUERY) -> Band:
    """The cheapest allocation for a band of so many sets; a band whose sets link only with equal ones has no segment."""
    h = rule.differences(high)
    if h == 0:
        return Band(low, high, 0, 0, 0)
    best = None
    for e in sorted({0, 1, 2, 2 + h // 10, 2 + h // 5}):
        units = h + 1 + e
        per = high / units
        for double in sorted({0, 1, units // 4, units // 2}):
            single = units - 2 * double
            if single < 0 or (single == 0 and e):
                continue
            empty = math.exp(-per)
            frequent = n_sets * empty > FREQUENT
            kept = _poisson_above(single * empty, e) if frequent else 1.0
            chance = single * (empty * kept) ** 2 + double * (math.exp(-2 * per) * (1 + 2 * per)) ** 2
            cost = n_sets * (single + double * (2 * per + 1)) + PAIR_COST * chance * n_sets**2 / 2
            if best is None or cost < best[0]:
                best = (cost, Band(low, high, single, double, e))
    return best[1]


def edges(top: int, rule: Rule = QUERY) -> list[tuple[int, int]]:
    """Lowest and highest size of each band, up to one that holds ``top``."""
    low, out = 1, []
    while low <= top:
        high = max(low, 100 * low // rule.percent)
        out.append((low, high))
        low = high + 1
    return out


def band_table(counts: dict[int, int], top: int, rule: Rule = QUERY) -> list[Band]:
    """All bands; ``counts``: how many sets a band (by number) has. A band also indexes the sets of the next one."""
    return [allocate(low, high, counts.get(k, 0) + counts.get(k + 1, 0), rule) for k, (low, high) in enumerate(edges(top, rule))]


def signatures(shingles: np.ndarray, number: int, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set under band ``number``: values, and which are of segments of weight 1."""
    with np.errstate(over="ignore"):
        unit = ((shingles >> np.uint64(32)) * np.uint64(band.units) >> np.uint64(32)).astype(np.int64)
        segment = np.where(unit < 2 * band.double, unit // 2, unit - band.double)
        value = mix64(shingles + np.uint64(number))
        n = band.single + band.double
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, segment, value)
        salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(number << 32))
        full = mix64(sums + salt)
        exact = np.arange(n) >= band.double
        if not band.double:
            return full, exact
        inside = segment < band.double
        less = mix64(sums[segment[inside]] - value[inside] + salt[segment[inside]])
        return np.concatenate([full, less]), np.concatenate([exact, np.zeros(len(less), bool)])


def _pack(sids: list[int], slack: list[tuple[int, int]], values: np.ndarray, place: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, block): signatures of a part in order, 40 bits each as differences, with their sets' places."""
    part = ((values & np.uint64(0xFFFFF)) % np.uint64(parts)).astype(np.int64)
    key = values >> np.uint64(24)
    order = np.lexsort((key, part))
    part, key, place = part[order], key[order], place[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    names, blocks = [], []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        high = np.diff((key[a:b] >> np.uint64(8)).astype(np.uint32), prepend=np.uint32(0))
        planes = high.view(np.uint8).reshape(-1, 4).T.tobytes()
        used, at = np.unique(place[a:b] & 0x3FFF, return_inverse=True)
        small = (at | (place[a:b] & 0xC000)).astype(np.uint16)
        head = np.array([sids[i] for i in used.tolist()], np.int64).tobytes() + np.array([slack[i] for i in used.tolist()], np.uint16).tobytes()
        names.append(int(part[a]))
        blocks.append(np.array([len(used), b - a], np.uint32).tobytes() + head + planes + (key[a:b] & np.uint64(255)).astype(np.uint8).tobytes() + small.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blocks, pa.binary())], names=["part", "block"])


def _unpack(part: int, block: bytes) -> tuple[np.ndarray, ...]:
    """key (with the part above its 40 bits), set, upper, exact, slack of every signature of a block."""
    n_sets, n = np.frombuffer(block, np.uint32, 2).tolist()
    at = 8
    sids = np.frombuffer(block, np.int64, n_sets, at)
    slack = np.frombuffer(block, np.uint16, 2 * n_sets, at + 8 * n_sets).reshape(-1, 2)
    at += 12 * n_sets
    high = np.cumsum(np.ascontiguousarray(np.frombuffer(block, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64))
    low = np.frombuffer(block, np.uint8, n, at + 4 * n).astype(np.int64)
    small = np.frombuffer(block[at + 5 * n :], np.uint16, n).astype(np.int64)
    place, upper, exact = small & 0x3FFF, (small & 0x8000) > 0, (small & 0x4000) > 0
    return (part << 40) | (high << 8) | low, sids[place], upper, exact, slack[place, upper.astype(np.int8)]


_BUCKETS = "g long, low array<long>, up array<long>, key long, sid long, upper boolean, exact boolean, slack long"


def _buckets(batches, most: int):
    """From packed blocks to buckets of two sets or more: small ones as lists (each content once), frequent ones row by row."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    known: set[int] = set()
    lists = pa.list_(pa.int64())

    def frame(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        kinds = {"g": pa.int64(), "low": lists, "up": lists, "key": pa.int64(), "sid": pa.int64(), "upper": pa.bool_(), "exact": pa.bool_(), "slack": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if k not in given else given[k] if isinstance(given[k], pa.Array) else pa.array(given[k], t) for k, t in kinds.items()], names=list(kinds))

    def ordered():
        key, sid, upper, exact, slack = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        o = np.lexsort((sid, key))
        key, sid, upper, exact, slack = (x[o] for x in (key, sid, upper, exact, slack))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        return tuple(x[new] for x in (key, sid, upper, exact, slack))

    def flush_frequent(key, sid, upper, exact, slack):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        known.update(key[first[size > most]].tolist())
        often = np.repeat(size > most, size)
        if known:
            often |= np.isin(key, np.fromiter(known, np.int64))
        return often

    def emit(key, sid, upper, exact, slack):
        for a in range(0, len(key), 200_000):
            s = slice(a, a + 200_000)
            yield frame(key=key[s], sid=sid[s], upper=upper[s], exact=exact[s], slack=slack[s])

    limit = PARTITION_ROWS + PARTITION_ROWS // 2
    for batch in batches:
        for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append(_unpack(part, block))
            rows += len(held[-1][0])
            if rows > limit:  # frequent ones leave as they come, so what is held stays bounded
                cols = ordered()
                often = flush_frequent(*cols)
                yield from emit(*(c[often] for c in cols))
                held = [tuple(c[~often] for c in cols)]
                rows = len(held[0][0])
                limit = max(limit, 2 * rows)
    if not held:
        return
    cols = ordered()
    often = flush_frequent(*cols)
    yield from emit(*(c[often] for c in cols))
    key, sid, upper, _, _ = (c[~often] for c in cols)
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    lows = np.add.reduceat((~upper).astype(np.int64), first)
    with np.errstate(over="ignore"):
        content = np.add.reduceat(mix64(sid.view(np.uint64) * np.uint64(2) + upper.astype(np.uint64)), first)
    good = np.flatnonzero((size > 1) & (lows > 0))
    if not len(good):
        return
    _, one = np.unique(content[good], return_index=True)
    good = good[one]
    for a in range(0, len(good), 20_000):
        part = good[a : a + 20_000]
        n = size[part]
        at = np.arange(n.sum()) + np.repeat(first[part] - (np.cumsum(n) - n), n)
        owner, s, u = np.repeat(np.arange(len(part)), n), sid[at], upper[at]
        cols = {}
        for name, own in (("low", ~u), ("up", u)):
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[own], minlength=len(part)))]).astype(np.int32)
            cols[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(s[own]))
        yield frame(g=content[part].view(np.int64), **cols)


def described(docs: DataFrame, rule: Rule) -> DataFrame:
    """file, row, doc_id, n_shingles and sid of every placed document."""
    schema = f"file long, row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, sid long"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in utf8(batch.column(3))]
            n, sid = [], []
            for s in steps(texts):
                for x in shingle_sets(texts[s], rule.shingle):
                    n.append(len(x))
                    sid.append(set_id(x))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sid, pa.int64())], names=["file", "row", "doc_id", "n_shingles", "sid"])

        return step

    return map_batches(docs.select("file", "row", "doc_id", "text"), make, schema)


def index(docs: DataFrame, bands: list[Band], parts: int, rule: Rule) -> DataFrame:
    """Packed signature blocks of all sets; a task sends each set once."""
    lows = np.array([b.low for b in bands])

    def run(batches):
        seen: set[int] = set()
        sids: list[int] = []
        slack: list[tuple[int, int]] = []
        values, place, total = [], [], 0

        def flush():
            out = _pack(sids, slack, np.concatenate(values), np.concatenate(place), parts)
            sids.clear(), slack.clear(), values.clear(), place.clear()
            return out

        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(0))]
            for s in steps(texts):
                for x in shingle_sets(texts[s], rule.shingle):
                    sid = set_id(x)
                    if not len(x) or sid in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sid)
                    own = int(np.searchsorted(lows, len(x), side="right")) - 1
                    got = False
                    for upper, k in ((0, own), (0x8000, own - 1)):
                        if k >= 0 and bands[k].units:
                            v, exact = signatures(x, k, bands[k])
                            values.append(v)
                            place.append(np.where(exact, 0x4000, 0) | upper | len(sids))
                            got = True
                    if got:
                        sids.append(sid)
                        slack.append((bands[own].slack, bands[own - 1].slack if own else 0))
                        total += len(values[-1])
                    if len(sids) >= BLOCK_DOCS or total >= FLUSH:
                        yield flush()
                        total = 0
        if sids:
            yield flush()

    return docs.select("text").mapInArrow(run, "part long, block binary")


def _shingles(text: bytes, shingle: int) -> set:
    words = text.translate(ASCII_LOWER).split()
    return set(zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else {tuple(words)} if words else set()


def _sketch(shingles: np.ndarray) -> bytes:
    """Parities of how many shingles fall in each of 64 buckets or more (a power of two, about one a shingle)."""
    buckets = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _may_link(a: bytes, b: bytes, sizes: int, rule: Rule = QUERY) -> bool:
    """False only if the sets can't link: a member of the symmetric difference flips one parity, so parities that differ bound it from below.

    ``sizes``: of both sets together. The wider sketch folds: its buckets are counted modulo the other's.
    """
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "big") ^ int.from_bytes(a[half:], "big")).to_bytes(half, "big")
    apart = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return (100 + rule.percent) * apart <= (100 - rule.percent) * sizes


def with_sketches(texts: DataFrame, rule: Rule) -> DataFrame:
    """sid, text and the sketch of each set."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ts = utf8(batch.column(1))
            out = [_sketch(x) for s in steps(ts) for x in shingle_sets(ts[s], rule.shingle)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["sid", "text", "sketch"])

        return step

    return map_batches(texts, make, "sid long, text string, sketch binary")


def _joined(pairs: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """The pairs with a column of both sets."""
    left, right = (texts.select(F.col("sid").alias(x), F.col(column).alias(f"x{x}")) for x in ("a", "b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "xa", "xb", "sizes")


def _filtered(pairs: DataFrame, make) -> DataFrame:
    """Pairs (a, b, xa, xb, sizes) for which the task's function of (a, xa, xb, sizes) holds."""

    def run(batches):
        holds = make()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            xa, xb = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            sizes = batch.column(4).to_pylist()
            keep = [i for i in range(len(a)) if holds(a[i], xa[i], xb[i], sizes[i])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b, sizes)], names=["a", "b", "sizes"])

    return pairs.mapInArrow(run, "a long, b long, sizes long")


def _feasible(na: str, nb: str, rule: Rule) -> F.Column:
    """Sizes of which one is large enough for the other."""
    return (F.col(na) * 100 >= rule.percent * F.col(nb)) & (F.col(nb) * 100 >= rule.percent * F.col(na))


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Of the pairs (a, b, sizes), those that link, as (a, b), written; texts: sid, text, sketch, a row a set.

    Pairs whose sketches bound the symmetric difference too high drop out; what is left is decided on the words.
    """

    def by_sketch():
        return lambda a, xa, xb, sizes: _may_link(xa, xb, sizes, rule)

    near = stored(_filtered(_joined(pairs, texts, "sketch"), by_sketch), "pairs")

    def by_words():
        held: dict = {}

        def holds(a, xa, xb, sizes):
            if held.get("a") != a:
                held["a"], held["set"] = a, _shingles(xa, rule.shingle)
            left, right = held["set"], _shingles(xb, rule.shingle)
            return rule.links(len(left & right), len(left) + len(right))

        return holds

    wanted = near.select(F.col("a").alias("w")).union(near.select("b")).distinct()
    own = texts.join(wanted, F.col("sid") == F.col("w"), "left_semi")
    return stored(_filtered(_joined(near, own, "text"), by_words).select("a", "b"), "links", WIDE_ROWS)


def _with_component(rows: DataFrame, comps: DataFrame, key: str, name: str) -> DataFrame:
    c = comps.select(F.col("node").alias(f"_{name}"), F.col("comp").alias(name))
    return rows.join(c, F.col(key) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(name, key)).drop(f"_{name}")


def prefixes(centre: np.ndarray, own: np.ndarray, rule: Rule, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, int]:
    """Members of the two sets' difference by which a set is indexed under a centre, and how many of them are for partners that differ from the centre as much or more.

    With d members of the difference, H the most that linked sets may differ in and r = (100 - percent) / (100 + percent): a partner
    with as many or more gives t >= max(d - H / 2, d (1 - r) / 2), one with fewer t >= d - H, or d (1 - r) / 2 if this set links with
    the centre, as its partner then does not; t >= 1 always. Any order that all sets of the centre share is right; rare members come
    first: ``common`` has members (ascending) and how often a sample of the centre's sets differ in them.
    """
    added, lacking = np.setdiff1d(own, centre, True), np.setdiff1d(centre, own, True)
    d, h = len(added) + len(lacking), rule.differences(len(own))
    half = d * rule.percent // (100 + rule.percent) + 1  # more than d (1 - r) / 2
    index = d - max(half, -(-(2 * d - h) // 2)) + 1
    linked = rule.links(len(own) - len(added), len(own) + len(centre))
    probe = d - half + 1 if linked else d - max(1, d - h) + 1
    ordered = np.concatenate([added, lacking])
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], ordered), len(common[0]) - 1)
        ordered = ordered[np.lexsort((ordered, np.where(common[0][at] == ordered, common[1][at], 0)))]
    return ordered[: max(index, probe)], max(0, index)


def centres_of(rows: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """centre, c (its text), and the at most COMMON members in which most of a sample of at most SAMPLE of its sets differ from it: members and counts, as bytes."""
    w = Window.partitionBy("centre").orderBy(F.xxhash64("sid"), "sid")
    some = rows.select("centre", "sid").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= SAMPLE).drop("nth")
    some = some.join(texts.select("sid", F.col("text").alias("x")), "sid").select("centre", "x")
    own = texts.join(rows.select("centre").distinct(), F.col("sid") == F.col("centre"), "left_semi").select(F.col("sid").alias("centre"), F.col("text").alias("x"))

    def count(keys, own: pa.Table, some: pa.Table) -> pa.Table:
        text = own.column("x")[0].as_py()
        centre = shingle_sets([text.encode()], rule.shingle)[0]
        found = [np.setxor1d(centre, shingle_sets([t], rule.shingle)[0], True) for t in utf8(some.column("x"))]
        member, n = np.unique(np.concatenate(found or [centre[:0]]), return_counts=True)
        top = np.sort(np.argsort(-n, kind="stable")[: min(COMMON, int((n > 1).sum()))])
        return pa.table({"centre": pa.array([keys[0].as_py()], pa.int64()), "c": [text], "members": [member[top].tobytes()], "counts": [n[top].astype(np.uint8).tobytes()]})

    return own.groupBy("centre").cogroup(some.groupBy("centre")).applyInArrow(count, "centre long, c string, members binary, counts binary")


def refined(rows: DataFrame, texts: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Packed blocks (part, block) that index the sets (centre, sid) of crowded buckets anew, by their differences from the centre."""
    centres = stored(centres_of(rows, texts, rule), "centres")
    size = centres.agg(F.sum(F.octet_length("c") + F.octet_length("members"))).first()[0] or 0
    own = texts.select("sid", F.col("text").alias("x"))
    both = rows.join(own, "sid").join(F.broadcast(centres) if size <= BROADCAST_BYTES else centres, "centre")

    def run(batches):
        held: dict[int, tuple] = {}
        sids: list[int] = []
        values, place, total = [], [], 0
        for batch in batches:
            texts_x = utf8(batch.column(2))
            ids, own_sids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in steps(texts_x):
                for i, x in zip(range(s.start, s.stop), shingle_sets(texts_x[s], rule.shingle), strict=True):
                    if ids[i] not in held:
                        if len(held) >= 64:
                            held.clear()
                        c, members, counts = (batch.column(k)[i].as_py() for k in (3, 4, 5))
                        held[ids[i]] = shingle_sets([c.encode()], rule.shingle)[0], (np.frombuffer(members, np.uint64), np.frombuffer(counts, np.uint8))
                    centre, common = held[ids[i]]
                    at, index = prefixes(centre, x, rule, common)
                    with np.errstate(over="ignore"):
                        values.append(mix64(at + np.uint64(ids[i] & 0xFFFFFFFFFFFFFFFF)))
                    place.append(np.where(np.arange(len(at)) < index, 0, 0x8000) | len(sids))
                    sids.append(own_sids[i])
                    total += len(at)
                    if len(sids) >= BLOCK_DOCS or total >= FLUSH:
                        yield _pack(sids, [(0, 0)] * len(sids), np.concatenate(values), np.concatenate(place), parts)
                        sids, values, place, total = [], [], [], 0
        if sids:
            yield _pack(sids, [(0, 0)] * len(sids), np.concatenate(values), np.concatenate(place), parts)

    return both.select("centre", "sid", "x", "c", "members", "counts").mapInArrow(run, "part long, block binary")


def _members(blocks: DataFrame, parts: int, frequent: int) -> DataFrame:
    """key, sid and probe of the sets in buckets, from packed blocks; a set whose frequent signatures can't decide a link leaves those out."""
    buckets = stored(blocks.repartition(parts, "part").mapInArrow(lambda batches: _buckets(batches, frequent), _BUCKETS), "buckets", WIDE_ROWS)
    small = buckets.where("g IS NOT NULL").groupBy("g").agg(F.first("low").alias("low"), F.first("up").alias("up"))
    often = buckets.where("g IS NULL").select("key", "sid", "upper", "exact", "slack")
    weight = often.where("exact").groupBy(F.col("sid").alias("s"), F.col("upper").alias("u")).agg(F.count("*").alias("z"))
    needed = often.join(weight, (F.col("sid") == F.col("s")) & (F.col("upper") == F.col("u")), "left").where(~F.col("exact") | (F.col("z") > F.col("slack")))
    each = F.concat(F.transform("low", lambda x: F.struct(x.alias("sid"), F.lit(False).alias("probe"))), F.transform("up", lambda x: F.struct(x.alias("sid"), F.lit(True).alias("probe"))))
    few = small.select("g", F.explode(each).alias("m")).select(F.xxhash64("g", F.lit(0)).alias("key"), "m.sid", "m.probe")
    return few.union(needed.select(F.xxhash64("key", F.lit(1)), "sid", "upper"))


def _open(work: DataFrame) -> DataFrame:
    """The buckets of (key, sid, probe, n, comp) in which a link could still join components.

    Every pair that matters has a set outside the largest component and one that is no probe: the fewer of both are ``first`` sets, ``strays`` of them.
    """
    parts = work.groupBy(F.col("key").alias("k"), "comp").agg(F.count("*").alias("of"), F.count_if(~F.col("probe")).alias("full"))
    outside = F.sum("of") - F.max("of")
    state = parts.groupBy("k").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("of", "comp")).alias("main"), outside.alias("outside"), F.sum("full").alias("full"))
    out = work.join(state.where("comps > 1 AND full > 0"), F.col("key") == F.col("k"))
    first = F.when(F.col("outside") <= F.col("full"), F.col("comp") != F.col("main")).otherwise(~F.col("probe"))
    return out.select(*work.columns, F.least("outside", "full").alias("strays"), first.alias("first"))


def _pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs across the components of each open bucket, one of which is no probe: first sets against all."""
    left = rows.where("first").select("key", F.col("sid").alias("a"), F.col("probe").alias("pa"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    right = rows.select("key", F.col("sid").alias("b"), F.col("probe").alias("pb"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    out = left.join(right, "key").where("ca <> cb AND NOT (pa AND pb)").where(_feasible("na", "nb", rule))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("sizes")).distinct()


def _linked(work: DataFrame, texts: DataFrame, rule: Rule, frequent: int = FREQUENT) -> DataFrame:
    """node, comp of all sets that link, from buckets (key, sid, probe, n)."""
    spark = work.sparkSession
    links, comps = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, comp long")

    def grown(pairs: DataFrame) -> None:
        nonlocal links, comps
        more = verified(pairs, texts, rule)
        if more.limit(1).count():
            links = stored(links.union(more), "links")
            comps = stored(components(links.toDF("u", "v")), "components")

    for level in range(LEVELS + 1):
        held = work.groupBy(F.col("sid").alias("s")).agg(F.count("*").alias("held"))
        ranked = work.join(held, F.col("sid") == F.col("s"))
        best = F.max(F.when(~F.col("probe"), F.struct("held", "sid", "n")))
        centre = ranked.groupBy(F.col("key").alias("k")).agg(best.alias("c")).where("c IS NOT NULL")
        work = stored(ranked.join(centre, F.col("key") == F.col("k")).select("key", "sid", "probe", "n", F.col("c.sid").alias("centre"), F.col("c.n").alias("nc"), F.col("c.held").alias("weight")), "work")
        stars = work.where("sid <> centre").where(_feasible("n", "nc", rule)).select(F.col("centre").alias("a"), F.col("sid").alias("b"), "weight", (F.col("n") + F.col("nc")).alias("sizes")).distinct()
        if not level:  # each set against its weightiest centre first
            grown(stars.groupBy("b").agg(F.max(F.struct("weight", "a", "sizes")).alias("m")).select("m.a", "b", "m.sizes"))
        apart = _with_component(_with_component(stars, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb")
        grown(apart.select("a", "b", "sizes"))
        rows = stored(_open(_with_component(work.where("sid <> centre"), comps, "sid", "comp")), "open")
        if not level:
            budget = SMALL * work.count()
        # buckets that share a centre hold much the same sets, which are indexed once: together they decide
        anew = F.floor(F.col("n") * ((100 - rule.percent) / rule.percent)) + 1  # signatures that index a set anew, at most
        made = rows.groupBy(F.col("centre").alias("c")).agg(F.sum("strays").alias("pairs"))  # strays of each row's bucket: all pairs across components
        index = rows.select("centre", "sid", "n").distinct().groupBy(F.col("centre").alias("i")).agg(F.sum(anew).alias("anew"))
        made = stored(made.join(index, F.col("c") == F.col("i")).select("c", "pairs", "anew"), "costs")
        pairs, signatures_anew = made.agg(F.sum("pairs"), F.sum("anew")).first()
        all_now = level == LEVELS or (pairs or 0) <= min(budget, signatures_anew or 0)
        rows = rows.join(made.select("c", (F.col("pairs") <= F.col("anew")).alias("settled")), F.col("centre") == F.col("c")).drop("c")
        few = F.lit(True) if all_now else (F.col("strays") <= SMALL) | F.col("settled")
        grown(_pairs(rows.where(few), rule))
        if all_now:
            break
        rows = _open(_with_component(rows.where(~few).drop("comp", "strays", "first", "settled"), comps, "sid", "comp"))
        rows = stored(rows.select("centre", "sid", "n").distinct(), "crowded")
        expected = rows.agg(F.sum(anew)).first()[0] or 0
        parts = int(max(16, -(-expected // PARTITION_ROWS)))
        size = rows.select(F.col("sid").alias("s"), "n").distinct()
        work = _members(refined(rows.select("centre", "sid"), texts, rule, parts), parts, frequent).join(size, F.col("sid") == F.col("s"))
        work = _open(_with_component(work.select("key", "sid", "probe", "n"), comps, "sid", "comp")).select("key", "sid", "probe", "n")
        work = stored(work, "finer")
    return comps


def linked_components(docs: DataFrame, rule: Rule = QUERY, frequent: int = FREQUENT) -> DataFrame:
    """file, row, doc_id, n_shingles, sid and cid (the set's component) of every placed document."""
    sets = stored(described(docs, rule), "sets")
    known = sets.where("n_shingles > 0").select("sid", F.col("n_shingles").alias("n")).distinct()
    top = known.agg(F.max("n")).first()[0]
    if top is None:
        return sets.withColumn("cid", F.col("sid"))
    lows = [low for low, _ in edges(top, rule)]
    own = F.size(F.filter(F.array(*[F.lit(x) for x in lows]), lambda x: x <= F.col("n"))) - 1
    counts = {r["band"]: r["c"] for r in known.groupBy(own.alias("band")).agg(F.count("*").alias("c")).collect()}  # a row a band
    bands = band_table(counts, top, rule)
    expected = sum(c * (bands[k].signatures + (bands[k - 1].signatures if k else 0)) for k, c in counts.items())
    parts = int(max(16, -(-expected // PARTITION_ROWS)))
    members = _members(index(docs, bands, parts, rule), parts, frequent)

    # sizes, and one text, of the sets that share a bucket
    rep = sets.where("n_shingles > 0").groupBy(F.col("sid").alias("s")).agg(F.min(F.struct("file", "row")).alias("r"), F.first("n_shingles").alias("n"))
    work = stored(members.join(rep.select("s", "n"), F.col("sid") == F.col("s")).select("key", "sid", "probe", "n"), "members")
    rep = rep.join(work.select("sid").distinct(), F.col("s") == F.col("sid"), "left_semi").select("s", "r.file", "r.row")
    texts = stored(with_sketches(docs.select("file", "row", "text").join(rep, ["file", "row"]).select(F.col("s").alias("sid"), "text"), rule), "near-texts")
    return _with_component(sets, _linked(work, texts, rule, frequent), "sid", "cid")


def op10_jaccard_join(docs: DataFrame, frequent: int = FREQUENT, rule: Rule = QUERY) -> DataFrame:
    """The thin query: component_id is the smallest doc_id of the component."""
    got = linked_components(placed(docs, "doc_id", "text"), rule, frequent)
    least = got.where("n_shingles > 0").groupBy(F.col("cid").alias("c")).agg(F.min("doc_id").alias("least"))
    out = got.join(least, (F.col("cid") == F.col("c")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component (five words, 80 in 100) one row stays, and all rows without words; columns pass through, whatever their names."""
    names = docs.columns
    rows = placed(docs, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    got = linked_components(rows.select("file", "row", *[F.col(f"c{names.index(c)}").alias(c) for c in ("doc_id", "text")]), STAGE)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    alone = F.when(F.col("n_shingles") == 0, F.struct("file", "row"))
    kept = got.groupBy(F.when(F.col("n_shingles") > 0, F.col("cid")).alias("c"), alone.alias("alone")).agg(F.min(order).alias("m"))
    out = rows.join(kept.select("m.file", "m.row"), ["file", "row"], "left_semi")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
