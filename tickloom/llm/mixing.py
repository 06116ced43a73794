"""Operator 5, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources, in code point order with null last, weigh 5, 2, 1, repeating, and share
``share`` of all words; a target stops at ``repeats`` times its source's words and what is
over is shared again by weight until none is above.

Draws: a source's documents stand in the order of a keyed digest, as one line of words, cut into
blocks of ``block_words``; a document belongs to the block in which it begins. Each pass (first all
words, then what the target still needs) draws blocks in the order of a keyed permutation (the order
of the blocks' digests) until it has its words; only the last document drawn is cut. So every pass
has an exact quota of blocks. The quotas of all passes are split among the output shards by a tree: a
node's quotas go left and right by a multivariate hypergeometric draw with the node's own seed,
down to single shards, so every shard's quotas are exact and any node can be drawn anywhere again. A
shard's quota is a range of the permuted blocks; ranges are disjoint, so each block is drawn once in a
pass. Within a shard, documents are shuffled: their place is that of a keyed hash.

Scale: sizes are counted first and only places, digests and sizes move; a hot source's line, and its
permuted blocks, are summed in digest buckets, then within each; joins are on (source, block) and on a
row's place. The tree's upper nodes are drawn by the driver, those below by tasks; blocks grow so
that fewer than 2**29 exist. The driver holds a few numbers a source.

Edge cases: null and empty texts have size 0 and are never taken; a source without words gets
target 0; repeated rows are drawn like any others (equal rows may swap places, which changes
nothing); null ids and sources are values of their own; an empty table gives an empty result;
other columns are ignored, and pass through the stage whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE_BYTES, placed, stored, utf8

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 2048, 1 << 20, 11
#: Sources up to which the plan is broadcast; beyond, Spark chooses the join.
BROADCAST_SOURCES = 100_000
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def count_words(texts: list[bytes | None]) -> np.ndarray:
    """Words of each text: where what is no white space begins."""
    data = np.frombuffer(b"".join(b" " + (t or b"") for t in texts), np.uint8)
    space = _IS_SPACE[data]
    begins = np.zeros(len(data), np.int64)
    begins[1:] = space[:-1] & ~space[1:]
    sizes = np.array([len(t or b"") + 1 for t in texts])
    return np.add.reduceat(begins, np.cumsum(sizes) - sizes) if len(texts) else np.zeros(0, np.int64)


def sized(rows: DataFrame) -> DataFrame:
    """file, row, doc_id, source, digest and size of every placed row; the digest orders a source's documents."""

    def run(batches):
        for b in batches:
            sizes = np.concatenate([count_words(utf8(b.column(5).slice(i, 256))) for i in range(0, b.num_rows, 256)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sizes)], names=["file", "row", "doc_id", "source", "digest", "size"])

    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(SEED)), source, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    own = rows.select("file", "row", "doc_id", "source", digest.alias("digest"), "text")
    return own.mapInArrow(run, f"file long, row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, digest string, size long")


def targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """A row for each source: number, source_size, target and the words that two passes take (first, rest)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # sources only: their number is small
    per = per.withColumn("number", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    everything = W.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(W.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everything) * share
    level = (wanted - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    per = per.withColumn("wanted", wanted).withColumn("capped", F.col("cap") / F.col("weight") < level)
    left = F.col("wanted") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    rest_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), left / rest_weight * F.col("weight")))
    quota = F.floor(F.col("target") + 0.5)
    per = per.withColumn("target", target)
    return per.select("source", "number", "source_size", "target", F.least(quota, F.col("source_size")).alias("first"), F.greatest(quota - F.col("source_size"), F.lit(0)).alias("rest"))


def split(quotas: list[int], begin: list[int], low: int, high: int, seed: int) -> tuple[tuple, tuple]:
    """The two children of the node of shards [low, high): what each gets of every pass's blocks."""
    middle = (low + high) // 2
    total = sum(quotas)
    share = total * (middle - low) // (high - low)
    rng = np.random.default_rng([seed, low, high])
    left = rng.multivariate_hypergeometric(quotas, share, method="marginals").tolist()
    right = [q - x for q, x in zip(quotas, left, strict=True)]
    return (left, begin, low, middle), (right, [b + x for b, x in zip(begin, left, strict=True)], middle, high)


def drawn_blocks(spark, quotas: dict[tuple[int, int], int], shards: int, seed: int) -> DataFrame:
    """A row for each drawn block: number, pass, nth (its place in the pass's permutation) and shard; ``quotas``: blocks by (number, pass)."""
    passes = sorted(quotas)
    nodes = [([quotas[p] for p in passes], [0] * len(passes), 0, shards)] if passes else []
    while nodes and len(nodes) < 64 and any(n[3] - n[2] > 1 for n in nodes):
        nodes = [c for n in nodes for c in (split(*n, seed) if n[3] - n[2] > 1 else (n,))]
    schema = "number long, pass int, nth long, shard long"
    if not nodes:
        return spark.createDataFrame([], schema)
    frame = spark.createDataFrame(nodes, "quotas array<long>, begin array<long>, low long, high long").repartition(min(64, len(nodes)))

    def grow(batches):
        for batch in batches:
            for _, r in batch.iterrows():
                stack = [(list(r.quotas), list(r.begin), int(r.low), int(r.high))]
                while stack:
                    node = stack.pop()
                    if node[3] - node[2] > 1:
                        stack += split(*node, seed)
                        continue
                    for (number, e), q, b in zip(passes, node[0], node[1], strict=True):
                        for k in range(0, int(q), 100_000):
                            yield pd.DataFrame({"number": number, "pass": np.int32(e), "nth": np.arange(b + k, b + min(int(q), k + 100_000)), "shard": node[2]})

    return frame.mapInPandas(grow, schema)


def _digits(rows: int) -> int:
    """Hexadecimal digits of a bucket's name, so that a bucket has about 4096 of so many rows."""
    return min(8, max(1, math.ceil(math.log(rows / 4096, 16)))) if rows > 4096 else 1


def _prefix(rows: DataFrame, by: list[str], key: str, tie: list[str], digits: int, **sums: str) -> DataFrame:
    """``sums`` (name: column) over all rows of the same ``by`` before each one in the order of ``key`` (hexadecimal): over buckets first, then within each."""
    rows = rows.withColumn("bucket", F.substring(key, 1, digits))
    heads = rows.groupBy(*by, "bucket").agg(*[F.sum(c).alias(f"sum_{n}") for n, c in sums.items()])
    before = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*by, "bucket", *[F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"head_{n}") for n in sums])
    inside = W.partitionBy(*by, "bucket").orderBy(key, *tie).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(heads, [*by, "bucket"])
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"head_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).drop(f"head_{n}")
    return out.drop("bucket")


def mix(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Of placed rows (file, row, doc_id, source, text): file, row, doc_id, size, source_size and target of each, and its draws (file, row, pass, words, shard, place), written."""
    spark = rows.sparkSession
    sizes = stored(sized(rows), "sizes")
    plan = stored(targets(sizes), "targets")
    want = plan.select("number", "first", "rest").collect()  # one a source, numbers only
    words = sum(r["first"] + r["rest"] for r in want)
    while words // block_words >= 1 << 29:
        block_words *= 2
    known = plan.withColumnRenamed("source", "s")
    known = F.broadcast(known) if len(want) <= BROADCAST_SOURCES else known
    line = sizes.join(known.select("s", "number"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    line = _prefix(line, ["number"], "digest", ["doc_id", "file", "row"], _digits(sizes.count()), start="size")
    line = stored(line.where("size > 0").withColumn("block", F.floor(F.col("start") / block_words)), "line")

    blocks = line.groupBy("number", "block").agg(F.sum("size").alias("words"), F.min("start").alias("begin"))
    quota = F.explode(F.array(F.struct(F.lit(0).alias("pass"), F.col("first").alias("quota")), F.struct(F.lit(1).alias("pass"), F.col("rest").alias("quota")))).alias("p")
    passes = plan.select("number", quota).select("number", "p.pass", "p.quota").where("quota > 0")
    blocks = blocks.join(F.broadcast(passes) if len(want) <= BROADCAST_SOURCES else passes, "number")
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.col("pass").cast("string"), F.col("number").cast("string"), F.col("block").cast("string")).cast("binary"))
    blocks = blocks.withColumn("key", key).withColumn("one", F.lit(1).cast("long"))
    blocks = _prefix(blocks, ["number", "pass"], "key", ["block"], _digits(words // block_words), before="words", nth="one")
    blocks = blocks.where("before < quota").select("number", "pass", "block", "begin", "nth", F.least("words", F.col("quota") - F.col("before")).alias("limit"))
    blocks = stored(blocks, "blocks")
    quotas = {(r["number"], r["pass"]): r["n"] for r in blocks.groupBy("number", "pass").agg(F.count("*").alias("n")).collect()}  # two a source, at most
    drawn = blocks.join(drawn_blocks(spark, quotas, max(1, -(-words // shard_words)), seed), ["number", "pass", "nth"])

    take = F.least(F.col("size"), F.col("limit") - (F.col("start") - F.col("begin")))
    draws = line.join(drawn, ["number", "block"]).withColumn("words", take).where("words > 0")
    shuffled = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "pass", "digest"), "file", "row")
    draws = draws.select("file", "row", "pass", "words", "shard", F.row_number().over(shuffled).cast("long").alias("place"))
    shares = sizes.join(known.select("s", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return shares.select("file", "row", "doc_id", "size", "source_size", "target"), stored(draws, "draws")


def op5_mix_sources(docs: DataFrame) -> DataFrame:
    """The thin query: the words taken of every document, and where its draws stand (at most one a pass: pass, shard, place in the shard)."""
    shares, draws = mix(placed(docs, "doc_id", "source", "text"))
    own = draws.groupBy(F.col("file").alias("f"), F.col("row").alias("r")).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("pass", "shard", "place"))).alias("draws"))
    out = shares.join(own, (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("draws", F.array().cast(own.schema["draws"].dataType)).alias("draws"))


def taken_words(docs: DataFrame) -> DataFrame:
    """The words taken of every document alone, which SQL can state."""
    return op5_mix_sources(docs).drop("draws")


TAKEN_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat_ws('|', '11', coalesce('=' || source, ''), coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS digest
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source
), w AS (
  SELECT *, CASE (number - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS wanted,
         CAST(cap AS DOUBLE) / weight < (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS capped
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE),
         (wanted - coalesce(CAST(sum(cap) FILTER (capped) OVER () AS DOUBLE), 0)) / CAST(sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) * weight) END AS target
  FROM l
), q AS (
  SELECT source, number, source_size, target, least(CAST(floor(target + 0.5) AS BIGINT), source_size) AS first,
         greatest(CAST(floor(target + 0.5) AS BIGINT) - source_size, 0) AS rest FROM t
), p AS (
  SELECT d.doc_id, d.digest, d.size, q.number, q.source_size, q.target, q.first, q.rest,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), b AS (
  SELECT number, start // 2048 AS block, e.pass, sum(size) AS words, min(start) AS head, any_value(CASE e.pass WHEN 0 THEN first ELSE rest END) AS quota
  FROM p, (VALUES (0), (1)) e(pass) WHERE size > 0 GROUP BY ALL
), k AS (
  SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY number, pass ORDER BY md5(concat_ws('|', '11', pass, number, block)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS upto FROM b
), g AS (
  SELECT number, block, pass, head, greatest(0, least(words, quota - upto)) AS most FROM k
)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(greatest(0, least(p.size, coalesce(g0.most - (p.start - g0.head), 0))) + greatest(0, least(p.size, coalesce(g1.most - (p.start - g1.head), 0))) AS BIGINT) AS taken
FROM p LEFT JOIN g g0 ON p.number = g0.number AND p.start // 2048 = g0.block AND g0.pass = 0
       LEFT JOIN g g1 ON p.number = g1.number AND p.start // 2048 = g1.block AND g1.pass = 1
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as it was drawn, shards one after the other in their shuffled order; the one a pass ends in keeps its first words."""
    names = docs.columns
    rows = placed(docs, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    shares, draws = mix(rows.select("file", "row", *[F.col(f"c{names.index(c)}").alias(c) for c in ("doc_id", "source", "text")]))
    out = rows.join(draws.join(shares.select("file", "row", "size"), ["file", "row"]), ["file", "row"])
    out = out.repartition("shard").sortWithinPartitions("shard", "place")
    text = F.col(f"c{names.index('text')}")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, 1, F.col("words").cast("int")), " ")).otherwise(text)
    new = {"text": cut} | ({"n_chars": F.length(cut).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
