"""Mixing sources to target weights by hash-threshold histograms.

Tokens are counted per document with a public tokenizer and summed per source and hash
bucket. The total of the mixture is the largest at which every source can give its
share within its repeats; each source then gives whole copies of itself plus the
documents below a hash threshold, found from the bucket sums by refining the boundary
bucket, in one pass over the documents and without any order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions.text import source_key
from meshquarry.llm.thresholds import hash_rank, thresholds
from meshquarry.session import spill

#: Where the vocabulary files of public tokenizers lie, and the one used.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer splits text before merging (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with doc_id and source as given and ``n_tokens``, the tokens of the whole text (null and empty: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), n], names=["doc_id", "source", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "source", F.col(text).alias("text")).mapInArrow(run, "doc_id long, source string, n_tokens long")


PLAN = "source string, weight double, max_repeats int, tokens double, wanted double, copies int, budget double, short double"


def mix_plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """:data:`PLAN`: what each source has to give (one row per target; no more leaves the cluster).

    ``sizes`` has source (key) and n_tokens per document. Weights are brought to a sum of 1; targets without a source or
    weight are left out, sources without tokens give nothing. Without ``total_tokens`` the mixture is as large as all
    shares allow; with it, sources that can't give their share within max_repeats give all they may and ``short`` says
    how much is missing.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("w"), F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1))).alias("r"))
    t = t.filter(F.col("source").isNotNull() & (F.col("w") > 0)).groupBy("source").agg(F.max("w").alias("w"), F.max("r").alias("r"))
    rows = t.join(sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")), "source", "left").collect()
    live = [x for x in rows if x.n]
    weights = sum(x.w for x in live)
    total = total_tokens if total_tokens is not None else min((x.n * x.r / (x.w / weights) for x in live), default=0.0)
    out = []
    for x in sorted(rows, key=lambda x: x.source):
        n, share = float(x.n or 0), x.w / weights if x.n else 0.0
        wanted = share * total
        give = min(wanted, n * x.r)
        copies = min(int(x.r), int(give / n + 1e-12)) if n else 0
        out.append((x.source, share, int(x.r), n, wanted, copies, max(0.0, give - copies * n), wanted - give))
    return sizes.sparkSession.createDataFrame(out, PLAN)


def mixed(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, repeats >= 1) and its plan. Documents of sources without a target give nothing."""
    sizes = spill(count_tokens(docs, tokenizer=tokenizer).withColumn("source", source_key(F.col("source"))).filter(F.col("source").isNotNull()), "tokens")
    p = mix_plan(sizes, targets, total_tokens)
    rank = hash_rank(F.col("doc_id"), seed=seed)
    t = thresholds(sizes, ["source"], F.col("n_tokens"), rank, p)
    give = p.join(t, "source", "left").select("source", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold"))  # one row per target
    repeats = F.col("copies") + F.when(rank < F.col("threshold"), 1).otherwise(0)
    return sizes.join(F.broadcast(give), "source").select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).filter(F.col("repeats") > 0), p


def shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens_mixed, documents, most_repeats, max_repeats, short."""
    per = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_mixed"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    j = plan.join(per, "source", "left").na.fill({"tokens_mixed": 0, "documents": 0, "most_repeats": 0})
    j = j.withColumn("all_tokens", F.sum("tokens_mixed").over(W.partitionBy(F.lit(0))))  # one row per target
    return j.select("source", F.col("weight").alias("target_share"), (F.col("tokens_mixed") / F.col("all_tokens")).alias("actual_share"), "tokens_mixed", "documents", "most_repeats", "max_repeats", F.round("short", 3).alias("short"))
