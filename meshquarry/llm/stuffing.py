"""Keyword-stuffed and link-list pages: bagged trees on content and link features, smoothed by host.

Two views of a page are kept apart. The first holds how dense its links and separators are,
how many of its word pairs repeat and whether one line fills it; pages at an extreme of it get
a weak label, the rest none. The second holds what its words, units and links are like: how
often each word stands in weakly labelled spam rather than in clean pages (counted over all
pages), how many words a unit says again, how long units are and how they vary, what stands beside links and where these lead.
Bagged decision trees learn the weak labels from the second view only and score every page; the
scores are then moved towards the spam rate of the page's host. No word of any language is
named here.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquarry.functions.text import source_key
from meshquarry.llm.subtitles import repair_encoding, without_times
from meshquarry.llm.thresholds import hash_rank
from meshquarry.session import salted_join, spill

#: Most pages the trees are fitted on (a hash sample of the weakly labelled pages).
FIT_ROWS = 20_000
#: Weak labels: spam where one of these shares is reached, clean where all of the lower ones are kept.
SPAM_FROM = {"links": 0.5, "pair_repeats": 0.3, "separators": 0.35}
CLEAN_TO = {"links": 0.05, "pair_repeats": 0.1, "separators": 0.12, "top_unit": 0.5}
#: Repetition is measured within so many units and averaged, so that it doesn't grow with the length of a page.
TOGETHER = 40
#: Most words that get a weight: rarer ones than their total / MOST_WORDS are left to the other features.
MOST_WORDS = 250_000
#: A word needs at least this many labelled pages for a weight.
LEAST_PAGES = 5
#: Shallow trees, as deeper ones learn the errors of the weak labels.
TREES, DEPTH = 40, 3
#: Weight of the host's log odds in a page's.
HOST_WEIGHT = 0.5

_LINK = re.compile(r"://|^www\.|\[\.\]|href=|^#\w|\w\.\w[\w-]+(?:/|$)|\w@\w+\.", re.I)
_HOST = re.compile(r"(?:://)?((?:[\w-]+(?:\.|\[\.\]))+\w{2,})")
_SENTENCE = re.compile(r"(?<=[.?!…])\s+(?=[^\s\d])")
_SPLIT = {i: " " for i in range(0x2700) if not chr(i).isalnum() and chr(i) not in "'’\n"}
_MARKUP = re.compile(r"</?[a-z]{1,4}>|\{[^}\n]{0,40}\}", re.I)

#: The view that the weak labels are made from, and the content and link features that the trees see.
LABEL_VIEW = ("links", "pair_repeats", "separators", "top_unit")
TEXT_VIEW = ("digits", "echoes", "unit_words", "unit_spread", "link_hosts", "beside_links")
WORD_VIEW = ("mean_weight", "weight_25", "weight_50", "weight_75", "clean_units", "spam_units", "known")
FEATURES = TEXT_VIEW + WORD_VIEW
PAGE = "doc_id long, source string, words long, units string, " + ", ".join(f"{f} double" for f in LABEL_VIEW + TEXT_VIEW)
WEIGHED = "doc_id long, source string, words long, label double, " + ", ".join(f"{f} double" for f in FEATURES)


def _is_link(word: str) -> bool:
    """Whether a word is a link or tag; plain words (with one sign at their end) are told without a pattern."""
    head = word[:-1]
    return not (word.isalnum() or (head.isalnum() and word[-1] != "=")) and _LINK.search(word) is not None


def units(text: str) -> list[str]:
    """Lines outside header, cue numbers and times; sentences where a line does not end in a link."""
    t = without_times(repair_encoding(text.replace("\r\n", "\n").replace("\r", "\n")))
    if "<" in t or "{" in t:
        t = _MARKUP.sub(" ", t)
    out: list[str] = []
    for line in t.split("\n"):
        line = line.strip()
        if line:
            out += [line] if _is_link(line.rsplit(" ", 1)[-1]) else _SENTENCE.split(line)
    return out


def page_views(text: str | None) -> tuple:
    """words, units and the label and text view of one page; nothing but zeros for null, empty and textless ones.

    Lines said again, as in songs and chants, count once where repetition is measured.
    """
    nothing = (0, "", *(0.0 for _ in LABEL_VIEW + TEXT_VIEW))
    if not text:
        return nothing
    own = units(text)
    whole = "\n".join(own)
    raw = whole.split()
    parsed = [w for u in whole.lower().translate(_SPLIT).split("\n") if (w := tuple(u.split()))]
    n = sum(map(len, parsed))
    if not n:
        return nothing
    linked = [w for w in raw if _is_link(w)]
    once = list(dict.fromkeys(parsed))
    blocks = [once[i : i + TOGETHER] for i in range(0, len(once), TOGETHER)]
    weight = [sum(map(len, b)) for b in blocks]
    repeats = sum(w * _pair_repeats(b) for w, b in zip(weight, blocks)) / sum(weight)
    separators = sum(map(whole.count, ",|;")) / len(raw)
    sizes = np.fromiter(map(len, parsed), float)
    hosts = {m[1].lower() for w in linked if (m := _HOST.search(w))}
    beside = [len(u.split()) for u in own if _LINK.search(u)] if linked else []
    return (
        n, "\n".join(" ".join(u) for u in parsed), len(linked) / len(raw), repeats, separators, max(Counter(parsed).values()) / len(parsed),
        sum(map(whole.count, "0123456789")) / sum(map(len, raw)), 1 - sum(len(set(u)) for u in parsed) / n, float(sizes.mean()), float(sizes.std()), len(hosts) / len(linked) if linked else 0.0, (sum(beside) - len(linked)) / len(beside) if beside else 0.0,
    )


def _pair_repeats(block: list[tuple[str, ...]]) -> float:
    """Share of the word pairs of some different units that were met before."""
    pairs = Counter(p for u in block for p in zip(u, u[1:]))
    return 1 - len(pairs) / seen if (seen := pairs.total()) else 0.0


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["words", "units", *LABEL_VIEW, *TEXT_VIEW]
    kinds = [pa.int64(), pa.string(), *(pa.float64() for _ in LABEL_VIEW + TEXT_VIEW)]
    for b in batches:
        rows = [page_views(t.as_py()) for t in b.column("text")]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *(pa.array(c, type=t) for c, t in zip(cols, kinds))], names=["doc_id", "source", *names])


def weak_label(pages: DataFrame) -> DataFrame:
    """``pages`` with ``label``: 1 at an extreme of the label view, 0 far from all, else null; textless pages have none."""
    spam = F.lit(False)
    clean = F.lit(True)
    for f in LABEL_VIEW:
        spam = spam | (F.col(f) >= SPAM_FROM[f]) if f in SPAM_FROM else spam
        clean = clean & (F.col(f) <= CLEAN_TO[f])
    return pages.withColumn("label", F.when(F.col("words") > 0, F.when(spam, 1.0).when(clean, 0.0)))


def page_table(docs: DataFrame) -> DataFrame:
    """:data:`PAGE` and the weak label of the whole text of each page."""
    return weak_label(docs.select(F.col("doc_id").cast("long"), source_key(F.col("source")).alias("source"), "text").mapInArrow(_parse, PAGE))


def word_weights(pages: DataFrame, most: int = MOST_WORDS) -> dict[str, float]:
    """Log odds of each word to stand in a weakly labelled spam page rather than a clean one.

    Counted over all labelled pages, combining before the shuffle. Only words that make up at least one of ``most`` parts
    of all (page, word) pairs come back, so never more than ``most`` words, whatever the corpus.
    """
    per_page = pages.filter(F.col("label").isNotNull()).select("label", F.explode(F.array_distinct(F.split("units", "[ \n]"))).alias("w"))
    counts = per_page.groupBy("w").agg(F.count("*").alias("n"), F.sum("label").alias("spam"))
    counts = spill(counts.filter(F.col("n") >= LEAST_PAGES), "words")
    all_ = counts.agg(F.sum("n").alias("n")).first().n or 0
    n = {r.label: r["count"] for r in pages.groupBy("label").count().collect()}
    n1, n0 = n.get(1.0, 0) + 1, n.get(0.0, 0) + 1
    rows = counts.filter(F.col("n") >= all_ / most).collect()
    return {r.w: math.log((r.spam + 0.5) / n1) - math.log((r.n - r.spam + 0.5) / n0) for r in rows}


def _weigh(weights: dict[str, float], text: str) -> tuple[float, ...]:
    """:data:`WORD_VIEW` of one page from its units; a word without a weight says nothing."""
    if not text:
        return (0.0,) * len(WORD_VIEW)
    parsed = [u.split(" ") for u in text.split("\n")]
    size = np.fromiter(map(len, parsed), float)
    flat = [w for u in parsed for w in u]
    own = np.fromiter((weights.get(w, 0.0) for w in flat), float)
    mean = np.add.reduceat(own, np.concatenate(([0], np.cumsum(size[:-1]).astype(int)))) / size
    share = size / size.sum()
    order = np.argsort(mean)
    upto = np.cumsum(share[order])
    quarters = (float(mean[order[min(len(order) - 1, int(np.searchsorted(upto, p)))]]) for p in (0.25, 0.5, 0.75))
    return (float(own.mean()), *quarters, float(share[mean < -1].sum()), float(share[mean > 0].sum()), sum(w in weights for w in flat) / len(flat))


def weighed(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """:data:`WEIGHED`: all features of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)
    first = ["doc_id", "source", "words", "label", *TEXT_VIEW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_weigh(sent.value, t) for t in b.column("units").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(WORD_VIEW)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in first), *(pa.array(c, type=pa.float64()) for c in cols)], names=[*first, *WORD_VIEW])

    return pages.select(*first, "units").mapInArrow(run, WEIGHED)


def fit(pages: DataFrame, rows: int = FIT_ROWS, seed: int = 5) -> RandomForestClassificationModel | None:
    """Bagged trees on at most about ``rows`` weakly labelled pages of each label; None if they have only one label."""
    labelled = pages.filter(F.col("label").isNotNull())
    n = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    share = {k: min(1.0, rows / 2 / v) for k, v in n.items()}
    limit = lambda k: F.lit(int(share[k] * (1 << 62)) - 1)
    sample = labelled.filter(hash_rank(F.col("doc_id"), seed=seed) <= F.when(F.col("label") == 1, limit(1.0)).otherwise(limit(0.0)))
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample).select("x", "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=1.0, seed=seed, maxBins=64).fit(train)


def scored(docs: DataFrame, fit_rows: int = FIT_ROWS, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """doc_id, source, words, label, page_score, host_rate, score of every page.

    Where all weak labels agree nothing can be learnt and the label itself (none: 0) is the page's score. Pages without a
    host are smoothed by the rate of all such pages.
    """
    pages = spill(page_table(docs), "pages")
    pages = spill(weighed(pages, word_weights(pages)), "weighed")
    model = fit(pages, fit_rows)
    if model is None:
        p = pages.withColumn("page_score", F.coalesce("label", F.lit(0.0)))
    else:
        p = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(pages)).withColumn("page_score", vector_to_array("probability")[1])
    p = spill(p.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "words", "label", F.when(F.col("words") > 0, F.col("page_score")).otherwise(0.0).alias("page_score")), "scores")
    all_ = p.agg(F.avg("page_score").alias("r")).first().r or 0.5
    # ten pages' worth of the overall rate, so that a host of few pages says little
    hosts = p.groupBy("source").agg(((F.sum("page_score") + 10 * all_) / (F.count("*") + 10)).alias("host_rate"))
    j = salted_join(p, hosts, "source", F.col("doc_id"))
    clip = lambda c: F.least(F.lit(0.999), F.greatest(F.lit(0.001), c))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    z = odds(F.col("page_score")) + F.lit(host_weight) * (odds(F.col("host_rate")) - odds(F.lit(float(all_))))
    return j.withColumn("score", F.when(F.col("words") > 0, 1 / (1 + F.exp(-z))).otherwise(0.0)).select("doc_id", "source", "words", "label", "page_score", "host_rate", "score")


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """doc_id and score of the pages that are stuffed."""
    return scored(docs).filter(F.col("score") >= 0.5).select("doc_id", "score")
