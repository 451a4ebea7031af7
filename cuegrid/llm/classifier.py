"""Operator 7: quality classifier of documents, hosts and paths by hierarchical empirical Bayes.

Evidence of a document: the log likelihood ratios (rejected against accepted) of the features
present in its whole text put together, learned from a bounded sample of labelled documents
(``sample``, those of the least hash of the id; of copies, exact or near, one is learned from).
A feature's rate of rejection counts by the bound of its Wilson interval that is nearer to the
prior, three standard errors wide, so that chance features weigh nothing. Against the global prior it gives the document's own
probability; summed by host, these shrink towards the prior, and by path towards the host, as
strongly as the spread between hosts warrants (method of moments). The posterior joins the
evidence to the rate of the document's path, without its own share.

Without labels of both classes nothing is rejected. Null text counts as empty; null hosts and
paths form groups of their own; null ids are classified like others. Labels with nulls are
not learned from. Texts of any length are read whole. Repeated rows count each; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import rest_of, slices, written

#: Labelled documents learned from, at most.
SAMPLE = 20_000
#: A feature is learned if it occurs in so many of them.
MIN_DOCS = 5
#: Standard errors of the interval of a feature's rate.
ERRORS = 3
REJECT = 0.5
#: The good evidence of many features together counts no more than this.
MOST_GOOD = -1.0
_SYMBOL = re.compile(r"[#*$%&|<>]")
_EDGES = ".,;:!?\"'()[]{}#*$%&|<>"


def features(text: str) -> set[str]:
    """Lower-case words, their first five letters, and the shape of the text in coarse classes."""
    raw = text.split()
    n = max(1, len(raw))
    tally = Counter(raw)
    found = {w.strip(_EDGES).lower() for w in tally}
    found.discard("")
    found |= {w[:5] + "~" for w in found if len(w) > 5}
    upper = sum(k for w, k in tally.items() if len(w) > 1 and w.isupper())
    lines = [x for x in text.split("\n") if x]
    top = 20 * max(tally.values(), default=0) // max(n, 40)
    shape = {
        # Within 100 words each time, since long texts come to repeat most of their words.
        "repeats": 10 * (n - sum(len(set(raw[k : k + 100])) for k in range(0, n, 100))) // n,
        "top": top if top > 3 else 0,  # common words reach a tenth or more of a short text
        "symbols": min(20, 20 * len(_SYMBOL.findall(text)) // n),
        "upper": 5 * upper // n,
        "marks": min(10, 5 * text.count("!") // n),
        "words": min(8, n.bit_length()),
        "lines": 5 * (len(lines) - len(set(lines))) // max(1, len(lines)),
    }
    return found | {f" {k} {v}" for k, v in shape.items()}


def _least_hashes(text: str) -> list[int]:
    """Three min-hashes of the text's windows of three words; near copies share most of them."""
    w = text.lower().split()
    h = np.fromiter((xxhash.xxh64_intdigest(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), np.uint64)
    return [int((h * np.uint64(odd) + np.uint64(odd >> 3)).min() >> np.uint64(1)) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, bad of the sample, one of each set of copies; the ids and labels broadcast are ``size`` rows at most."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.append_column("hashes", pa.array([_least_hashes(t.as_py()) for t in b["text"]], pa.list_(pa.int64())))

    rows = sample.mapInArrow(run, sample.withColumn("hashes", F.array().cast("array<long>")).schema)
    for k in range(3):
        first = F.row_number().over(Window.partitionBy("bad", F.get("hashes", F.lit(k))).orderBy("doc_id", F.xxhash64("text")))
        rows = rows.withColumn("_first", first).filter("_first = 1").drop("_first")
    return rows.select("text", "bad")


def learn(sample: DataFrame, min_docs: int = MIN_DOCS) -> tuple[dict[str, float], float]:
    """The weight of each feature, and the log odds of rejection among the labelled. The sample bounds the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [Counter(), Counter()]
            for text, bad in zip(b["text"], b["bad"]):
                k = bad.as_py()
                seen[k].update(features(text.as_py()))
                seen[k][" all"] += 1
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[x] for x in names], pa.int64()) for s in seen)], names=["feature", "good", "bad"])

    counts = sample.mapInArrow(run, "feature string, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = written(counts.filter(F.col("good") + F.col("bad") >= min_docs), "features")
    total = counts.filter("feature = ' all'").first()
    if total is None or not total.good or not total.bad:
        return {}, 0.0
    prior = total.bad / (total.good + total.bad)
    n, k = F.col("good") + F.col("bad"), F.col("bad")
    z2 = float(ERRORS**2)
    half = ERRORS * F.sqrt(k * (n - k) / n + z2 / 4)
    low, high = (k + z2 / 2 - half) / (n + z2), (k + z2 / 2 + half) / (n + z2)
    rate = F.when(low > prior, low).when(high < prior, high).otherwise(prior)
    weight = _odds(rate) - _odds(F.lit(prior))
    kept = counts.filter("feature <> ' all'").select("feature", weight.alias("weight")).filter(F.abs("weight") > 0.1)
    return {r.feature: r.weight for r in kept.collect()}, float(sample.sparkSession.range(1).select(F.log(F.lit(total.bad / total.good))).first()[0])


def evidence(found: list[float]) -> float:
    """The weights of a document put together. Features overlap and copies share them, so each
    further one against the document counts six tenths of the one before."""
    against = sorted((w for w in found if w > 0), reverse=True)
    return sum(w * 0.6**k for k, w in enumerate(against)) + max(MOST_GOOD, sum(w for w in found if w < 0))


def with_evidence(docs: DataFrame, shared) -> DataFrame:
    """docs with evidence: log likelihood ratio of rejection by its text. shared: broadcast of weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in slices(batches):
            out = []
            for t in b["text"]:
                out.append(evidence([weights[f] for f in features(t.as_py() or "") if f in weights]))
            yield b.append_column("evidence", pa.array(out, pa.float64()))

    return docs.mapInArrow(run, docs.withColumn("evidence", F.lit(0.0)).schema)


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def site_rates(scored: DataFrame, prior: float) -> DataFrame:
    """_host, _path, n, total (of the documents' probabilities), rate of the host and strength of shrinking."""
    own = _logistic(F.col("evidence") + F.lit(prior))
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum(own).alias("_total"))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_host_n"), F.sum("_total").alias("_host_total"))
    mean = F.sum("_host_total") / F.sum("_host_n")
    # Between hosts: the mean squared distance from the global rate, less what chance alone gives.
    overall = hosts.agg(mean.alias("_rate"), F.sum("_host_n").alias("_docs"), F.count("*").alias("_hosts"))
    spread = hosts.join(F.broadcast(overall)).agg(
        F.max("_rate").alias("_rate"),
        (F.sum(F.col("_host_n") * F.pow(F.col("_host_total") / F.col("_host_n") - F.col("_rate"), 2)) / F.max("_docs") - F.max("_hosts") * F.max("_rate") * (1 - F.max("_rate")) / F.max("_docs")).alias("_between"),
    )
    strength = F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("_rate") * (1 - F.col("_rate")) / F.greatest(F.col("_between"), F.lit(1e-9)) - 1))
    shrunk = hosts.join(F.broadcast(spread)).select(F.col("_host").alias("_h"), strength.alias("_strength"), ((F.col("_host_total") + strength * F.col("_rate")) / (F.col("_host_n") + strength)).alias("_host_rate"))
    return paths.join(shrunk, paths["_host"].eqNullSafe(shrunk["_h"])).drop("_h", "_host_n", "_host_total")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, reject: float = REJECT, with_text: bool = True) -> DataFrame:
    """row (the document's other columns), text, evidence, host_rate, path_rate (without the
    document itself), posterior and kept. host and path name columns of docs: where documents have
    addresses, their host and path; ``documents`` has neither, so source and language stand for them."""
    weights, prior = learn(labelled_sample(docs.select("doc_id", "text"), labels, sample))
    # The user's columns travel in a struct; texts are read once, and kept with their evidence if asked for.
    given = docs.select(rest_of(docs), F.col("text").alias("text"), F.col(f"`{host}`").alias("_host"), F.col(f"`{path}`").alias("_path"))
    scored = with_evidence(given, docs.sparkSession.sparkContext.broadcast(weights))
    scored = written(scored if with_text else scored.drop("text"), "evidence")
    rates = site_rates(scored, prior)
    rates = rates.select(F.struct("_host", "_path").alias("_site"), F.struct("_n", "_total", "_host_rate", "_strength").alias("_r"))
    # Sites are few beside documents; where they are not small Spark joins by the site, and splits hot ones.
    joined = scored.join(rates, F.struct("_host", "_path").eqNullSafe(rates["_site"]))
    own = _logistic(F.col("evidence") + F.lit(prior))
    path_rate = (F.col("_r._total") - own + F.col("_r._strength") * F.col("_r._host_rate")) / (F.col("_r._n") - 1 + F.col("_r._strength"))
    out = joined.select("row", *(["text"] if with_text else []), "evidence", F.col("_r._host_rate").alias("host_rate"), path_rate.alias("path_rate"))
    out = out.withColumn("posterior", _logistic(F.col("evidence") + _odds(F.col("path_rate"))))
    return out.withColumn("kept", (F.col("posterior") < reject) if weights else F.lit(True))
