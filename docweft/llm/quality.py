"""Quality classification with hierarchical empirical Bayes over sites.

1. Two document classifiers (logistic, over hashed words, beginnings of words,
   shares of word shapes and a few counts) are fitted on a bounded sample of labelled rows,
   ``max_labelled`` of them, those with the smallest hash of their id: one for
   quality, one for toxicity.
2. They score every document, in one reading. Grouped aggregation of the quality gives each host and each path
   its number of documents and the sums of their probabilities. The method of
   moments over all hosts and all paths tells how much sites really differ, and
   so how many documents a prior is worth: the corpus is the prior of hosts,
   a host is the prior of its paths.
3. A document's final log odds are those of its own evidence plus
   ``site_weight`` times the difference between its path's posterior and the
   corpus. The document itself is left out of its sites' posteriors, so a site
   of one document has the prior of the level above.
4. A document is kept if its quality reaches ``threshold`` and its toxicity is
   below ``toxic_threshold``. Toxicity is the document's own: it is not
   excused by a good site.

Sums are made before the shuffle, so a host with a third of all rows costs one
row per task; sites are joined back by Spark, which broadcasts them only below
its checked threshold and splits a key with very many rows otherwise.

Defined results: a null text is empty; a null host or path is a site of its
own, named by the empty string; documents without an id are scored like others;
labels with null quality are not used, null toxic counts as 0, of repeated
labels of an id each counts; without usable labels of both sorts of quality all
documents have quality 0.5, without those of toxicity all have toxicity 0; equal texts of equal sites get equal results; an
empty table gives an empty result; other columns are ignored or, in
:func:`keep_good`, kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import alone, settle, unused, written

WORD_BITS, SHAPE_BITS = 15, 10
#: Beginnings of longer words have slots of their own, so that inflected and compound words share evidence.
PREFIXES = (4, 6)
COUNTS = 6
_PREFIX, _SHAPE = 1 << WORD_BITS, (1 + len(PREFIXES)) << WORD_BITS
WIDTH = _SHAPE + (1 << SHAPE_BITS) + COUNTS
#: Words that a Python worker remembers.
WORDS = 150_000
#: Words and prefixes that don't differ between good and bad labelled documents by so many standard deviations have no weight.
LEAST_DEVIATIONS = 4.0


def _slot(text: str, bits: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


class _Slots(dict):
    """word -> its word slot, with its shape slot and, 0 for none, its prefix slots and one in the higher bits."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS:
            self.clear()
        marks = "".join(c for c in word if not c.isalnum())
        core = word.strip(marks)
        tail = word[len(word.rstrip(marks)) :][:3]
        case = "u" if core.isupper() and len(core) > 1 else "t" if core[:1].isupper() else "l" if core.islower() else "m"
        shape = f"{case}{'d' if any(c.isdigit() for c in core) else ''}{min(len(core) // 8, 3)}{tail}"
        plain = core.lower()
        value = _slot(plain, WORD_BITS) | _slot(shape, SHAPE_BITS) << WORD_BITS
        for i, n in enumerate(PREFIXES):
            if len(plain) > n:
                value |= (_slot(plain[:n], WORD_BITS) + 1) << (WORD_BITS + SHAPE_BITS + i * (WORD_BITS + 1))
        self[word] = value
        return value


_SLOTS = _Slots()
#: What words and beginnings of words count: each slot once at most.
_ONES = np.ones(_SHAPE, "f4")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: words and beginnings of words that occur, shares of word shapes, and counts."""
    alone(_SLOTS)
    text = text or ""
    words = text.split()
    lines = text.split("\n")
    n = len(words)
    found = np.fromiter(map(_SLOTS.__getitem__, words), "i8", n)
    own, often = np.unique(found & ((1 << WORD_BITS) - 1), return_counts=True)
    shapes, times = np.unique((found >> WORD_BITS) & ((1 << SHAPE_BITS) - 1), return_counts=True)
    begun = []
    for i in range(len(PREFIXES)):
        marks = np.unique((found >> (WORD_BITS + SHAPE_BITS + i * (WORD_BITS + 1))) & ((1 << (WORD_BITS + 1)) - 1))
        begun.append(marks[marks > 0] + (_PREFIX * (i + 1) - 1))
    different = len(own) / max(1, n)
    counts = np.array(
        [
            math.log1p(n) / 8,
            2 * different,
            2 * (different * math.sqrt(max(1, n)) < 4),
            2 * len(set(lines)) / len(lines),
            4 * n / (1 + len(text)),
            4 * often.max(initial=0) / max(1, n),
        ]
    )
    words_and_prefixes = np.concatenate([own, *begun])
    slots = np.concatenate([words_and_prefixes, shapes + _SHAPE, np.arange(COUNTS) + (WIDTH - COUNTS)])
    values = np.concatenate([np.ones(len(words_and_prefixes)), 3 * np.sqrt(times / max(1, n)), counts])
    return slots, values


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = 1000, batch: int = 128, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights and, last, the bias of a logistic model, by AdaGrad in a fixed order: eight passes, or about ``steps`` steps.

    A row is slots and their values; the first slots, as many as there are more of them, have the value 1.
    """
    w, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-8)
    words = _SHAPE
    share = good.mean()
    seen_in, lift = np.zeros(WIDTH), np.zeros(WIDTH)
    for at in range(0, len(rows), 500):  # in parts, so that nothing as large as all features is made beside them
        part = np.concatenate([s for s, _ in rows[at : at + 500]])
        seen_in += np.bincount(part, minlength=WIDTH)
        lift += np.bincount(part, weights=np.repeat(good[at : at + 500], [len(s) for s, _ in rows[at : at + 500]]), minlength=WIDTH)
    seen_in, lift = seen_in[:words], lift[:words] - seen_in[:words] * share
    plain = np.zeros(WIDTH + 1, bool)
    plain[:words] = np.abs(lift) < LEAST_DEVIATIONS * np.sqrt(np.maximum(seen_in, 1) * share * (1 - share))
    order = np.random.default_rng(0)
    for _ in range(max(8, steps * batch // len(rows))):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            slots = np.concatenate([rows[i][0] for i in part])
            values = np.concatenate([x for i in part for x in (_ONES[: len(rows[i][0]) - len(rows[i][1])], rows[i][1])]).astype("f8")
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(of, weights=w[slots] * values, minlength=len(part)) + w[-1]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[part]) / len(part)
            slope = np.bincount(slots, weights=d[of] * values, minlength=WIDTH + 1)
            slope[-1] = d.sum()
            slope += decay * w
            slope[plain] = 0
            seen += slope**2
            w -= rate * slope / np.sqrt(seen)
    return w


@dataclass(frozen=True)
class Weights:
    """The classifiers' weights; None where there were no labels of both sorts."""

    quality: np.ndarray | None = None
    toxic: np.ndarray | None = None


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Weights:
    """Both classifiers. The sample and what one task trains on are ``max_labelled`` rows at most."""
    good, toxic = F.col("quality") == 1, F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("id"), good.cast("int").alias("good"), toxic.cast("int").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("id"), "id", "good", "toxic").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def extract(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [features(x.as_py()) for x in part.column(3)]
                slots = pa.array([s.astype("i4") for s, _ in found], pa.list_(pa.int32()))
                values = pa.array([v[np.count_nonzero(s < _SHAPE) :].astype("f4") for s, v in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], slots, values], names=["id", "good", "toxic", "slots", "values"])

    def learn(table: pa.Table) -> pa.Table:
        # rows are put in order by number and stay views: a sorted copy of all features is as large as they are
        order = pc.sort_indices(table.select(["id", "good", "toxic"]), [("id", "ascending"), ("good", "ascending"), ("toxic", "ascending")]).to_numpy()
        views = [(s.values.to_numpy(), v.values.to_numpy()) for s, v in zip(table["slots"], table["values"], strict=True)]
        rows = [views[i] for i in order.tolist()]
        out = {}
        for name in ("good", "toxic"):
            marks = table[name].to_numpy()[order].astype("f8")
            w = train(rows, marks) if 0 < marks.sum() < len(marks) else np.zeros(0)
            out[name] = pa.array([w.astype("f4").tobytes()], pa.binary())
        return pa.table(out)

    # one text of each id, the smallest, so that repeated rows neither swell the fit nor outweigh other labels
    chosen = texts.join(F.broadcast(sample.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    joined = chosen.join(F.broadcast(sample), "id").select("id", "good", "toxic", "text")  # bounded by max_labelled
    kinds = "id long, good int, toxic int, slots array<int>, values array<float>"
    rows = joined.mapInArrow(extract, kinds).groupBy(F.lit(0).alias("one")).applyInArrow(learn, "good binary, toxic binary").collect()
    if not rows:
        return Weights()
    read = lambda packed: np.frombuffer(packed, "f4").astype("f8") if packed else None
    return Weights(read(rows[0].good), read(rows[0].toxic))


def evidence(text: Column, weights: Weights) -> Column:
    """The document classifiers' probabilities (good, toxic) of a text."""
    known = {name: w.astype("f4").tobytes() for name, w in (("good", weights.quality), ("toxic", weights.toxic)) if w is not None}
    if not known:
        return F.struct(F.lit(0.5).alias("good"), F.lit(0.0).alias("toxic"))

    @F.arrow_udf("good double, toxic double")
    def score(texts: pa.Array) -> pa.Array:
        models = {name: np.frombuffer(packed, "f4").astype("f8") for name, packed in known.items()}
        out = {name: np.empty(len(texts)) for name in models}
        for i, text in enumerate(texts):
            slots, values = features(text.as_py())
            for name, w in models.items():
                out[name][i] = w[slots] @ values + w[-1]
        odds = {name: 1 / (1 + np.exp(-np.clip(z, -15, 15))) for name, z in out.items()}
        rest = {"good": np.full(len(texts), 0.5), "toxic": np.zeros(len(texts))}
        return pa.StructArray.from_arrays([pa.array(odds.get(n, rest[n])) for n in ("good", "toxic")], names=["good", "toxic"])

    return score(text.cast("string"))


def _strength(total: float, sites: float, within: float, between: float, squares: float) -> float:
    """Documents that a prior is worth: variance within sites against variance of the sites' true means."""
    s2 = max(within, 1e-9) / max(total - sites, 1.0)
    room = total - squares / max(total, 1.0)
    t2 = (between - max(sites - 1, 0.0) * s2) / room if room > 0 else 0.0
    return min(1e6, s2 / t2) if t2 > 1e-12 else 1e6


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums of each (host, path), and the corpus mean with the worth of both priors.

    ``scored`` is host, path, p.
    """
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n_path"), F.sum("p").alias("s_path"), F.sum(F.col("p") * F.col("p")).alias("q_path"))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"), F.sum("q_path").alias("q_host"))
    sites = written(paths.join(hosts, "host"), "sites")
    mean = lambda s, n: F.col(s) / F.col(n)
    a = sites.agg(
        F.sum("n_path").alias("total"),
        F.sum("s_path").alias("good"),
        F.count(F.lit(1)).alias("paths"),
        F.sum(F.col("q_path") - F.col("s_path") * mean("s_path", "n_path")).alias("path_within"),
        F.sum(F.col("n_path") * F.pow(mean("s_path", "n_path") - mean("s_host", "n_host"), 2)).alias("path_between"),
        F.sum(F.col("n_path") * F.col("n_path") / F.col("n_host")).alias("path_squares"),
    ).first()
    if not a.total:
        return sites, {"mean": 0.5, "host": 1e6, "path": 1e6}
    m = a.good / a.total
    b = (
        sites.select("host", "n_host", "s_host", "q_host")
        .distinct()
        .agg(
            F.count(F.lit(1)).alias("hosts"),
            F.sum(F.col("q_host") - F.col("s_host") * mean("s_host", "n_host")).alias("within"),
            F.sum(F.col("n_host") * F.pow(mean("s_host", "n_host") - m, 2)).alias("between"),
            F.sum(F.col("n_host") * F.col("n_host")).alias("squares"),
        )
        .first()
    )
    path_s2 = max(a.path_within, 1e-9) / max(a.total - a.paths, 1.0)
    room = a.total - a.path_squares
    t2 = (a.path_between - (a.paths - b.hosts) * path_s2) / room if room > 0 else 0.0
    return sites, {
        "mean": m,
        "host": _strength(a.total, b.hosts, b.within, b.between, b.squares),
        "path": min(1e6, path_s2 / t2) if t2 > 1e-12 else 1e6,
    }


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(inside / (F.lit(1.0) - inside))


def combined(p: Column, prior: dict[str, float], site_weight: float, sums: tuple[str, ...] = ("n_host", "s_host", "n_path", "s_path")) -> Column:
    """The final probability, from p and the joined sums of its sites, without the document itself."""
    n_host, s_host, n_path, s_path = map(F.col, sums)
    host = (s_host - p + prior["host"] * prior["mean"]) / (n_host - 1 + prior["host"])
    path = (s_path - p + host * prior["path"]) / (n_path - 1 + prior["path"])
    odds = _logit(p) + site_weight * (_logit(path) - _logit(F.lit(prior["mean"])))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _site(name: Column) -> Column:
    return F.coalesce(name.cast("string"), F.lit(""))


def _kept(quality: Column, toxic: Column, threshold: float, toxic_threshold: float) -> Column:
    return (quality >= threshold) & (toxic < toxic_threshold)


def classify(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_labelled: int = 20_000, site_weight: float = 0.5, threshold: float = 0.5, toxic_threshold: float = 0.3
) -> DataFrame:
    """doc_id, host, path, evidence, quality, toxicity, kept for each row of ``docs``."""
    weights = fit(docs, labels, max_labelled)
    scored = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _site(host).alias("host"), _site(path).alias("path"), evidence(F.col("text"), weights).alias("e")).select(
            "doc_id", "host", "path", F.col("e.good").alias("p"), F.col("e.toxic").alias("toxicity")
        )
    )
    sites, prior = site_posteriors(scored.select("host", "path", "p"))
    out = scored.join(sites, ["host", "path"]).withColumn("quality", combined(F.col("p"), prior, site_weight))
    kept = _kept(F.col("quality"), F.col("toxicity"), threshold, toxic_threshold)
    return out.select("doc_id", "host", "path", F.col("p").alias("evidence"), "quality", "toxicity", kept.alias("kept"))


def keep_good(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_labelled: int = 20_000, site_weight: float = 0.5, threshold: float = 0.5, toxic_threshold: float = 0.3
) -> DataFrame:
    """``docs`` without the documents that are rejected, all columns kept.

    Texts are scored once and kept with their scores as Parquet in the shared
    folder; sites are summed from the scores alone and joined on the second reading.
    """
    weights = fit(docs, labels, max_labelled)
    own_host, own_path, e, *sums = unused(docs, 7)
    scored = written(docs.select("*", _site(host).alias(own_host), _site(path).alias(own_path), evidence(F.col("text"), weights).alias(e)), "scored")
    sites, prior = site_posteriors(scored.select(F.col(own_host).alias("host"), F.col(own_path).alias("path"), F.col(e)["good"].alias("p")))
    known = sites.select("host", "path", "n_host", "s_host", "n_path", "s_path").toDF(own_host, own_path, *sums)
    final = combined(F.col(e)["good"], prior, site_weight, tuple(sums))
    joined = scored.join(known, [own_host, own_path]).where(_kept(final, F.col(e)["toxic"], threshold, toxic_threshold))
    return joined.select(*(f"`{c}`" for c in docs.columns))
