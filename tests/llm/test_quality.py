"""Quality: held-out accuracy, the site posteriors against plain Python, and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docweft.llm import quality

DOCS = "doc_id long, text string, source string, lang string, host string, p double, __mark int"
LABELS = "doc_id long, quality int, toxic int, text string"


def make(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        kind = rng.random()
        q, t = 1, 0
        if kind < 0.2:
            text, q = [w + rng.choice(["$$$", "###"]) for w in text], 0
        elif kind < 0.3:
            text[5:5] = ["idiot"]
            t = 1
        docs.append((i, " ".join(text), rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), "clash", 0.5, 1))
        labels.append((i, q, t, "clash"))
    return docs, labels


def test_held_out_and_sites(spark):
    docs, labels = make(1500)
    d = spark.createDataFrame(docs, DOCS)
    known = spark.createDataFrame(labels[:900] + [(5, None, None, ""), (None, 1, 0, ""), (10**6, 1, 0, "")], LABELS)
    rows = {r.doc_id: r for r in quality.classify(d, known, F.col("source"), F.col("lang")).collect()}
    right = [rows[i].kept == (q == 1 and t == 0) for i, q, t, _ in labels[900:]]
    assert len(rows) == 1500 and sum(right) / len(right) > 0.93
    # the formula, in plain Python, from the evidence that was returned
    paths, hosts = {}, {}
    for r in rows.values():
        paths.setdefault((r.host, r.path), []).append(r.evidence)
        hosts.setdefault(r.host, []).append(r.evidence)
    total = len(rows)
    m = sum(r.evidence for r in rows.values()) / total

    def moments(groups, centre, size):
        within = sum(sum((p - sum(g) / len(g)) ** 2 for p in g) for g in groups.values())
        s2 = within / (total - len(groups))
        between = sum(len(g) * (sum(g) / len(g) - centre(k)) ** 2 for k, g in groups.items())
        return s2, between, total - sum(len(g) ** 2 / size(k) for k, g in groups.items())

    s2, between, room = moments(hosts, lambda k: m, lambda k: total)
    t2 = (between - (len(hosts) - 1) * s2) / room
    worth_host = min(1e6, s2 / t2) if t2 > 1e-12 else 1e6
    s2, between, room = moments(paths, lambda k: sum(hosts[k[0]]) / len(hosts[k[0]]), lambda k: len(hosts[k[0]]))
    t2 = (between - (len(paths) - len(hosts)) * s2) / room
    worth_path = min(1e6, s2 / t2) if t2 > 1e-12 else 1e6

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    for r in rows.values():
        h, g = hosts[r.host], paths[r.host, r.path]
        host = (sum(h) - r.evidence + worth_host * m) / (len(h) - 1 + worth_host)
        path = (sum(g) - r.evidence + worth_path * host) / (len(g) - 1 + worth_path)
        assert r.kept == (r.quality >= 0.5 and r.toxicity < 0.3)
        want = 1 / (1 + math.exp(-(logit(r.evidence) + 0.5 * (logit(path) - logit(m)))))
        assert r.quality == pytest.approx(want, rel=1e-6)


def test_filter_agrees_and_keeps_columns(spark):
    docs, labels = make(300, 2)
    docs += [(None, None, None, None, None, None, None), (7, "", "c", "z", "", 0.0, 0), docs[0], (8, "word " * 100_000, "a", "x", "", 0.1, 1)]
    d, known = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    out = quality.keep_good(d, known, F.col("source"), F.col("lang"))
    assert out.columns == d.columns
    kept = quality.classify(d, known, F.col("source"), F.col("lang")).where("kept").select("doc_id")
    key = lambda rows: sorted(str(r.doc_id) for r in rows)
    assert key(out.collect()) == key(kept.collect())


def test_empty(spark):
    docs, labels = make(5)
    d, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    none = quality.classify(d.limit(0), known, F.col("source"), F.col("lang"))
    assert none.count() == 0
    unlabelled = quality.classify(d, known.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(unlabelled) == 5 and all(r.kept and r.quality == pytest.approx(0.5) for r in unlabelled)
    assert quality.keep_good(d, known.limit(0), F.col("source"), F.col("lang")).count() == 5


def test_repeated_rows_do_not_swell_the_fit(spark):
    docs, labels = make(200, 3)
    known = spark.createDataFrame(labels, LABELS)
    once = quality.fit(spark.createDataFrame(docs, DOCS), known)
    often = quality.fit(spark.createDataFrame(docs + [docs[5]] * 300, DOCS).repartition(3), known)
    assert (once.quality == often.quality).all() and (once.toxic == often.toxic).all()


def test_held_out_labels(spark):
    """Accuracy on every fifth label of a real table, none of which is fitted."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    tested = docs.join(labels.where(chosen), "doc_id", "left_semi")
    weights = quality.fit(docs, labels.where(~chosen))
    rows = tested.join(labels, "doc_id").select("quality", "toxic", quality.evidence(F.col("text"), weights).alias("e")).collect()
    kept = [(r.e.good >= 0.5 and r.e.toxic < 0.3, r.quality, r.toxic) for r in rows]
    share = lambda x: sum(x) / len(x)
    assert len(rows) > 600
    assert share([k for k, q, t in kept if q == 1 and t == 0]) >= 0.97
    assert share([not k for k, q, t in kept if q == 0]) >= 0.97
    assert share([not k for k, q, t in kept if t == 1]) >= 0.9
