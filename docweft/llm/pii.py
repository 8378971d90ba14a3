"""Personal data by weak supervision, in DataFrame expressions only.

Base detectors (e-mail, IP address, payment card, phone) have fixed patterns
and checks; their spans always stay. Wider patterns propose further candidate
spans: secrets (long keys), numbers (account-like digit groups) and spelled-out
addresses. They are sought in the text with the base spans blanked out; a key
around a card-like run of digits stays a candidate. Labelers of three sorts vote
on each candidate: regular expressions on the span, gazetteers on the words
before it, and its context. Votes are counted per pattern of votes over all
documents. Expectation-maximisation on these counts estimates the share of true
spans of each kind and, for each labeler, how often it votes yes, no or not at
all on true and on other spans; a labeler may turn out worse than chance.

The final span classifier sees none of the votes but the span's character
classes (n-grams of lower-case letters, capitals, digits and other signs), its
length and the words around it. Each feature's log odds come from sums of
posteriors over all candidates, one aggregation; two more numbers, fitted on
binned scores, turn their sum into log odds.

What reaches the driver is bounded by construction: counts of vote patterns
(``3 * 3 ** len(LABELERS)`` rows at most), sums per feature (some two hundred
rows) and per bin of scores (``2 * BINS + 1`` rows), whatever the number of documents.

Everything is linear in a text, or nearly so in its number of spans (their
positions are running sums in two levels). Patterns are written so that a match
never backtracks over more than itself: possessive groups, and a match only
begins where no earlier one could.

Defined results: a null text is the empty text and has no spans; equal rows get
equal spans; order is by start, then kind as listed in :data:`KINDS`; added
spans touch base spans only where they hold them wholly; an empty table gives an
empty result, and a model that adds nothing. Columns other than the text are
never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import bind, settle, unused

#: Kinds in their order: the base kinds, then the added ones.
KINDS = ("email", "ip", "card", "phone", "secret", "number", "address")
BASE = KINDS[:4]

#: The patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/\x{E000}-])(?=[A-Za-z_+/\x{E000}-]*+[0-9])[A-Za-z0-9_+/\x{E000}-]{20,}+={0,2}+"
    r"|(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){8,}+(?![0-9A-Za-z])"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++"
)
#: What stands for the characters of a card, which may lie inside a key, and of any other base span.
CARD_BLANK, BLANK = "\ue000", "\ue001"

#: Words that speak for or against personal data when they stand before a candidate.
FOR_WORDS = "token|key|apikey|secret|password|passwd|pwd|auth|bearer|credential|account|iban|ssn|passport|phone|tel|mobile|call|fax|card|mail|email|contact"
AGAINST_WORDS = "version|page|pages|isbn|issn|doi|commit|checksum|md5|sha1|sha256|build|revision|figure|table|order|http|https|www"

#: Characters before and behind a candidate that labelers and features may look at.
CONTEXT = 32


def _scan(values: Column, op) -> Column:
    """Running results of ``op`` over an array of numbers, in blocks of about the root of its size.

    ``op`` takes what came before (null at first) and a value, and must be associative.
    """
    none = F.array().cast("array<int>")

    def run(part: Column) -> Column:
        return F.aggregate(part, none, lambda acc, v: F.concat(acc, F.array(op(F.try_element_at(acc, F.lit(-1)), v))))

    def blocks(all_values: Column) -> Column:
        n = F.size(all_values)
        step = F.ceil(F.sqrt(n)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1), lambda i: run(F.slice(all_values, i * step + 1, step)))
        return bind(parts, joined)

    def joined(parts: Column) -> Column:
        heads = run(F.transform(parts, lambda x: F.element_at(x, -1)))
        return bind(heads, lambda h: F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: op(F.get(h, i - 1), v))))))

    return bind(values, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(none))


def _sum(before: Column, v: Column) -> Column:
    return F.coalesce(before, F.lit(0)) + v


def _matches(text: Column, pattern: str) -> Column:
    """start, stop (code points, stop exclusive), text m of each match, left to right, and at most ``CONTEXT`` characters
    before and behind it that belong to no other match."""

    def placed(found: Column, gaps: Column) -> Column:
        stops = _scan(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), _sum)

        def spans(ends: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                before, behind = F.get(gaps, i), F.get(gaps, i + 1)
                stop = F.get(ends, i)
                return F.struct(
                    (stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("m"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(behind, F.lit(CONTEXT)).alias("behind")
                )

            return F.transform(found, one)

        return bind(stops, spans)

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: bind(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)))


MATCHES = "array<struct<start:int,stop:int,m:string,before:string,behind:string>>"


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(MATCHES))


#: Characters of a piece that a text is cut into before spans are cut out of it.
PIECE = 1024


def merged(spans: Column) -> Column:
    """Sorted spans (start, rank, stop) with those that overlap put together under the first one's rank."""

    def groups(every: Column, tops: Column) -> Column:
        opens = F.filter(F.transform(every, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(tops, i - 1)), i)), lambda i: i.isNotNull())

        def close(first: Column) -> Column:
            def one(i: Column, j: Column) -> Column:
                s, last = F.get(every, i), F.coalesce(F.get(first, j + 1), F.size(every)) - 1
                return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), F.get(tops, last).alias("stop"))

            return F.transform(first, one)

        return bind(opens, close)

    return bind(spans, lambda every: bind(_scan(F.transform(every, lambda s: s["stop"]), lambda a, b: F.greatest(a, b)), lambda tops: groups(every, tops)))


def replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with each of the sorted, possibly overlapping spans replaced by what ``by`` gives for it."""

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        within = F.substring(F.get(pieces, first), a % PIECE + 1, b - a)
        across = F.concat(
            F.substring(F.get(pieces, first), a % PIECE + 1, F.lit(PIECE)),
            F.array_join(F.slice(pieces, first + 2, last - first - 1), ""),
            F.coalesce(F.substring(F.get(pieces, last), F.lit(1), b % PIECE), F.lit("")),
        )
        return F.when(a >= b, F.lit("")).when(first == last, within).otherwise(across)

    def build(pieces: Column, cuts: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            return F.concat(cut(pieces, F.coalesce(F.get(cuts, i - 1)["stop"], F.lit(0)), s["start"]), by(s))

        tail = cut(pieces, F.element_at(cuts, -1)["stop"], F.length(text))
        return F.concat(F.array_join(F.transform(cuts, one), ""), tail)

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1," + str(PIECE) + "}"), F.lit(0))
    done = bind(pieces, lambda p: bind(merged(spans), lambda cuts: build(p, cuts)))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _card_holds(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _ip_holds(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\.", -1), lambda p: F.regexp_replace(p, "^0++(?=[0-9])", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def _phone_holds(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


def _typed(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """Sorted spans (start, rank, stop) of the base kinds."""
    digit = text.rlike("[0-9]")
    email = _if(text.contains("@"), _matches(text, EMAIL))
    ip = F.filter(_if(digit, _matches(text, IP)), lambda s: _ip_holds(s["m"]))
    card = F.filter(_if(digit, _matches(text, CARD)), lambda s: _card_holds(s["m"]))
    phone = F.filter(_if(text.contains("+"), _matches(text, PHONE)), lambda s: _phone_holds(s["m"]))
    kinds = zip(BASE, (email, ip, card, phone), strict=True)
    return F.sort_array(F.concat(*(_typed(spans, kind) for kind, spans in kinds)))


#: Votes are 1 (personal), -1 (not) or 0 (abstains); each labeler is a column over a candidate c
#: with its kind, text m, and the context before and behind it.
def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def _labelers(c: dict[str, Column]) -> dict[str, Column]:
    m, before, behind = c["m"], c["before"], c["behind"]
    digits = F.length(F.regexp_replace(m, r"[^0-9\x{E000}]", ""))
    return {
        "regex_shape": _vote(
            m.rlike(r"^[0-9a-fA-F\x{E000}]{32,}$|^(?:AKIA|ghp_|sk-|xox[bp]-)|(?:\(at\)|\[at\])") | ((c["kind"] == "number") & digits.between(9, 12)),
            m.rlike(r"^[-=_+/]+$|^/?[A-Za-z]+(?:[-_/][A-Za-z0-9]+)+$"),
        ),
        "regex_mixed": _vote(m.rlike(r"^(?=(?:[^0-9]*[0-9]){4})(?=.*[A-Za-z])[A-Za-z0-9+=\x{E000}]{24,}$"), m.rlike(r"^(.)\1+$|^(?:19|20)[0-9]{2}[ -]")),
        "gazetteer_for": _vote(before.rlike(rf"(?i)\b(?:{FOR_WORDS})\b")),
        "gazetteer_against": _vote(F.lit(False), before.rlike(rf"(?i)\b(?:{AGAINST_WORDS})\b")),
        "context_assigned": _vote(before.rlike(r"[=:]\s*[\"'(]?$"), before.rlike(r"[0-9.,$€£]\s?$|[/#]$")),
        "context_closed": _vote(behind.rlike(r"^[\"')]"), behind.rlike(r"^(?:/|\.[A-Za-z]{2,4}\b|\s?%)")),
    }


LABELERS = ("regex_shape", "regex_mixed", "gazetteer_for", "gazetteer_against", "context_assigned", "context_closed")


#: N-grams of character classes (a: lower case, A: capital, 9: digit, -: other) that the classifier looks for.
GRAMS = ("a9", "9a", "A9", "9A", "aA", "Aa", "a-", "-a", "A-", "-A", "9-", "-9", "a9a", "9a9", "A9A", "9A9", "aaaa", "AAAA", "9999", "99999999", "aaaaaaaa", "a-a", "9-9", "a-9", "9-a", "--")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789" + CARD_BLANK
#: Slots that the words around a span are hashed into, and bins of scores on either side of zero.
WORD_SLOTS, BINS = 48, 60


def _features(c: dict[str, Column], rank: Column) -> Column:
    """Names of what the final classifier sees of a span."""
    m, before, behind = c["m"], c["before"], c["behind"]
    shape = F.regexp_replace(F.translate(m, _LOWER + _UPPER + _DIGITS, "a" * 26 + "A" * 26 + "9" * 11), "[^aA9]", "-")
    grams = bind(shape, lambda x: F.array(*(F.concat(F.lit(f"g{i}:"), x.contains(g).cast("int").cast("string")) for i, g in enumerate(GRAMS))))
    length = F.least(F.floor(F.log2(F.greatest(F.length(m), F.lit(1)))), F.lit(8)).cast("string")
    share = F.floor(F.length(F.regexp_replace(m, r"[^0-9\x{E000}]", "")) * 4 / F.greatest(F.length(m), F.lit(1))).cast("string")
    words = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(before), F.lit("[a-z]{2,}"), F.lit(0))), lambda w: F.concat(F.lit("w"), F.pmod(F.xxhash64(w), F.lit(WORD_SLOTS)).cast("string")))
    signs = F.array(F.concat(F.lit("b:"), F.right(F.regexp_replace(before, r"[\s\"'(]+$", ""), F.lit(1)).rlike("[=:]").cast("string")), F.concat(F.lit("q:"), behind.rlike(r"^[\"')]").cast("string")), F.concat(F.lit("p:"), behind.rlike(r"^[/.%]").cast("string")))
    return F.concat(F.array(F.concat(F.lit("k"), rank.cast("string")), F.concat(F.lit("l"), length), F.concat(F.lit("d"), share)), signs, grams, F.array_distinct(words))


def blanked(text: Column, base: Column) -> Column:
    """``text`` with its base spans blanked out, every character in place."""
    sign = lambda s: F.when(s["rank"] == KINDS.index("card"), CARD_BLANK).otherwise(BLANK)
    return replaced(text, base, lambda s: F.repeat(sign(s), s["stop"] - s["start"]))


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans beside the base spans: (start, stop, rank, votes, features); votes and features are arrays."""

    def judge(s: Column) -> Column:
        kind = F.when(s["m"].rlike(r"^[0-9 -]+$"), "number").when(s["m"].rlike(r"[(\[]at[)\]]"), "address").otherwise("secret")
        c = {"m": s["m"], "kind": kind, "before": s["before"], "behind": s["behind"]}
        votes = _labelers(c)
        rank = F.when(kind == "secret", KINDS.index("secret")).when(kind == "number", KINDS.index("number")).otherwise(KINDS.index("address"))
        return F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), rank.alias("rank"), F.array(*(votes[x] for x in LABELERS)).alias("votes"), _features(c, rank).alias("features")
        )

    found = bind(blanked(text, base), lambda x: _if(x.rlike("[0-9]|[(\\[]at[)\\]]"), _matches(x, CANDIDATE)))
    return F.transform(found, judge)


@dataclass(frozen=True)
class SpanModel:
    """What was estimated: shares of true spans, each labeler's reliability, and the classifier."""

    share: dict[int, float] = field(default_factory=dict)
    reliability: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    bias: float = -1.0

    def sum_of(self, features: Column) -> Column:
        """Sum of the weights of a span's features."""
        if not self.weights:
            return F.lit(0.0)
        known = F.create_map(*(F.lit(x) for pair in sorted(self.weights.items()) for x in pair))
        return F.aggregate(features, F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(known, f), F.lit(0.0)))

    def score(self, features: Column) -> Column:
        """Log odds of a candidate."""
        return self.sum_of(features) * F.lit(self.slope) + F.lit(self.bias)


#: Counts that stand for what is expected of a labeler before any data, by its vote, on true and on other spans.
_EXPECTED = {1: {1: 3.0, 0: 2.0, -1: 1.0}, 0: {1: 1.0, 0: 2.0, -1: 3.0}}


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[dict[int, float], list[float], list[float]]:
    """Share of true spans of each kind, reliability of each labeler, and posterior of each pattern (kind, votes, count).

    A labeler votes yes, no or not at all, with probabilities of its own on
    true and on other spans. Its reliability is the share of right ones among the votes it casts.
    """
    width = len(patterns[0][1]) if patterns else 0
    kinds = sorted({k for k, _, _ in patterns})
    posterior = [1 / (1 + math.exp(-sum(votes))) for _, votes, _ in patterns]
    share, rates = dict.fromkeys(kinds, 0.5), []
    for _ in range(rounds):
        for k in kinds:
            rows = [(p, n) for p, (kind, _, n) in zip(posterior, patterns, strict=True) if kind == k]
            share[k] = (1 + sum(p * n for p, n in rows)) / (2 + sum(n for _, n in rows))
        rates = []
        for j in range(width):
            count = {y: dict(e) for y, e in _EXPECTED.items()}
            for p, (_, votes, n) in zip(posterior, patterns, strict=True):
                count[1][votes[j]] += n * p
                count[0][votes[j]] += n * (1 - p)
            rates.append({y: {v: c / sum(x.values()) for v, c in x.items()} for y, x in count.items()})
        for i, (kind, votes, _) in enumerate(patterns):
            odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(r[1][v] / r[0][v]) for r, v in zip(rates, votes, strict=True))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    total = sum(n for _, _, n in patterns) or 1
    true = sum(p * n for p, (_, _, n) in zip(posterior, patterns, strict=True)) / total
    right = []
    for r in rates:
        cast = true * (r[1][1] + r[1][-1]) + (1 - true) * (r[0][1] + r[0][-1])
        right.append((true * r[1][1] + (1 - true) * r[0][-1]) / cast)
    return share, right, posterior


def fit_line(bins: list[tuple[float, float, float]], steps: int = 3000, rate: float = 0.05) -> tuple[float, float]:
    """Slope and bias of log odds on (score, sum of posteriors, count) bins, by gradient descent."""
    total = sum(n for _, _, n in bins) or 1.0
    slope, bias = 0.5, 0.0
    for _ in range(steps):
        a = b = 0.0
        for x, p, n in bins:
            d = (n / (1 + math.exp(-max(-30.0, min(30.0, slope * x + bias)))) - p) / total
            a += d * x
            b += d
        slope -= rate * (a + 1e-3 * slope)
        bias -= rate * b
    return slope, bias


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Estimate labelers and train the span classifier on the candidates of all documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = docs.select(text.alias("text")).withColumn("base", base_spans(F.col("text")))
    found = settle(spans.select(F.explode(candidates(F.col("text"), F.col("base"))).alias("c")).select("c.rank", "c.votes", "c.features"))
    rows = sorted((r["rank"], tuple(r["votes"]), r["n"]) for r in found.groupBy("rank", "votes").agg(F.count(F.lit(1)).alias("n")).collect())
    if not rows:
        return SpanModel()
    share, right, posterior = expectation_maximisation(rows)
    marks = docs.sparkSession.createDataFrame([(k, list(v), p) for (k, v, _), p in zip(rows, posterior, strict=True)], "rank int, votes array<int>, p double")
    marked = found.join(F.broadcast(marks), ["rank", "votes"])  # as many rows as there are vote patterns
    sums = marked.select("p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    true = sum(p * n for p, (_, _, n) in zip(posterior, rows, strict=True))
    false = sum(n for _, _, n in rows) - true
    weights = {r.f: math.log((r.yes + 1) / (true + 2)) - math.log((r.no + 1) / (false + 2)) for r in sums}
    model = SpanModel(share, dict(zip(LABELERS, right, strict=True)), weights)
    cell = F.greatest(F.least(F.round(model.sum_of(F.col("features"))), F.lit(BINS)), F.lit(-BINS)).alias("x")
    bins = [(r.x, r.p, float(r.n)) for r in marked.select(cell, "p").groupBy("x").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()]
    slope, bias = fit_line([*sorted(bins), (4.0, 1.8, 2.0), (-4.0, 0.2, 2.0)])
    return SpanModel(share, model.reliability, weights, slope, bias)


def with_spans(docs: DataFrame, model: SpanModel, text_col: str = "text", base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """``docs`` with two more columns: base spans, and all spans, as (start, rank, stop) in order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn(base_col, base_spans(text))
    good = F.filter(candidates(text, F.col(base_col)), lambda c: model.score(c["features"]) > 0)
    added = F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["stop"].alias("stop")))
    return out.withColumn(spans_col, F.sort_array(F.concat(F.col(base_col), added)))


def as_text(spans: Column) -> Column:
    """``kind:start:stop`` of each span, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans share the first one's."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    return replaced(text, spans, lambda s: F.get(kinds, s["rank"]))


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``n_chars``, where there is one, follows.

    All columns are kept. A null text stays null.
    """
    model = model or fit(docs)
    base, spans = unused(docs, 2)
    spanned = with_spans(docs, model, base_col=base, spans_col=spans)
    out = spanned.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text").cast("string"), F.col(spans))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))
