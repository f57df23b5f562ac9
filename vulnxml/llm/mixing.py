"""Mixing sources to target weights with soft membership, in DataFrame terms.

A classifier learned from a labelled table gives every document a posterior
over the domains of its labels. One half of a sample (at most about ``SAMPLE``
labelled rows of each domain, chosen by a hash of the id) finds each domain's
marker words and word ends; the other half tells how many markers of each
domain, and what share of different words, the texts of each domain have. The
posterior is naive Bayes over these few values, none included. Long texts hold
more markers by chance, so a count is set against the count that the other
domains' texts of as many different words have (a power of that number, fitted
by ``Curve``), and different words are counted in stretches of ``STRETCH`` words,
which long texts have more of: both values mean the same at any length. The expected
tokens of a domain are the sum over documents of rate x tokens x posterior.
Projected gradient descent on the squared gap to the targets, started at rate
1, fits a nonnegative rate of at most ``MAX_RATE`` for each document. As a rate
depends on the posterior alone, documents are first added up by posterior, of
which there are no more than values of the features, at any size of the corpus;
a round is one aggregate over that table, its result one number per domain, from
which every posterior takes its next step. Rounds end when the loss no longer
falls, not at a number. The targets are shares;
their total is the largest for which no domain has to be repeated. Shares of
the domains in ``UPPER`` are upper ones: such a domain doesn't bind the total,
and one that has less than its share is asked for what it has. Where soft
membership puts a target out of reach, the fit is the nearest it can be.

Rates become copies: fractions are kept by a hash of id and text, so every
document with a positive rate may be drawn and copies add up to the fit.

Everything is built-in functions: no Python touches a row. Null text has no
words and the prior as its posterior; null ids hash like any value; without
labelled rows all rates are 1; a domain without a row gives up its share.
Repeated rows get the same rate and copies each.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnxml.llm.common import fresh_name, materialise, unit_hash

SAMPLE, TOLERANCE = 1500, 1e-3
#: No document is used more often.
MAX_RATE = 1.0
#: A marker is this many times likelier in its domain, in this share of its rows
#: and in so many of them; the best ones of a domain are used.
RATIO, SUPPORT, LEAST, MARKERS = 5.0, 0.02, 4, 256
#: Shares of different words are told apart in as many steps, over stretches of so many words.
STEPS, STRETCH = 8, 256
#: Levels of a marker count over its expected one: two to a factor of 2, up to the greatest there is.
#: A level counts for this share of a row at its neighbours, which few short texts may reach.
LEVELS, BLUR = int(2 * math.log2(2 * MARKERS + 1)) + 1, 0.02
#: Classes of different words to a factor of e, and the greatest power of them a mean may grow with.
CLASSES, STEEP = 8, 2.0
SPACES, SIGNS = "[ \\t-\\r]+", "[ \\t-\\r.,;:!?|#$%&*()\"<>]+"
#: Shares of expected tokens by domain of the labels table, and its columns.
TARGETS = {"quality=1,toxic=0": 0.96, "quality=1,toxic=1": 0.02, "quality=0,toxic=0": 0.02}
LABELS = ["quality", "toxic"]
#: Domains that nothing is dropped for: little junk must not shrink the corpus.
UPPER = frozenset(("quality=1,toxic=1", "quality=0,toxic=0"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def evidence(text: Column, words_: Column) -> Column:
    """The different words in lower case without signs, and word ends (~ before
    the last two characters)."""
    ends = F.array_distinct(F.transform(words_, lambda w: F.right(w, F.lit(2))))
    return F.concat(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), SIGNS)), F.transform(ends, lambda e: F.concat(F.lit("~"), e)))


def domain(label_cols: list[str]) -> Column:
    """Name of a labelled row's domain, such as quality=1,toxic=0."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in label_cols])


@dataclass
class Curve:
    """Mean count exp(level + power x size) of texts of a size (a log)."""

    level: float
    power: float

    def mean(self, size: float) -> float:
        return math.exp(min(50.0, max(-50.0, self.level + self.power * size)))

    @classmethod
    def fit(cls, seen: Counter) -> Curve:
        """From {(size, count): rows}, by Newton steps of Poisson regression
        that holds to half a marker in all and to power 1 if rows are few."""
        events, rows = sum(k * n for (_, k), n in seen.items()), sum(seen.values())
        out = cls(math.log((events + 0.5) / (rows + 1)), 1.0)
        for _ in range(50):
            means = [(x, k, n, out.mean(x)) for (x, k), n in seen.items()]
            push = [0.5 + sum(n * (k - m) for _, k, n, m in means) - out.mean(0.0), sum(n * (k - m) * x for x, k, n, m in means) - 4 * (out.power - 1)]
            across = sum(n * m * x for x, _, n, m in means)
            step = solve([[sum(n * m for *_, n, m in means) + out.mean(0.0), across], [across, sum(n * m * x * x for x, _, n, m in means) + 4]], push, 0.0)
            long = max(1.0, *map(abs, step))
            out.level, out.power = out.level + step[0] / long, min(STEEP, max(-STEEP, out.power + step[1] / long))
        return out


@dataclass
class Model:
    """Bounded by domains x ``MARKERS``."""

    names: list[str]
    markers: list[list[str]]
    priors: list[float]
    curves: list[Curve]  # expected count of each domain's markers in other domains' texts
    centre: float  # mean size, from which the curves count
    chances: list[list[list[float]]]  # log chance of each value, by feature and domain

    def hits(self, e: Column) -> Column:
        """The markers of any domain in the evidence."""
        return F.array_intersect(e, _held(sorted({w for m in self.markers for w in m})))

    def counts(self, hits: Column) -> list[Column]:
        return [F.size(F.array_intersect(_held(m), hits)) for m in self.markers]

    def features(self, size: Column, hits: Column, words_: Column) -> list[Column]:
        x = size - F.lit(self.centre)
        return [*[level(k, F.exp(F.lit(c.level) + F.lit(c.power) * x)) for k, c in zip(self.counts(hits), self.curves)], variety(words_)]


def _held(markers: list[str]) -> Column:
    return F.split(F.lit(" ".join(markers)), " ") if markers else F.array().cast("array<string>")  # a word holds no space


def level(count: Column, mean: Column) -> Column:
    """How far a count is over its expected one; half the root allows for chance."""
    over = F.log2((count + F.lit(0.5)) / (mean + F.sqrt(mean) / 2 + F.lit(0.5)))
    return F.least(F.greatest(F.floor(2 * over), F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def size_of(e: Column) -> Column:
    """Log of the number of different words and word ends."""
    return F.log(F.greatest(F.size(e), F.lit(1)).cast("double"))


def variety(words_: Column) -> Column:
    n = F.size(words_)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / STRETCH).cast("int"))
    different = F.aggregate(starts, F.lit(0), lambda acc, i: acc + F.size(F.array_distinct(F.slice(words_, i * STRETCH + 1, STRETCH))))
    return F.floor(different * (STEPS - 1) / F.greatest(n, F.lit(1))).cast("int")


def fit_classifier(docs: DataFrame, labels: DataFrame, label_cols: list[str], id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = labels.where(F.col(id_col).isNotNull()).dropna(subset=label_cols).select(F.col(id_col).alias("id"), domain(label_cols).alias("domain")).distinct()
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(sorted(sizes), [], [], [], 0.0, [])
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("domain") == name, min(1.0, SAMPLE / n)).otherwise(share)
    chosen = known.where(unit_hash("id", seed=13) < share)  # bounded: may be broadcast
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    half = F.when(unit_hash("id", seed=29) < 0.5, 0).otherwise(1)
    src = text.select("domain", half.alias("half"), words(F.col("text")).alias("w"), "text").select("domain", "half", "w", evidence(F.col("text"), F.col("w")).alias("e"))
    src = materialise(src, "labelled")
    drawn = {(r["half"], r["domain"]): r["n"] for r in src.groupBy("half", "domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    model.names = [d for d in model.names if any((h, d) in drawn for h in (0, 1))]
    per_word = src.where("half = 0").select("domain", F.explode("e").alias("word")).where("word <> ''").groupBy("word").agg(
        F.count(F.lit(1)).alias("all"), *[F.sum((F.col("domain") == d).cast("int")).alias(f"n{i}") for i, d in enumerate(model.names)])
    per_word = materialise(per_word, "words") if model.names else per_word
    total = sum(n for (h, _), n in drawn.items() if h == 0)
    for i, d in enumerate(model.names):
        own = drawn.get((0, d), 0)
        lift = ((F.col(f"n{i}") + 0.5) / (own + 1)) / ((F.col("all") - F.col(f"n{i}") + 0.5) / (total - own + 1))
        best = per_word.where((F.col(f"n{i}") >= max(LEAST, SUPPORT * own)) & (lift >= RATIO)).orderBy((F.col(f"n{i}") * F.log(lift)).desc(), "word").limit(MARKERS)
        model.markers.append([r["word"] for r in best.select("word").collect()])
    model.priors = [math.log(sizes[d] / sum(sizes[x] for x in model.names)) for d in model.names]
    rest = src.where("half = 1")
    size = F.round(size_of(F.col("e")) * CLASSES).cast("int")
    counts = F.array(*model.counts(model.hits(F.col("e")))).cast("array<int>")
    found = rest.select("domain", size.alias("size"), F.posexplode(counts).alias("k", "v")).groupBy("domain", "size", "k", "v").agg(F.count(F.lit(1)).alias("n")).collect()
    model.centre = sum(r["size"] / CLASSES * r["n"] for r in found) / max(1, sum(r["n"] for r in found))
    for i, d in enumerate(model.names):
        others = Counter()
        for r in found:
            if r["k"] == i and r["domain"] != d:
                others[r["size"] / CLASSES - model.centre, r["v"]] += r["n"]
        model.curves.append(Curve.fit(others))
    features = model.features(size_of(F.col("e")), model.hits(F.col("e")), F.col("w"))
    table = rest.select("domain", F.posexplode(F.array(*features)).alias("k", "v")).groupBy("domain", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    seen = {(r["domain"], r["k"], r["v"]): r["n"] for r in table.collect()}
    for k in range(len(features)):
        values, blur = (LEVELS, BLUR) if k < len(features) - 1 else (STEPS, 0.0)
        rows = lambda d, v: seen.get((d, k, v), 0) + blur * (seen.get((d, k, v - 1), 0) + seen.get((d, k, v + 1), 0)) + 0.25
        model.chances.append([[math.log(rows(d, v) / (drawn.get((1, d), 0) * (1 + 2 * blur) + 0.25 * values)) for v in range(values)] for d in model.names])
    return model


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def with_posteriors(docs: DataFrame, model: Model, text_col: str, tokens: str, posterior: str) -> DataFrame:
    """Adds the number of words and the array of posteriors (in the order of
    the model's domains)."""
    text, table = F.col(text_col), [[F.array(*map(F.lit, row)) for row in feature] for feature in model.chances]

    def logits(f: Column) -> Column:
        return F.array(*[sum((F.get(rows[i], f[k]) for k, rows in enumerate(table)), F.lit(prior)) for i, prior in enumerate(model.priors)]).cast("array<double>")

    def softmax(z: Column) -> Column:
        return _let(F.transform(z, lambda v: F.exp(v - F.array_max(z))), lambda x: _let(
            F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.transform(x, lambda v: v / total)))

    def scored(w: Column) -> Column:
        p = _let(evidence(text, w), lambda e: _let(F.struct(size_of(e).alias("size"), model.hits(e).alias("hits")), lambda m: _let(
            F.array(*model.features(m["size"], m["hits"], w)), lambda f: _let(logits(f), softmax))))
        return F.struct(F.size(w).cast("bigint").alias("n"), p.alias("p"))

    both = fresh_name(docs, "scored")
    out = docs.withColumn(both, _let(words(text), scored))
    return out.withColumn(tokens, F.col(f"{both}.n")).withColumn(posterior, F.col(f"{both}.p")).drop(both)


def rate_of(posterior: list[str], moves: list[list[float]]) -> Column:
    """A document's rate after the given steps: each moves against the
    gradient, then back into 0 to ``MAX_RATE``. ``posterior``: SQL of each. The
    steps are one literal, so the plan is the same however many there are."""
    steps = F.from_json(F.lit(json.dumps(moves)), "array<array<double>>")

    def step(rate: Column, push: Column) -> Column:
        down = sum((push[i] * F.expr(p) for i, p in enumerate(posterior)), F.lit(0.0))
        return F.least(F.lit(MAX_RATE), F.greatest(F.lit(0.0), rate - down))
    return F.aggregate(steps, F.lit(1.0), step)


def fit_rates(narrow: DataFrame, names: list[str], weights: dict[str, float], upper: frozenset[str] = UPPER) -> tuple[list[list[float]], dict[str, tuple[float, float]]]:
    """(steps, {domain: (expected total, target)}) for a table of tokens and
    posterior. The squared gaps are weighted by the inverse of the matrix of
    sum(tokens x posterior_i x posterior_j), for which a step of length 1 is
    the longest that always descends. A document's gradient, per token, depends
    on its posterior alone, so a step is one number per domain."""
    d = len(names)
    if not d:
        return [], {}
    narrow = materialise(narrow.groupBy("posterior").agg(F.sum("tokens").alias("tokens")).select("tokens", *[F.col("posterior")[i].alias(f"p{i}") for i in range(d)]), "classes")
    posterior = [f"p{i}" for i in range(d)]

    def sums(rate: Column, cells: list[str]) -> list[float]:
        rated = narrow.withColumn("amount", F.col("tokens") * rate)
        return [float(v or 0.0) for v in rated.agg(*[F.expr(f"sum(amount * {c})") for c in cells]).first()]

    have = sums(F.lit(1.0), [*posterior, *(f"{p} * {q}" for p in posterior for q in posterior)])
    have, flat = have[:d], have[d:]
    curve, whole = [flat[i * d:i * d + d] for i in range(d)], sum(have)
    want = [max(0.0, weights.get(n, 0.0)) if h > 0 else 0.0 for n, h in zip(names, have)]
    if not sum(want):
        return [], {n: (h, h) for n, h in zip(names, have)}
    reach = {n: h * sum(want) / w for n, h, w in zip(names, have, want) if w > 0}
    budget = min([b for n, b in reach.items() if n not in upper] or reach.values())
    target = [min(h, budget * w / sum(want)) for h, w in zip(have, want)]
    moves: list[list[float]] = []
    now, loss = have, math.inf
    while True:
        gap = [s - t for s, t in zip(now, target)]
        push = solve(curve, gap, 1e-6 * whole)
        before, loss = loss, sum(g * x for g, x in zip(gap, push)) / whole
        if loss <= TOLERANCE ** 2 or moves and before - loss <= TOLERANCE * before:
            return moves, dict(zip(names, zip(now, target)))
        moves.append(push)
        now = sums(rate_of(posterior, moves), posterior)


def solve(matrix: list[list[float]], right: list[float], ridge: float) -> list[float]:
    """x with (matrix + ridge) x = right, for a small symmetric matrix."""
    n = len(right)
    rows = [[v + ridge * (i == j) for j, v in enumerate(row)] + [right[i]] for i, row in enumerate(matrix)]
    for i in range(n):
        top = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for r in range(n):
            if r != i and rows[i][i]:
                f = rows[r][i] / rows[i][i]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[i])]
    return [rows[i][n] / rows[i][i] if rows[i][i] else 0.0 for i in range(n)]


def copies(rate: Column, *key: Column | str) -> Column:
    return F.floor(rate + unit_hash(*key, seed=17)).cast("int")


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, label_cols: list[str] | None = None,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, posterior of each domain (a map),
    rate, copies."""
    model = fit_classifier(docs, labels, label_cols or LABELS, id_col, text_col)
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    narrow = materialise(with_posteriors(src, model, "text", "tokens", "posterior").select("id", "h", "tokens", "posterior"), "posteriors")
    moves, _ = fit_rates(narrow, model.names, weights or TARGETS)
    rated = narrow.withColumn("rate", rate_of([f"posterior[{i}]" for i in range(len(model.names))], moves))
    names = F.array(*map(F.lit, model.names)).cast("array<string>")
    return rated.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), F.map_from_arrays(names, F.col("posterior")).alias("posterior"),
                        "rate", copies(F.col("rate"), "id", "h").alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, label_cols: list[str] | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as often as the mixture has them, with their columns."""
    model = fit_classifier(docs, labels, label_cols or LABELS, id_col, text_col)
    t, p, c = (fresh_name(docs, n) for n in ("mix_tokens", "mix_posterior", "mix_copies"))
    scored = materialise(with_posteriors(docs, model, text_col, t, p), "mixed")
    moves, _ = fit_rates(scored.select(F.col(t).alias("tokens"), F.col(p).alias("posterior")), model.names, weights or TARGETS)
    rate = rate_of([f"`{p}`[{i}]" for i in range(len(model.names))], moves)
    return scored.withColumn(c, F.explode(F.array_repeat(F.lit(1), copies(rate, F.col(id_col), F.xxhash64(F.col(text_col)))))).select(*docs.columns)
