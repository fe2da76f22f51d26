"""Operator 2, mixing sources to target weights by soft membership (native: DataFrame functions only).

1. A labelled table trains a naive Bayes classifier over the presence of words and word endings and the share
   of distinct words (repetitive texts have no junk words of their own): at most
   ``most_rows`` labelled texts (that bound is the parameter; rows drawn by a hash of the id, equal texts
   counted once) are counted per (feature, domain) by a two-phase aggregate. Features are kept by a
   likelihood-ratio test of their document counts (``least_g``), ``most_features`` a domain at most: a word
   of a language that few texts are in needs a handful of texts, not a share of all of them. Found features
   add their log odds; of absent ones, which go together by language and kind of junk, only the absence
   of all counts, by the texts that it was seen in. The odds that texts with features start from are set
   so that the posteriors of the labelled texts sum to the domains' counts.
2. Every text gets its domain posteriors in one expression over its words; nothing is exploded.
3. Nonnegative rates r_i, one per document and at most ``most_copies`` (one: nothing is repeated), are fitted to

       min  1/2 sum_k x_k^2 / s_k  +  ridge / 2 sum_i w_i (r_i - 1)^2 ,  0 <= r_i <= most_copies

   where w_i = n_i / T is the document's share of all T tokens, p_ik its posterior, E_k = sum_i w_i p_ik r_i the
   expected tokens of a domain, s_k its target weight, and x_k = E_k - s_k sum_j E_j how far the domain is
   from that weight of all that stays (with a ``budget``: x_k = E_k - budget s_k). Accelerated projected gradient
   in the metric of the w_i: a step needs the K expected domain totals only, one distributed sum. Between
   written states (every ``fold`` steps) a document's rate is re-derived from its posteriors by folding over
   the few gradients since, K + 2 numbers each. It stops when every domain is within ``tolerance`` of its
   target, as a share of it.
4. A document is drawn by a hash of its id and text against its rate. What chance then leaves between drawn
   and target totals is taken out by K offsets c, the rate used being r_i + sum_k c_k p_ik within its bounds: a few
   Newton steps, one distributed sum each.

Targets are weights. A domain after the first that has less than its target keeps what it has, and the others
share the rest in their proportions (``scarce`` "keep"), and documents of the first domain by a posterior of ``clean`` have a
rate of one at least: they aren't thinned out because another domain is rare or can't be told apart. The fit knows
that bound and takes from the others. With ``scarce`` "thin" the weights are met as they are stated, whatever has to go for it.

Domains here are the label classes: good (quality 1, not toxic), poor (quality 0, not toxic), toxic.
Edge cases: null or blank texts have the prior as posteriors and no tokens; null ids and repeated rows are
scored each (rows with equal id and text share their draw); labels with nulls or without a text are ignored;
without usable labels posteriors are the uniform prior and no row goes; an empty table gives an empty result;
``resample`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, checkpointed, free_names

DOMAINS = ("good", "poor", "toxic")


@dataclass(frozen=True)
class MixConfig:
    targets: tuple[float, ...] = (0.96, 0.03, 0.01)  # token weights of DOMAINS after mixing
    budget: float | None = None  # tokens after mixing, as a multiple of the tokens before; None: as many as the weights leave
    scarce: str = "keep"  # or "thin": see above
    most_copies: float = 1.0
    clean: float = 0.9  # posterior of the first domain from which a document stays
    most_rows: int = 20_000
    most_features: int = 1000  # per domain, the most significant ones
    least_g: float = 15.1  # least G statistic of a feature (chance 1e-4, one degree of freedom)
    ridge: float = 0.001
    steps: int = 60
    fold: int = 10
    tolerance: float = 0.002
    draw_steps: int = 10
    seed: int = 11


#: Deleted from words before comparison (fixed values).
PUNCTUATION = ".,;:?"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """White-space separated words with A-Z in lower case and without PUNCTUATION, and empty strings between.

    One translation does all three, so a text is walked once before the split.
    """
    spaces = " " * len(SPACE_CHARS)
    return F.split(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS + _UPPER + PUNCTUATION, spaces + _LOWER), " ")


def features(found: Column, known=None) -> Column:
    """Distinct words, their last three characters after a blank (which no word holds), and after two the tenth
    in which the share of distinct words lies; of ``known`` alone, if given."""
    endings = F.transform(found, lambda w: F.substring(w, -3, 3))
    distinct = F.array_distinct(found)
    tenth = F.concat(F.lit("  distinct "), F.floor(10 * F.size(distinct) / F.greatest(F.size(found), F.lit(1))).cast("string"))
    variety = F.array(tenth)
    if known is not None:
        none = F.array().cast("array<string>")
        only = lambda of, names: F.filter(of, lambda w: w.isin(names)) if names else none
        distinct = only(distinct, [w for w in known if w[0] != " "])
        endings = only(endings, [w[1:] for w in known if w[0] == " " and w[1] != " "])
        tenths = [w for w in known if w[:2] == "  "]
        variety = F.when(tenth.isin(tenths), variety).otherwise(none) if tenths else none
    return F.concat(distinct, F.transform(F.array_distinct(endings), lambda w: F.concat(F.lit(" "), w)), F.when(F.size(found) > 0, variety).otherwise(F.array().cast("array<string>")))


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def _g_statistic(n: Column, size: int, n0: Column, size0: int) -> Column:
    """G of the 2 x 2 table: texts of a domain and of domain 0, with a feature and without."""
    whole = float(max(1, size + size0))
    having = n + n0
    term = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * whole / (row * column))).otherwise(0.0)
    lacking = F.lit(whole) - having
    return 2.0 * (term(n, float(size), having) + term(n0, float(size0), having) + term(F.lit(size) - n, float(size), lacking) + term(F.lit(size0) - n0, float(size0), lacking))


@dataclass(frozen=True)
class Model:
    """Log odds of domains 1.. against domain 0: of a text with features, added per feature, and of one without any."""

    base: tuple[float, ...]
    added: dict[str, tuple[float, ...]]
    none: tuple[float, ...]


def train(docs: DataFrame, labels: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    marked = labels.select(F.col(id_col).cast("long").alias("l_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("l_id IS NOT NULL AND domain IS NOT NULL").distinct()
    sample = checkpointed(marked.orderBy(F.xxhash64("l_id", F.lit(cfg.seed)), "l_id", "domain").limit(cfg.most_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))  # most_rows rows at most
    once = texts.groupBy("domain", F.xxhash64("text").alias("digest")).agg(F.max("text").alias("text"))
    found = checkpointed(once.select("domain", features(F.array_remove(words(F.col("text")), "")).alias("found")))
    k = len(DOMAINS)
    sizes = [0] * k
    for r in found.groupBy("domain").agg(F.count("*").alias("n")).collect():
        sizes[r.domain] = r.n
    cells = found.select("domain", F.explode("found").alias("feature")).groupBy("feature").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{d}") for d in range(k)])
    rate = lambda d: F.col(f"n{d}") / float(max(1, sizes[d]))
    picked: dict[str, tuple[int, ...]] = {}
    for d in range(1, k):
        g = _g_statistic(F.col(f"n{d}"), sizes[d], F.col("n0"), sizes[0])
        top = cells.where(rate(d) >= 4 * rate(0)).withColumn("g", g).where(F.col("g") >= cfg.least_g).orderBy(F.col("g").desc(), "feature").limit(cfg.most_features)
        picked |= {r["feature"]: tuple(r[f"n{j}"] for j in range(k)) for r in top.collect()}
    least = 0.5 / max(1, *sizes)  # the same for all domains: a feature unseen in two of them tells nothing between these
    p = {w: [n[d] / max(1, sizes[d]) + least for d in range(k)] for w, n in picked.items()}
    base = [math.log((sizes[d] + 1.0) / (sizes[0] + 1.0)) for d in range(1, k)]
    if not picked:
        return Model(tuple(base), {}, tuple(base))
    added = {w: tuple(math.log(q[d] / q[0]) for d in range(1, k)) for w, q in sorted(p.items())}
    hits = found.select("domain", F.filter("found", lambda w: w.isin(list(added))).alias("__h"))
    scored = hits.select("domain", F.size("__h").alias("n"), F.aggregate("__h", _odds([0.0] * (k - 1)), _adder(added)).alias("s")).collect()  # most_rows rows at most
    bare = [sum(r.domain == d and not r.n for r in scored) for d in range(k)]
    none = [math.log((bare[d] + 0.5) / (bare[0] + 0.5)) for d in range(1, k)]
    return Model(tuple(_start([r.domain for r in scored if r.n], [tuple(r.s) for r in scored if r.n], base)), added, tuple(none))


def _start(domains: list[int], scores: list[tuple[float, ...]], base: list[float]) -> list[float]:
    """Log odds to add to the scores, from ``base`` on, by which the domains' posteriors sum to their counts."""
    import numpy as np

    if not scores:
        return base
    full = np.column_stack([np.zeros(len(scores)), np.array(scores)])
    seen = np.bincount(domains, minlength=full.shape[1]) + 0.5
    at = np.array([0.0, *base])
    for _ in range(200):
        e = full + at
        e = np.exp(e - e.max(axis=1, keepdims=True))
        at += np.log(seen / ((e / e.sum(axis=1, keepdims=True)).sum(axis=0) + 0.5))
        at -= at[0]
    return [float(x) for x in at[1:]]


def _odds(values) -> Column:
    return F.struct(*[F.lit(x).alias(f"s{d}") for d, x in enumerate(values)])


def _adder(added: dict[str, tuple[float, ...]]):
    """acc, feature -> acc with the feature's log odds."""
    table = F.create_map(*[x for w, v in added.items() for x in (F.lit(w), _odds(v))]) if added else None
    return lambda acc, w: acc if table is None else F.struct(*[(acc[f"s{d}"] + table[w][f"s{d}"]).alias(f"s{d}") for d in range(len(DOMAINS) - 1)])


def with_posteriors(docs: DataFrame, model: Model, cfg: MixConfig, text_col: str = "text", names: tuple[str, str] = ("__n", "__p")) -> DataFrame:
    """``docs`` with two more columns: words (those of punctuation alone don't count), and the array of domain posteriors."""
    k = len(model.base)
    found, known = free_names([*docs.columns, *names], "__w", "__h")
    marked = docs.withColumn(found, F.array_remove(words(F.col(text_col)), "")).withColumn(names[0], F.size(found).cast("long"))

    def finish(acc: Column) -> Column:
        top = F.greatest(F.lit(0.0), *[acc[f"s{d}"] for d in range(k)])
        e = [F.exp(-top)] + [F.exp(acc[f"s{d}"] - top) for d in range(k)]
        return F.array(*[x / sum(e[1:], e[0]) for x in e])

    # one fold from the text's known words to its posteriors: nothing in it is evaluated per domain
    marked = marked.withColumn(known, features(F.col(found), list(model.added)))
    start = F.when(F.size(known) == 0, _odds(model.none)).otherwise(_odds(model.base))
    return marked.withColumn(names[1], F.aggregate(known, start, _adder(model.added), finish)).drop(found, known)


def _least(p: Column, cfg: MixConfig) -> Column:
    """The least rate of a document: one where clean documents are to stay."""
    if cfg.scarce == "thin" or cfg.budget is not None:
        return F.lit(0.0)
    return F.when(p[0] >= cfg.clean, 1.0).otherwise(0.0)


def _rate(steps: list[list[float]], r0: Column, y0: Column, a: Column, eta: float, cfg: MixConfig) -> Column:
    """(rate, look-ahead) after the given steps, each [gradient of domain 0.., their mean by targets, momentum], from a written state."""
    k = len(DOMAINS)
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def one(acc: Column, s: Column) -> Column:
        pull = sum((acc["a"][d] * s[d] for d in range(1, k)), acc["a"][0] * s[0]) - s[k] + cfg.ridge * (acc["y"] - 1.0)
        r = F.least(F.lit(float(cfg.most_copies)), F.greatest(_least(acc["a"], cfg), acc["y"] - eta * pull))
        return F.struct(r.alias("r"), (r + s[k + 1] * (r - acc["r"])).alias("y"), acc["a"].alias("a"))

    # the posteriors ride in the accumulator, so an expression behind them is evaluated once a row
    start = F.struct(r0.alias("r"), y0.alias("y"), a.alias("a"))
    return F.aggregate(listed, start, one) if steps else start


@dataclass(frozen=True)
class MixFit:
    """The fit as K + 2 numbers a step: any row's rate can be replayed from its own posteriors."""

    steps: tuple[tuple[float, ...], ...]
    eta: float
    weights: tuple[float, ...]  # target weights met, after the rule for scarce domains
    expected: tuple[float, ...]  # expected domain totals, as shares of all tokens before mixing
    drawn: tuple[float, ...] = ()  # totals of the drawn documents
    offsets: tuple[float, ...] = (0.0,) * len(DOMAINS)

    def rate(self, p: Column, cfg: MixConfig) -> Column:
        return _rate([list(s) for s in self.steps], F.lit(1.0), F.lit(1.0), p, self.eta, cfg)["r"]

    def copies(self, rate: Column, p: Column, draw: Column, cfg: MixConfig) -> Column:
        """How often a document with that draw is taken: its rate, moved by the offsets, rounded by chance."""
        moved = sum((p[d] * F.lit(float(c)) for d, c in enumerate(self.offsets)), rate)
        held = F.least(F.lit(float(cfg.most_copies)), F.greatest(_least(p, cfg), moved))
        return _once(held, lambda x: (F.floor(x) + (draw < x - F.floor(x)).cast("long")).cast("int"))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once: a lambda's variable, where a column would be written out at each place."""
    return F.transform(F.array(value), use)[0]


def weights_of(totals: list[float], cfg: MixConfig) -> list[float]:
    """Target weights, given the domain totals before mixing, by the rule for scarce domains."""
    whole = sum(cfg.targets)
    wanted = [t / whole for t in cfg.targets]
    if cfg.scarce == "thin" or cfg.budget is not None or not wanted[0]:
        return wanted
    scale = totals[0] / wanted[0]
    held = [totals[0], *(min(scale * w, t) for w, t in zip(wanted[1:], totals[1:], strict=True))]
    return [x / sum(held) for x in held] if sum(held) else wanted


def draw_key(id_col: Column, text: Column, cfg: MixConfig) -> Column:
    """A number in [0, 1) by id and text: the same in ``mix`` and ``resample``."""
    return F.pmod(F.xxhash64(id_col.cast("long"), text, F.lit(cfg.seed)), F.lit(1 << 30)) / float(1 << 30)


def _distance(totals: list[float], weights: list[float], cfg: MixConfig) -> tuple[list[float], float]:
    """(x_k, the greatest of |x_k| as a share of the domain's target)."""
    whole = cfg.budget if cfg.budget is not None else sum(totals)
    x = [t - w * whole for t, w in zip(totals, weights, strict=True)]
    if not whole:  # nothing is no mix of the wanted weights
        return x, float("inf")
    return x, max((abs(a) / (w * whole) for a, w in zip(x, weights, strict=True) if w * whole > 0), default=0.0)


def fit_rates(marks: DataFrame, cfg: MixConfig = MixConfig()) -> tuple[DataFrame, MixFit]:
    """``marks`` (with __n, __p and __u, the draw) with ``__rate``, and the fit.

    The step length comes from the K x K Gram matrix of the posteriors, one aggregate.
    """
    import numpy as np

    k = len(DOMAINS)
    state = checkpointed(marks.withColumn("__r", F.lit(1.0)).withColumn("__y", F.lit(1.0)))
    tokens = state.agg(F.sum("__n")).first()[0] or 0
    nothing = MixFit((), 0.0, (0.0,) * k, (0.0,) * k, (0.0,) * k)
    if not tokens:
        return state.withColumn("__rate", F.lit(1.0)).drop("__r", "__y"), nothing
    total = lambda c: F.sum(F.col("__n") * c) / float(tokens)
    p = [F.col("__p")[d] for d in range(k)]
    gram = state.agg(*[total(p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], *[total(p[i]).alias(f"t{i}") for i in range(k)]).first()
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    weights = weights_of([gram[f"t{i}"] for i in range(k)], cfg)
    scale = np.array([max(w, 1e-6) for w in weights])
    project = np.eye(k) - (np.outer(weights, np.ones(k)) if cfg.budget is None else 0.0)
    inner = project @ g @ project.T / np.sqrt(np.outer(scale, scale))
    eta = 1.0 / (float(np.linalg.eigvalsh(inner)[-1]) + cfg.ridge)
    steps: list[list[float]] = []
    history: list[tuple[float, ...]] = []
    theta, before, totals = 1.0, float("inf"), [0.0] * k
    for number in range(cfg.steps + 1):
        now = _rate(steps, F.col("__r"), F.col("__y"), F.col("__p"), eta, cfg)
        at = state.select("__n", "__p", now["y"].alias("y")).agg(*[total(p[i] * F.col("y")).alias(f"e{i}") for i in range(k)]).first()
        totals = [at[f"e{i}"] for i in range(k)]
        x, away = _distance(totals, weights, cfg)
        if away <= cfg.tolerance or number == cfg.steps:
            break
        if away > before:
            theta = 1.0  # restart the momentum
        following = (1.0 + math.sqrt(1.0 + 4.0 * theta * theta)) / 2.0
        pull = [a / float(c) for a, c in zip(x, scale, strict=True)]
        mean = sum(a * w for a, w in zip(pull, weights, strict=True)) if cfg.budget is None else 0.0
        steps.append([*pull, mean, (theta - 1.0) / following])
        history.append(tuple(steps[-1]))
        theta, before = following, away
        if len(steps) == cfg.fold:
            moved = _rate(steps, F.col("__r"), F.col("__y"), F.col("__p"), eta, cfg)
            state = checkpointed(state.withColumn("__s", moved).withColumn("__r", F.col("__s.r")).withColumn("__y", F.col("__s.y")).drop("__s"))
            steps = []
    last = _rate(steps, F.col("__r"), F.col("__y"), F.col("__p"), eta, cfg)
    done = checkpointed(state.withColumn("__rate", last["r"]).drop("__r", "__y"))
    expected = done.agg(*[total(p[i] * F.col("__rate")) for i in range(k)]).first()
    fit = MixFit(tuple(history), eta, tuple(weights), tuple(expected))
    return done, _drawn(done, fit, total, cfg)


def _drawn(done: DataFrame, fit: MixFit, total, cfg: MixConfig) -> MixFit:
    """The fit with the offsets that bring the drawn totals nearest to the targets."""
    from dataclasses import replace

    import numpy as np

    k = len(DOMAINS)
    best, nearest = fit, float("inf")
    for number in range(cfg.draw_steps):
        copies = fit.copies(F.col("__rate"), F.col("__p"), F.col("__u"), cfg)
        free = ((F.col("__rate") > _least(F.col("__p"), cfg)) & (F.col("__rate") < cfg.most_copies)).cast("int")
        rows = done.select("__n", "__p", copies.alias("copies"), free.alias("free"))
        p = [F.col("__p")[d] for d in range(k)]
        sums = rows.agg(*[total(p[i] * F.col("copies")).alias(f"e{i}") for i in range(k)], *[total(p[i] * p[j] * F.col("free")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        totals = [sums[f"e{i}"] for i in range(k)]
        x, away = _distance(totals, list(fit.weights), cfg)
        away = max(away, 0.95 - sum(totals) / max(sum(fit.expected), 1e-12))  # nor is a draw that loses many tokens the fit keeps
        if away < nearest:
            best, nearest = replace(fit, drawn=tuple(totals)), away
        if away <= cfg.tolerance:
            break
        g = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        project = np.eye(k) - (np.outer(fit.weights, np.ones(k)) if cfg.budget is None else 0.0)
        scale = np.array([max(w, 1e-6) for w in fit.weights])[:, None]
        step = np.linalg.lstsq(project @ g / scale, -np.array(x)[:, None] / scale, rcond=1e-6)[0][:, 0]
        step *= min(1.0, 0.25 / max(1e-12, float(np.abs(step).max())))  # few documents: many steps fit none
        step *= 1.0 if number < 3 else 0.5  # one long document may come and go with whole steps
        fit = replace(fit, offsets=tuple(float(a + b) for a, b in zip(fit.offsets, step, strict=True)))
    return best


def _slim(docs: DataFrame, id_col: str, text_col: str, cfg: MixConfig) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), draw_key(F.col(id_col), F.col(text_col), cfg).alias("__u"))


def mix(docs: DataFrame, labels: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_tokens, p_good, p_poor, p_toxic, rate, copies, kept."""
    marks = with_posteriors(_slim(docs, id_col, text_col, cfg), train(docs, labels, cfg, id_col, text_col), cfg).drop("text")
    fitted, fit = fit_rates(marks, cfg)
    copies = fit.copies(F.col("__rate"), F.col("__p"), F.col("__u"), cfg)
    return fitted.select("doc_id", F.col("__n").alias("n_tokens"), *[F.col("__p")[d].alias(f"p_{name}") for d, name in enumerate(DOMAINS)], F.col("__rate").alias("rate"), copies.alias("copies"), (copies > 0).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` after mixing, same columns: each row as often as its own rate and draw say (at most once by default).

    The fit's short list of steps gives any row's rate from its own posteriors, so rows are
    judged in the scan that keeps them, without a join.
    """
    model = train(docs, labels, cfg, id_col, text_col)
    _, fit = fit_rates(with_posteriors(_slim(docs, id_col, text_col, cfg).drop("doc_id"), model, cfg).drop("text"), cfg)
    n, p, often = free_names(docs.columns, "__n", "__p", "__copies")
    marked = with_posteriors(docs, model, cfg, text_col, (n, p))
    copies = _once(F.col(p), lambda x: fit.copies(fit.rate(x, cfg), x, draw_key(F.col(id_col), F.col(text_col), cfg), cfg))
    # a generator, not a filter: that would be pushed below the posteriors and evaluate them again for its condition
    names = [F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*names, F.explode(F.array_repeat(F.lit(True), copies)).alias(often)).select(*names)
