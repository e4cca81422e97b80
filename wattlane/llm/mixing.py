"""Mixing documents to target domain weights (operator 1, DataFrame functions only).

Domains follow the labels: ``clean`` (quality 1, not toxic), ``low`` (quality 0,
not toxic), ``toxic``.  Membership is soft.

Method.
1. A multinomial logistic regression over hashed word beginnings and endings (Spark ML, on at most
   ``MAX_TRAIN_ROWS`` labelled documents picked by a hash of doc_id, a documented
   bound) gives every document its posterior p over the domains.  Each distinct
   word is hashed once; the margins are sums over a literal array of coefficients.
2. Each document gets a rate r >= 0, the number of times it is wanted.  The
   expected tokens of domain k are sum_d r_d n_d p_dk.  The rates minimise the
   plain least squares distance of these totals from the targets by projected
   gradient:

       r_d <- max(0, r_d - step * p_d . (totals - targets))

   with the largest safe step, 1 / (largest eigenvalue of sum_d n_d p_d p_d').
   A domain with hardly any tokens thus weighs hardly anything; an inverse of
   that matrix as the measure would let a hundred stray tokens steer every rate.
   The descent goes from coarse to fine: one aggregate sums the documents in the
   cells of a grid over the posteriors (``GRID``, at most 2,145 cells, whatever
   the corpus); the descent on the cells is settled there; from its rates the
   rounds go on over the documents, one aggregate of a handful of sums each,
   until the totals settle.  The driver sees only the cells and those sums.
   A row's rate is an expression of its posterior and of the rounds' small
   vectors; every ``FOLD`` rounds the table is written anew with the rates so far.
   Targets that cannot be met end nearest to them; no number of rounds fails.
3. Rates become whole copies: floor(r), and one more if a hash of doc_id falls
   under the fraction, so that the expected totals hold.

Edge cases: null and empty texts have no tokens, weigh nothing and keep rate 1;
labels that are null or contradict each other count with their worst; without
labels of at least two domains every document is ``clean`` with posterior 1;
targets that no rates can meet give the nearest totals; repeated rows get equal
rates; an empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import cut, own_columns

DOMAINS = ("clean", "low", "toxic")
MAX_TRAIN_ROWS = 10_000
WORD_SLOTS = 1 << 14
STEM = 4
#: Cells of the coarse descent for each unit of a posterior, and its rounds.
GRID, COARSE_ROUNDS = 64, 100_000
#: The rounds over the documents end when no total changes by more than TOLERANCE of the largest target, or after MAX_ROUNDS.
MAX_ROUNDS, TOLERANCE = 50, 1e-5
#: Rounds after which the rates so far are written, so that a round applies few steps.
FOLD = 10
#: Helper columns; long, so that no column of a caller's table clashes.
P = [f"mixing_p_{d}" for d in DOMAINS]
N, RATE, COPIES = "mixing_n_tokens", "mixing_rate", "mixing_copies"


SPACE = " \t\n\v\f\r"


def words(text: Column) -> Column:
    """The words of a text that is not blank; a blank one gives one empty word."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), "[\\x20\\x09-\\x0D]+")


def slots(kinds: Column, size: Column) -> Column:
    """What the classifier sees, as distinct numbers under ``WORD_SLOTS``: first letters and last character of each kind of word
    (as written, so capitals count), and how often words repeat in a text of this size."""

    def slot(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(WORD_SLOTS)).cast("int")

    stems = F.transform(kinds, lambda w: slot(F.left(w, F.lit(STEM))))
    tails = F.transform(kinds, lambda w: slot(F.right(w, F.lit(1)), F.lit(1)))
    variety = slot(F.floor(F.log2(size + 1)), F.floor(F.size(kinds) * 10 / F.greatest(size, F.lit(1))), F.lit(2))
    return F.array_distinct(F.concat(stems, tails, F.array(variety)))


def with_slots(docs: DataFrame, *carried: Column) -> DataFrame:
    """The carried columns with the token count and the slots of each text; step by step, so that nothing is worked out twice."""
    found = docs.select(*carried, words(F.col("text")).alias("mixing_words"))
    found = found.withColumns({N: F.when(F.get("mixing_words", F.lit(0)) == "", 0).otherwise(F.size("mixing_words")).cast("long"),
                               "mixing_kinds": F.array_distinct("mixing_words")})
    return found.withColumn("mixing_slots", slots(F.col("mixing_kinds"), F.col(N))).drop("mixing_words", "mixing_kinds")


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, mixing_label): the worst label of each document, as the place in DOMAINS."""
    return (labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
            .agg(F.expr("cast(case when max(coalesce(toxic, 0)) = 1 then 2 when min(coalesce(quality, 1)) = 0 then 1 else 0 end as double)").alias("mixing_label")))


def _literal(values: np.ndarray) -> Column:
    """A constant array; as text, since a call for each element would take longer than the fit."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def with_posteriors(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``docs`` with the token count and one posterior column for each domain."""
    picked = domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)  # bounded: broadcast
    train = with_slots(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), F.col("mixing_label"))
    names = [str(k) for k in range(WORD_SLOTS)]
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="mixing_names", outputCol="mixing_x")
    train = cut(vectors.setBinary(True).transform(train.withColumn("mixing_names", F.col("mixing_slots").cast("array<string>"))).select("mixing_label", "mixing_x"),
                "mixing-train")
    kinds = sorted(r[0] for r in train.select("mixing_label").distinct().collect())  # three at most
    if len(kinds) < 2:
        size = F.when(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE)) == "", 0).otherwise(F.size(words(F.col("text")))).cast("long")
        return docs.select(*own_columns(docs), size.alias(N), *[F.lit(1.0 if k == 0 else 0.0).alias(c) for k, c in enumerate(P)])
    model = LogisticRegression(featuresCol="mixing_x", labelCol="mixing_label", family="multinomial", maxIter=30, regParam=1e-4, standardization=False).fit(train)
    weights, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()  # bounded: three rows of WORD_SLOTS
    out = with_slots(docs, *own_columns(docs))

    def margin(k: int) -> Column:
        # against the first class, whose margin is then 0
        w = _literal(weights[k] - weights[0])
        return F.aggregate("mixing_slots", F.lit(float(intercept[k] - intercept[0])), lambda a, s: a + F.get(w, s))

    out = out.withColumns({f"mixing_z{k}": margin(k) for k in range(1, len(intercept))}).drop("mixing_slots")
    top = F.greatest(F.lit(0.0), *[F.col(f"mixing_z{k}") for k in range(1, len(intercept))]) if len(intercept) > 1 else F.lit(0.0)
    scale = {k: F.exp((F.col(f"mixing_z{k}") if k else F.lit(0.0)) - top) for k in range(len(intercept))}
    out = out.withColumns({f"mixing_e{k}": e for k, e in scale.items()})
    total = sum((F.col(f"mixing_e{k}") for k in scale), F.lit(0.0))
    return out.select(*own_columns(docs), N, *[(F.col(f"mixing_e{k}") / total if k in scale else F.lit(0.0)).alias(c) for k, c in enumerate(P)])


def cell_of() -> Column:
    """The grid cell of a row's posterior: the last two posteriors fix the first."""
    a, b = (F.round(F.col(p) * GRID).cast("int") for p in P[1:])
    return F.least(F.lit(GRID), F.greatest(F.lit(0), a)) * (GRID + 1) + F.least(F.lit(GRID), F.greatest(F.lit(0), b))


def coarse_rates(cells: np.ndarray, goal: np.ndarray, max_rate: float | None) -> np.ndarray:
    """Rates of the cells (tokens, tokens of each domain) by the same descent, settled."""
    n, sums = cells[:, 0], cells[:, 1:]
    p = sums / n[:, None]
    step = 1 / max(np.linalg.eigvalsh(sums.T @ p)[-1], 1e-300)
    r = np.ones(len(n))
    for _ in range(COARSE_ROUNDS):
        after = np.clip(r - step * (p @ (r @ sums - goal)), 0, max_rate)
        moved = np.abs((after - r) @ sums).max()
        r = after
        if moved <= 1e-12 * max(1.0, np.abs(goal).max()):
            break
    return r


def fit_rates(members: DataFrame, targets: dict[str, float], max_rate: float | None = None) -> tuple[Column, np.ndarray]:
    """The rate as an expression over the columns of ``members``, and the totals it reaches.

    ``targets``: wanted tokens of each domain. ``max_rate`` bounds the rates from above, too (1: no document is repeated).
    """
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS])
    cells = members.where(F.col(N) > 0).groupBy(cell_of().alias("cell")).agg(F.sum(F.col(N).cast("double")), *[F.sum(F.col(N) * F.col(p)) for p in P]).collect()
    if not cells:
        return F.lit(1.0), np.zeros(len(P))
    found = np.array(cells, np.float64)
    start = np.ones((GRID + 1) ** 2)
    start[found[:, 0].astype(int)] = coarse_rates(found[:, 1:], goal, max_rate)
    first = F.get(_literal(start), cell_of())
    gram = members.agg(*[F.sum(F.col(N) * F.col(a) * F.col(b)) for a in P for b in P]).first()
    step = 1 / max(np.linalg.eigvalsh(np.array(gram, np.float64).reshape(len(P), len(P)))[-1], 1e-300)
    steps: list[np.ndarray] = []
    before = None

    def after(rate: Column, steps: list[np.ndarray]) -> Column:
        # the steps are data, not code: every round runs the same compiled plan
        if not steps:
            return rate

        def descend(r: Column, g: Column) -> Column:
            r = F.greatest(F.lit(0.0), r - sum((F.col(p) * F.get(g, F.lit(k)) for k, p in enumerate(P)), F.lit(0.0)))
            return r if max_rate is None else F.least(F.lit(float(max_rate)), r)

        return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps]), rate, descend)

    rows, folded = members.select(N, *P, first.alias(RATE)), 0
    for _ in range(MAX_ROUNDS):
        rate = after(F.col(RATE), steps[folded:])
        totals = np.array(rows.agg(*[F.sum(rate * F.col(N) * F.col(p)) for p in P]).first(), np.float64)
        if before is not None and np.abs(totals - before).max() <= TOLERANCE * max(1.0, np.abs(goal).max()):
            break
        before = totals
        steps.append(step * (totals - goal))
        if len(steps) - folded == FOLD:
            rows, folded = cut(rows.select(N, *P, after(F.col(RATE), steps[folded:]).alias(RATE)), "mixing-rates"), len(steps)
    return F.when(F.col(N) > 0, after(first, steps)).otherwise(F.lit(1.0)), totals


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Whole copies: the fraction is drawn by a hash of doc_id, so a rerun draws the same."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate + F.lit(1e-9)) + (draw < F.pmod(rate + F.lit(1e-9), F.lit(1.0))).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, max_rate: float | None = None,
        carry: bool = True) -> DataFrame:
    """``docs`` with token count, posteriors, rate and copies.

    ``weights``: share of each domain in a mix of ``budget`` tokens (by default as many as there are). ``carry=False`` drops
    the other columns of ``docs`` early, but for doc_id.
    """
    members = with_posteriors(docs, labels)
    members = cut(members if carry else members.select("doc_id", N, *P), "mixing")
    total = float(members.agg(F.coalesce(F.sum(N), F.lit(0))).first()[0]) if budget is None else budget
    rate, _ = fit_rates(members, {d: w * total for d, w in weights.items()}, max_rate)
    out = members.withColumn(RATE, rate)
    return out.withColumn(COPIES, copies_of(F.col(RATE), F.col("doc_id")))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, max_rate: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    out = mix(docs, labels, weights, budget, max_rate).where(F.col(COPIES) > 0)
    if max_rate is not None and max_rate <= 1:
        return out.select(*own_columns(docs))
    return out.withColumn("mixing_copy", F.explode(F.sequence(F.lit(1), F.col(COPIES).cast("int")))).select(*own_columns(docs))
