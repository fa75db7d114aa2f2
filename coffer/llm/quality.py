r"""Quality rules with robust multivariate outliers (operator 6, native).

``measured`` counts a few statistics of every whole text; the base rule rejects texts of fewer than ten words and
texts of which more than a fifth of the words stand in repeated five-word windows. The rest become vectors
(``FEATURES``: log length, log mean word length, symbols, repeated lines, repeated words, each on a scale that makes ordinary
prose roughly normal). For each language and source a minimum-covariance-determinant estimate gives centre and
scatter of the ordinary documents; a document whose squared Mahalanobis distance exceeds ``CUTOFF`` is rejected.

The estimate follows FAST-MCD with deterministic starts: two initial subsets (nearest to the coordinate-wise medians
by sum and by maximum of squared robust z-scores), concentration steps (estimate from the subset, keep
the ``H`` share with the smallest distances) until none lowers a determinant, the start with the smaller determinant, a consistency factor from the
median distance (at least 1: where floored features make the median distance small, it would shrink their floor and
reject ordinary documents), and one reweighting step. A step is one aggregation of sums and products by group, so a source that
holds a third of all rows is folded map-side like any other. Vectors are rounded to 1/256 and quantiles are taken of
rounded values: sums stay exact, ``percentile`` holds a bounded number of distinct values, and reruns agree.

Groups of fewer than ``MIN_GROUP`` documents are pooled by language, and languages of fewer over the rest; if even
that is too small, only the base rule decides.

Edge cases: null or empty text has no words and fails the base rule; null language or source is a value of its own;
repeated rows are judged alike and each counts; statistics that don't vary in a group get a least scatter
(``LEAST``), so they neither divide by zero nor reject small differences; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, load, materialize, text_of, words

FEATURES = ("x0", "x1", "x2", "x3", "x4")
#: Least standard deviation of each feature.
LEAST = (0.5, 0.1, 0.25, 0.25, 0.25)
H = 0.75
MIN_GROUP = 60
#: Squared distance beyond which a document is rejected: the 0.9999 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 25.7448
#: Medians of chi-square with 5 degrees of freedom, and its 0.975 quantile.
CHI_MEDIAN, CHI_975 = 4.3515, 12.8325
UNIT = 256.0
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``STATS``, ``n_lines`` and ``base_failed``; one pass, no shuffle.

    Repeated windows: the hash of each five-word window, with its position in the low bits, is sorted within the
    row; neighbours of equal hash are repeats, and the distances between their sorted positions give the words
    covered.
    """
    own = [c for c in docs.columns if c not in (*STATS, "n_lines", "base_failed")]
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE))
    a = docs.select(*own, words(text).alias("_w"), lines.alias("_l"),
                    F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    w, n = F.col("_w"), F.size("_w")
    a = a.select(*own, "n_symbols", "_w", n.cast("long").alias("n_words"),
                 F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
                 F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 F.expr("shiftleft(1L, CAST(ceil(log2(size(_w) + 1)) AS INT))").alias("_m"))
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
    packed = F.when(F.size(w) > 5, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(w) - 5),
        lambda i: window(i).bitwiseAND(-F.col("_m")).bitwiseOR(i.cast("long")))))
    a = a.select(*own, *STATS[:4], "n_lines", "_m", packed.alias("_s"))
    s, m = F.col("_s"), F.col("_m")
    same = lambda x, y: F.coalesce(x.bitwiseAND(-m) == y.bitwiseAND(-m), F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.when(i > 0, F.get(s, i - 1))))
    a = a.select(*own, *STATS[:4], "n_lines", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(m - 1))).alias("_p"))
    p = F.col("_p")
    cover = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(5).cast("long")))),
                        F.lit(0).cast("long"), lambda acc, x: acc + x)
    a = a.select(*own, *STATS[:4], "n_lines", F.coalesce(cover, F.lit(0).cast("long")).alias("n_repeat_words"))
    return a.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def _vector() -> list[Column]:
    """The features, as whole multiples of 1/UNIT."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = (F.log(n + 1.0),
           # mean word length, drawn towards five in short texts
           4 * F.log((F.col("word_chars") + 150) / (n + 30)),
           F.log(1 + 100.0 * F.col("n_symbols") / n),
           F.log(1 + 10.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
           F.log(1 + 10.0 * F.col("n_repeat_words") / n))
    return [F.round(x * UNIT).alias(f) for f, x in zip(FEATURES, raw)]


def _small_groups(rows: DataFrame, key: str, wider: Column) -> DataFrame:
    """``rows`` with ``key`` replaced by ``wider`` where its group is below MIN_GROUP."""
    few = rows.filter(~F.col("base_failed")).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= MIN_GROUP)
    r, f = rows.alias("r"), few.alias("f")
    return r.join(f, F.col(f"r.{key}") == F.col(f"f.{key}"), "left").select(
        *[F.col(f"r.{c}") for c in rows.columns if c != key],
        F.when(F.col("_n").isNotNull(), F.col(f"r.{key}")).otherwise(wider).alias(key))


def _estimate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Centre ``m*`` and Cholesky factor ``l*`` of the scatter of each group, from sums and products."""
    sums = [F.count("*").alias("_n")] + [F.sum(f).alias(f"_s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(f) * F.col(g)).alias(f"_s{i}{j}") for i, f in enumerate(FEATURES) for j, g in enumerate(FEATURES) if j <= i]
    e = rows.groupBy(*by).agg(*sums)
    product = lambda i, j: F.col(f"_s{i}{j}") / F.col("_n") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("_n") / F.col("_n")
    e = e.select(*by, "_n", *[(F.col(f"_s{i}") / F.col("_n")).alias(f"m{i}") for i in range(5)],
                 *[(F.greatest(product(i, j), F.lit((LEAST[i] * UNIT) ** 2)) if i == j else product(i, j)).alias(f"c{i}{j}")
                   for i in range(5) for j in range(i + 1)])
    for j in range(5):  # Cholesky, column by column
        e = e.withColumn(f"l{j}{j}", F.sqrt(F.greatest(
            F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0)), F.col(f"c{j}{j}") * 1e-6)))
        for i in range(j + 1, 5):
            e = e.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    det = sum((F.log(f"l{j}{j}") for j in range(5)), F.lit(0.0)).alias("logdet")
    return e.select(*by, *[f"m{i}" for i in range(5)], *[f"l{i}{j}" for i in range(5) for j in range(i + 1)], det)


def _distance(rows: DataFrame) -> DataFrame:
    """``rows`` (which hold features, centre and factor) with the squared distance ``d2``."""
    for j in range(5):
        rows = rows.withColumn(f"_y{j}", (F.col(FEATURES[j]) - F.col(f"m{j}") - sum((F.col(f"l{j}{k}") * F.col(f"_y{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    return rows.withColumn("d2", sum((F.col(f"_y{j}") ** 2 for j in range(5)), F.lit(0.0)))


def _nearest(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    """The ``share`` of each group's rows with the smallest ``d2`` (rounded to 1/64 of an octave)."""
    r = rows.withColumn("_q", F.round(F.log2(F.col("d2") + 1e-6) * 64))
    limit = r.groupBy(*by).agg(F.percentile("_q", F.lit(share)).alias("_limit"))
    return r.join(limit, by).filter(F.col("_q") <= F.col("_limit"))


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and scaled factor of each group ``gk`` of ``rows`` (``gk`` and the features)."""
    by = ["gk", "start"]
    centre = rows.groupBy("gk").agg(*[F.percentile(f, F.lit(0.5)).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    near = rows.join(centre, "gk")
    spread = near.groupBy("gk").agg(*[F.greatest(F.percentile(F.abs(F.col(f) - F.col(f"m{i}")), F.lit(0.5)) * 1.4826, F.lit(LEAST[i] * UNIT)).alias(f"v{i}")
                                      for i, f in enumerate(FEATURES)])
    z = [((F.col(f) - F.col(f"m{i}")) / F.col(f"v{i}")) ** 2 for i, f in enumerate(FEATURES)]
    seeds = near.join(spread, "gk").select("gk", *FEATURES, F.explode(F.array(
        F.struct(F.lit(0).alias("start"), sum(z[1:], z[0]).alias("d2")), F.struct(F.lit(1).alias("start"), F.greatest(*z).alias("d2")))).alias("_e"))
    seeds = seeds.select("gk", *FEATURES, "_e.start", "_e.d2")
    now = materialize(_estimate(_nearest(seeds, by, H), by), "mcd")
    # a step counts only if it lowers the determinant, so the search ends
    fell = F.coalesce(F.col("n.logdet") < F.col("o.logdet") - 1e-9, F.lit(False))
    moved = True
    while moved:
        step = _estimate(_nearest(_distance(rows.join(now, "gk")), by, H), by)
        both = now.alias("o").join(step.alias("n"), F.expr("o.gk = n.gk AND o.start = n.start"), "left")
        both = materialize(both.select("o.gk", "o.start", *[F.when(fell, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in now.columns if c not in by],
                                       fell.alias("_fell")), "mcd")
        now, moved = both.drop("_fell"), bool(both.filter("_fell").limit(1).count())
    best = now.groupBy("gk").agg(F.min_by(F.struct(*[c for c in now.columns if c not in by]), F.struct("logdet", "start")).alias("b")).select("gk", "b.*")
    scaled = _rescaled(rows, materialize(best, "mcd"))
    ordinary = _distance(rows.join(materialize(scaled, "mcd"), "gk")).filter(F.col("d2") <= CHI_975)
    return materialize(_rescaled(rows, materialize(_estimate(ordinary, ["gk"]), "mcd")).coalesce(1), "mcd")


def _rescaled(rows: DataFrame, now: DataFrame) -> DataFrame:
    """``now`` scaled so that the median distance is that of a normal sample."""
    d = _distance(rows.join(now, "gk")).withColumn("_q", F.round(F.log2(F.col("d2") + 1e-6) * 64))
    half = d.groupBy("gk").agg(F.percentile("_q", F.lit(0.5)).alias("_half"))
    factor = F.sqrt(F.greatest(F.pow(F.lit(2.0), F.col("_half") / 64) / CHI_MEDIAN, F.lit(1.0)))
    return now.join(half, "gk").select("gk", *[f"m{i}" for i in range(5)], *[(F.col(f"l{i}{j}") * factor).alias(f"l{i}{j}") for i in range(5) for j in range(i + 1)], "logdet")


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model by group, group of each language and source) from a written table of ``measured`` rows."""
    keyed = stats.select("lang", "source", "base_failed", *_vector(), F.to_json(F.struct("lang", "source")).alias("gk"))
    grouped = _small_groups(keyed, "gk", F.to_json(F.struct("lang")))
    grouped = materialize(_small_groups(grouped, "gk", F.lit("*")), "quality-vectors")
    model = estimates(grouped.filter(~F.col("base_failed")).select("gk", *FEATURES))
    groups = materialize(grouped.select("lang", "source", "gk").distinct().coalesce(1), "quality-groups")
    enough = grouped.filter(~F.col("base_failed")).groupBy("gk").agg(F.count("*").alias("_n")).filter(F.col("_n") >= MIN_GROUP).select("gk")
    return materialize(model.join(enough, "gk", "left_semi").coalesce(1), "quality-model"), groups


def judge(rows: DataFrame, model: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (measured) with ``distance`` (null where no model holds) and ``kept``. Model and groups are written
    tables of one row a group, so Spark broadcasts them only below its size threshold."""
    own = rows.columns
    r, g, m = rows.select("*", *_vector()).alias("r"), groups.alias("g"), model.alias("m")
    j = (r.join(g, F.expr("r.lang <=> g.lang AND r.source <=> g.source"), "left").join(m, F.expr("g.gk = m.gk"), "left")
         .select("r.*", *[F.col(f"m.{c}") for c in model.columns if c != "gk"]))
    j = _distance(j)
    return j.select(*own, F.when(~F.col("base_failed"), F.round("d2", 6)).alias("distance"),
                    (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass. Every text is measured once; texts are written with their statistics, not shuffled."""
    # the rules' own columns stand apart, whatever columns the documents have
    wide = measured(docs.select("lang", "source", "text", F.struct(*docs.columns).alias("_row"))).drop("text")
    stats = materialize(wide, "quality-stats")
    return judge(stats, *fit(stats.drop("_row"))).filter("kept").select("_row.*")


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = materialize(measured(docs).drop("text"), "quality-stats")
    out = judge(stats, *fit(stats))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
