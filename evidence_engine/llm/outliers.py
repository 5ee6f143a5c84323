"""Quality rules: base counts and robust multivariate outliers, in DataFrame functions alone.

Each document gives a vector of transformed statistics. For every language and source, every language and all documents,
location and scatter are those of the h-subset with the smallest covariance determinant: from several starts, concentration
steps take the share KEEP of the rows nearest by Mahalanobis distance and estimate again, which never raises the determinant;
the best start of each group goes on until its determinant no longer falls. A group's estimate is drawn towards that of the
group around it with the weight of PRIOR_ROWS rows, so small groups have a say by their size. A document far from the estimate
of its language and source is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, join_by_hot_key, staged

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Share of a group's rows in the subset of a concentration step.
KEEP = 0.5
#: Steps that all starts take, and at most the best one; it ends when the determinant's logarithm falls by less than FALL.
FIRST_STEPS, STEPS, FALL = 2, 40, 0.01
#: Rows that the estimate of the group around counts for.
PRIOR_ROWS = 50
#: Squared Mahalanobis distance beyond which a document is rejected.
CUTOFF = 50.0
#: Medians of the chi-square distribution by degrees of freedom. Fixed values.
CHI2_MEDIAN = {1: 0.4549, 2: 1.3863, 3: 2.3660, 4: 3.3567, 5: 4.3515}
#: Up to so many groups are broadcast with their estimates (2 MB); beyond it rows and groups are joined by a shuffle.
BROADCAST_GROUPS = 10_000
#: The statistics' names and the least standard deviations that an estimate may give them.
STATISTICS = {"x_word": 0.04, "x_symbol": 0.15, "x_repeat": 0.10, "x_line": 0.08}
#: Standard deviations of the scatter that all documents' estimate is drawn towards, as multiples of the least ones.
PRIOR_SPREAD = 3.0


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of docs with these and text."""
    text = F.coalesce("text", F.lit(""))
    whole = F.btrim(text, F.lit(SPACES))
    a = docs.select(
        "doc_id", "lang", "source",
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "[ \\t\\n\\x0B\\f\\r]+")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    b = a.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
    )
    windows = F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
    c = b.withColumn("windows", windows).drop("hashes")
    # only texts in which some window comes back are looked at further
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    d = c.withColumn("sorted", F.when(again, F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("windows")
    n = F.size("sorted")
    same = lambda k, other: F.get("sorted", k)["h"] == F.get("sorted", other)["h"]
    twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k > 0) & same(k, k - 1)) | ((k < n - 1) & same(k, k + 1)))
    e = d.withColumn("starts", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(twice, lambda k: F.get("sorted", k)["i"])))).drop("sorted")
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("starts", first, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")), lambda s: s["n"])
    return e.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def statistics(counts: DataFrame) -> DataFrame:
    """The counts with the transformed statistics: word length, symbols, repeated words and repeated lines. Short texts are
    drawn towards usual values by pseudo-counts, logarithms and roots make the rates more alike in spread."""
    n = F.col("n_words")
    return counts.withColumns({
        "x_word": F.log((F.col("word_chars") + 250.0) / (n + 50.0)),
        "x_symbol": F.log1p(100.0 * F.col("n_symbols") / (F.col("word_chars") + 200.0)),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / (n + 50.0)),
        "x_line": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10.0)),
    })


def factor(groups: DataFrame, names: list[str]) -> DataFrame:
    """Adds the lower triangular Cholesky factor l_i_j of the covariances c_i_j, after a floor under the variances."""
    out = groups
    for i in range(len(names)):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") + (F.lit(STATISTICS[names[i]] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance of the statistics from the group's location m_i, by forward substitution."""
    solved: list[Column] = []
    for i, x in enumerate(names):
        y = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * solved[j]
        solved.append(y / F.col(f"l_{i}_{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def pairs(names: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i + 1)]


def moments(rows: DataFrame, names: list[str]) -> DataFrame:
    """Count, means and covariances of every group."""
    at = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)]
    return rows.groupBy("grp").agg(F.count("*").alias("n_in"), *at, *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs(names)])


def with_groups(rows: DataFrame, groups: DataFrame, total: int, few: bool) -> DataFrame:
    """Left join of rows with one-row-per-group values by grp."""
    return rows.join(F.broadcast(groups), "grp", "left") if few else join_by_hot_key(rows, groups, "grp", "n", total)


def log_determinant(names: list[str]) -> Column:
    return F.round(sum((2 * F.log(f"l_{i}_{i}") for i in range(1, len(names))), 2 * F.log("l_0_0")), 9)


def started(rows: DataFrame, names: list[str], medians: DataFrame, total: int, few: bool) -> DataFrame:
    """Three starts of every group, with the start's number before the group's name: medians with absolute deviations, means
    with covariances, and medians with the covariances of the directions from them (spatial signs)."""
    off = with_groups(rows, medians, total, few)
    spread = off.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5).alias(f"s_{i}") for i, x in enumerate(names)])
    scale = [F.greatest(1.4826 * F.col(f"s_{i}"), F.lit(STATISTICS[x])) for i, x in enumerate(names)]
    centre = staged(medians.join(spread, "grp").select("grp", "n", *[f"m_{i}" for i in range(len(names))], *[s.alias(f"s_{i}") for i, s in enumerate(scale)]), "centre")
    named = lambda df, k: df.withColumn("grp", F.concat(F.lit(f"{k}"), F.col("grp")))
    fields = ["grp", "n", *[f"m_{i}" for i in range(len(names))]]
    first = centre.select(*fields, *[((F.col(f"s_{i}") ** 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs(names)])
    second = moments(rows, names).join(centre.select("grp", "n"), "grp").select(*first.columns)
    z = [(F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, x in enumerate(names)]
    length = F.greatest(F.sqrt(sum((y * y for y in z[1:]), z[0] * z[0])), F.lit(1e-9))
    signs = with_groups(rows, centre, total, few).select("grp", *[(y / length).alias(x) for x, y in zip(names, z)])
    third = moments(signs, names).drop("n_in", *[f"m_{i}" for i in range(len(names))]).join(centre, "grp")
    third = third.select(*fields, *[(len(names) * F.col(f"c_{i}_{j}") * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in pairs(names)])
    return factor(named(first, 0).unionByName(named(second, 1)).unionByName(named(third, 2)), names)


def concentrated(rows: DataFrame, groups: DataFrame, names: list[str], total: int, few: bool, keep: float) -> DataFrame:
    """A concentration step: every group's estimate from the share keep of its rows nearest by the estimate before, and by how
    much the logarithm of the determinant falls (null in the first step)."""
    far = with_groups(rows, groups, total, few).select("grp", *names, distance(names).alias("d2"))
    sizes = groups.select("grp", "n", (F.col("logdet") if "logdet" in groups.columns else F.lit(None).cast("double")).alias("was"))
    cut = far.groupBy("grp").agg(F.percentile_approx("d2", keep).alias("cut")).join(sizes.drop("was"), "grp")
    near = with_groups(far, cut, total, few).where("d2 <= cut")
    new = factor(moments(near, names).join(sizes, "grp"), names).withColumn("logdet", log_determinant(names))
    return staged(new.withColumn("fall", F.col("was") - F.col("logdet")).drop("was"), "scatter")


def covariances(rows: DataFrame, names: list[str], total: int, keep: float = KEEP, steps: int = STEPS) -> DataFrame:
    """n, location m_i and scatter c_i_j of the minimum-covariance-determinant estimate for every grp of rows (grp and the
    names), scaled to agree with all rows where those are normal. logdet is that of the subset, with the least variances."""
    medians = rows.groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile_approx(x, 0.5).alias(f"m_{i}") for i, x in enumerate(names)])
    medians = staged(medians, "medians")
    few = medians.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    groups = started(rows, names, medians, total, few)
    thrice = rows.select(F.explode(F.array(*[F.concat(F.lit(f"{k}"), F.col("grp")) for k in range(3)])).alias("grp"), *names)
    for _ in range(FIRST_STEPS):
        groups = concentrated(thrice, groups, names, 3 * total, few, keep)
    fields = [c for c in groups.columns if c != "grp"]
    best = groups.groupBy(F.expr("substring(grp, 2)").alias("grp")).agg(F.min_by(F.struct(*fields), F.struct("logdet", "grp")).alias("x")).select("grp", "x.*")
    groups, done = staged(best, "scatter"), None
    for _ in range(steps):
        active = rows.join(F.broadcast(groups.select("grp")) if few else groups.select("grp"), "grp", "left_semi") if done is not None else rows
        new = concentrated(active, groups, names, total, few, keep)
        ended = new.where(F.col("fall") < FALL)
        done = ended if done is None else done.unionByName(ended)
        groups = new.where(F.col("fall") >= FALL)
        if groups.isEmpty():
            break
    found = staged(groups.unionByName(done) if done is not None else groups, "scatter")
    # for normal data the median distance is the chi-square median: scale the scatter so that it is here
    far = with_groups(rows, found, total, few).select("grp", distance(names).alias("d2"))
    scale = far.groupBy("grp").agg(F.greatest(F.percentile_approx("d2", 0.5) / CHI2_MEDIAN[len(names)], F.lit(1.0)).alias("scale"))
    scaled = found.join(scale, "grp")
    return scaled.select("grp", "n", "logdet", *[f"m_{i}" for i in range(len(names))], *[(F.col("scale") * F.col(f"c_{i}_{j}")).alias(f"c_{i}_{j}") for i, j in pairs(names)])


def blended(groups: DataFrame, names: list[str]) -> DataFrame:
    """Estimates (n, m_i, c_i_j) drawn towards those of the group around (up_m_i, up_c_i_j): the moments of n rows of the one
    and PRIOR_ROWS of the other taken together. Groups of fewer rows than give a scatter, or none, take the other's."""
    n = F.coalesce("n", F.lit(0))
    w = F.when(n > len(names), n / (n + F.lit(PRIOR_ROWS))).otherwise(0.0)
    off = [F.coalesce(F.col(f"m_{i}") - F.col(f"up_m_{i}"), F.lit(0.0)) for i in range(len(names))]
    at = [(F.col(f"up_m_{i}") + w * off[i]).alias(f"m_{i}") for i in range(len(names))]
    scatter = [((1 - w) * F.col(f"up_c_{i}_{j}") + w * F.coalesce(f"c_{i}_{j}", f"up_c_{i}_{j}") + w * (1 - w) * off[i] * off[j]).alias(f"c_{i}_{j}") for i, j in pairs(names)]
    return groups.select(*[c for c in groups.columns if c[0] == "g"], *at, *scatter)


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    docs has doc_id, text, lang and source; other columns are ignored. A null text has no words, and a null lang or source is
    a group like any other. base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not
    base_failed, and the squared distance from the estimate of the document's language and source is at most ``cutoff``. That
    estimate weighs with that of the language, and this one with that of all documents, by their numbers of rows; where all
    documents that did not fail are fewer than 5, nothing else is rejected and the distance is null. Rows that failed are in
    no estimate. Repeated rows count as often as they occur.
    """
    names = list(STATISTICS)
    counts = staged(statistics(base_counts(columns(docs, "doc_id", "text", "lang", "source"))), "counts")
    # compared to false, so that a null fails nothing
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    key = lambda *c: F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), x), F.lit("-")) for x in c]))
    counts = counts.withColumns({"base_failed": failed, "g2": key("lang", "source"), "g1": key("lang")})
    passed = counts.where(~F.col("base_failed"))
    rows = passed.select(F.explode(F.array("g2", "g1", F.lit("[]"))).alias("grp"), *names)
    rows = staged(rows, "rows")
    total = rows.count()
    fields = [*[f"m_{i}" for i in range(len(names))], *[f"c_{i}_{j}" for i, j in pairs(names)]]
    found = staged(covariances(rows, names, total).select("grp", "n", *fields), "estimates")
    up = lambda df: df.select(*[c for c in df.columns if c not in fields], *[F.col(c).alias(f"up_{c}") for c in fields])
    # all documents: one row
    top = found.where(F.col("grp") == "[]").where(F.col("n") > len(names)).first()
    prior = [F.lit((PRIOR_SPREAD * STATISTICS[names[i]]) ** 2 if i == j else 0.0).alias(f"up_c_{i}_{j}") for i, j in pairs(names)]
    value = {c: F.lit(top[c] if top else None).cast("double") for c in fields}
    root = docs.sparkSession.range(1).select(F.lit(top["n"] if top else 0).alias("n"), *[value[c].alias(c) for c in fields], *[value[f"m_{i}"].alias(f"up_m_{i}") for i in range(len(names))], *prior)
    root = blended(root, names).first()
    of = lambda df, level: df.join(found.withColumnRenamed("grp", level), level, "left")
    langs = of(counts.select("g1").distinct(), "g1").select("*", *[F.lit(root[c]).cast("double").alias(f"up_{c}") for c in fields])
    sources = of(counts.groupBy("g2", "g1").agg(F.count("*").alias("n_all")), "g2").join(up(blended(langs, names)), "g1")
    sizes = counts.groupBy("g2").agg(F.count("*").alias("n"))
    groups = factor(blended(sources.drop("g1", "n_all"), names).withColumnRenamed("g2", "grp"), names).join(sizes.withColumnRenamed("g2", "grp"), "grp")
    groups = staged(groups, "groups")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    # sums in another order differ in the last digits: rounded, the distance is the same in every run
    near = with_groups(counts.withColumnRenamed("g2", "grp"), groups, total, few).withColumn("distance", F.round(distance(names), 6))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return near.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
