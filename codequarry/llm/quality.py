"""Quality rules: fixed word rules, then robust multivariate outliers, in DataFrame functions only.

Every text gets five counts. Texts that pass the word rules give a vector of transformed statistics:
log of the mean word length, and square roots of the shares of symbols, repeated lines and words in
repeated windows. Per language and source its centre and scatter are estimated by the minimum
covariance determinant: from a start at the medians and median deviations, concentration steps keep
the HALF share of texts with the smallest Mahalanobis distance and re-estimate from those, which can
only lower the determinant. A text is rejected when its squared distance exceeds CUTOFF.

Statistics are counted on a fixed grid first, and the steps run over grid cells weighted by their
number of texts, so a step's work follows the number of occupied cells and a hot source costs no more
than a small one. Every group of a language and source has its own estimate; as that of a few texts is uncertain, its centre
and scatter are averaged with its language's, which count for PRIOR texts, and those with the estimate of all texts
likewise. FLOOR is added to each deviation, as clean texts have no spread in symbols or repeats at all.

Defined results: a null or empty text has zero counts and fails the rules; a null language or source
is a group of its own; repeated rows are judged alike; cells tied at the edge of the HALF share all count; an empty table
gives no rows; extra columns are ignored, and keep_good() hands them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import discard, durable, let, native_words, sided, table, unused

# The word rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Share of texts that estimates rest on; its factor makes the scatter consistent for 4 normal statistics.
HALF, CONSISTENT, STEPS = 0.75, 1.49, 4
#: Grid of the statistics, deviations that are added to the estimated ones, and largest squared distance.
GRID = (0.02, 0.02, 0.02, 0.05)
FLOOR = (0.06, 0.05, 0.05, 0.15)
CUTOFF = 30.0
#: Texts that the estimate of the language, or of all, counts for beside a group's own.
PRIOR = 50.0
#: Parts that a group is dealt over in joins, so that a hot one is no single task.
SALT = 16

P = len(GRID)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words in a window of WINDOW words whose like occurs again in the text. Windows are sorted by hash, so
    that equals are neighbours; the positions of those found twice are sorted, and their union is measured."""

    def union(p: Column) -> Column:
        covered = F.transform(p, lambda v, i: F.when(i + 1 < F.size(p), F.least(F.get(p, i + 1) - v, F.lit(WINDOW))).otherwise(F.lit(WINDOW)))
        return F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda e, o: F.coalesce(F.get(s, o)["h"] == e["h"], F.lit(False))
        found = F.filter(s, lambda e, i: same(e, i + 1) | (F.when(i > 0, same(e, i - 1)).otherwise(F.lit(False))))
        return let(F.sort_array(F.transform(found, lambda e: e["at"])), union)

    def windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, twice))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) > WINDOW, let(grams, windows)).otherwise(F.lit(0).cast("long"))


def text_stats(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; zeros for a null text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(
        native_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )


def _statistics() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / words), F.sqrt(F.col("n_repeat_words") / words)]


def _group_keys() -> list[Column]:
    """Of the group by language and source, of the language, and of all texts; nulls are values of their own."""
    quoted = {c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source")}
    return [F.to_json(F.struct(quoted["lang"].alias("l"), quoted["source"].alias("s"))), F.to_json(F.struct(quoted["lang"].alias("l"))), F.lit("{}")]


def _salted(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined with the one row of their group g; each group stands SALT times, its rows dealt over those."""
    many = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = [c for c in rows.columns if c != "g"]
    return rows.withColumn("salt", F.pmod(F.xxhash64(*own), F.lit(SALT)).cast("int")).join(many, ["g", "salt"]).drop("salt")


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance from the estimate in columns m0.. and its Cholesky factor l00.., by forward substitution."""
    total = F.lit(0.0)
    solved: list[Column] = []
    for i in range(P):
        rest = x[i] - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
        total = total + solved[i] * solved[i]
    return total


def _estimate(cells: DataFrame, factor: float) -> DataFrame:
    """Per group g: n, means m and Cholesky factor l of the scatter of cells(g, x0.., n)."""
    n = F.col("n")
    sums = [
        F.sum(n).alias("n"), *(F.sum(n * F.col(f"x{i}")).alias(f"s{i}") for i in range(P)),
        *(F.sum(n * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1))
    ]
    out = cells.groupBy("g").agg(*sums)
    out = out.select("g", "n", *(F.col(f"c{i}{j}") for i in range(P) for j in range(i + 1)), *((F.col(f"s{i}") / n).alias(f"m{i}") for i in range(P)))
    scatter = lambda i, j: factor * (F.col(f"c{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOOR[i] ** 2 if i == j else 0.0)
    return _factored(out, scatter).select("g", "n", *(f"m{i}" for i in range(P)), *LOWER)


#: Names of the Cholesky factor's entries.
LOWER = tuple(f"l{i}{j}" for i in range(P) for j in range(i + 1))


def _factored(df: DataFrame, scatter) -> DataFrame:  # noqa: ANN001
    """df with the Cholesky factor l00.. of scatter(i, j), a column for each entry on and below the diagonal."""
    for i in range(P):
        for j in range(i + 1):
            rest = scatter(i, j)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return df


def _averaged(groups: DataFrame, own: str, pooled: str, prior: float) -> DataFrame:
    """groups with the estimate in the struct `own` (with its `texts`; null if there is none) averaged with that in `pooled`, which
    counts for `prior` texts; the result takes the place of both."""
    share = F.coalesce(F.col(f"{own}.texts"), F.lit(0)) / (F.coalesce(F.col(f"{own}.texts"), F.lit(0)) + F.lit(prior))
    both = lambda x, y: F.coalesce(share * x, F.lit(0.0)) + (1 - share) * y
    product = lambda e, i, j: sum((F.col(f"{e}.l{i}{k}") * F.col(f"{e}.l{j}{k}") for k in range(j + 1)), F.lit(0.0))
    out = groups.select("*", *(both(F.col(f"{own}.m{i}"), F.col(f"{pooled}.m{i}")).alias(f"m{i}") for i in range(P)))
    out = _factored(out, lambda i, j: both(product(own, i, j), product(pooled, i, j)))
    kept = [c for c in groups.columns if c not in (own, pooled)]
    return out.select(*kept, F.struct(*(f"m{i}" for i in range(P)), *LOWER).alias(own))


def _start(cells: DataFrame) -> DataFrame:
    """Medians and median deviations per group, in the form of an estimate."""
    n = F.col("n")
    medians = cells.groupBy("g").agg(F.sum(n).alias("all"), *(F.percentile(f"x{i}", 0.5, n).alias(f"m{i}") for i in range(P)))
    spread = _salted(cells, medians).groupBy("g").agg(
        F.sum(n).alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *(
            F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, n).alias(f"d{i}") for i in range(P)
        )
    )
    return spread.select(
        "g", "n", *(f"m{i}" for i in range(P)),
        *(
            (
                F.sqrt((1.4826 * F.col(f"d{i}")) ** 2 + FLOOR[i] ** 2) if i == j else F.lit(0.0)
            ).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)
        )
    )


def estimates(counted: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates per group g of counted(lang, source, counts), which passed the word rules."""
    at = [F.round(x / g).cast("int").alias(f"b{i}") for i, (x, g) in enumerate(zip(_statistics(), GRID))]
    keys = F.array(*_group_keys())
    fine = counted.groupBy("lang", "source", *at).agg(F.count("*").alias("k"))
    cells = durable(
        fine.select(F.explode(keys).alias("g"), *(f"b{i}" for i in range(P)), "k").groupBy("g", *(f"b{i}" for i in range(P))).agg(F.sum("k").alias("n"))
        .select("g", *((F.col(f"b{i}") * GRID[i]).alias(f"x{i}") for i in range(P)), "n")
    )
    x = [F.col(f"x{i}") for i in range(P)]
    own = ["g", *(f"x{i}" for i in range(P)), "n"]
    estimate = durable(_start(cells))
    for _ in range(steps):
        before = estimate
        far = _salted(cells, estimate.drop("n")).select(*own, F.round(_distance(x), 6).alias("d"))
        edge = far.groupBy("g").agg(F.percentile("d", HALF, F.col("n")).alias("edge"))
        estimate = durable(_estimate(_salted(far, edge).where(F.col("d") <= F.col("edge")).select(*own), CONSISTENT))
        discard(before)
    texts = cells.groupBy("g").agg(F.sum("n").alias("texts"))
    return estimate.drop("n").join(texts, "g")


def count_texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, key (hash of id, text, language and source), the five counts and base_failed, one row for each of docs."""
    counted = docs.select("doc_id", "lang", "source", F.xxhash64("doc_id", "text", "lang", "source").alias("key"), text_stats(F.col("text")).alias("s"))
    return durable(counted).select("doc_id", "lang", "source", "key", "s.*").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def judge(docs: DataFrame, cutoff: float = CUTOFF, prior: float = PRIOR) -> DataFrame:
    """What count_texts() returns, with the squared distance (null where the word rules fail) and kept."""
    counted = count_texts(docs)
    found = durable(estimates(counted.where(~F.col("base_failed"))))
    estimate = [c for c in found.columns if c != "g"]
    keys = _group_keys()
    groups = counted.where(~F.col("base_failed")).select("lang", "source").distinct().select(*(k.alias(f"g{i}") for i, k in enumerate(keys)))
    for i in range(3):
        groups = groups.join(found.select(F.col("g").alias(f"g{i}"), F.struct(*estimate).alias(f"e{i}")), f"g{i}", "left")
    groups = _averaged(_averaged(groups, "e1", "e2", prior), "e0", "e1", prior).select(F.col("g0").alias("g"), "e0.*")
    vector = counted.select(*counted.columns, keys[0].alias("g"), *(x.alias(f"x{i}") for i, x in enumerate(_statistics())))
    many = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = vector.withColumn("salt", F.pmod("key", F.lit(SALT)).cast("int")).join(many, ["g", "salt"], "left")
    distance = F.when(~F.col("base_failed"), _distance([F.col(f"x{i}") for i in range(P)]))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return dealt.select("doc_id", "key", *COUNTS, "base_failed", distance.alias("distance")).withColumn("kept", verdict)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    key = unused("key", docs.columns)
    bad = sided(judge(docs).where(~F.col("kept")).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, F.xxhash64("doc_id", "text", "lang", "source")).join(bad, key, "left_anti").select(docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
