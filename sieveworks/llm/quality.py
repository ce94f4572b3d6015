"""Quality rules: fixed base rules, then robust multivariate outliers of text statistics in each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.store import write_table
from sieveworks.llm.text import SPACES, WORD, words

MIN_WORDS, MOST_REPEATED = 50, 50
#: Share of a group that an estimate rests on, number of concentration steps, least rows for an estimate of a cell's own.
CORE, STEPS, LEAST_ROWS = 0.75, 3, 40
#: Least standard deviation of each feature, so that a feature that hardly varies in a group rejects nobody.
FEATURES = {"f_words": 1.0, "f_length": 0.25, "f_symbols": 0.5, "f_lines": 0.5, "f_repeat": 0.25}
#: Squared distance beyond which a document goes (0.99999 quantile of chi-square with 5 degrees), on distances scaled to its median.
CUTOFF, CHI2_MEDIAN = 30.86, 4.351
#: Group rows (about 300 bytes each) are sent to the executors up to this number.
BROADCAST_GROUPS = 50_000
FEW = 64


def repeated_words(word_array: Column) -> Column:
    """Words that stand in a 3-word window which occurs at least twice in the array."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    def of_hashes(h: Column) -> Column:
        return F.transform(F.array(F.sort_array(h)), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i - 1) == x)))[0]

    def by_value(h: Column, twice: Column) -> Column:
        return covered(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, F.get(h, i))))

    def by_order(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda p: F.filter(p, lambda e, j: (F.get(p, j - 1)["x"] == e["x"]) | (F.get(p, j + 1)["x"] == e["x"]))
        starts = F.transform(F.array(placed), lambda p: F.sort_array(F.transform(same(p), lambda e: e["i"])))[0]
        return covered(starts)

    def of(h: Column, twice: Column) -> Column:
        return F.when(F.size(twice) == 0, 0).when(F.size(twice) <= FEW, by_value(h, twice)).otherwise(by_order(h))

    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = F.transform(F.array(hashes(word_array)), lambda h: F.transform(F.array(of_hashes(h)), lambda t: of(h, t))[0])[0]
    return F.when(F.size(word_array) < 3, 0).otherwise(counted).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, source, text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as empty. One pass, no shuffle; three-word windows are compared by 64-bit hashes."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"), words(F.col("text")).alias("words"), F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    counted = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _with_features(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return rows.withColumns({
        "cell": F.concat(F.lit("2"), key("lang"), F.lit("\n"), key("source")),
        "lang_cell": F.concat(F.lit("1"), key("lang")),
        "f_words": F.log1p(F.col("n_words").cast("double")),
        "f_length": F.log((F.col("word_chars") + 1.0) / (n + 1.0)),
        "f_symbols": F.log1p(100.0 * F.col("n_symbols") / n),
        "f_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "f_repeat": F.asin(F.sqrt(F.col("n_repeat_words") / n)),
    })


def _join_cells(rows: DataFrame, cells: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(cells) if small else cells, "cell", "inner")


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor (columns l_i_j, m_i)."""
    names = list(FEATURES)
    for i, f in enumerate(names):
        rest = F.col(f) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("distance", sum((F.col(f"y_{i}") ** 2 for i in range(len(names))), F.lit(0.0)))


def _factor(cells: DataFrame) -> DataFrame:
    """Cholesky factor of each cell's covariance (c_i_j), as columns."""
    p = len(FEATURES)
    for j in range(p):
        under = F.col(f"c_{j}_{j}")
        for k in range(j):
            under = under - F.col(f"l_{j}_{k}") ** 2
        cells = cells.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(under, F.lit(1e-9))))
        for i in range(j + 1, p):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            cells = cells.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    return cells.select("cell", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def robust_cells(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Minimum-covariance-determinant estimates: mean, Cholesky factor and scale of each cell with at least so many rows.

    Starts from medians and quartile ranges, then each concentration step keeps the CORE share of a cell's rows that
    lie nearest and takes their mean and covariance. Every step is two map-side combined aggregations of all rows."""
    names, p = list(FEATURES), len(FEATURES)
    quartiles = [F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(f"q_{i}") for i, f in enumerate(names)]
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= least)
    start = [F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)]
    for i, floor in enumerate(FEATURES.values()):
        spread = F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(floor))
        start += [(spread if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for j in range(i + 1)]
    cells = write_table(cells.select("cell", *start), "mcd-cells")
    small = cells.count() <= BROADCAST_GROUPS
    for _ in range(STEPS):
        near = _distance(_join_cells(rows, cells, small)).select("cell", *names, "distance")
        limits = near.groupBy("cell").agg(F.percentile_approx("distance", CORE, 10_000).alias("limit"))
        core = _join_cells(near, write_table(limits, "mcd-limits"), small).where("distance <= limit")
        means = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(names)]
        covariances = [(F.covar_pop(names[i], names[j]) + F.lit(FEATURES[names[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
        cells = write_table(_factor(core.groupBy("cell").agg(*means, *covariances)), "mcd-cells")
    middle = _distance(_join_cells(rows, cells, small)).groupBy("cell").agg(F.percentile_approx("distance", 0.5, 10_000).alias("median"))
    scale = F.greatest(F.col("median") / CHI2_MEDIAN, F.lit(1.0)).alias("scale")
    return write_table(cells.join(middle, "cell").select(*cells.columns, scale), "mcd-cells")


def judge_quality(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, source, text) with the columns of statistics(), outlier (scaled squared distance) and kept.

    Documents that fail a base rule are not kept. Of the others, those beyond CUTOFF from their language and source's
    robust centre are not kept; null languages and sources are values like others. Cells with fewer than LEAST_ROWS
    documents that pass are judged by their language's estimate over all sources, and where that has too few as well by
    the whole corpus's, however few it has. Repeated rows are judged alike; empty tables give empty results."""
    rows = write_table(_with_features(statistics(docs)), "quality-rows")
    passing = rows.where("NOT base_failed")
    cells = robust_cells(passing)
    for name, least in (("lang_cell", LEAST_ROWS), (None, 1)):
        wider = F.col(name) if name else F.lit("0")
        cells = cells.unionByName(robust_cells(passing.withColumn("cell", wider), least))
    cells = write_table(cells, "mcd-cells")
    small = cells.count() <= BROADCAST_GROUPS
    own = cells.select(F.col("cell").alias("estimated"))
    # The estimate of each cell of the table: its own, its language's or the corpus's.
    asked = rows.select("cell", "lang_cell").distinct()
    for place, key in (("own", "cell"), ("wide", "lang_cell")):
        asked = asked.join(F.broadcast(own) if small else own, F.col(key) == F.col("estimated"), "left").withColumnRenamed("estimated", place)
    asked = asked.select("cell", F.coalesce("own", "wide", F.lit("0")).alias("by"))
    asked = asked.join(cells.withColumnRenamed("cell", "by"), "by").drop("by")
    known = write_table(asked, "mcd-known")
    judged = _distance(rows.join(F.broadcast(known) if known.count() <= BROADCAST_GROUPS else known, "cell", "left")).withColumn("outlier", F.col("distance") / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce("outlier", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "outlier", kept.alias("kept"))
