"""Quality rules: text statistics in the JVM, and robust multivariate outliers per language and source."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import SPACE, checkpointed, partitions

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ("x0", "x1", "x2", "x3", "x4")
#: Share of a group that the efficient estimate is fitted on; it stands only where the estimate over half the rows agrees.
HALF = 0.75
#: 0.75 over the share of chi-square(7) below the 0.75 quantile of chi-square(5): makes the covariance of the inner
#: three quarters that of a normal sample of five variables.
CONSISTENCY = 1.41207
#: The same for the inner half, and its fall per unit of share (half the rows and three is more than half of a small group).
HALF_CONSISTENCY, HALF_SLOPE = 1.91221, 2.37
#: The 0.99999 quantile of chi-square(5).
CUTOFF = 30.8562
#: A variance of 25^2 is added to each variable (hundredths of a log unit): most texts have no symbol and no repeat,
#: so that their variance over the inner rows is zero.
FLOOR = 625.0
LEAST_ROWS = 50
#: Shapes of groups (some 400 bytes each) up to this many are broadcast, more are joined by a shuffle.
FEW_SHAPES = 30_000
#: Counted vectors in a partition, as long as there are no more partitions than the session shuffles into.
VECTORS = 50_000
#: Stands for any language or source; names of groups are empty or begin with "=".
POOLED = "*"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _chars_of(text: Column, dropped: str) -> Column:
    return F.char_length(F.translate(text, dropped, ""))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `docs` but the text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Whole texts, null as empty. A window of eight words repeats when its XXH64 does; the words of repeated windows are
    counted once each, from the sorted window starts, and only texts that repeat a window are sorted.
    """
    keep = [c for c in docs.columns if c != text]
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_w", _words(F.col("_t")))
    d = d.withColumn("_n", F.size("_w"))
    d = d.withColumn("_h", F.when(F.col("_n") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("_n") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.rtrim(x, F.lit(SPACES)) != ""))
    starts = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(*keep, F.col("_n").cast("long").alias("n_words"), _chars_of(F.col("_t"), SPACES).cast("long").alias("word_chars"),
                 (F.char_length("_t") - _chars_of(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 F.when(F.size(F.array_distinct("_h")) < F.size("_h"), starts).alias("_s"))

    def at(i: Column) -> Column:
        return F.get("_s", i)["h"]

    twice = F.filter("_s", lambda x, i: (x["h"] == at(i - 1)) | (x["h"] == at(i + 1)))
    again = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(again, F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
                          lambda a, i: F.struct((i + WINDOW).alias("end"), (a["sum"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("sum")), lambda a: a["sum"])
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def features() -> dict[str, Column]:
    """Five statistics as whole parts of a log unit (repeats coarser, word length finer), so that sums are exact and repeat in every run."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    of = (F.log1p(F.col("n_words").cast("double")) * 100, F.log(chars / n) * 400, F.log1p(100.0 * F.col("n_symbols") / chars) * 100,
          F.log1p(F.col("n_dup_lines").cast("double")) * 50, F.log1p(100.0 * F.col("n_repeat_words") / n) * 50)
    return {name: F.round(c).cast("long") for name, c in zip(FEATURES, of)}


def _medians(rows: DataFrame) -> DataFrame:
    """Median and median deviation of each variable per group, from counts of its whole values: no group is gathered."""
    values = rows.select("g1", "g2", "w", F.posexplode(F.array(*FEATURES)).alias("k", "v")).groupBy("g1", "g2", "k", "v").agg(F.sum("w").alias("count"))

    def median(df: DataFrame, value: str, name: str) -> DataFrame:
        w = Window.partitionBy("g1", "g2", "k")
        upto = F.sum("count").over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
        inner = df.withColumns({"_upto": upto, "_all": F.sum("count").over(w)})
        return inner.withColumn(name, F.min(F.when(F.col("_upto") * 2 >= F.col("_all"), F.col(value))).over(w)).drop("_upto", "_all")

    mid = median(values, "v", "m")
    mid = median(mid.withColumn("dev", F.abs(F.col("v") - F.col("m"))), "dev", "mad")
    per = mid.groupBy("g1", "g2").agg(*[F.max(F.when(F.col("k") == i, F.col(c))).cast("double").alias(f"{n}{i}") for i in range(len(FEATURES)) for c, n in (("m", "m"), ("mad", "d"))])
    d = len(FEATURES)
    diagonal = {f"l{i}{i}": F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOOR) for i in range(d)}
    below = {f"l{i}{j}": F.lit(0.0) for i in range(d) for j in range(i)}
    return per.select("g1", "g2", *[F.col(f"m{i}") for i in range(d)], *[c.alias(n) for n, c in {**diagonal, **below}.items()])


def _signs(rows: DataFrame, medians: DataFrame, few: bool) -> DataFrame:
    """The second start: medians with the covariance of the rows' directions from them, which distance does not weigh."""
    d = len(FEATURES)
    df = rows.join(F.broadcast(medians) if few else medians, ["g1", "g2"])
    df = df.withColumns({f"y{i}": (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"l{i}{i}") for i in range(d)})
    size = F.sqrt(sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(d)), F.lit(0.0)))
    df = df.withColumn("_size", size).withColumns({f"y{i}": F.when(F.col("_size") > 0, F.round(1000 * F.col(f"y{i}") / F.col("_size"))).otherwise(0).cast("long") for i in range(d)})
    ones = [F.max(c).alias(c) for c in [f"m{i}" for i in range(d)] + [f"l{i}{i}" for i in range(d)]]
    sums = df.groupBy("g1", "g2").agg(F.sum("w").alias("n"), *ones, *[F.sum(F.col("w") * F.col(f"y{i}") * F.col(f"y{j}")).alias(f"q{i}{j}") for i in range(d) for j in range(i + 1)])
    return _factor(sums.withColumns({f"c{i}{j}": F.col(f"q{i}{j}") * d / (F.col("n") * 1e6) * F.col(f"l{i}{i}") * F.col(f"l{j}{j}") + (FLOOR if i == j else 0.0) for i in range(d) for j in range(i + 1)}))


def _factor(df: DataFrame) -> DataFrame:
    """Cholesky factor `l` of the covariance `c`."""
    d = len(FEATURES)
    for j in range(d):
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.lit(1.0), F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))))
        if j + 1 < d:
            df = df.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, d)})
    return df


def _shape(sums: DataFrame) -> DataFrame:
    """Mean, Cholesky factor of the floored, consistent covariance and log determinant `det` from a group's exact sums."""
    d = len(FEATURES)
    n = F.col("n").cast("double")
    factor = F.when(F.col("run") == 0, CONSISTENCY).otherwise(HALF_CONSISTENCY - HALF_SLOPE * (n / F.col("size") - 0.5))
    df = sums.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(d)})
    df = df.withColumns({f"c{i}{j}": factor * (F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOOR if i == j else 0.0) for i in range(d) for j in range(i + 1)})
    return _factor(df).withColumn("det", sum((F.log(f"l{i}{i}") for i in range(d)), F.lit(0.0)))


def _with_distance(rows: DataFrame, shape: DataFrame, few: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """Squared Mahalanobis distance `d2` by forward substitution, and the columns `more` of the shape; with `few` shapes
    no row moves."""
    d = len(FEATURES)
    wanted = [f"m{i}" for i in range(d)] + [f"l{i}{j}" for i in range(d) for j in range(i + 1)]
    shape = shape.select("g1", "g2", *more, *wanted)
    df = rows.join(F.broadcast(shape) if few else shape, ["g1", "g2"])
    for i in range(d):
        df = df.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(d)), F.lit(0.0))).drop(*wanted, *[f"y{i}" for i in range(d)])


def _class() -> Column:
    return F.floor(F.log1p("d2") * 100)


def _inner_sums(measured: DataFrame) -> DataFrame:
    """One concentration step: the exact sums of each group's nearest rows.

    Rows are counted and summed by group and distance class (hundredths of log(1 + d2)), which combines before the
    shuffle; classes are taken in order until the share is reached. A hot group is a few thousand class rows. Run 0
    takes `HALF` of the group or a few more. The other runs take (n + 6) / 2 rows exactly: of the last class as large a
    part of its sums as is missing, so that a block of equal rows never gets past the share.
    """
    d = len(FEATURES)
    w = F.col("w")
    names = [*[f"s{i}" for i in range(d)], *[f"q{i}{j}" for i in range(d) for j in range(i + 1)]]
    sums = [F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(d)] + [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(d) for j in range(i + 1)]
    classes = measured.groupBy("g1", "g2", "run", _class().alias("class")).agg(F.sum("w").alias("n"), *sums)
    group = Window.partitionBy("g1", "g2", "run")
    before = F.coalesce(F.sum("n").over(group.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.col("run") == 0
    inner = classes.withColumns({"_before": before, "size": F.sum("n").over(group)})
    inner = inner.withColumn("_want", F.when(whole, F.ceil(F.col("size") * HALF)).otherwise(F.least("size", F.floor((F.col("size") + d + 1) / 2)))).where("_before < _want")
    inner = inner.withColumn("_part", F.when(whole, F.col("n")).otherwise(F.least("n", F.col("_want") - F.col("_before"))))
    part = [F.sum(F.when(F.col("_part") == F.col("n"), F.col(c)).otherwise(F.round(F.col(c) * (F.col("_part") / F.col("n"))).cast("long"))).alias(c) for c in names]
    return inner.groupBy("g1", "g2", "run").agg(F.max("size").alias("size"), F.max("class").alias("level"), F.sum("_part").alias("n"), *part)


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """Per group (g1, g2) of rows counted by `w`: mean and factor of the minimum-covariance-determinant estimate of x0..x4.

    Three runs of concentration steps per group: over three quarters of the rows from medians and median deviations
    (run 0), and over half of them from there and from the directions' covariance (runs 1 and 2), of which the smaller
    determinant counts. Half the rows can be anything without moving that one far. The estimate over three quarters is
    steadier and stands unless one of its inner rows is an outlier by the other. A group's run 0 goes on until its inner
    rows are those of an earlier step; in the others a step counts only if it lowers the determinant. Settled runs take no
    part in further steps. Sums are whole numbers.

    The counted vectors are range-partitioned by group once, so that a group stands in few partitions and its classes
    combine before they are shuffled, and a hot group in several; a step moves class sums only.
    """
    spread = partitions(rows.sparkSession)
    small = max(8, spread // 16)  # shapes are one row a group and run
    counted = checkpointed(rows.groupBy("g1", "g2", *FEATURES).agg(F.sum("w").alias("w")))
    rows = checkpointed(counted.repartitionByRange(min(spread, 1 + counted.count() // VECTORS), "g1", "g2", *FEATURES))
    medians = checkpointed(_medians(rows).coalesce(small))
    few = medians.count() * 3 <= FEW_SHAPES
    second = _signs(rows, medians, few).select(*medians.columns)
    shape = medians.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1)))).unionByName(second.withColumn("run", F.lit(2)))
    best = None

    def ranked(df: DataFrame, columns: list[str], new: bool) -> DataFrame:
        rank = F.when(F.col("run") == 0, F.lit(0.0 if new else 1.0)).otherwise(F.col("det"))
        return df.select("g1", "g2", "run", F.struct(rank.alias("rank"), F.lit(int(new)).alias("new"), *columns).alias("x"), (F.lit(None).cast("array<long>") if new else F.col("seen")).alias("seen"))

    while True:
        new = _shape(_inner_sums(_with_distance(rows, shape, few, ("run",))))
        columns = [c for c in new.columns if c not in ("g1", "g2", "run")] + ["mark"]
        new = new.withColumn("mark", F.xxhash64("n", *[c for c in columns if c[0] in "sq" and c[1:].isdigit()]))
        if best is None:
            new = new.withColumns({"seen": F.array("mark"), "settled": F.lit(False)})
        else:
            both = ranked(best, columns, False).union(ranked(new, columns, True)).groupBy("g1", "g2", "run").agg(F.min("x").alias("x"), F.max("seen").alias("seen"))
            settled = F.when(F.col("run") == 0, F.array_contains("seen", F.col("x.mark"))).otherwise(F.col("x.new") == 0)
            new = both.select("g1", "g2", "run", *[F.col(f"x.{c}").alias(c) for c in columns], F.array_union("seen", F.array("x.mark")).alias("seen"), settled.alias("settled"))
        best = checkpointed(new.coalesce(small))
        shape = best.where("not settled")
        if shape.isEmpty():
            break
    wide = best.where("run = 0").select("g1", "g2", F.col("level"), *[c for c in columns if c[0] in "ml" and c[1:].isdigit()])
    half = best.where("run > 0").groupBy("g1", "g2").agg(F.min(F.struct("det", "run")).alias("least")).select("g1", "g2", F.col("least.run").alias("run")).join(best, ["g1", "g2", "run"]).select(*[c for c in wide.columns if c != "level"])
    inside = _with_distance(rows, wide, few, ("level",)).where(_class() <= F.col("level")).drop("d2", "level")
    bad = _with_distance(inside, half, few).where(F.col("d2") > CUTOFF).select("g1", "g2").distinct()
    return checkpointed(wide.drop("level").join(bad, ["g1", "g2"], "left_anti").unionByName(half.join(bad, ["g1", "g2"], "left_semi")).coalesce(small))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, distance for every row.

    The base rule fails texts under 20 words and those with over 30 % of the words in repeated windows. The others are
    judged within their language and source (nulls are groups of their own) by the squared Mahalanobis distance from
    the group's minimum-covariance-determinant estimate, fitted on its rows that pass the base rule; rows beyond the
    0.99999 quantile of chi-square(5) go. Groups with fewer than `least_rows` such rows say nothing about their shape:
    they are judged by the estimate over all such rows of their language, or over all rows where the language has too
    few. Only where even those are fewer do rows stay with a null distance. DataFrame functions only; repeated rows and null ids are rows like others.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")).alias("g1"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("g2"), F.col(text).alias("text"))
    stats = text_statistics(d).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    stats = checkpointed(stats.withColumns(features()))  # the texts are read once
    passed = stats.where(~F.col("base_failed")).groupBy("g1", "g2", *FEATURES).agg(F.count(F.lit(1)).alias("w"))
    sizes = stats.groupBy("g1", "g2").agg(F.count_if(~F.col("base_failed")).alias("one"))
    groups = sizes.withColumn("lang", F.sum("one").over(Window.partitionBy("g1"))).crossJoin(sizes.agg(F.sum("one").alias("every")))
    one, lang, every = (F.coalesce(F.col(c) >= least_rows, F.lit(False)) for c in ("one", "lang", "every"))
    level = F.when(one, 0).when(lang, 1).when(every, 2)
    groups = checkpointed(groups.select("g1", "g2", F.when(level < 2, F.col("g1")).when(level == 2, F.lit(POOLED)).alias("e1"), F.when(level == 0, F.col("g2")).when(level > 0, F.lit(POOLED)).alias("e2")))
    wanted = groups.select("e1", "e2").distinct()
    pools = F.explode(F.array(*[F.struct(a.alias("e1"), b.alias("e2")) for a, b in ((F.col("g1"), F.col("g2")), (F.col("g1"), F.lit(POOLED)), (F.lit(POOLED), F.lit(POOLED)))]))
    members = passed.withColumn("e", pools).select("e.e1", "e.e2", "w", *FEATURES).join(wanted, ["e1", "e2"])
    shape = minimum_covariance(members.withColumnsRenamed({"e1": "g1", "e2": "g2"}))
    d_shape = groups.join(shape.withColumnsRenamed({"g1": "e1", "g2": "e2"}), ["e1", "e2"], "left").drop("e1", "e2")
    judged = _with_distance(stats, d_shape, groups.count() <= FEW_SHAPES)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))
