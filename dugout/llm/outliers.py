"""Quality rules as robust multivariate outliers, in DataFrame functions only.

*Statistics*: counts over a whole text (words, symbols, marks, lines that came before, words in repeated windows), each
found inside the row by array functions, so a text is read once and never shuffled. *Vector*: five shares of these
counts, made level by a root or a logarithm and rounded to 1/``GRID``; equal vectors of one group are one row with a
count. *Groups*: language and source; sources with fewer than ``LEAST`` texts are put together by language, and languages
that are still too small with each other. *Estimates*: minimum covariance determinant for each group. Every start (the
medians, and ``STARTS`` random handfuls of vectors) gives a centre and a covariance; a concentration step takes the texts nearest to
it, ``SHARE`` of the group, and their mean and covariance. After ``EARLY`` steps the start of the smallest determinant goes on until no
determinant falls, ``STEPS`` at most. The nearest are found by a histogram of distances, so neither a large group
nor a vector that a third of all texts share is sorted in one task; a step takes whole histogram bins, a hundredth
of a distance wide. *Verdict*: a text is rejected when its Mahalanobis distance, corrected for the share, is above ``CUT``.

Each variance has a floor: most texts have no symbol and no repeated line at all, and without it any other number of
them would be infinitely far. Sums are whole numbers, so a result does not depend on the order of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dugout.llm.common import stored

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
GRID, LEAST, SHARE, STARTS, EARLY, STEPS = 1024, 50, 0.75, 4, 2, 12
#: Standard deviations a statistic has at least: word length, symbols, marks, repeated lines, repeated words.
FLOORS = (0.1, 0.06, 0.08, 0.2, 0.2)
#: Chi-square with five degrees of freedom: its 0.75 quantile is 6.626, and a seven-degree one is below that with probability 0.531.
CONSISTENT = 0.75 / 0.531
#: Squared distance beyond which a text goes: the 0.999 quantile of chi-square with five degrees of freedom.
CUT = 20.515

BLANK = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"'()+,-./:;=?@[\\]^_`{}~"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")
SIDE = len(FLOORS)
PAIRS = [(i, j) for i in range(SIDE) for j in range(i + 1)]


def _with(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the text has twice or more, the first occurrence included."""

    def covered(windows: Column) -> Column:
        """Windows in the order of their hash stand beside their like; the places of those are then put in order."""
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(line: Column) -> Column:
            n = F.size(line)
            same = lambda x, at: line[at]["h"] == x["h"]
            found = F.filter(line, lambda x, at: F.when(at > 0, same(x, at - 1)).otherwise(False) | F.when(at < n - 1, same(x, at + 1)).otherwise(False))
            places = F.array_sort(F.transform(found, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
            step = lambda now, at: F.struct((now["total"] + F.least(F.lit(WINDOW), at - now["last"])).alias("total"), at.alias("last"))
            return F.aggregate(places, start, step, lambda now: now["total"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_with(ordered, again))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))

    some = _with(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _with(windows(hashes), covered))
    return F.when(F.size(words) >= WINDOW, some).otherwise(0)


def statistics(text: Column) -> Column:
    """A struct of ``STATISTICS`` of a text; a null text is an empty one.

    n_words: runs of characters that are no blank. word_chars: code points in words. n_symbols, n_marks: characters
    of ``SYMBOLS`` and ``MARKS``. n_lines: lines with a word. n_dup_lines: those of them equal to an earlier line.
    """
    text = F.coalesce(text, F.lit(""))
    flat = F.translate(text, BLANK, " " * len(BLANK))
    words = F.array_remove(F.split(flat, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, BLANK, " " * len(BLANK))) != "")
    by_words = _with(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = _with(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    found = F.struct(by_words.alias("w"), by_lines.alias("l"))

    def flat_struct(x: Column) -> Column:
        parts = {
            "n_words": x["w"]["n_words"], "word_chars": F.length(F.translate(text, BLANK + " ", "")), "n_symbols": _count(text, SYMBOLS), "n_marks": _count(text, MARKS),
            "n_lines": x["l"]["n_lines"], "n_dup_lines": x["l"]["n_dup_lines"], "n_repeat_words": x["w"]["n_repeat_words"]}
        return F.struct(*[parts[name].cast("bigint").alias(name) for name in STATISTICS])

    return _with(found, flat_struct)


def vector() -> list[Column]:
    """The transformed statistics in whole steps of 1/``GRID``; texts without words are not asked."""
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    parts = [
        F.log(F.col("word_chars") / F.col("n_words")), share("n_symbols", "word_chars"), share("n_marks", "word_chars"),
        share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(part * GRID).cast("bigint").alias(f"u{i}") for i, part in enumerate(parts)]


def grouped(rows: DataFrame) -> DataFrame:
    """(lang, source, grp): the group of every pair that occurs; null where even all small ones together are too few."""
    name = F.col("lang")
    found = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    small = found.where(F.col("n") < LEAST)
    pools = small.groupBy("lang").agg(F.sum("n").alias("pool"))
    rest = pools.where(F.col("pool") < LEAST).agg(F.coalesce(F.sum("pool"), F.lit(0)).alias("rest"))
    pools = pools.crossJoin(rest)  # one row
    own = F.concat(F.lit("s"), F.length(name), F.lit(":"), name, F.col("source"))
    pooled = F.when(F.col("pool") >= LEAST, F.concat(F.lit("l"), name)).when(F.col("rest") >= LEAST, F.lit("a"))
    return found.join(pools, "lang", "left").select("lang", "source", F.when(F.col("n") >= LEAST, own).otherwise(pooled).alias("grp"))


def _sums(cells: DataFrame, by: list[str]) -> DataFrame:
    """Count, sums and sums of products of the vectors of each group."""
    one = [F.sum(F.col("n") * F.col(f"u{i}")).alias(f"s{i}") for i in range(SIDE)]
    two = [F.sum((F.col("n") * F.col(f"u{i}") * F.col(f"u{j}")).cast("decimal(38,0)")).cast("double").alias(f"q{i}{j}") for i, j in PAIRS]
    return cells.groupBy(*by).agg(F.sum("n").alias("taken"), *one, *two)


def estimates(sums: DataFrame, by: list[str]) -> DataFrame:
    """Centre m, inverse covariance p and log determinant of each group, by sweeping one statistic after the other."""
    n = F.col("taken").cast("double")
    mean = [(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(SIDE)]
    spread = {(i, j): F.col(f"q{i}{j}") / n - F.col(f"s{i}") / n * (F.col(f"s{j}") / n) + ((FLOORS[i] * GRID) ** 2 if i == j else 0) for i, j in PAIRS}
    now = sums.select(*by, *mean, *[spread[p].alias("p%d%d" % p) for p in PAIRS], F.lit(0.0).alias("det"))
    for k in range(SIDE):
        at = lambda i, j: F.col("p%d%d" % (max(i, j), min(i, j)))
        pivot = at(k, k)
        swept = {}
        for i, j in PAIRS:
            if i == k and j == k:
                swept[i, j] = -1 / pivot
            elif k in (i, j):
                swept[i, j] = at(i, j) / pivot
            else:
                swept[i, j] = at(i, j) - at(i, k) * at(j, k) / pivot
        now = now.select(*by, *[f"m{i}" for i in range(SIDE)], *[swept[p].alias("p%d%d" % p) for p in PAIRS], (F.col("det") + F.log(pivot)).alias("det"))
    return now.select(*by, *[f"m{i}" for i in range(SIDE)], *[(-F.col("p%d%d" % p)).alias("p%d%d" % p) for p in PAIRS], "det")


def distance() -> Column:
    """Squared Mahalanobis distance of the vector u from the centre m under the inverse covariance p."""
    off = [F.col(f"u{i}") - F.col(f"m{i}") for i in range(SIDE)]
    return reduce(Column.__add__, [(1 if i == j else 2) * F.col(f"p{i}{j}") * off[i] * off[j] for i, j in PAIRS])


def concentrate(cells: DataFrame, known: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Estimates of the ``SHARE`` of each group that lies nearest to its present centre."""
    near = cells.join(known, by).withColumn("bin", F.floor(F.log(1 + F.greatest(distance(), F.lit(0.0))) * 100).cast("int"))
    bins = near.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))  # a few thousand bins at most
    last = bins.withColumn("upto", upto).join(sizes, "grp").where(F.col("upto") >= F.ceil(F.col("all") * SHARE)).groupBy(*by).agg(F.min("bin").alias("last"))
    return estimates(_sums(near.join(last, by).where(F.col("bin") <= F.col("last")), by), by)


def covariance_estimates(cells: DataFrame) -> DataFrame:
    """Centre and inverse covariance (grp, m, p) of each group of ``cells``: grp, n, u."""
    sizes = stored(cells.groupBy("grp").agg(F.sum("n").alias("all")), "sizes")
    pick = F.row_number().over(Window.partitionBy("grp", "start").orderBy(F.xxhash64("start", *[f"u{i}" for i in range(SIDE)]), *[f"u{i}" for i in range(SIDE)]))
    several = cells.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS))))
    handful = several.where("start > 0").withColumn("pick", pick).where(F.col("pick") <= SIDE + 1).withColumn("n", F.lit(1))
    first = estimates(_sums(handful, ["grp", "start"]), ["grp", "start"])
    middle = [F.percentile(f"u{i}", 0.5, F.col("n")).alias(f"m{i}") for i in range(SIDE)]
    plain = [F.lit((1 / (FLOORS[i] * GRID)) ** 2 if i == j else 0.0).alias(f"p{i}{j}") for i, j in PAIRS]
    medians = cells.groupBy("grp").agg(*middle).select("grp", F.lit(0).alias("start"), *[f"m{i}" for i in range(SIDE)], *plain, F.lit(0.0).alias("det"))
    now = stored(medians.unionByName(first), "starts")
    for _ in range(EARLY):
        now = stored(concentrate(several, now, sizes, ["grp", "start"]), "starts")
    order = Window.partitionBy("grp").orderBy("det", "start")
    now = stored(now.withColumn("best", F.row_number().over(order)).where("best = 1").drop("best", "start"), "best")
    for _ in range(STEPS - EARLY):
        after = stored(concentrate(cells, now, sizes, ["grp"]), "best")
        before = now.select("grp", F.col("det").alias("was"))
        falls = after.join(before, "grp").where(F.col("det") < F.col("was") - 1e-6)
        done = falls.isEmpty()
        # A group whose determinant no longer falls keeps what it had.
        fallen = falls.drop("was")
        now = now if done else stored(fallen.unionByName(now.join(fallen, "grp", "left_anti")), "best")
        if done:
            break
    return now


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``STATISTICS``, base_failed, distance and kept.

    base_failed: fewer than ``LEAST_WORDS`` words, or more than ``REPEAT_PERCENT`` hundredths of them in repeated windows. Such
    texts are not kept, take no part in the estimates and have no distance. Of the others those are kept whose
    squared distance is not above ``CUT``; where a text's group has no estimate (``LEAST``) the distance is null and the text is kept.
    A null text is an empty one; a null language or source counts as the empty name. Repeated rows and ids are counted and
    returned each; texts of any length are read whole. An empty table gives an empty result; other columns
    are not looked at, whatever their names.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), name(lang).alias("lang"), name(source).alias("source"), statistics(F.col(text)).alias("found"))
    rows = rows.select("doc_id", "lang", "source", "found.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed), "statistics")
    sound = rows.where("not base_failed").select("*", *vector())
    cells = sound.groupBy("lang", "source", *[f"u{i}" for i in range(SIDE)]).agg(F.count(F.lit(1)).alias("n"))
    cells = stored(cells, "vectors")
    groups = stored(grouped(cells), "groups").where("grp is not null")
    pooled = cells.join(groups, ["lang", "source"]).groupBy("grp", *[f"u{i}" for i in range(SIDE)]).agg(F.sum("n").alias("n"))
    known = covariance_estimates(stored(pooled, "cells"))
    judged = sound.join(groups, ["lang", "source"], "left").join(known, "grp", "left").withColumn("distance", distance() / CONSISTENT)
    columns = ["doc_id", *STATISTICS, "base_failed", "distance"]
    judged = judged.select(*columns).unionByName(rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")).select(*columns))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))
