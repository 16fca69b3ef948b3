"""Quality rules: two fixed rules, then multivariate outliers by robust distance, in DataFrame functions only.

Five statistics of a text are transformed (logarithms of smoothed ratios) and rounded to 1/256, so that all sums
over documents are exact integers and no result depends on the order of rows.  Per language and source the
minimum covariance determinant is sought from three starts by concentration steps (keep the three quarters of
documents that are nearest, take their mean and covariance, measure again): two steps from each start, then steps to
convergence from the one whose determinant is least.  A document whose squared Mahalanobis distance exceeds the cutoff
is rejected.  No statistic counts as narrower than the data give reason for: counts of what most documents lack have no
spread among the nearest, and there one symbol, line or repeated window in the group's shorter documents is the least
standard deviation; for word length and length it is the spread of all documents (a group may be copies of one text).

Groups that are too small use their language's estimate, then the estimate of all documents.  Only histograms and sums
are grouped, so a source with most of the rows is no more work for any task than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, join_salted, need, release, stash

#: Fixed rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS = 10, 20, 5
#: Documents that a group needs for an estimate of its own, and the share of documents that concentration steps keep.
MIN_GROUP, CORE_NUMERATOR, CORE_DENOMINATOR = 50, 3, 4
#: Steps from each start, and steps at most from the best one (it ends where nothing changes).
FIRST_STEPS, MOST_STEPS = 2, 12
#: Squared distance beyond which a document is rejected (seven standard deviations), and the factor that makes the
#: covariance of the nearest three quarters consistent at the normal distribution in five dimensions.
CUTOFF, CONSISTENCY = 49.0, 1.412
#: A word length counts as if the text had so many more words of so many characters; the length of a group's shorter
#: documents is this quantile of its lengths (a tenth).
PRIOR_WORDS, PRIOR_CHARS, SHORT = 100, 5, 10
#: Least standard deviations of word length and length where all documents are alike, and the share of each variance
#: that is added to it, so that few documents give a covariance that can be inverted, too.
LEAST_WORD_LENGTH, LEAST_LENGTH, RIDGE = 1 / 32, 1 / 4, 1 / 16
#: Distances are counted in bins of 1/32 up to 100, so that a group's histogram has at most 3201 rows; the core's edge
#: lies far below that, and what lies beyond counts as 100.
UNIT, BINS, FAR = 256, 32, 100.0
#: Estimates of so many groups at most are sent to all tasks (a few hundred bytes each); more are joined over salts.
MOST_SENT = 20_000
DIM = range(1, 6)

BLANK = r"[\x20\x09-\x0D]+"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are runs of other than blanks.  A null text has none.  Columns of these names are replaced.
    Windows of five words are compared by a 64-bit hash within one document.
    """
    need(docs, text_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in (*STATISTICS, "base_failed")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    a = docs.select(*others, text.alias("__text"), F.filter(F.split(text, BLANK), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    n = F.size("__words")
    w = WINDOW_WORDS
    windows = F.when(n >= w, F.transform(F.sequence(F.lit(1), n - (w - 1)), lambda i: F.xxhash64(F.slice("__words", i, F.lit(w)))))
    b = a.select(
        *others,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        windows.alias("__windows"),
    )
    c = b.select(
        *others, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__ordered"),
    )
    d = c.select(*others, *STATISTICS[:4], F.when(F.col("__ordered").isNotNull(), _places("__ordered")).alias("__places"))
    steps = F.transform("__places", lambda p, k: F.least(F.lit(w), F.coalesce(F.get("__places", k + 1) - p, F.lit(w))))
    repeat = F.coalesce(F.aggregate(steps, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long")
    e = d.select(*others, *STATISTICS[:4], repeat.alias("n_repeat_words"))
    return e.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _places(ordered: str) -> Column:
    """First words (from 0) of the windows that occur twice or more, from windows in hash order: equal neighbours."""
    none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
    before = F.concat(F.array(none), F.slice(ordered, 1, F.size(ordered) - 1))
    after = F.concat(F.slice(ordered, 2, F.size(ordered)), F.array(none))
    near = F.arrays_zip(F.col(ordered).alias("x"), before.alias("p"), after.alias("q"))
    twice = F.filter(near, lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["q"]["h"], F.lit(False)))
    return F.array_sort(F.transform(twice, lambda z: z["x"]["i"]))


def _transformed() -> list[Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    raw = [
        F.log((chars + PRIOR_CHARS * PRIOR_WORDS) / (words + PRIOR_WORDS)),
        F.log(1 + 100 * F.col("n_symbols") / (chars + 50)),
        F.log(1 + 100 * F.col("n_dup_lines") / (words + 50)),
        F.log(1 + 100 * F.col("n_repeat_words") / (words + 50)),
        F.log(words + 10),
    ]
    return [F.floor(x * UNIT + 0.5).cast("long").alias(f"__x{i}") for i, x in zip(DIM, raw, strict=True)]


def _joined(rows: DataFrame, table: DataFrame, on: list[str], how: str, small: bool) -> DataFrame:
    """Rows with what their group has.  A hot group is one task in neither case."""
    if small:
        return rows.join(F.broadcast(table), on, how)
    key = F.xxhash64(*on)
    named = table.select(key.alias("__key"), *[c for c in table.columns if c not in on])  # 64-bit hashes of names
    return join_salted(rows.withColumn("__key", key), named, "__key", how).drop("__key")


def _distance(rows: DataFrame, stats: DataFrame, how: str = "inner", small: bool = True) -> DataFrame:
    """Adds __d2 (and the start, __st, in whose measure): forward substitution in the Cholesky factor of the group's
    covariance."""
    out = _joined(rows, stats, ["__g"], how, small)
    for i in DIM:
        z = f"__x{i} / {float(UNIT)}D - __m{i}" + "".join(f" - __l{i}{j} * __z{j}" for j in range(1, i))
        out = out.selectExpr("*", f"({z}) / __l{i}{i} AS __z{i}")
    keep = [f"`{c}`" for c in rows.columns] + ["__st"] * ("__st" in stats.columns)
    return out.selectExpr(*keep, " + ".join(f"__z{i} * __z{i}" for i in DIM) + " AS __d2")


PAIRS = [(i, j) for i in DIM for j in range(1, i + 1)]
STATS = [*(f"__m{i}" for i in DIM), *(f"__l{i}{j}" for i, j in PAIRS), *(f"__f{i}" for i in DIM)]


def _quantiles(fit: DataFrame) -> DataFrame:
    """Per group, from exact histograms: each statistic's quartiles (q1, m, q3) and the short documents' length."""
    long = fit.select("__g", F.stack(F.lit(5), *[c for i in DIM for c in (F.lit(i), F.col(f"__x{i}"))]).alias("dim", "v"))
    # dealt by value: else the window's exchange would bring every task's partial counts of a group to one task
    counts = long.groupBy("__g", "dim", "v").agg(F.count(F.lit(1)).alias("n")).repartition("__g", "dim", "v")
    w = Window.partitionBy("__g", "dim")
    met = counts.select("__g", "dim", "v", F.sum("n").over(w.orderBy("v")).alias("upto"), F.sum("n").over(w).alias("n"))
    least = lambda i, share, of: F.min(F.when((F.col("dim") == i) & (of * F.col("upto") >= share * F.col("n")), F.col("v")))
    return met.groupBy("__g").agg(*[least(i, k, 4).alias(f"q{k}{i}") for i in DIM for k in (1, 2, 3)], least(5, 1, SHORT).alias("short"))


def _spread_of_all(fit: DataFrame) -> list[float]:
    """Quartile ranges of word length and length over all groups, as standard deviations: the least ones of any group."""
    long = fit.select(F.stack(F.lit(2), F.lit(1), F.col("__x1"), F.lit(5), F.col("__x5")).alias("dim", "v"))
    counts = long.groupBy("dim", "v").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are values
    w = Window.partitionBy("dim")
    met = counts.select("dim", "v", F.sum("n").over(w.orderBy("v")).alias("upto"), F.sum("n").over(w).alias("n"))
    least = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("v")))
    found = {r["dim"]: r["width"] for r in met.groupBy("dim").agg((least(3) - least(1)).alias("width")).collect()}  # two rows
    return [max(least, found.get(i, 0) / (1.349 * UNIT)) for i, least in ((1, LEAST_WORD_LENGTH), (5, LEAST_LENGTH))]


def _floors(out: DataFrame, all_1: float, all_5: float) -> DataFrame:
    """Adds __f1 .. __f5, rounded to 1/1024: the least standard deviations."""
    words = F.exp(F.col("short") / float(UNIT)) - 10
    chars = F.exp(F.col("q21") / float(UNIT)) * (words + PRIOR_WORDS) - float(PRIOR_CHARS * PRIOR_WORDS)
    out = out.withColumn("__words", F.greatest(words, F.lit(0.0))).withColumn("__chars", F.greatest(chars, F.lit(0.0)))
    one = [F.lit(all_1), F.log(1 + 100 / (F.col("__chars") + 50)), F.log(1 + 100 / (F.col("__words") + 50)), F.log(1 + 100.0 * 2 * WINDOW_WORDS / (F.col("__words") + 50)), F.lit(all_5)]
    return out.select("*", *[(F.floor(f * 1024 + 0.5) / 1024.0).alias(f"__f{i}") for i, f in zip(DIM, one, strict=True)])


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Per group n, s1 .. s5, s11 .. s55: counts and sums of the statistics and of their products."""
    sums = [f"sum(__x{i}) AS s{i}" for i in DIM] + [f"sum(__x{i} * __x{j}) AS s{i}{j}" for i, j in PAIRS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *map(F.expr, sums))


def _means(sums: DataFrame, *by: str) -> DataFrame:
    """a1 .. a5, a11 .. a55 of :func:`_sums`."""
    return sums.selectExpr(*by, *[f"s{i} / n AS a{i}" for i in DIM], *[f"s{i}{j} / n AS a{i}{j}" for i, j in PAIRS])


def _spread(i: int, j: int) -> str:
    return f"((a{i}{j} - a{i} * a{j}) / {float(UNIT * UNIT)}D)"


def _at_least(variance: str, i: int) -> str:
    return f"greatest({variance}, __f{i} * __f{i}) * {1 + RIDGE}D"


def _factored(out: DataFrame, factor: float) -> DataFrame:
    """Adds __m (the means) and __l, the Cholesky factor of the covariance with the floors under its diagonal."""

    def rest(i: int, j: int) -> str:
        v = f"{factor}D * {_spread(i, j)}"
        return (_at_least(v, i) if i == j else v) + "".join(f" - __l{i}{k} * __l{j}{k}" for k in range(1, j))

    for j in DIM:
        out = out.selectExpr("*", f"sqrt({rest(j, j)}) AS __l{j}{j}")
        if j < DIM[-1]:
            out = out.selectExpr("*", *[f"({rest(i, j)}) / __l{j}{j} AS __l{i}{j}" for i in DIM if i > j])
    return out.selectExpr("*", *[f"a{i} / {float(UNIT)}D AS __m{i}" for i in DIM])


def _starts(fit: DataFrame) -> DataFrame:
    """Three measures for each group: medians and quartile ranges; mean and covariance; medians and variances."""
    base = stash(_floors(_quantiles(fit).join(_means(_sums(fit, "__g"), "__g"), "__g"), *_spread_of_all(fit)))
    floors = [f"__f{i}" for i in DIM]

    def diagonal(start: int, variance) -> DataFrame:
        scale = [(f"sqrt({_at_least(variance(i), i)})" if i == j else "0.0D") + f" AS __l{i}{j}" for i, j in PAIRS]
        return base.selectExpr("__g", f"{start} AS __st", *[f"q2{i} / {float(UNIT)}D AS __m{i}" for i in DIM], *scale, *floors)

    def quartiles(i: int) -> str:
        sd = f"((q3{i} - q1{i}) / {1.349 * UNIT!r}D)"
        return f"{sd} * {sd}"

    classical = _factored(base, 1.0).select("__g", F.lit(2).alias("__st"), *STATS)
    return diagonal(1, quartiles).unionByName(classical).unionByName(diagonal(3, lambda i: _spread(i, i)))


def _concentrate(fit: DataFrame, stats: DataFrame, small: bool = True) -> DataFrame:
    """One step: mean and Cholesky factor of the covariance of the documents nearest under ``stats``; __same says whether
    nothing has changed.  The documents are read once: their sums by bins of distance, which are added up to the core's
    edge (a group has a bounded number of bins, so no task gets more of one group)."""
    binned = _distance(fit, stats, small=small).withColumn("__bin", F.floor(F.least(F.col("__d2"), F.lit(FAR)) * BINS).cast("long"))
    sums = _sums(binned, "__g", "__st", "__bin").repartition("__g", "__st", "__bin")
    w = Window.partitionBy("__g", "__st")
    met = sums.select("*", (F.sum("n").over(w.orderBy("__bin")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("all"))
    core = met.filter(CORE_DENOMINATOR * F.col("before") < CORE_NUMERATOR * F.col("all")).groupBy("__g", "__st")
    names = ["n", *(f"s{i}" for i in DIM), *(f"s{i}{j}" for i, j in PAIRS)]
    old = stats.selectExpr("__g", "__st", *[f"__f{i}" for i in DIM], *[f"{c} AS {c}_old" for c in STATS])
    out = _means(core.agg(*[F.expr(f"sum({c}) AS {c}") for c in names]), "__g", "__st").join(old, ["__g", "__st"])
    return _factored(out, CONSISTENCY).selectExpr("__g", "__st", *STATS, " AND ".join(f"{c} = {c}_old" for c in STATS) + " AS __same")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, cutoff: float = CUTOFF, steps: int = MOST_STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """:func:`statistics` of ``docs`` with ``distance`` (squared, null where a fixed rule failed) and ``kept``.

    Null languages and sources count as empty ones.  Repeated rows get the same verdict.  With fewer documents
    than ``min_group`` altogether the estimate is that of all of them.  An empty table gives no rows.
    """
    need(docs, text_col, lang_col, source_col)
    plain = [f"`{c}`" for c in docs.columns if c not in ("distance", "kept")]
    measured = statistics(docs.select(*plain), text_col)
    rows = hold(measured.select("*", *_transformed(), *_group(lang_col, source_col)))
    judged = _verdict(rows, *_fit(rows, steps, min_group), cutoff)
    return judged.select(*[f"`{c}`" for c in measured.columns], F.col("__d2").alias("distance"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, cutoff: float = CUTOFF, steps: int = MOST_STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, whole.  Texts are measured twice, so that none is shuffled:
    once for the estimates, and once where each row meets its group's."""
    need(docs, text_col, lang_col, source_col)
    group = _group(lang_col, source_col)
    rows = hold(statistics(docs.select(F.col(f"`{text_col}`"), *group), text_col).select("*", *_transformed()))
    fitted = _fit(rows, steps, min_group)
    whole = statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__measured"), *group), "__measured")
    return _verdict(whole.select("*", *_transformed()), *fitted, cutoff).filter("__kept").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def _group(lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "__l"), (source_col, "__s"))]


def _fit(rows: DataFrame, steps: int, min_group: int) -> tuple[DataFrame, DataFrame, bool]:
    """Which estimate each language and source uses, the estimates, and whether they are few."""
    good = rows.filter("not base_failed")
    sizes = good.groupBy("__l", "__s").agg(F.count(F.lit(1)).alias("n_s"))
    sizes = sizes.join(sizes.groupBy("__l").agg(F.sum("n_s").alias("n_l")), "__l")
    key = F.when(F.col("n_s") >= min_group, F.concat_ws("\u0001", F.lit("s"), "__l", "__s")).when(F.col("n_l") >= min_group, F.concat_ws("\u0001", F.lit("l"), "__l")).otherwise(F.lit("a"))
    uses = stash(sizes.select("__l", "__s", key.alias("__own")))
    small = uses.count() <= MOST_SENT  # estimates are no more than groups, languages and one for all
    fit = hold(_fit_rows(_joined(good.select("__l", "__s", *[f"__x{i}" for i in DIM]), uses, ["__l", "__s"], "inner", small), small))
    stats = stash(_starts(fit))
    for _ in range(FIRST_STEPS):
        stats = stash(_concentrate(fit, stats, small))
    release(fit.sparkSession)
    determinant = F.lit(1.0)
    for i in DIM:
        determinant = determinant * F.col(f"__l{i}{i}")
    best = stats.groupBy("__g").agg(F.min(F.struct(determinant.alias("det"), "__st", *STATS)).alias("best"))
    stats = stash(best.select("__g", "best.__st", *[f"best.{c}" for c in STATS]))
    for _ in range(steps):
        stats = stash(_concentrate(fit, stats, small))
        if stats.filter("not __same").isEmpty():  # a row for each group
            break
    fit.unpersist()
    release(rows.sparkSession)
    return uses, stats.drop("__st", "__same"), small


def _verdict(rows: DataFrame, uses: DataFrame, stats: DataFrame, small: bool, cutoff: float) -> DataFrame:
    """Adds __d2 (null where a fixed rule failed) and __kept."""
    placed = _joined(rows, uses.withColumnRenamed("__own", "__g"), ["__l", "__s"], "left", small)
    far = _distance(placed, stats, "left", small).withColumn("__d2", F.when(~F.col("base_failed"), F.col("__d2")))
    return far.withColumn("__kept", F.coalesce(~F.col("base_failed") & (F.col("__d2") <= cutoff), F.lit(False)))


def _fit_rows(rows: DataFrame, small: bool) -> DataFrame:
    """Rows by the estimate that they take part in: their own group's, and their language's and everything's
    where some group falls back to it (then all rows of the language, or all rows, take part)."""
    x = [f"__x{i}" for i in DIM]
    back = rows.filter(F.col("__own").startswith("l") | (F.col("__own") == "a")).select("__own").distinct()
    send = lambda known: F.broadcast(known) if small else known  # noqa: E731  no more than languages, and one
    own = rows.filter(F.col("__own").startswith("s")).select(F.col("__own").alias("__g"), *x)
    by_lang = rows.select(F.concat_ws("\u0001", F.lit("l"), "__l").alias("__g"), *x).join(send(back.withColumnRenamed("__own", "__g")), "__g", "left_semi")
    every = rows.select(F.lit("a").alias("__g"), *x).join(send(back.withColumnRenamed("__own", "__g")), "__g", "left_semi")
    return own.unionByName(by_lang).unionByName(every)


def quality_oracle() -> str:
    """The same verdicts in DuckDB SQL over ``documents``."""
    lets = []
    # what is narrow is kept, as later steps read it more than once
    let = lambda name, sql: lets.append(f"{name} AS {'NOT ' * name.startswith(('doc', 'win'))}MATERIALIZED (\n{sql}\n)")
    dims = list(DIM)
    pairs = [(i, j) for i in dims for j in range(1, i + 1)]
    w = WINDOW_WORDS
    let("doc0", r"SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(text, '') AS text FROM documents")
    let("doc1", r"SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM doc0")
    let("win0", f"SELECT rid, unnest(generate_series(1, len(ws) - {w - 1})) AS p, ws FROM doc1 WHERE len(ws) >= {w}")
    let("win1", f"SELECT rid, p, array_to_string(list_slice(ws, p, p + {w - 1}), ' ') AS k FROM win0")
    let("win2", "SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM win1) WHERE c > 1")
    let("win3", f"SELECT rid, sum(least({w}, coalesce(nxt - p, {w})))::BIGINT AS r FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM win2) GROUP BY rid")
    let("base", rf"""SELECT d.rid, d.doc_id, d.l, d.s, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r, 0)::BIGINT AS n_repeat_words FROM doc1 d LEFT JOIN win3 USING (rid)""")
    q = lambda e, i: f"floor(({e}) * {UNIT} + 0.5)::BIGINT AS x{i}"
    let("rows0", f"""SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  {q(f'ln((word_chars + {PRIOR_CHARS * PRIOR_WORDS})::DOUBLE / (n_words + {PRIOR_WORDS}))', 1)}, {q('ln(1 + 100 * n_symbols / (word_chars + 50)::DOUBLE)', 2)},
  {q('ln(1 + 100 * n_dup_lines / (n_words + 50)::DOUBLE)', 3)}, {q('ln(1 + 100 * n_repeat_words / (n_words + 50)::DOUBLE)', 4)}, {q('ln((n_words + 10)::DOUBLE)', 5)} FROM base""")
    let("sizes", "SELECT l, s, count(*) AS n_s, sum(count(*)) OVER (PARTITION BY l) AS n_l FROM rows0 WHERE NOT base_failed GROUP BY l, s")
    let("keyed", f"SELECT r.*, CASE WHEN n_s >= {MIN_GROUP} THEN 's' || chr(1) || r.l || chr(1) || r.s WHEN n_l >= {MIN_GROUP} THEN 'l' || chr(1) || r.l ELSE 'a' END AS own FROM rows0 r JOIN sizes USING (l, s) WHERE NOT base_failed")
    xs = ", ".join(f"x{i}" for i in dims)
    let("fit", f"""SELECT own AS g, {xs} FROM keyed WHERE own LIKE 's%'
UNION ALL SELECT 'l' || chr(1) || l, {xs} FROM keyed WHERE 'l' || chr(1) || l IN (SELECT own FROM keyed)
UNION ALL SELECT 'a', {xs} FROM keyed WHERE 'a' IN (SELECT own FROM keyed)""")
    u = f"{float(UNIT)}::DOUBLE"
    uu = f"{float(UNIT * UNIT)}::DOUBLE"
    let("med0", " UNION ALL ".join(f"SELECT g, {i} AS dim, x{i} AS v FROM fit" for i in dims))
    let("med1", "SELECT g, dim, v, row_number() OVER (PARTITION BY g, dim ORDER BY v) AS k, count(*) OVER (PARTITION BY g, dim) AS n FROM med0")
    quarters = ", ".join(f"min(v) FILTER (WHERE dim = {i} AND 4 * k >= {k} * n) AS q{k}{i}" for i in dims for k in (1, 2, 3))
    let("med2", f"SELECT g, {quarters}, min(v) FILTER (WHERE dim = 5 AND {SHORT} * k >= n) AS short FROM med1 GROUP BY g")
    moments = ", ".join([f"sum(x{i})::DOUBLE / count(*) AS a{i}" for i in dims] + [f"sum(x{i} * x{j})::DOUBLE / count(*) AS a{i}{j}" for i, j in pairs])
    let("all0", f"SELECT g, {moments} FROM fit GROUP BY g")
    let("met0", f"SELECT dim, min(v) FILTER (WHERE 4 * k >= n) AS q1, min(v) FILTER (WHERE 4 * k >= 3 * n) AS q3 FROM (SELECT dim, v, row_number() OVER (PARTITION BY dim ORDER BY v) AS k, count(*) OVER (PARTITION BY dim) AS n FROM med0 WHERE dim IN (1, 5)) GROUP BY dim")
    whole = lambda i, least: f"greatest({least}::DOUBLE, coalesce((SELECT (q3 - q1) / {1.349 * UNIT!r}::DOUBLE FROM met0 WHERE dim = {i}), 0))"
    one = [whole(1, LEAST_WORD_LENGTH), "ln(1 + 100 / (chars + 50))", "ln(1 + 100 / (words + 50))", f"ln(1 + {100.0 * 2 * w}::DOUBLE / (words + 50))", whole(5, LEAST_LENGTH)]
    floors = ", ".join(f"floor(({f}) * 1024 + 0.5) / 1024.0::DOUBLE AS f{i}" for i, f in zip(dims, one, strict=True))
    let("base0", f"""SELECT *, {floors} FROM (SELECT *, greatest(exp(q21 / {u}) * (raw + {PRIOR_WORDS}) - {float(PRIOR_CHARS * PRIOR_WORDS)}::DOUBLE, 0.0::DOUBLE) AS chars, greatest(raw, 0.0::DOUBLE) AS words
  FROM (SELECT med2.*, all0.* EXCLUDE (g), exp(short / {u}) - 10 AS raw FROM med2 JOIN all0 USING (g)))""")
    spread = lambda i, j: f"((a{i}{j} - a{i} * a{j}) / {uu})"
    keep = ", ".join([*(f"m{i}" for i in dims), *(f"l{i}{j}" for i, j in pairs), *(f"f{i}" for i in dims)])

    least = lambda v, i: f"greatest({v}, f{i} * f{i}) * {1 + RIDGE}::DOUBLE"

    def factored(at: str, factor: float) -> str:
        for i, j in pairs:
            v = f"{factor!r}::DOUBLE * {spread(i, j)}"
            if i == j:
                v = least(v, i)
            v += "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            at = f"(SELECT *, {f'sqrt({v})' if i == j else f'({v}) / l{j}{j}'} AS l{i}{j} FROM {at})"
        return f"(SELECT *, {', '.join(f'a{i} / {u} AS m{i}' for i in dims)} FROM {at})"

    def diagonal(start: int, variance) -> str:
        scale = ", ".join((f"sqrt({least(variance(i), i)})" if i == j else "0.0::DOUBLE") + f" AS l{i}{j}" for i, j in pairs)
        return f"SELECT g, {start} AS st, {', '.join(f'q2{i} / {u} AS m{i}' for i in dims)}, {scale}, {', '.join(f'f{i}' for i in dims)} FROM base0"

    quartile = lambda i: f"((q3{i} - q1{i}) / {1.349 * UNIT!r}::DOUBLE) * ((q3{i} - q1{i}) / {1.349 * UNIT!r}::DOUBLE)"
    let("stats0", f"{diagonal(1, quartile)} UNION ALL SELECT g, 2 AS st, {keep} FROM {factored('base0', 1.0)} UNION ALL {diagonal(3, lambda i: spread(i, i))}")

    def distance(name: str, rows: str, stats: str) -> str:
        at = f"SELECT r.*, t.* EXCLUDE (g) FROM {rows} r JOIN {stats} t USING (g)"
        for i in dims:
            z = f"x{i} / {u} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(1, i))
            at = f"SELECT *, ({z}) / l{i}{i} AS z{i} FROM ({at})"
        let(name, f"SELECT *, {' + '.join(f'z{i} * z{i}' for i in dims)} AS d2 FROM ({at})")
        return name

    stats = "stats0"
    for step in range(1, FIRST_STEPS + MOST_STEPS + 1):
        distance(f"dist{step}", "fit", stats)
        let(f"bin{step}", f"SELECT g, st, {xs}, floor(least(d2, {FAR}::DOUBLE) * {BINS})::BIGINT AS b FROM dist{step}")
        let(f"cum{step}", f"SELECT g, st, b, sum(n) OVER (PARTITION BY g, st ORDER BY b) AS upto, sum(n) OVER (PARTITION BY g, st) AS n FROM (SELECT g, st, b, count(*) AS n FROM bin{step} GROUP BY g, st, b)")
        let(f"level{step}", f"SELECT g, st, min(b) AS level FROM cum{step} WHERE {CORE_DENOMINATOR} * upto >= {CORE_NUMERATOR} * n GROUP BY g, st")
        let(f"core{step}", f"SELECT g, st, {moments} FROM bin{step} JOIN level{step} USING (g, st) WHERE b <= level GROUP BY g, st")
        fs = ", ".join(f"t.f{i}" for i in dims)
        let(f"stats{step}", f"SELECT g, st, {keep} FROM {factored(f'(SELECT c.*, {fs} FROM core{step} c JOIN {stats} t USING (g, st))', CONSISTENCY)}")
        stats = f"stats{step}"
        if step == FIRST_STEPS:
            det = " * ".join(["1.0::DOUBLE", *(f"l{i}{i}" for i in dims)])
            let("best", f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {det}, st) AS place FROM {stats}) WHERE place = 1")
            stats = "best"
    distance("final", "(SELECT own AS g, * EXCLUDE (own) FROM keyed)", stats)
    return "WITH " + ",\n".join(lets) + f"\nSELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, coalesce(NOT r.base_failed AND d2 <= {CUTOFF}, FALSE) AS kept FROM rows0 r LEFT JOIN final f USING (rid)"
