"""Every operator as a query on the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import command, formats, hashing, numbers, signal, stats, text
from ..operators import corpus, metrics, ordered, relational, sampling, similarity, trials
from ..sources import readers
from .registry import HASH, NORM, ORACLE, QUERIES, SEED, TOKENS, query, read

__all__ = ["ORACLE", "QUERIES"]

NGRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - {1} + 1, 1) + 1), lambda i: array_to_string(list_slice({0}, i, i + {1} - 1), ' ')))"


BUDGETS = {"click": 90.0, "view": 50.0, "purchase": 120.0}


# ---------------------------------------------------------------- trials and percentiles


@query("""SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS highest,
  CASE event_type WHEN 'click' THEN 90.0 WHEN 'view' THEN 50.0 WHEN 'purchase' THEN 120.0 END::DOUBLE AS budget,
  CASE WHEN event_type NOT IN ('click', 'view', 'purchase') OR count(value) = 0 THEN ''
       WHEN quantile_disc(value, 0.95) <= CASE event_type WHEN 'click' THEN 90.0 WHEN 'view' THEN 50.0 ELSE 120.0 END THEN 'MEETS' ELSE 'MISSES' END AS verdict
  FROM events GROUP BY event_type""")
def trial_percentiles(spark, d):
    return trials.against_budget(trials.percentiles(read(spark, d, "events"), ["event_type"]), BUDGETS, "event_type")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT l_returnflag, stage, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS highest FROM ("
       + " UNION ALL ".join(f"SELECT l_returnflag, '{m}' AS stage, {m} AS value FROM lineitem" for m in _MEASURES) + ") GROUP BY ALL")
def stage_long_percentiles(spark, d):
    return trials.percentiles(trials.long_form(read(spark, d, "lineitem"), ["l_returnflag"], _MEASURES), ["l_returnflag", "stage"])


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n, avg(value) AS mean, max(value) AS highest, count(*) FILTER (value > 100) AS n_over FROM events GROUP BY event_type")
def trial_aggregate(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("highest"), F.count_if(F.col("value") > 100).alias("n_over"))


@query("""WITH g AS (SELECT source, lang, avg(n_chars) AS r, count(*) AS n FROM documents GROUP BY source, lang) SELECT lang, sum(r * n) / sum(n) AS pooled FROM g GROUP BY lang""")
def weighted_pool(spark, d):
    g = read(spark, d, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("r"), F.count("*").alias("n"))
    return metrics.weighted_pool(g, "r", "n", "lang")


@query("SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_over FROM events GROUP BY ROLLUP (event_type)")
def grand_total_rollup(spark, d):
    g = read(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_over"))
    return g.withColumn("event_type", F.coalesce("event_type", F.lit("all")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 10")
def having_buckets(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).where("n >= 10")


@query("SELECT lang, coalesce(n, 0) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) t(lang) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)")
def zero_filled_tally(spark, d):
    return sampling.zero_filled(read(spark, d, "documents"), "lang", ["de", "en", "es", "fr", "it"])


@query("SELECT source, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM documents GROUP BY source")
def counts_with_share(spark, d):
    from pyspark.sql import Window

    g = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("n"), "source")


@query("""WITH a AS (SELECT o_orderpriority, avg(o_totalprice) AS cooled FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority, avg(o_totalprice) AS hot FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderpriority, cooled, hot, 100.0 * (hot - cooled) / cooled AS change FROM a JOIN b USING (o_orderpriority)""")
def headroom_change(spark, d):
    o = read(spark, d, "orders")
    mean = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    return trials.headroom(mean("F"), mean("O"), "o_orderpriority", "v")


@query("""SELECT 'events' AS item, count(*)::DOUBLE AS value, CASE WHEN count(*) >= 100 THEN 'Met' ELSE 'Missed' END AS verdict FROM events
UNION ALL SELECT 'mean', avg(value), CASE WHEN max(value) <= 1e9 THEN 'Met' WHEN min(value) > 1e9 THEN 'Missed' ELSE 'Not demonstrated' END FROM events
UNION ALL SELECT 'toxic', avg(toxic), CASE WHEN avg(toxic) > 0.5 THEN 'Missed' ELSE 'Met' END FROM labels""")
def requirements_summary(spark, d):
    e, lab = read(spark, d, "events"), read(spark, d, "labels")
    a = e.agg(F.lit("events").alias("item"), F.count("*").cast("double").alias("value"), F.when(F.count("*") >= 100, "Met").otherwise("Missed").alias("verdict"))
    b = e.agg(F.lit("mean").alias("item"), F.avg("value").alias("value"), formats.interval_verdict(F.min("value"), F.max("value"), F.lit(1e9)).alias("verdict"))
    c = lab.agg(F.lit("toxic").alias("item"), F.avg("toxic").alias("value"), F.when(F.avg("toxic") > 0.5, "Missed").otherwise("Met").alias("verdict"))
    return a.unionByName(b).unionByName(c)


# ---------------------------------------------------------------- predictions

_PRED = """p AS (SELECT event_id, user_id, event_type AS gold, CASE (event_id % 7 + 7) % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'hover' WHEN 2 THEN 'click' ELSE event_type END AS dispatched, value > 5 AS parsed_ok FROM events)"""


def _predictions(spark, d):
    k = F.pmod(F.col("event_id"), F.lit(7))
    out = F.when(k == 0, "unknown").when(k == 1, "hover").when(k == 2, "click").otherwise(F.col("event_type"))
    p = read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("gold"), out.alias("dispatched"), (F.col("value") > 5).alias("parsed_ok"))
    return p.withColumn("correct", F.col("gold") == F.col("dispatched"))


@query(f"""WITH {_PRED} SELECT gold, count(*) AS n, avg((gold = dispatched)::INT) AS exact_match,
 count(*) FILTER (dispatched IN ('unknown', 'hover') AND gold <> dispatched)::DOUBLE / nullif(count(*) FILTER (gold <> dispatched), 0) AS safe_failure_rate,
 avg((dispatched <> 'unknown')::INT) AS false_command_rate, avg(parsed_ok::INT) AS schema_validity FROM p GROUP BY gold""")
def prediction_summary(spark, d):
    return metrics.summary(_predictions(spark, d), "gold")


@query(f"WITH {_PRED} SELECT avg((gold = dispatched)::INT) AS exact_match FROM p")
def exact_match_rate(spark, d):
    return _predictions(spark, d).agg(metrics.rate(F.col("correct")).alias("exact_match"))


@query(f"WITH {_PRED} SELECT gold, dispatched, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, d):
    return metrics.confusion(_predictions(spark, d), "gold", "dispatched")


_F1 = f"""WITH {_PRED}, c AS (SELECT DISTINCT gold AS class FROM p),
s AS (SELECT class, (SELECT count(*) FROM p WHERE gold = class AND dispatched = class) AS tp, (SELECT count(*) FROM p WHERE gold <> class AND dispatched = class) AS fp, (SELECT count(*) FROM p WHERE gold = class AND dispatched <> class) AS fn FROM c)"""


@query(f"{_F1} SELECT class, tp, fp, fn, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1 FROM s")
def class_scores(spark, d):
    return metrics.class_scores(_predictions(spark, d), "gold", "dispatched")


@query(f"{_F1} SELECT avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE) AS macro_f1 FROM s")
def macro_f1(spark, d):
    return metrics.macro_f1(_predictions(spark, d), "gold", "dispatched")


@query(f"WITH {_PRED} SELECT count(*) FILTER (dispatched IN ('unknown', 'hover') AND gold <> dispatched)::DOUBLE / nullif(count(*) FILTER (gold <> dispatched), 0) AS safe_failure_rate, avg((dispatched <> 'unknown')::INT) AS false_command_rate FROM p")
def safety_rates(spark, d):
    safe = F.col("dispatched").isin("unknown", "hover")
    return _predictions(spark, d).agg(metrics.share_of(safe, ~F.col("correct")).alias("safe_failure_rate"), metrics.rate(F.col("dispatched") != "unknown").alias("false_command_rate"))


@query(f"""WITH {_PRED} SELECT CASE WHEN gold = dispatched THEN 'correct' WHEN dispatched = 'unknown' THEN 'model_unknown' WHEN dispatched = 'hover' THEN 'model_hover' WHEN NOT parsed_ok THEN 'unparsed' ELSE 'wrong_intent' END AS cause, count(*) AS n FROM p GROUP BY cause""")
def failure_taxonomy(spark, d):
    cause = F.when(F.col("correct"), "correct").when(F.col("dispatched") == "unknown", "model_unknown").when(F.col("dispatched") == "hover", "model_hover").when(~F.col("parsed_ok"), "unparsed").otherwise("wrong_intent")
    return _predictions(spark, d).groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query(f"WITH {_PRED} SELECT coalesce(gold, 'all') AS gold, count(*) FILTER (NOT parsed_ok AND gold = dispatched) AS keeping, count(*) FILTER (NOT parsed_ok) AS errors FROM p GROUP BY ROLLUP (gold)")
def errors_keeping_intent(spark, d):
    g = _predictions(spark, d).rollup("gold").agg(F.count_if(~F.col("parsed_ok") & F.col("correct")).alias("keeping"), F.count_if(~F.col("parsed_ok")).alias("errors"))
    return g.withColumn("gold", F.coalesce("gold", F.lit("all")))


_TURNS = f"""t AS (SELECT conv_id, turn, role, {TOKENS.format(NORM.format("text"))} AS w FROM conversations), j AS (SELECT a.conv_id, a.role, a.w AS w1, b.w AS w2 FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _turn_pairs(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", text.tokens(text.normalise_transcript(F.col("text"))).alias("w"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return t.withColumnRenamed("w", "w1").join(b, ["conv_id", "turn"])


@query(f"WITH {_TURNS} SELECT role, 2.0 * sum(len(list_intersect(w1, w2))) / sum(len(list_distinct(w1)) + len(list_distinct(w2)))::DOUBLE AS micro_f1 FROM j GROUP BY role")
def slot_micro_f1(spark, d):
    return metrics.micro_f1(_turn_pairs(spark, d), "w1", "w2", "role")


@query(f"WITH {_TURNS}, x AS (SELECT role, abs(len(w1) - len(w2)) AS errors, len(w1) AS words FROM j) SELECT role, count(*) AS n, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, sum(errors)::DOUBLE / sum(words) AS rate FROM x WHERE words > 0 GROUP BY role")
def pooled_rate_by_bucket(spark, d):
    x = _turn_pairs(spark, d).select("role", F.abs(F.size("w1") - F.size("w2")).cast("bigint").alias("errors"), F.size("w1").cast("bigint").alias("words"))
    return metrics.pooled_rate(x, "errors", "words", "role")


@query()
def word_edit_counts(spark, d):
    """Substitutions, deletions and insertions between the whole texts of adjacent turns."""
    return _turn_pairs(spark, d).select("conv_id", "turn", text.word_edits(F.col("w1"), F.col("w2")).alias("e"), F.size("w1").alias("ref_words")).select("conv_id", "turn", "e.*", "ref_words")


_PAIRS = "p AS (SELECT doc_id, lang, quality = 1 AS x, toxic = 1 AS y FROM labels JOIN documents USING (doc_id))"


def _label_pairs(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("x"), (F.col("toxic") == 1).alias("y"))


_CELLS = "count(*) FILTER (x AND y) AS a, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) FILTER (NOT x AND NOT y) AS d"


@query(f"WITH {_PAIRS} SELECT lang, {_CELLS} FROM p GROUP BY lang")
def mcnemar_cells(spark, d):
    return metrics.contingency(_label_pairs(spark, d), "x", "y", "lang")


#: The chi-square tail of one degree is erfc(sqrt(x / 2)) = 2 / sqrt(pi) e^(-x/2) times the integral of e^(-t^2 - 2 t sqrt(x/2)), by Simpson's rule; the exact p sums binomials by their logarithms.
_MCNEMAR = f"""WITH {_PAIRS}, k AS (SELECT lang, {_CELLS} FROM p GROUP BY lang),
s AS (SELECT *, CASE WHEN b + c = 0 THEN 0.0::DOUBLE ELSE greatest(0, abs(b - c) - 1) ** 2 / (b + c)::DOUBLE END AS statistic FROM k),
e AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))))) END AS p_exact,
  CASE WHEN b + c = 0 THEN 1.0 ELSE 2 / sqrt(pi()) * exp(-statistic / 2) * 0.002 / 3 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(0 - pow(i * 0.002::DOUBLE, 2) - 2 * i * 0.002 * sqrt(statistic / 2)))) END AS p_chi2 FROM s)
SELECT lang, a, b, c, d, statistic, CASE WHEN b + c < 25 THEN p_exact ELSE p_chi2 END AS p_value, p_exact, p_chi2, CASE WHEN b + c < 25 THEN 'exact' ELSE 'chi2' END AS test, CASE WHEN b + c < 25 THEN p_exact ELSE p_chi2 END < 0.0125 AS significant FROM e"""


@query(_MCNEMAR)
def mcnemar_tests(spark, d):
    cells = metrics.contingency(_label_pairs(spark, d), "x", "y", "lang")
    return cells.withColumn("t", stats.mcnemar_test(F.col("b"), F.col("c"))).select("lang", "a", "b", "c", "d", "t.*", (F.col("t.p_value") < stats.bonferroni(0.05, 4)).alias("significant"))


@query(f"WITH {_PAIRS}, r AS (SELECT x::INT AS a, y::INT AS b, (lang = 'en')::INT AS c FROM p), s AS (SELECT sum(a) AS s0, sum(b) AS s1, sum(c) AS s2, sum(a + b + c) AS t, sum((a + b + c) * (a + b + c)) AS t2 FROM r) SELECT CASE WHEN 3 * t - t2 = 0 THEN 0.0 ELSE 2.0 * (3 * (s0 * s0 + s1 * s1 + s2 * s2) - t * t) / (3 * t - t2) END::DOUBLE AS q, 2 AS dof FROM s")
def cochran_q_stat(spark, d):
    r = _label_pairs(spark, d).select(F.col("x").cast("int").alias("a"), F.col("y").cast("int").alias("b"), (F.col("lang") == "en").cast("int").alias("c"))
    return metrics.cochran_q(r, ["a", "b", "c"])


@query(ORACLE["cochran_q_stat"].replace("SELECT CASE", "SELECT *, exp(-q / 2) AS p FROM (SELECT CASE", 1) + ")")
def cochran_q_test(spark, d):
    return cochran_q_stat(spark, d).withColumn("p", stats.chi2_p(F.col("q"), F.col("dof")))


@query("""WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM events GROUP BY event_type), t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * m) AS s, sum(n * m * m) AS s2, sum((n - 1) * v) AS within FROM g)
SELECT ((s2 - s * s / nn) / (k - 1)) / (within / (nn - k)) AS f, (k - 1)::BIGINT AS d1, (nn - k)::BIGINT AS d2 FROM t""")
def anova_f(spark, d):
    return metrics.anova(read(spark, d, "events"), "event_type", "value")


@query("SELECT *, power(d2 / (d2 + 4 * f), d2 / 2.0) * (1 + d2 / 2.0 * (1 - d2 / (d2 + 4 * f))) AS p FROM (" + ORACLE["anova_f"] + ")")  # in closed form for d1 = 4
def anova_test(spark, d):
    return anova_f(spark, d).withColumn("p", stats.f_p(F.col("f"), F.col("d1"), F.col("d2")))


@query("""SELECT event_type, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, min(value) AS lowest, max(value) AS highest, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) FILTER (value >= 50) AS n_above FROM events GROUP BY event_type""")
def group_moments_iqr(spark, d):
    return metrics.group_moments(read(spark, d, "events"), "event_type", "value", 50.0)


@query("""WITH g AS (SELECT source, avg(n_chars) AS v FROM documents GROUP BY source), m AS (SELECT v AS mine FROM g WHERE source = 'src1') SELECT count(*) FILTER (v > mine) AS worse, count(*) FILTER (v < mine) AS better, 100.0 * count(*) FILTER (v < mine) / count(*) AS percentile FROM g, m WHERE source <> 'src1'""")
def position_in_distribution(spark, d):
    g = read(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("v"))
    return metrics.position(g, "source", "v", "src1")


@query()
def bootstrap_interval(spark, d):
    g = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("num"), F.count("*").alias("den"))
    return metrics.bootstrap(g, "event_type", "num", "den", seed=SEED, unit="user_id")


@query()
def exact_intervals(spark, d):
    g = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    return g.withColumn("b", stats.binomial_ci(F.col("k"), F.col("n"))).withColumn("r", stats.poisson_ci(F.col("k"), F.lit(24.0))).select("event_type", "n", "k", F.col("b.lo").alias("share_lo"), F.col("b.hi").alias("share_hi"), F.col("r.lo").alias("rate_lo"), F.col("r.hi").alias("rate_hi"))


# ---------------------------------------------------------------- sampling

_H = HASH.format(seed=SEED, salt="sample", key="doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) ORDER BY r, n, source LIMIT 50")
def stratified_round_robin(spark, d):
    return sampling.round_robin(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 50, SEED).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) AS r FROM documents) ORDER BY r, lang LIMIT 50")
def choose_subset(spark, d):
    return sampling.round_robin(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50, SEED, by_size=False).select("doc_id").orderBy("doc_id")


@query(f"SELECT doc_id, {HASH.format(seed=SEED, salt='order', key='doc_id')} AS h FROM documents")
def hash_shuffle(spark, d):
    return read(spark, d, "documents").select("doc_id", sampling.hash_order(F.col("doc_id"), SEED, "order").alias("h")).orderBy("h", "doc_id")


@query("""WITH w AS (SELECT source AS k, count(*) AS w FROM documents GROUP BY source), x AS (SELECT k, 100 * w / sum(w) OVER () AS x FROM w), b AS (SELECT k, x, floor(x) AS base FROM x)
SELECT k AS source, (base + CASE WHEN row_number() OVER (ORDER BY round(x - base, 9) DESC, k) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM b""")
def largest_remainder_quota(spark, d):
    w = read(spark, d, "documents").groupBy("source").agg(F.count("*").cast("double").alias("w"))
    return sampling.largest_remainder(w, "source", "w", 100)


_SHARES = [("clean", 0.5), ("perturbed", 0.2), ("tts_clean", 0.15), ("tts_noise", 0.1), ("mixed", 0.05)]


@query("""WITH shares(name, s, o) AS (VALUES ('clean', 0.5::DOUBLE, 1), ('perturbed', 0.2, 2), ('tts_clean', 0.15, 3), ('tts_noise', 0.1, 4), ('mixed', 0.05, 5)),
g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), x AS (SELECT lang, name, o, n, n * s AS x, floor(round(n * s, 9)) AS base FROM g, shares),
q AS (SELECT lang, name, o, base + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY round(x - base, 9) DESC, name) <= n - sum(base) OVER (PARTITION BY lang) THEN 1 ELSE 0 END AS q FROM x),
c AS (SELECT lang, name, sum(q) OVER (PARTITION BY lang ORDER BY o) AS hi, sum(q) OVER (PARTITION BY lang ORDER BY o) - q AS lo FROM q),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY """ + HASH.format(seed=SEED, salt="variant", key="doc_id") + """, doc_id) AS p FROM documents)
SELECT doc_id, r.lang, name AS assigned FROM r JOIN c ON r.lang = c.lang AND p > lo AND p <= hi""")
def variant_assignment(spark, d):
    return sampling.assign_by_quota(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", _SHARES, SEED)


@query("""WITH k AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY """ + HASH.format(seed=SEED, salt="split", key="source") + """, source) AS p, count(*) OVER () AS n FROM k),
b AS (SELECT *, floor(round(n * 0.7, 9)) AS b1, floor(round(n * 0.1, 9)) AS b2, floor(round(n * 0.2, 9)) AS b3 FROM r), e AS (SELECT *, n - b1 - b2 - b3 AS lost, round(n * 0.7 - b1, 9) AS r1, round(n * 0.1 - b2, 9) AS r2, round(n * 0.2 - b3, 9) AS r3 FROM b),
f AS (SELECT *, b1 + (((r2 > r1)::INT + (r3 > r1 OR r3 = r1)::INT) < lost)::INT AS q1, b2 + (((r1 > r2 OR r1 = r2)::INT * 0 + (r1 > r2)::INT + (r3 > r2 OR r3 = r2)::INT) < lost)::INT AS q2 FROM e)
SELECT source, CASE WHEN p <= q1 THEN 'train' WHEN p <= q1 + q2 THEN 'val' ELSE 'test' END AS assigned FROM f""")
def split_assignment(spark, d):
    keys = read(spark, d, "documents").select("source").distinct().withColumn("all", F.lit("all"))
    return sampling.assign_by_quota(keys, "source", "all", [("train", 0.7), ("val", 0.1), ("test", 0.2)], SEED, salt="split").drop("all")


@query(f"SELECT doc_id FROM documents ORDER BY {HASH.format(seed=SEED, salt='random', key='doc_id')}, doc_id LIMIT 25")
def hash_sample(spark, d):
    return read(spark, d, "documents").select("doc_id").orderBy(sampling.hash_order(F.col("doc_id"), SEED, "random"), "doc_id").limit(25)


# ---------------------------------------------------------------- joins


@query("""WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, quality, n_chars, CASE WHEN a.doc_id IS NULL THEN 'right' WHEN b.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL OUTER JOIN b USING (doc_id)""")
def paired_full_outer(spark, d):
    return relational.paired(read(spark, d, "labels").select("doc_id", "quality"), read(spark, d, "documents").where(F.col("doc_id") % 3 != 0).select("doc_id", "n_chars"), "doc_id")


@query("""WITH a AS (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS l_orderkey, o_totalprice AS published FROM orders) SELECT l_orderkey, v, published FROM a LEFT JOIN b USING (l_orderkey) WHERE published IS NULL OR abs(v - published) > 100000""")
def provenance_reconcile(spark, d):
    a = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("v"))
    b = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("v"))
    return relational.reconcile(a, b, "l_orderkey", "v", 100000.0)


@query("""WITH a AS (SELECT doc_id, source, quality = 1 AS x, toxic = 0 AS y FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) AS n, count(*) FILTER (x <> y) AS flipped, count(*) FILTER (NOT x AND y) AS gains, count(*) FILTER (x AND NOT y) AS losses FROM a GROUP BY source""")
def parity_flips(spark, d):
    base = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return relational.flips(base.select("doc_id", "source", (F.col("quality") == 1).alias("ok")), base.select("doc_id", (F.col("toxic") == 0).alias("ok")), "doc_id", "ok", "source")


@query("SELECT a.c_custkey FROM customer a LEFT JOIN (SELECT s_suppkey AS c_custkey, s_nationkey FROM supplier) b USING (c_custkey) WHERE a.c_nationkey IS DISTINCT FROM b.s_nationkey")
def differing_rows(spark, d):
    a = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("v"))
    return relational.differing(a, read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("v")), "c_custkey", "v")


@query("""SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size <= p.p_size AND q.p_retailprice >= p.p_retailprice AND (q.p_size < p.p_size OR q.p_retailprice > p.p_retailprice))""")
def pareto_frontier(spark, d):
    return relational.pareto(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("""SELECT a, b, gap FROM (SELECT x.s_name AS a, y.s_name AS b, (y.v - x.v) / y.v AS gap FROM (SELECT s_name, s_nationkey, s_acctbal + 20000 AS v FROM supplier) x JOIN (SELECT s_name, s_nationkey, s_acctbal + 20000 AS v FROM supplier) y ON x.s_nationkey <> y.s_nationkey AND (x.v < y.v OR x.v = y.v AND x.s_name < y.s_name)) ORDER BY gap, a, b LIMIT 1""")
def closest_pair(spark, d):
    return relational.closest_pair(read(spark, d, "supplier").select("s_name", "s_nationkey", (F.col("s_acctbal") + 20000).alias("v")), "s_name", "s_nationkey", "v")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
def all_pairs(spark, d):
    return relational.unordered_pairs(read(spark, d, "nation"), "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT c_nationkey, 'x' FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 5)")
def upsert_merge(spark, d):
    old = read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    new = read(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_nationkey").cast("bigint").alias("n_nationkey")).distinct().withColumn("n_name", F.lit("x"))
    return relational.upsert(old, new, ["n_nationkey"])


@query("SELECT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1")
def partition_isolation(spark, d):
    docs = read(spark, d, "documents")
    return relational.shared_members(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "source")


@query("SELECT source, count(DISTINCT lang) AS n_splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def straddling_groups(spark, d):
    return relational.straddling(read(spark, d, "documents"), "source", "lang")


@query("SELECT arg_max(event_id, ts) AS event_id, user_id FROM (SELECT user_id, event_id, struct_pack(t := ts, e := event_id) AS ts FROM events) GROUP BY user_id")
def last_by_key(spark, d):
    return relational.latest_by_key(read(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", F.struct("ts", "event_id")).select("event_id", "user_id")


_SPANS = "s AS (SELECT user_id, event_id AS span_id, epoch(ts) AS t0, epoch(ts) + 600.0 * abs(value) / 100 AS t1 FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id, epoch(ts) AS t FROM events WHERE event_type = 'view')"


def _spans(spark, d):
    e = read(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    s = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("span_id"), F.col("t").alias("t0"), (F.col("t") + 600.0 * F.abs("value") / 100).alias("t1"))
    return s, e.where("event_type = 'view'").select("user_id", "event_id", "t")


@query(f"WITH {_SPANS} SELECT p.user_id, event_id, t, arg_max(span_id, t0) AS span_id FROM p LEFT JOIN s ON s.user_id = p.user_id AND t >= t0 AND t <= t1 GROUP BY ALL")
def interval_in_flight(spark, d):
    s, p = _spans(spark, d)
    return relational.interval_latest(p, s, ["user_id"], "t", "t0", "t1", "span_id", 300.0)


@query(f"WITH {_SPANS} SELECT p.user_id, event_id, t, (SELECT min(t0) FROM s WHERE s.user_id = p.user_id AND t0 >= t) AS reflex FROM p")
def reflex_suppression(spark, d):
    s, p = _spans(spark, d)
    return relational.suppressed(p, s, "user_id", "t", "t0").select("user_id", "event_id", "t", "reflex")


@query(f"WITH {_TURNS}, n AS (SELECT conv_id, role, w1, w2, list_filter(range(1, greatest(len(w1), len(w2)) + 1), lambda i: w1[i] IS DISTINCT FROM w2[i]) AS x FROM j) SELECT role, min(x[1] - 1)::INT AS least_at, max(x[1] - 1)::INT AS most_at, count(*) AS n FROM n WHERE len(x) > 0 GROUP BY role")
def token_array_divergence(spark, d):
    p = _turn_pairs(spark, d).select("role", relational.divergence(F.col("w1"), F.col("w2")).alias("v")).where("v is not null")
    return p.groupBy("role").agg(F.min("v.at").alias("least_at"), F.max("v.at").alias("most_at"), F.count("*").alias("n"))


# ---------------------------------------------------------------- ordered


@query("""SELECT event_type, user_id, count(*) FILTER (g IS NULL OR g > 40) AS n_events FROM (SELECT event_type, user_id, event_id - lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS g FROM events WHERE value >= 20) GROUP BY ALL""")
def debounced_events(spark, d):
    return ordered.event_counts(read(spark, d, "events"), ["event_type", "user_id"], "event_id", "value", 20.0, 40)


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (branch = 'B' AND seq < mark) AS n_stale FROM (SELECT user_id, branch, seq, max(CASE WHEN branch = 'A' THEN seq ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS mark FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS branch, (event_id * 7919) % 1000 AS seq FROM events)) GROUP BY user_id""")
def sequence_high_water(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "A").otherwise("B").alias("branch"), (F.col("event_id") * 7919 % 1000).alias("seq"))
    return ordered.high_water(e, ["user_id"], "event_id", "seq", "branch").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("stale").alias("n_stale"))


_INTENTS = ["takeoff", "altitude_reached", "move", "land", "ground_contact", "abort", "reset", "hover", "takeoff", "altitude_reached", "formation"]


_FSM_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, ({_INTENTS!r})[((event_id * 31 + user_id) % {len(_INTENTS)}) + 1] AS intent, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS r, 'LANDED' AS state, 0::BIGINT AS n FROM events UNION ALL
SELECT e.user_id, e.r, CASE WHEN intent = 'takeoff' AND state = 'LANDED' THEN 'TAKING_OFF' WHEN intent = 'land' AND state IN ('TAKING_OFF', 'FLYING') THEN 'LANDING' WHEN intent = 'abort' AND state IN ('TAKING_OFF', 'FLYING', 'LANDING') THEN 'ABORTED'
  WHEN intent = 'altitude_reached' AND state = 'TAKING_OFF' THEN 'FLYING' WHEN intent = 'ground_contact' AND state = 'LANDING' THEN 'LANDED' WHEN intent = 'reset' AND state = 'ABORTED' THEN 'LANDED' ELSE state END,
  n + CASE WHEN intent IN ('altitude_reached', 'ground_contact', 'reset') THEN 0 WHEN intent = 'abort' THEN (state IN ('TAKING_OFF', 'FLYING', 'LANDING'))::INT WHEN intent = 'takeoff' AND state = 'LANDED' THEN 1 WHEN state IN ('TAKING_OFF', 'FLYING') THEN 1 ELSE 0 END
FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, arg_max(state, r) AS final_state, max(n) AS n_dispatched FROM f GROUP BY user_id"""


@query(_FSM_SQL)
def fsm_fold(spark, d):
    names = F.array(*map(F.lit, _INTENTS))
    e = read(spark, d, "events").select("user_id", "event_id", F.element_at(names, (F.pmod(F.col("event_id") * 31 + F.col("user_id"), F.lit(len(_INTENTS))) + 1).cast("int")).alias("intent"))
    return ordered.fold_states(e, ["user_id"], "event_id", "intent")


_END_SQL = """WITH RECURSIVE e AS (SELECT user_id, least(abs(value) / 100, 1.0) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS r, 0::BIGINT AS free, false AS open, 0::BIGINT AS start, -1::BIGINT AS quiet, NULL::BIGINT AS s, NULL::BIGINT AS en, NULL::BOOLEAN AS forced FROM events UNION ALL
SELECT user_id, r, CASE WHEN ends OR cut THEN r ELSE free END, open1 AND NOT (ends OR cut), CASE WHEN ends OR cut THEN 0 ELSE start1 END, CASE WHEN ends OR cut THEN -1 ELSE quiet1 END,
  CASE WHEN ends OR cut THEN start1 END, CASE WHEN ends THEN least(quiet1 + 1, r) WHEN cut THEN r END, CASE WHEN ends OR cut THEN cut END
FROM (SELECT *, NOT ends AND open1 AND r - start1 >= 12 AS cut FROM (SELECT *, open AND p < 0.5 - 0.15 AND r - quiet1 >= 3 AS ends FROM (
  SELECT f.user_id, e.r, f.free, f.open, p, f.open OR p >= 0.5 AS open1, CASE WHEN p >= 0.5 AND NOT f.open THEN greatest(f.free, e.r - 1 - 1) ELSE f.start END AS start1,
    CASE WHEN p >= 0.5 THEN -1 WHEN f.open AND p < 0.5 - 0.15 AND f.quiet < 0 THEN e.r - 1 ELSE f.quiet END AS quiet1 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))))
SELECT user_id, s AS start, en AS "end", r AS t0, forced FROM f WHERE forced IS NOT NULL"""


@query(_END_SQL)
def endpoint_sessions(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.least(F.abs("value") / 100, F.lit(1.0)).alias("p"))
    return ordered.endpoints(e, ["user_id"], "event_id", "p", silence=3, pad=1, longest=12)


@query("SELECT user_id, arg_min(event_id, event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_own_event(spark, d):
    return ordered.first_of_kind(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("SELECT user_id, value - prev AS gain FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_minus_prev(spark, d):
    return trials.last_gain(read(spark, d, "events"), "user_id", "event_id", "value")


@query("SELECT user_id, max(event_id) AS last_ok, count(*) AS n FROM (SELECT user_id, event_id, bool_and(value < 80) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM events) WHERE ok GROUP BY user_id")
def contiguous_envelope(spark, d):
    return trials.contiguous(read(spark, d, "events"), "event_id", F.col("value") < 80, "user_id").groupBy("user_id").agg(F.max("event_id").alias("last_ok"), F.count("*").alias("n"))


@query("""WITH t(threshold) AS (SELECT unnest([0.0, 5.0, 10.0, 20.0, 40.0, 60.0])), m AS (SELECT threshold, event_type, avg((value < threshold)::INT) AS missed FROM events, t GROUP BY ALL), w AS (SELECT threshold, max(missed) AS worst FROM m GROUP BY threshold) SELECT max(threshold)::DOUBLE AS threshold FROM w WHERE worst <= 0.3""")
def threshold_select(spark, d):
    return trials.highest_threshold(read(spark, d, "events"), "event_type", "value", [0, 5, 10, 20, 40, 60], 0.3)


@query("SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) AS trailing FROM events")
def trailing_mean(spark, d):
    return ordered.trailing_mean(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 10).drop("value")


# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5 FROM documents")
def normalise_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.normalise_transcript(F.col("text"))).alias("norm_md5"))


@query(f"WITH t AS (SELECT item_id, {TOKENS.format(NORM.format('text'))} AS w FROM benchmark) SELECT item_id, len({NGRAMS.format('w', 3)}) AS n_grams FROM t")
def word_ngrams(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.size(text.ngrams(text.tokens(text.normalise_transcript(F.col("text"))), 3)).cast("bigint").alias("n_grams"))


@query(r"SELECT p_partkey, trim(regexp_extract(x, '^((?:[^,(]|\([^)]*\))*)', 1)) AS head FROM (SELECT p_partkey, p_name || ' (a, b) ' || p_brand || ', ' || p_type AS x FROM part)")
def first_outside_parens(spark, d):
    x = F.concat("p_name", F.lit(" (a, b) "), "p_brand", F.lit(", "), "p_type")
    return read(spark, d, "part").select("p_partkey", text.first_outside_parens(x).alias("head"))


@query("SELECT event_id, list_sort(list_transform(json_keys(props), lambda k: k || '=' || json_extract_string(props, '$.' || k))) AS pairs FROM events")
def slot_pairs(spark, d):
    m = F.from_json("props", "map<string,string>")
    return read(spark, d, "events").select("event_id", F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("pairs"))


@query("SELECT doc_id, " + HASH.format(seed=SEED, salt="seed", key="doc_id") + " AS seed, sha256(text) AS digest FROM documents")
def stable_hash_seed(spark, d):
    return read(spark, d, "documents").select("doc_id", hashing.stable_key(SEED, "seed", F.col("doc_id")).alias("seed"), hashing.digest(F.col("text")).alias("digest"))


@query("SELECT source, (7 + ('0x' || substr(sha256(source), 1, 8))::BIGINT) % 4294967296 AS seed FROM (SELECT DISTINCT source FROM documents)")
def bucket_seeds(spark, d):
    return read(spark, d, "documents").select("source").distinct().select("source", hashing.bucket_seed(7, F.col("source")).alias("seed"))


@query(f"""WITH n AS (SELECT doc_id, text, lang, source, {NORM.format('text')} AS k FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS n FROM n GROUP BY k""")
def dedup_first_wins(spark, d):
    docs = read(spark, d, "documents").select("doc_id", text.normalise_transcript(F.col("text")).alias("k"))
    return docs.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@query(f"""WITH n AS (SELECT doc_id, {NORM.format('text')} AS norm, source AS label FROM documents) SELECT md5(norm) AS norm_md5, count(*) AS n_rows, count(DISTINCT label) AS n_labels, arg_min(label, doc_id) AS first_label FROM n GROUP BY norm HAVING count(DISTINCT label) > 1""")
def dedup_conflicts(spark, d):
    return corpus.dedup_conflicts(read(spark, d, "documents"), "text", "source", "doc_id").withColumn("norm_md5", F.md5("norm")).drop("norm")


@query(f"""WITH r AS (SELECT {NORM.format('text')} AS k FROM documents WHERE doc_id % 2 = 0) SELECT doc_id AS held FROM documents WHERE doc_id % 2 = 1 AND {NORM.format('text')} IN (SELECT k FROM r WHERE k <> '')""")
def exact_contamination(spark, d):
    docs = read(spark, d, "documents")
    return similarity.exact_matches(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "text")


_LEAK_SQL = f"""WITH n AS (SELECT doc_id, lang, {NORM.format('text')} AS k FROM documents), t AS (SELECT doc_id, lang, {TOKENS.format('k')} AS w FROM n WHERE k <> ''), f AS (SELECT doc_id, lang, list_distinct(w) AS a, {NGRAMS.format('w', 2)} AS b FROM t),
p AS (SELECT h.doc_id AS held, r.doc_id AS ref, greatest(len(list_intersect(h.a, r.a))::DOUBLE / (len(h.a) + len(r.a) - len(list_intersect(h.a, r.a))), len(list_intersect(h.b, r.b))::DOUBLE / (len(h.b) + len(r.b) - len(list_intersect(h.b, r.b)))) AS score
FROM f h JOIN f r ON h.doc_id % 2 = 1 AND r.doc_id % 2 = 0 @on AND (least(len(h.a), len(r.a)) >= 0.85 * greatest(len(h.a), len(r.a)) - 1 OR least(len(h.b), len(r.b)) >= 0.85 * greatest(len(h.b), len(r.b)) - 1))
SELECT held, min(ref) AS ref, arg_min(score, ref) AS score FROM p WHERE score >= 0.85 GROUP BY held"""


@query(_LEAK_SQL.replace("@on", ""))
def near_dup_cross_split(spark, d):
    docs = read(spark, d, "documents")
    return similarity.leaks(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "text")


@query(_LEAK_SQL.replace("@on", "AND h.lang = r.lang"))
def near_dup_within_group(spark, d):
    docs = read(spark, d, "documents")
    return similarity.leaks(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "text", within="lang")


@query(f"""WITH i AS (SELECT item_id, unnest({NGRAMS.format('w', 3)}) AS g FROM (SELECT item_id, {TOKENS.format(NORM.format('text'))} AS w FROM benchmark)), s AS (SELECT DISTINCT unnest({NGRAMS.format('w', 3)}) AS g FROM (SELECT {TOKENS.format(NORM.format('text'))} AS w FROM documents))
SELECT item_id, count(*) AS n_grams, count(s.g) AS n_seen, count(s.g)::DOUBLE / count(*) AS share FROM i LEFT JOIN s USING (g) WHERE g <> '' GROUP BY item_id""")
def benchmark_ngram_overlap(spark, d):
    return similarity.ngram_overlap(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "doc_id", "text", 3)


# ---------------------------------------------------------------- commands


@query("SELECT event_id, CASE WHEN isnan(value) THEN NULL ELSE least(greatest(value, 0.5), 15.0) END AS z, CASE WHEN abs(value * 10) <= 180 THEN round(value * 10, 1) WHEN round(((value * 10 + 180) % 360 + 360) % 360 - 180, 1) = -180 AND value > 0 THEN 180.0 ELSE round(((value * 10 + 180) % 360 + 360) % 360 - 180, 1) END AS yaw FROM events")
def clamp_envelope(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", command.clamp_column("z", v).alias("z"), command.wrap_yaw_column(v * 10).alias("yaw"))


def _commands(spark, d):
    """Raw command texts, some malformed, from events."""
    k = F.pmod(F.col("event_id"), F.lit(8))
    v = F.format_string("%.2f", "value")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"intent":"altitude","z":'), v, F.lit("}"))).when(k == 1, F.concat(F.lit('{"yaw":'), v, F.lit(',"intent":"rotate"}')))
        .when(k == 2, F.concat(F.lit('{"intent":"move","dir":"east","dist":'), v, F.lit("}"))).when(k == 3, F.lit('{"intent":"formation","shape":"circle"}'))
        .when(k == 4, F.concat(F.lit('{"intent":"land","ids":['), (F.col("event_id") % 9).cast("string"), F.lit(",1]}"))).when(k == 5, F.lit('{"intent":"abort","x":1}'))
        .when(k == 6, F.lit("not json")).otherwise(F.concat(F.lit('{"intent":"move","pos":['), v, F.lit(",40,"), v, F.lit("]}")))
    )
    return read(spark, d, "events").select("event_id", raw.alias("raw"))


@query()
def command_parse(spark, d):
    """Canonical form, validation and fallback of raw commands."""
    return _commands(spark, d).withColumn("c", command.parse_command(F.col("raw"))).select("event_id", "raw", "c.*")


@query("""SELECT event_id, CASE (event_id % 8 + 8) % 8 WHEN 0 THEN regexp_full_match(v, '-?[0-9]{1,3}(\\.[0-9])?') WHEN 1 THEN false WHEN 2 THEN regexp_full_match(v, '-?[0-9]{1,3}(\\.[0-9])?') WHEN 3 THEN true WHEN 4 THEN (event_id % 9) <= 4 WHEN 5 THEN false WHEN 6 THEN false ELSE regexp_full_match(v, '-?[0-9]{1,3}(\\.[0-9])?') END AS ok FROM (SELECT event_id, printf('%.2f', value) AS v FROM events)""")
def grammar_accepts(spark, d):
    return _commands(spark, d).select("event_id", command.accepted(F.col("raw")).alias("ok"))


_ACTS = ["takeoff", "land", "hover", "abort", "move", "altitude", "rotate", "formation", "set_param", "unknown", "sing"]


@query(f"""WITH e AS (SELECT event_id, ({_ACTS!r})[event_id % 11 + 1] AS intent, (['LANDED', 'TAKING_OFF', 'FLYING', 'LANDING', 'ABORTED'])[user_id % 5 + 1] AS state FROM events)
SELECT event_id, intent, state, CASE intent WHEN 'takeoff' THEN state = 'LANDED' WHEN 'land' THEN state IN ('TAKING_OFF', 'FLYING') WHEN 'hover' THEN state IN ('TAKING_OFF', 'FLYING') WHEN 'abort' THEN state IN ('TAKING_OFF', 'FLYING', 'LANDING') WHEN 'set_param' THEN state <> 'ABORTED' WHEN 'unknown' THEN false WHEN 'sing' THEN false ELSE state = 'FLYING' END AS legal FROM e""")
def legality_table(spark, d):
    """Whether each event's intent may run in its state."""
    at = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (F.col(k) % len(xs)).cast("int"))
    return read(spark, d, "events").select("event_id", at(_ACTS, "event_id").alias("intent"), at(command.STATES, "user_id").alias("state")).withColumn("legal", command.legal(F.col("intent"), F.col("state")))


@query("""WITH n AS (SELECT DISTINCT p_size AS w, (p_partkey % 10)::INT AS t FROM part),
o AS (SELECT string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS ones, string_split('twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS tens)
SELECT w * 10 + t AS id, CASE WHEN w < 20 THEN ones[w + 1] WHEN w % 10 = 0 THEN tens[w // 10 - 1] ELSE tens[w // 10 - 1] || '-' || ones[w % 10 + 1] END || CASE WHEN t > 0 THEN ' point ' || ones[t + 1] ELSE '' END AS words, CASE WHEN t > 0 THEN w || '.' || t ELSE w::VARCHAR END AS digits FROM n, o""")
def number_words(spark, d):
    """Numbers spelled out and read back."""
    n = read(spark, d, "part").select((F.col("p_size") * 10 + F.col("p_partkey") % 10).cast("int").alias("id")).distinct().withColumn("x", F.col("id") / 10.0)
    return n.withColumn("words", numbers.number_to_words(F.col("x"))).withColumn("digits", numbers.words_to_digits(F.col("words"))).select("id", "words", "digits")


# ---------------------------------------------------------------- signals, generation


@query("""WITH f AS (SELECT vec_id, i // 16 AS frame, sqrt(avg(v::DOUBLE * v::DOUBLE)) AS level FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL), m AS (SELECT vec_id, level, max(level) OVER (PARTITION BY vec_id) AS peak FROM f)
SELECT vec_id, sqrt(avg(level * level)) AS active FROM m WHERE 20 * log10(greatest(level, 1e-12)) >= 20 * log10(greatest(peak, 1e-12)) - 6 GROUP BY vec_id""")
def frame_rms_active_level(spark, d):
    return read(spark, d, "embeddings").select("vec_id", signal.active_rms(F.col("embedding").cast("array<double>"), 16, 6.0).alias("active"))


_TARGETS = ['{"intent":"hover"}', '{"intent":"land","ids":[1]}', '{"intent":"land"}', '{"intent": "hover"}', '{"intent":"altitude","z":2.5}', '{"intent":"land","ids":[2,1]}']
_GOLD = ["hover", "land", "hover", "hover", "altitude", "land"]


@query(f"""WITH r AS (SELECT event_id, event_id % 6 AS k, ({_GOLD!r})[event_id % 6 + 1] AS gold_intent, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || '.' WHEN 2 THEN upper(event_type) ELSE '  ' END AS transcript FROM events),
b AS (SELECT event_id, list_filter([CASE WHEN k = 3 THEN 'grammar' END, CASE WHEN k IN (3, 5) THEN 'canonical' END, CASE WHEN k = 2 THEN 'intent' END, CASE WHEN trim(transcript) = '' THEN 'blank' END, CASE WHEN transcript <> lower(transcript) THEN 'case' END, CASE WHEN transcript LIKE '%.' THEN 'terminal' END], lambda x: x IS NOT NULL) AS broken FROM r)
SELECT event_id, broken FROM b WHERE len(broken) > 0""")
def invariant_violations(spark, d):
    """Records that break an invariant, with the names of those broken."""
    at = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % n).cast("int"))
    kind = F.col("event_type")
    said = F.get(F.array(kind, F.concat(kind, F.lit(".")), F.upper(kind), F.lit("  ")), (F.col("event_id") % 4).cast("int"))
    g = read(spark, d, "events").select("event_id", at(_TARGETS, 6).alias("target"), at(_GOLD, 6).alias("gold_intent"), said.alias("transcript"))
    return corpus.row_violations(g, command.accepted(F.col("target")), corpus.canonical_ok(F.col("target"))).select("event_id", "broken")


@query("SELECT axis, value, count(*) AS n FROM (SELECT 'lang' AS axis, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY ALL")
def axis_histogram(spark, d):
    return corpus.axis_histogram(read(spark, d, "documents"), ["lang", "source"])


@query("SELECT 'lang' AS axis, 'it' AS value")
def missing_axis_values(spark, d):
    return corpus.missing_values(read(spark, d, "documents"), {"lang": ["de", "en", "es", "fr", "it"]})


@query("SELECT lang, n, want FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) FULL JOIN (SELECT 'en' AS lang, 100::BIGINT AS want UNION ALL SELECT 'xx', 30) USING (lang) WHERE n IS DISTINCT FROM want")
def group_budgets(spark, d):
    authored = spark.createDataFrame([("en", 100), ("xx", 5)], "lang string, authored bigint")
    return corpus.budget_breaches(read(spark, d, "documents"), "lang", 30, authored)


@query("SELECT table_name, n FROM (SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region)")
def manifest_counts(spark, d):
    return readers.table_counts(spark, {"nation": f"{d}/nation.parquet", "region": f"{d}/region.parquet"})


# ---------------------------------------------------------------- streams


def _event_stream(spark, d, columns):
    from ..streaming import messages

    source = read(spark, d, "events")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
    return messages.file_source(spark, f"{d}/events*.parquet", ddl, fmt="parquet").select("user_id", "event_id", *columns)


def _stream_messages(spark, d):
    return _event_stream(spark, d, [F.when(F.col("event_type") == "click", "A").otherwise("B").alias("branch"), (F.col("event_id") * 7919 % 1000).alias("seq")])


@query(ORACLE["sequence_high_water"])
def stream_high_water(spark, d):
    from ..streaming import messages, stateful

    out = messages.run_available(stateful.high_water(_stream_messages(spark, d), "user_id"), "high_water")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("stale").alias("n_stale"))


@query("""SELECT user_id, count(*) FILTER (g IS NULL OR g > 40) AS n_events FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events WHERE value >= 20) GROUP BY ALL""")
def stream_debounce(spark, d):
    from ..streaming import messages, stateful

    out = messages.run_available(stateful.debounced(_event_stream(spark, d, ["value"]), "user_id", "event_id", "value", 20.0, 40), "debounce")
    return out.groupBy("user_id").agg(F.count("*").alias("n_events"))


@query(_FSM_SQL)
def stream_flight_states(spark, d):
    from ..streaming import messages, stateful

    names = F.array(*map(F.lit, _INTENTS))
    intent = F.element_at(names, (F.pmod(F.col("event_id") * 31 + F.col("user_id"), F.lit(len(_INTENTS))) + 1).cast("int")).alias("intent")
    out = messages.run_available(stateful.flight_states(_event_stream(spark, d, [intent]), "user_id"), "flight")
    return out.groupBy("user_id").agg(F.max_by("state", "event_id").alias("final_state"), F.count("dispatched").alias("n_dispatched"))


@query(_END_SQL)
def stream_endpoints(spark, d):
    from ..streaming import messages, stateful

    e = _event_stream(spark, d, [F.least(F.abs("value") / 100, F.lit(1.0)).alias("p")])
    return messages.run_available(stateful.endpoints(e, "user_id", "event_id", "p", silence=3, pad=1, longest=12), "endpoints")


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch(ts) AS at FROM events) SELECT u.user_id, u.event_id, (SELECT min(r.at) FROM e r WHERE r.user_id = u.user_id AND r.event_type = 'click' AND r.event_id < u.event_id AND r.at >= u.at - 3600
 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.user_id = u.user_id AND o.event_type = 'view' AND o.event_id > r.event_id AND o.event_id < u.event_id AND r.at < o.at - 3600)) AS reflex FROM e u WHERE event_type = 'view'""")
def stream_reflex_gate(spark, d):
    from ..streaming import messages, stateful

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    kind = F.when(F.col("event_type") == "click", "reflex").when(F.col("event_type") == "view", "utterance")
    e = _event_stream(spark, d, [kind.alias("kind"), F.when(kind == "reflex", at).otherwise(at - 3600).alias("at")]).where("kind is not null")
    return messages.run_available(stateful.reflex_gate(e, "user_id", "event_id", 7200.0), "reflex")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (branch = 'A') AS n_a FROM (SELECT user_id, CASE WHEN event_type = 'click' THEN 'A' WHEN event_type = 'view' THEN 'B' ELSE 'C' END AS branch FROM events) WHERE branch <> 'C' GROUP BY user_id")
def message_envelope(spark, d):
    """Messages written to the wire form and read back; unknown branches are dropped."""
    from ..streaming import messages

    e = read(spark, d, "events")
    branch = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B").otherwise("C")
    wire = e.select(messages.to_wire(F.col("event_id"), branch, F.to_json(F.struct("user_id")), F.lit(0.0)).alias("value"))
    back = messages.from_wire(wire).select(F.get_json_object("command", "$.user_id").cast("bigint").alias("user_id"), "branch")
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("branch") == "A").alias("n_a"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def event_ring(spark, d):
    from ..streaming import messages

    return messages.ring(read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


# ---------------------------------------------------------------- recorded runs


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, list({'c': o_orderstatus = 'F', 'd': CASE WHEN o_orderkey % 3 = 0 THEN 'hover' ELSE 'move' END} ORDER BY o_orderkey) AS s FROM orders GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n, avg(list_bool_and(list_transform(s, lambda x: x.c))::INT) AS "right", avg(s[len(s)].c::INT) AS right_last, sum(len(s) % 4)::DOUBLE / sum(len(s)) AS error_rate,
 count(*) FILTER (NOT list_bool_and(list_transform(s, lambda x: x.c)) AND list_bool_and(list_transform(s, lambda x: x.d = 'hover')))::DOUBLE / nullif(count(*) FILTER (NOT list_bool_and(list_transform(s, lambda x: x.c))), 0) AS safe_failures, sum(len(s))::BIGINT AS n_segments FROM s GROUP BY o_orderpriority""")
def condition_summary(spark, d):
    from ..operators import experiments

    o = read(spark, d, "orders")
    seg = F.struct(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("correct"), F.when(F.col("o_orderkey") % 3 == 0, "hover").otherwise("move").alias("dispatched"))
    items = o.groupBy("o_custkey", "o_orderpriority").agg(F.array_sort(F.collect_list(seg)).alias("segments")).withColumn("words", F.size("segments")).withColumn("errors", F.col("words") % 4)
    return experiments.condition_summary(items, "o_orderpriority", "segments", "errors", "words")


def _keyword_trials(spark, d):
    """Each user's events as one keyword trial of their commonest type."""
    e = read(spark, d, "events")
    ev = F.struct(F.col("event_id").alias("at"), F.col("event_type").alias("intent"), (F.col("event_id") % 50).cast("int").alias("frame_index"), F.col("value").alias("latency_offset_ms"),
                  (F.col("event_id") % 2 == 0).alias("in_flight"), (F.col("event_id") % 3 == 0).alias("aborted"), F.col("value").alias("abort_return_ms"), (F.col("value") * 2).alias("server_idle_ms"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(ev)).alias("events")).withColumn("truth", F.when(F.col("user_id") % 2 == 0, "click").otherwise("view")).withColumn("offset_s", F.lit(0.5))


_TRIALS = "t AS (SELECT user_id, list({'i': event_type, 'f': event_id % 50, 'v': value, 'r': event_id % 2 = 0 AND event_id % 3 = 0} ORDER BY event_id) AS ev, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END AS truth FROM events GROUP BY user_id)"


@query(f"WITH {_TRIALS}, x AS (SELECT truth, list_transform(ev, lambda e: e.i) AS i FROM t) SELECT truth, count(*) AS n, count(*) FILTER (list_contains(i, 'click')) AS fired_click, count(*) FILTER (list_contains(i, 'view')) AS fired_view, count(*) FILTER (NOT list_contains(i, truth)) AS missed FROM x GROUP BY truth")
def cross_trigger(spark, d):
    from ..operators import experiments

    return experiments.cross_trigger(_keyword_trials(spark, d), "truth", "events", ["click", "view"])


@query(f"""WITH {_TRIALS}, o AS (SELECT truth, list_filter(ev, lambda e: e.i = truth)[1] AS e FROM t), m AS (SELECT truth, e.v AS v, ((e.f + 1) * 0.08 - 0.5) * 1000 AS a, e.r AS r FROM o WHERE e IS NOT NULL),
l AS (SELECT truth, 'offset' AS measure, v AS value FROM m UNION ALL SELECT truth, 'algorithmic', a FROM m UNION ALL SELECT truth, 'system', v - a FROM m UNION ALL SELECT truth, 'recovery', greatest(v, v * 2) FROM m WHERE r)
SELECT truth, measure, count(*) AS n, sum(value) AS total, max(value) AS highest FROM l GROUP BY ALL""")
def keyword_measures(spark, d):
    from ..operators import experiments

    m = experiments.keyword_measures(_keyword_trials(spark, d), ["truth"], "truth", "events", "offset_s")
    return m.groupBy("truth", "measure").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest"))


@query("""WITH x AS (SELECT label, list_position(list_transform(embedding, lambda v: v >= 0.25), true) AS p FROM embeddings WHERE len(embedding) > 0) SELECT label, count(*) AS n, avg((p IS NULL OR p = 0)::INT) AS missed, avg(CASE WHEN p > 0 THEN p * 0.08 - 0.5 END) AS delay_s FROM x GROUP BY label""")
def trace_scores(spark, d):
    from ..operators import experiments

    return experiments.trace_scores(read(spark, d, "embeddings").withColumn("end_s", F.lit(0.5)), "label", "embedding", "end_s", 0.25)


@query("""WITH c AS (SELECT p_partkey AS path, p_brand AS label, p_type AS voice, p_size AS base, 1 + p_retailprice / 1000 AS scale, CASE WHEN p_partkey % 3 = 0 THEN p_size * 0.1 END AS exact_length FROM part),
k AS (SELECT base, min(exact_length) AS length FROM c WHERE exact_length IS NOT NULL GROUP BY base), j AS (SELECT * FROM c LEFT JOIN k USING (base)), r AS (SELECT label, voice, quantile_cont(length / scale, 0.5) AS ratio FROM j WHERE length IS NOT NULL GROUP BY ALL)
SELECT path, 0.25::DOUBLE AS onset, 0.25 + coalesce(length, ratio * scale) AS "end", length IS NOT NULL AS exact FROM j LEFT JOIN r USING (label, voice)""")
def keyword_spans(spark, d):
    from ..operators import experiments

    p = read(spark, d, "part")
    clips = p.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("label"), F.col("p_type").alias("voice"), F.col("p_size").alias("base"), (1 + F.col("p_retailprice") / 1000).alias("length_scale"), F.lit(0.25).alias("onset"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 0.1).cast("double").alias("exact_length"))
    return experiments.keyword_spans(clips)


@query("""WITH c AS (SELECT vec_id, unnest(list_transform(embedding, lambda v: v::DOUBLE - list_avg(list_transform(embedding, lambda w: w::DOUBLE)))) AS v, unnest(range(len(embedding))) AS i FROM embeddings), f AS (SELECT vec_id, i // 8 AS frame, sqrt(avg(v * v)) AS level FROM c GROUP BY ALL)
SELECT vec_id, quantile_cont(level, 0.2) AS floor FROM f GROUP BY vec_id""")
def take_noise_floor(spark, d):
    from ..operators import experiments

    return experiments.noise_floor(read(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def take_reports(spark, d):
    """Quality gate of takes: measures, failures and warnings."""
    from ..operators import experiments

    takes = read(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 10)).alias("samples"))
    return experiments.take_report(takes, "vec_id", "samples", 400, F.lit(0.01))


@query("""WITH a AS (SELECT doc_id, quality AS l1, toxic AS t1 FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS l2, toxic AS t2 FROM labels)
SELECT count(*) AS n, avg((l1 = l2)::INT) AS exact, avg((l1 = l2)::INT) AS intent, 2.0 * sum((l1 = l2)::INT + (t1 = t2)::INT) / (4 * count(*)) AS slot_f1 FROM a JOIN b USING (doc_id)""")
def label_agreement(spark, d):
    from ..operators import experiments

    lab = read(spark, d, "labels")

    def side(q):
        label = F.concat(F.lit('{"intent":"'), q.cast("string"), F.lit('"}'))
        return lab.select("doc_id", label.alias("label"), label.alias("raw"), F.array(F.concat(F.lit("q="), q.cast("string")), F.concat(F.lit("t="), F.col("toxic").cast("string"))).alias("pairs"))

    return experiments.agreement(side(F.col("quality")), side(F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))), "doc_id")


@query("SELECT o_orderkey, round(epoch_us(l) / 86400e6 - epoch_us(o) / 86400e6, 2) AS days FROM (SELECT o_orderkey, o_orderdate AS o, max(l_shipdate) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)")
def gap_days(spark, d):
    from ..operators import experiments

    last = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("l"))
    return read(spark, d, "orders").join(last, "o_orderkey").select("o_orderkey", experiments.gap_days(F.col("o_orderdate").cast("timestamp"), F.col("l").cast("timestamp")).alias("days"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS amount, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def nested_counts(spark, d):
    from ..operators import experiments

    out = experiments.nested_counts(read(spark, d, "documents"), "lang", ["source"], "n_chars")
    return out.select("lang", "n", "amount", F.size("by_source").cast("bigint").alias("n_sources"))


@query("""WITH b AS (SELECT event_type AS text, 0 AS s, event_id AS o FROM events UNION ALL SELECT n_name, 1, n_nationkey FROM nation), f AS (SELECT text, min(s * 1000000000000 + o) AS p FROM b GROUP BY text)
SELECT text, CASE WHEN p < 1000000000000 THEN 'harvested' ELSE 'fallback' END AS provenance FROM f ORDER BY p LIMIT 10""")
def distinct_then_fill(spark, d):
    from ..operators import experiments

    rows = read(spark, d, "events").select(F.col("event_type").alias("text"), F.col("event_id").cast("bigint").alias("o"))
    fallback = read(spark, d, "nation").select(F.col("n_name").alias("text"), F.col("n_nationkey").cast("bigint").alias("o"))
    return experiments.distinct_then_fill(rows, fallback, "text", "o", 10)


@query("SELECT label, md5(string_agg(vec_id || ':' || len(embedding), ',' ORDER BY vec_id)) AS parts, sum(len(embedding))::INT AS n FROM embeddings GROUP BY label")
def concatenated_arrays(spark, d):
    from ..operators import experiments

    e = read(spark, d, "embeddings")
    whole = experiments.concatenated(e, "label", "vec_id", "embedding").select("label", F.size("embedding").alias("n"))
    named = e.groupBy("label").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.size("embedding").alias("k")))), lambda x: F.concat(x["vec_id"].cast("string"), F.lit(":"), x["k"].cast("string"))), ",")).alias("parts"))
    return whole.join(named, "label")


@query("SELECT source, doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.7 + 1e-9) THEN 'train' ELSE 'eval' END AS part FROM documents")
def fold_partition(spark, d):
    from ..operators import experiments

    return experiments.by_fold(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 0.7)
