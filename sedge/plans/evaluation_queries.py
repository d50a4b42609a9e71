"""Queries of the evaluation, integrity and link operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import command
from ..operators import evaluation, integrity, link, ordered, trials

from .catalogue import _LEAK_SQL
from .registry import NORM, SEED, query, read

# ---------------------------------------------------------------- predictions

#: Predictions as JSON: the raw answer, the gold and the predicted command of every event.
_RAW = """p AS (SELECT event_id, user_id % 4 AS model, event_type AS gold_intent, value AS yaw, event_id % 5 AS k,
  CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'hover' WHEN 2 THEN 'hover' WHEN 3 THEN event_type ELSE 'click' END AS dispatched FROM events),
r AS (SELECT *, CASE k WHEN 1 THEN '{"intent":"hover"}' WHEN 2 THEN 'junk' ELSE '{"intent":"' || dispatched || '"}' END AS raw, k = 4 AND gold_intent = 'click' AS correct,
  CASE WHEN k = 3 AND event_id % 2 = 0 THEN -yaw ELSE yaw + 1 END AS py FROM p)"""


def _raw_predictions(spark, d):
    k = F.col("event_id") % 5
    e = read(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("model"), F.col("event_type").alias("gold_intent"), F.col("value").alias("yaw"), k.alias("k"))
    e = e.withColumn("dispatched", F.when(F.col("k") == 0, "unknown").when(F.col("k").isin(1, 2), "hover").when(F.col("k") == 3, F.col("gold_intent")).otherwise("click"))
    raw = F.when(F.col("k") == 1, '{"intent":"hover"}').when(F.col("k") == 2, "junk").otherwise(F.concat(F.lit('{"intent":"'), "dispatched", F.lit('"}')))
    py = F.when((F.col("k") == 3) & (F.col("event_id") % 2 == 0), -F.col("yaw")).otherwise(F.col("yaw") + 1)
    label = lambda intent, yaw: F.concat(F.lit('{"intent":"'), intent, F.lit('","yaw":'), yaw.cast("string"), F.lit("}"))
    return e.select("model", "event_id", "gold_intent", "dispatched", raw.alias("raw"), ((F.col("k") == 4) & (F.col("gold_intent") == "click")).alias("correct"), label(F.col("gold_intent"), F.col("yaw")).alias("gold"), label(F.col("dispatched"), py).alias("predicted"))


@query(f"""WITH {_RAW} SELECT model, count(*) AS n, count(*) FILTER (NOT correct) AS errors, count(*) FILTER (NOT correct AND dispatched IN ('unknown', 'hover')) AS safe_failures,
 count(*) FILTER (NOT correct AND dispatched IN ('unknown', 'hover'))::DOUBLE / nullif(count(*) FILTER (NOT correct), 0) AS safe_failure_rate,
 count(*) FILTER (NOT correct AND dispatched = 'unknown') AS safe_model_unknown, count(*) FILTER (NOT correct AND k = 1) AS safe_model_hover, count(*) FILTER (NOT correct AND k = 2) AS safe_validator_fallback,
 count(*) FILTER (gold_intent <> 'unknown' AND dispatched = 'unknown') AS volunteered_unknown, CASE WHEN model = 3 THEN avg((dispatched <> 'unknown')::INT) END AS false_command_rate FROM r GROUP BY model""")
def abstention_grid(spark, d):
    return evaluation.abstention_grid(_raw_predictions(spark, d), ["model"], F.col("model") == 3)


@query(f"""WITH {_RAW}, c AS (SELECT CASE WHEN dispatched IN ('unknown', 'hover') THEN 'resolved to a safe action' WHEN dispatched = gold_intent THEN 'right intent, wrong parameters' ELSE 'wrong intent, still actionable' END AS class, dispatched = gold_intent AND yaw = -py AS flip FROM r WHERE NOT correct),
k(class) AS (VALUES ('right intent, wrong parameters'), ('wrong intent, still actionable'), ('resolved to a safe action'))
SELECT class, count(c.flip) AS n FROM k LEFT JOIN c USING (class) GROUP BY class UNION ALL SELECT 'yaw sign flips', count(*) FILTER (flip) FROM c UNION ALL SELECT 'total', count(*) FROM c""")
def error_taxonomy(spark, d):
    return evaluation.error_taxonomy(_raw_predictions(spark, d))


@query(f"WITH {_RAW} SELECT event_id, CASE k WHEN 0 THEN 'model_unknown' WHEN 1 THEN 'model_hover' WHEN 2 THEN 'validator_fallback' END AS origin FROM r")
def failure_origin(spark, d):
    return _raw_predictions(spark, d).select("event_id", evaluation.failure_origin(F.col("dispatched"), F.col("raw")).alias("origin"))


@query("""WITH s AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1) SELECT cause, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 7 = 0 THEN 'parser wrong on reference text' WHEN o_custkey % 5 = 0 THEN 'no segment' WHEN len(k) > 1 THEN 'split by endpointer' WHEN k[1] % 3 = 0 THEN 'perfect transcript, parser wrong' WHEN k[1] % 2 = 0 THEN 'ASR error, wrong intent' ELSE 'ASR error, right intent, wrong slot' END AS cause FROM s) GROUP BY cause""")
def failure_causes(spark, d):
    from ..operators import experiments

    s = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    segments = F.when(F.col("o_custkey") % 5 == 0, F.slice("k", 1, 0)).otherwise(F.col("k"))
    first = F.get("k", F.lit(0))
    cause = experiments.failure_cause(segments, F.col("o_custkey") % 7 != 0, first % 3, F.lit("move"), F.when(first % 2 == 0, "land").otherwise("move"))
    return s.select(cause.alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tests between groups

_MOMENTS = "g AS (SELECT {0} AS g, count({1}) AS n, avg({1}) AS m, coalesce(var_samp({1}), 0) AS v, min({1}) AS lo, max({1}) AS hi FROM {2} GROUP BY 1)"


@query(f"""WITH x AS (SELECT lang, asin(sqrt(quality::DOUBLE)) AS q FROM labels JOIN documents USING (doc_id)), {_MOMENTS.format('lang', 'q', 'x')}, t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * m) AS s, sum(n * m * m) AS s2, sum((n - 1) * v) AS w FROM g)
SELECT ((s2 - s * s / nn) / (k - 1)) / (w / (nn - k)) AS f, (k - 1)::BIGINT AS d1, (nn - k)::BIGINT AS d2, NULL::VARCHAR AS reason FROM t""")
def arcsine_anova(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", evaluation.arcsine(F.col("quality").cast("double")).alias("q"))
    return evaluation.anova_guarded(x, "lang", "q")


@query("""SELECT 'few' AS grp, NULL::DOUBLE AS f, 'a group has fewer than two values' AS reason UNION ALL SELECT 'equal', NULL, 'all values are equal' UNION ALL SELECT 'constant', NULL, 'every group is constant'""")
def anova_reasons(spark, d):
    """Tables on which the analysis doesn't apply: a group of one, equal values, constant groups."""
    n = read(spark, d, "nation").select("n_regionkey", "n_nationkey")
    cases = {"few": F.when((F.col("n_regionkey") > 0) | (F.col("n_nationkey") == 0), F.col("n_nationkey").cast("double")), "equal": F.lit(1.0), "constant": F.col("n_regionkey").cast("double")}
    out = None
    for name, value in cases.items():
        part = evaluation.anova_guarded(n.select("n_regionkey", value.alias("v")), "n_regionkey", "v").select(F.lit(name).alias("grp"), "f", "reason")
        out = part if out is None else out.unionByName(part)
    return out


_TUKEY = f"""WITH {_MOMENTS.format('event_type', 'value', 'events')}, t AS (SELECT count(*) AS k, sum(n) - count(*) AS dof, sum((n - 1) * v) AS w FROM g)
SELECT a.g AS a, b.g AS b, a.m - b.m AS difference, abs(a.m - b.m) / sqrt(w / dof / 2 * (1.0 / a.n + 1.0 / b.n)) AS q, k, dof::BIGINT AS dof FROM g a JOIN g b ON a.g < b.g, t"""


@query(_TUKEY)
def tukey_pairs(spark, d):
    return evaluation.tukey_pairs(read(spark, d, "events"), "event_type", "value")


@query()
def tukey_test(spark, d):
    """Tukey's honest differences with p-values; the studentised range has no SQL form and is tested against tables."""
    return evaluation.tukey(read(spark, d, "events"), "event_type", "value")


@query()
def condition_intervals(spark, d):
    """Four ratios of each order priority with bootstrap intervals; tested against resampling in numpy."""
    o = read(spark, d, "orders").withColumn("ok", (F.col("o_orderstatus") == "F").cast("int")).withColumn("em", (F.col("o_orderkey") % 3 == 0).cast("int"))
    one = F.lit(1)
    ratios = {"crr": (F.col("ok"), one), "wer": (F.col("o_orderkey") % 4, F.col("o_orderkey") % 9), "em_minus_crr": (F.col("em") - F.col("ok"), one), "safe_failure_rate": (((F.col("ok") == 0) & (F.col("em") == 1)).cast("int"), 1 - F.col("ok"))}
    return evaluation.ratio_intervals(o, "o_orderpriority", "o_orderkey", ratios, SEED)


# ---------------------------------------------------------------- trials

_STAGES = ["l_quantity", "l_discount"]


@query("""WITH t AS (SELECT l_returnflag AS config, l_partkey AS item_id, CASE WHEN l_linenumber <> 2 THEN (l_linestatus = 'F')::INT END AS correct, l_extendedprice AS rss, l_tax * 100 AS temp, (l_linenumber = 3)::INT AS hot, l_linenumber AS tokens, nullif(l_quantity, 1) AS decode, l_quantity, l_discount, CASE WHEN l_linenumber > 1 THEN l_extendedprice END AS total FROM lineitem)
SELECT config, count(total) AS n_latency, count(DISTINCT CASE WHEN correct IS NOT NULL THEN item_id END) AS n_accuracy, round(avg(correct), 6) AS accuracy, round(max(rss), 2) AS peak_rss_mb, round(max(temp), 1) AS max_temperature_c, count(*) FILTER (hot = 1) AS throttled_trials,
 count(l_quantity) AS l_quantity_n, round(quantile_disc(l_quantity, 0.5), 2) AS l_quantity_p50, round(quantile_disc(l_quantity, 0.95), 2) AS l_quantity_p95, round(quantile_disc(l_quantity, 0.99), 2) AS l_quantity_p99,
 count(l_discount) AS l_discount_n, round(quantile_disc(l_discount, 0.5), 2) AS l_discount_p50, round(quantile_disc(l_discount, 0.95), 2) AS l_discount_p95, round(quantile_disc(l_discount, 0.99), 2) AS l_discount_p99,
 count(total) AS total_ms_n, round(quantile_disc(total, 0.5), 2) AS total_ms_p50, round(quantile_disc(total, 0.95), 2) AS total_ms_p95, round(quantile_disc(total, 0.99), 2) AS total_ms_p99,
 round(count(*) FILTER (hot = 1)::DOUBLE / count(total), 4) AS throttled_fraction, round((sum(tokens) FILTER (decode IS NOT NULL))::DOUBLE / sum(decode / 1000.0), 2) AS tokens_per_second FROM t GROUP BY config""")
def trial_summary(spark, d):
    li = read(spark, d, "lineitem")
    t = li.select(
        F.col("l_returnflag").alias("config"), F.col("l_partkey").alias("item_id"), F.when(F.col("l_linenumber") != 2, (F.col("l_linestatus") == "F").cast("int")).alias("correct"), F.col("l_extendedprice").alias("peak_rss_mb"),
        (F.col("l_tax") * 100).alias("temperature_c"), (F.col("l_linenumber") == 3).cast("int").alias("throttled_now"), F.col("l_linenumber").alias("tokens_predicted"), F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("slm_decode_ms"),
        *_STAGES, F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")).alias("total_ms"),
    )
    return evaluation.trial_summary(t, ["config"], _STAGES)


@query("""WITH s AS (SELECT l_returnflag AS host, l_quantity AS stt, l_linenumber::DOUBLE AS queue, l_tax AS prefill, l_discount AS decode, l_linestatus = 'F' AS done FROM lineitem),
l AS (SELECT host, 'stt' AS measure, stt AS value FROM s UNION ALL SELECT host, 'queue', queue FROM s UNION ALL SELECT host, 'llm', prefill + decode FROM s WHERE done UNION ALL SELECT host, 'http', stt - prefill - decode FROM s WHERE done)
SELECT host, measure, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS highest FROM l GROUP BY ALL""")
def segment_measures(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("host"), F.col("l_quantity").alias("stt"), F.col("l_linenumber").alias("queue"), F.col("l_tax").alias("prefill"), F.col("l_discount").alias("decode"), (F.col("l_linestatus") == "F").alias("done"))
    derived = {"llm": F.col("prefill") + F.col("decode"), "http": F.col("stt") - F.col("prefill") - F.col("decode")}
    return trials.percentiles(evaluation.segment_measures(s, ["host"], ["stt", "queue"], derived, F.col("done")), ["host", "measure"])


@query("""WITH i AS (SELECT o_totalprice + o_custkey AS total FROM orders), a AS (SELECT count(*) AS n, quantile_disc(total, 0.5) AS p50, quantile_disc(total, 0.95) AS p95 FROM i)
SELECT 'one host' AS run, n, p50, p95 FROM a UNION ALL SELECT 'two hosts', n, CASE WHEN n < 0 THEN p50 END, CASE WHEN n < 0 THEN p95 END FROM a""")
def stage_sums(spark, d):
    """Sums of stages over all orders: once measured on one host throughout, once on two, where no percentile may be given."""
    from ..operators import experiments

    seg = F.struct(F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    items = read(spark, d, "orders").select(F.array(seg).alias("segments"), "o_orderpriority")
    of = lambda name, host: experiments.stage_sums(items.withColumn("host", host), "segments", ["a", "b"], "host", "board").select(F.lit(name).alias("run"), "n", "p50", "p95")
    return of("one host", F.lit("board")).unionByName(of("two hosts", F.when(F.col("o_orderpriority") == "1-URGENT", "desk").otherwise("board")))


@query("""WITH a AS (SELECT o_orderpriority AS config, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS config, avg(o_totalprice) AS w FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), c AS (SELECT config, 100.0 * (w - v) / v AS change FROM a JOIN b USING (config))
SELECT count(*) AS n, max(change) AS worst, avg(change) AS mean, arg_max(config, change) AS worst_at FROM c""")
def headroom_report(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_orderpriority", "config")
    mean = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("config").agg(F.avg("o_totalprice").alias("v"))
    return evaluation.headroom_report(mean("F"), mean("O"), "config", "v")


@query("SELECT p_size, count(*) AS n FROM part WHERE p_size = 25 GROUP BY p_size")
def operating_point(spark, d):
    curve = read(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return evaluation.operating_point(curve, "p_size", 25)


@query("""WITH b AS (SELECT event_type AS class, user_id AS take, max(value) AS best, bool_or(value > 150) AS fired FROM events GROUP BY ALL) SELECT class, count(*) AS n, avg(fired::INT) AS share, coalesce(list(take ORDER BY take) FILTER (NOT fired), []) AS missed, avg(best) AS mean_best FROM b GROUP BY class""")
def class_misses(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("class"), F.col("user_id").alias("take"), "value", (F.col("value") > 150).alias("fired"))
    return evaluation.class_misses(e, "class", "take", "value", "fired")


@query()
def stream_rates(spark, d):
    """Debounced events of each class with their rate an hour and its exact interval; the Poisson quantile has no SQL form."""
    fired = ordered.debounced(read(spark, d, "events"), ["event_type"], "event_id", "value", 20.0, 40).groupBy("event_type").agg(F.count("*").alias("n"))
    return evaluation.stream_rates(fired, "event_type", F.lit(24.0))


@query("""WITH u AS (SELECT 'read' AS pool, source AS bucket, doc_id % 5 AS e, n_chars AS w FROM documents WHERE lang = 'en' UNION ALL SELECT 'free', source, doc_id % 7, n_chars FROM documents WHERE lang = 'de' UNION ALL SELECT 'other', source, doc_id % 3, n_chars FROM documents WHERE lang = 'fr' UNION ALL SELECT 'rest', source, doc_id % 2, n_chars FROM documents WHERE lang = 'es'),
r AS (SELECT pool, bucket, count(*) AS n, sum(e)::DOUBLE / nullif(sum(w), 0) AS rate FROM u GROUP BY ALL), g AS (SELECT bucket, max(rate) FILTER (pool = 'read') - max(rate) FILTER (pool = 'free') AS gap FROM r GROUP BY bucket)
SELECT pool, bucket, n, rate, CASE WHEN pool = 'read' THEN gap END AS gap FROM r JOIN g USING (bucket)""")
def prompted_gap(spark, d):
    docs = read(spark, d, "documents")
    pools = {name: docs.where(F.col("lang") == lang).select("source", (F.col("doc_id") % m).alias("e"), F.col("n_chars").alias("w")) for name, lang, m in (("read", "en", 5), ("free", "de", 7), ("other", "fr", 3), ("rest", "es", 2))}
    return evaluation.prompted_gap(pools, "source", "e", "w", "read", "free")


# ---------------------------------------------------------------- report relations


@query("""WITH a AS (SELECT source, lang, avg(n_chars) AS f1, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT source, max(n_chars) AS p95 FROM documents WHERE n_chars < 500 GROUP BY source) SELECT source, lang, CASE WHEN lang <> 'de' THEN f1 END AS f1, n, p95 FROM a LEFT JOIN t USING (source)""")
def accuracy_with_timing(spark, d):
    docs = read(spark, d, "documents")
    a = docs.groupBy("source", "lang").agg(F.avg("n_chars").alias("f1"), F.count("*").alias("n"))
    t = docs.where("n_chars < 500").groupBy("source").agg(F.max("n_chars").alias("p95"))
    return evaluation.accuracy_with_timing(a, t, ["source"], F.col("lang") == "de", "f1", ["p95"])


@query("""WITH r AS (SELECT source AS model, avg(n_chars) AS reference FROM documents WHERE lang = 'en' GROUP BY 1), p AS (SELECT source AS model, lang AS quant, avg(n_chars) AS deployed FROM documents WHERE lang <> 'en' GROUP BY ALL), t AS (SELECT source AS model, lang AS quant, count(*) AS b FROM documents WHERE lang = 'de' GROUP BY ALL)
SELECT model, quant, deployed, reference, b, 100.0 * (deployed - reference) AS delta, CASE WHEN deployed - reference IS NULL THEN '--' ELSE CASE WHEN deployed < reference THEN '−' ELSE '+' END || printf('%.1f', abs(100.0 * (deployed - reference))) END AS delta_text FROM p LEFT JOIN r USING (model) LEFT JOIN t USING (model, quant)""")
def quantisation_delta(spark, d):
    docs = read(spark, d, "documents").withColumnsRenamed({"source": "model", "lang": "quant"})
    score = lambda df, *keys: df.groupBy(*keys).agg(F.avg("n_chars").alias("score"))
    tests = docs.where("quant = 'de'").groupBy("model", "quant").agg(F.count("*").alias("b"))
    return evaluation.quantisation_delta(score(docs.where("quant = 'en'"), "model"), score(docs.where("quant <> 'en'"), "model", "quant"), tests, "model", ["quant"], "score")


@query("SELECT 'matched' AS part, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'unmatched', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def split_by_match(spark, d):
    measured = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("p95"))
    a, b = evaluation.split_by_match(read(spark, d, "customer"), measured, "c_custkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a, "matched").unionByName(count(b, "unmatched"))


@query("SELECT family, a, b, only_a FROM (VALUES ('quant', 'en', 'de'), ('quant', 'en', 'fr'), ('quant', 'es', 'de'), ('quant', 'es', 'fr')) p(family, a, b) LEFT JOIN (SELECT lang AS a, count(*) AS only_a FROM documents GROUP BY lang) USING (a)")
def declared_tests(spark, d):
    """Declared pairs of configurations, the tests of one family, with a count of the first."""
    pairs = evaluation.declared_pairs(spark, ("quant", ["en", "es"], ["de", "fr"]), ("control", ["en"], ["en", "it"]))
    chosen = evaluation.indexed_tests(pairs, "quant").withColumn("family", F.lit("quant"))
    return chosen.join(read(spark, d, "documents").groupBy(F.col("lang").alias("a")).agg(F.count("*").alias("only_a")), "a", "left").select("family", "a", "b", "only_a")


@query("""WITH g AS (SELECT source, avg((lang = 'en')::INT) AS rate FROM documents GROUP BY source) SELECT source, rate, CASE WHEN rate <= 0.5 THEN 'MEETS' ELSE 'MISS' END AS verdict FROM g""")
def verdict_table(spark, d):
    g = read(spark, d, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("rate"))
    return evaluation.with_verdict(g, "rate", 0.5).orderBy("source")


@query("WITH g AS (SELECT source, avg(n_chars) AS v FROM documents GROUP BY source) SELECT source, v FROM g ORDER BY v, source LIMIT 1")
def weakest_group(spark, d):
    return evaluation.weakest(read(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("v")), "source", "v")


@query("SELECT printf('%.1f to %.1f over %d trials', min(value), max(value), count(*)) AS state FROM events WHERE event_type = 'view'")
def run_state(spark, d):
    return evaluation.run_state(read(spark, d, "events"), "value", F.col("event_type") == "view")


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def corpus_sizes(spark, d):
    return evaluation.corpus_sizes(read(spark, d, "documents"), "source", "n_chars")


@query("SELECT source, (sum(n_chars) FILTER (lang = 'en'))::BIGINT AS en, (sum(n_chars) FILTER (lang = 'de'))::BIGINT AS de, min(n_chars) AS least, max(n_chars) AS greatest FROM documents GROUP BY source")
def sizes_by_split(spark, d):
    return evaluation.sizes_by_split(read(spark, d, "documents"), "source", "lang", "n_chars", ["en", "de"])


# ---------------------------------------------------------------- integrity


@query("""SELECT 'total' AS "check", '25' AS detail UNION ALL SELECT 'split', n_regionkey || ' ' || n || ' of 4' FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) WHERE n <> 4 AND n_regionkey < 2 UNION ALL SELECT 'split', '9 0 of 3'""")
def cardinality_findings(spark, d):
    return integrity.cardinality_findings(read(spark, d, "nation").withColumn("r", F.col("n_regionkey").cast("string")), "n_nationkey", "r", 24, {"0": 4, "1": 4, "9": 3})


@query("""SELECT 'missing' AS "check", 'it' AS detail UNION ALL SELECT 'unexpected', lang FROM (SELECT DISTINCT lang FROM documents) WHERE lang NOT IN ('de', 'en', 'it')""")
def coverage_findings(spark, d):
    return integrity.coverage_findings(read(spark, d, "documents"), "lang", ["de", "en", "it"])


@query("""WITH a AS (SELECT DISTINCT source AS k FROM documents WHERE lang = 'en'), e AS (SELECT DISTINCT source AS k FROM documents WHERE lang = 'de'), u AS (SELECT DISTINCT n_name AS k FROM nation UNION SELECT DISTINCT source FROM documents WHERE lang = 'fr')
SELECT 'shared' AS "check", k AS detail FROM a JOIN e USING (k) UNION ALL SELECT 'strayed', k FROM u WHERE k NOT IN (SELECT k FROM a)""")
def partition_findings(spark, d):
    docs = read(spark, d, "documents")
    used = read(spark, d, "nation").select(F.col("n_name").alias("source")).unionByName(docs.where("lang = 'fr'").select("source"))
    return integrity.partition_findings(docs.where("lang = 'en'"), docs.where("lang = 'de'"), used, "source")


@query("""WITH c AS (SELECT user_id AS base, CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, nullif(event_type, 'error') AS rir, CASE WHEN event_id % 3 = 0 THEN 'eval' WHEN event_id % 100 = 1 THEN 'eval' ELSE 'aug' END AS part FROM events)
SELECT 'straddling' AS "check", base::VARCHAR AS detail FROM c GROUP BY base HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'shared rir', rir FROM c WHERE rir IS NOT NULL GROUP BY rir HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'partition', split || ' ' || part || ' ' || count(*) FROM c WHERE rir IS NOT NULL AND part <> CASE split WHEN 'test' THEN 'eval' ELSE 'aug' END GROUP BY split, part UNION ALL SELECT 'hours', round(sum(1.0::DOUBLE) / 3600, 2)::VARCHAR FROM c HAVING sum(1.0) / 3600 < 1000""")
def clip_findings(spark, d):
    k = F.col("event_id")
    clips = read(spark, d, "events").select(F.col("user_id").alias("base"), F.when(k % 3 == 0, "test").otherwise("train").alias("split"), F.nullif(F.col("event_type"), F.lit("error")).alias("rir"), F.when((k % 3 == 0) | (k % 100 == 1), "eval").otherwise("aug").alias("part"), F.lit(1.0).alias("s"))
    return integrity.clip_findings(clips, "base", "split", ["rir"], "part", {"test": "eval", "train": "aug"}, "test", "s", 1000.0)


_LEAK_NORM = NORM.format("text")


@query(f"""WITH r AS (SELECT source FROM documents WHERE lang = 'en'), h AS (SELECT source FROM documents WHERE lang <> 'en'), leaks AS ({_LEAK_SQL.replace("h.doc_id % 2 = 1 AND r.doc_id % 2 = 0 @on", "h.lang <> 'en' AND r.lang = 'en'")})
SELECT 'family' AS "check", source AS detail FROM (SELECT source FROM r INTERSECT SELECT source FROM h) UNION ALL SELECT 'text', held || ' ' || CASE score WHEN 1 THEN 'equal or same words' ELSE 'near' END FROM leaks""")
def family_leakage(spark, d):
    """Families on both sides of a split, and every held-out text that equals or resembles one of the reference."""
    docs = read(spark, d, "documents")
    return integrity.split_leakage(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), "doc_id", "text", "source", most=None)


@query("SELECT c_custkey FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '  ' END AS accents, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE (c_custkey % 4)::VARCHAR END AS up, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 2)::VARCHAR END AS down FROM customer) WHERE trim(accents) <> '' AND try_cast(up AS INT) >= 2 AND try_cast(down AS INT) <= 0")
def eligible_clips(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise("  ").alias("accents"), F.when(k % 5 == 0, "x").otherwise((k % 4).cast("string")).alias("up_votes"), F.when(k % 7 != 0, (k % 2).cast("string")).alias("down_votes"))
    return integrity.eligible(c).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_totalprice BETWEEN 1000 AND 50000 ORDER BY o_orderkey LIMIT 300")
def members_in_range(spark, d):
    sample = read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return integrity.members_in_range(read(spark, d, "orders"), sample, "o_custkey", "o_totalprice", 1000, 50000, 300, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, variant, CASE variant WHEN 'asr_20db' THEN 20 WHEN 'asr_10db' THEN 10 END AS snr FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'asr_20db' WHEN 2 THEN 'asr_10db' ELSE 'perturbed' END AS variant FROM documents WHERE lang = 'en') WHERE variant LIKE 'asr%'")
def roundtrip_plan(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "train").otherwise("val").alias("split"))
    names = F.array(*map(F.lit, ("clean", "asr_20db", "asr_10db", "perturbed")))
    variants = docs.select("doc_id", F.get(names, (F.col("doc_id") % 4).cast("int")).alias("variant"))
    return integrity.roundtrip_plan(docs, variants, "doc_id", "split").select("doc_id", "variant", integrity.noise_level(F.col("variant")).alias("snr"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, lower(n_name), n_regionkey FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT 100, 'new', 0")
def merge_without_drift(spark, d):
    old = read(spark, d, "nation")
    new = old.where("n_nationkey % 2 = 1").withColumn("n_name", F.lower("n_name")).unionByName(spark.createDataFrame([(100, "new", 0)], old.schema))
    return integrity.merge_without_drift(old, new, ["n_nationkey"], ["n_regionkey"])


@query("WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT CASE WHEN n >= 80 THEN p_brand ELSE 'Other' END AS p_brand, count(*) AS n FROM part JOIN n USING (p_brand) GROUP BY 1")
def pooled_labels(spark, d):
    return integrity.pooled(read(spark, d, "part"), "p_brand", 80).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT event_id, round(value, 1) AS value FROM events")
def rounded_floats(spark, d):
    return integrity.round_floats(read(spark, d, "events").select("event_id", "value"))


@query("""SELECT n_name, CASE n_regionkey WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE n_regionkey = 3 END AS ok FROM nation""")
def pattern_within(spark, d):
    r = F.col("n_regionkey")
    pattern = F.when(r == 0, "shape:circle, radius,ids").when(r == 1, "ids").when(r == 2, "shape:line,depth").when(r == 3, "radius").otherwise("dir:up")
    n = read(spark, d, "nation").withColumn("p", pattern)
    return n.select("n_name", (integrity.pattern_within(F.col("p"), F.array(*map(F.lit, command.SLOTS["formation"]))) & (F.size(F.map_keys(integrity.checked_pattern(F.col("p")))) > 0)).alias("ok"))


@query("""WITH l AS (SELECT '{"intent":"altitude","z":' || printf('%.2f', value) || '}' AS label, printf('%.2f', value) AS v FROM events), u AS (SELECT label, any_value(v) AS v, count(*) AS n FROM l GROUP BY label) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_labels, count(*) FILTER (NOT regexp_full_match(v, '-?[0-9]{1,3}(\\.[0-9])?')) AS n_rejected FROM u""")
def grammar_report(spark, d):
    label = F.concat(F.lit('{"intent":"altitude","z":'), F.format_string("%.2f", "value"), F.lit("}"))
    return integrity.grammar_report(read(spark, d, "events").select(label.alias("label")), "label", command.accepted(F.col("label")))[1]


@query(f"""WITH p AS (SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS r, {_LEAK_NORM} AS t FROM documents) SELECT arg_min(doc_id, r * 1000000000000 + doc_id) AS doc_id FROM p WHERE t IS NOT NULL GROUP BY t""")
def unique_across_splits(spark, d):
    return integrity.unique_across(read(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id", "text", "lang", ["en", "de", "fr", "es"]).select("doc_id")


# ---------------------------------------------------------------- link


@query("""WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts + to_milliseconds((value * 100000)::BIGINT), event_id) AS arrival FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (arrival <> seq) AS n_moved FROM m GROUP BY user_id""")
def reserved_order(spark, d):
    """Messages numbered when processing starts and ordered when it ends."""
    done = F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 100000).cast("bigint") * 1000
    m = link.reserved(read(spark, d, "events").withColumn("done", done), "user_id", ["event_id"], ["done", "event_id"])
    return m.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("arrival") != F.col("seq")).alias("n_moved"))


@query("""WITH s AS (SELECT user_id, event_id // 4 AS step, event_id % 4 AS place, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B-stale' ELSE 'B' END AS path, event_type AS intent FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step, path <> 'B-stale', place) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY step, path = 'B-stale', place) AS arrival FROM s)
SELECT user_id, step, seq, arrival, CASE path WHEN 'A' THEN 'A' ELSE 'B' END AS branch, intent FROM n""")
def scripted_messages(spark, d):
    """Each user's events as a script: views are numbered before the others of their step and sent after them."""
    e = read(spark, d, "events")
    path = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B-stale").otherwise("B")
    steps = e.select("user_id", F.expr("event_id div 4").alias("step"), (F.col("event_id") % 4).alias("place"), path.alias("path"), F.col("event_type").alias("intent"))
    return link.scripted(steps, "user_id")


@query("SELECT user_id, stretch, arg_max(event_id, ts * 1000000 + event_id) AS event_id FROM (SELECT user_id, event_id, epoch_us(ts)::HUGEINT AS ts, floor(round(epoch(ts) / 3600, 6))::BIGINT AS stretch FROM events) GROUP BY ALL")
def sampled_trajectory(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return link.sampled(read(spark, d, "events").select("user_id", "event_id", t.alias("t")), ["user_id"], "t", 3600.0).select("user_id", "stretch", "event_id")


@query("""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS d, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),
p AS (SELECT a.k, a.d AS a, b.d AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM t a JOIN t b ON a.k = b.k AND a.d < b.d) SELECT k, count(*) FILTER (distance < 5) AS n_below, min(distance) AS distance FROM p GROUP BY k""")
def closest_drones(spark, d):
    """Lines of an order as drones of a tick: the closest two, and how many pairs are too close."""
    row = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    t = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("d")).agg(F.min(row).alias("r")).select("k", "d", F.col("r.l_quantity").alias("x"), (F.col("r.l_discount") * 100).alias("y"), (F.col("r.l_tax") * 100).alias("z"))
    return link.closest_pairs(t, ["k"], "d", 5.0).select("k", "n_below", "distance")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, avg((l_discount <= 0.05)::INT) AS share FROM lineitem GROUP BY ALL) SELECT l_orderkey, min(l_linenumber) FILTER (share >= 0.85) AS first FROM s GROUP BY l_orderkey""")
def settled_ticks(spark, d):
    shares = link.in_slot_shares(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_discount", 0.05)
    return link.first_settled(shares, ["l_orderkey"], "l_linenumber")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'discarded: older than reflex #7' WHEN event_id % 4 = 1 THEN 'logged, never dispatched' WHEN event_id % 4 = 2 THEN 'rejected in FLYING -> hold position' ELSE event_type END AS said FROM events")
def consumer_outcomes(spark, d):
    k = F.col("event_id") % 4
    asked = F.when(k == 1, "unknown").otherwise(F.col("event_type"))
    sent = F.when(k == 1, F.lit(None).cast("string")).when(k == 2, "hover").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", link.outcome_text(k == 0, F.lit(7), F.lit("FLYING"), asked, sent).alias("said"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN event_type ELSE event_type || ' (value ' || floor(value)::BIGINT || ', user ' || user_id || ')' END AS said FROM events")
def command_texts(spark, d):
    slots = F.when(F.col("event_id") % 2 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("value"), F.floor("value").cast("string"), F.lit("user"), F.col("user_id").cast("string")))
    return read(spark, d, "events").select("event_id", link.command_text(F.col("event_type"), slots).alias("said"))


