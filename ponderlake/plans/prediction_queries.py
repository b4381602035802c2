"""Queries over model predictions: tables of counts, transitions, information theory, tests, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statistics as S
from ..operators import audit, bootstrap, infotheory, permutation, significance, tables
from .base import LONG_SQL, PRED_SQL, predictions
from .registry import query, read

R6 = lambda c: F.round(c, 6)
WITH = f"WITH {PRED_SQL}"
LONG = f"WITH {PRED_SQL}, {LONG_SQL}"
PATTERN_SQL = "(SELECT unnest(['KKK', 'KKN', 'KNK', 'KNN', 'NKK', 'NKN', 'NNK', 'NNN']))"


def A():
    """Whether the first model is right."""
    return F.col("pred_a") == F.col("gold")


def B():
    return F.col("pred_b") == F.col("gold")


TR = "CASE WHEN pred_a = gold AND pred_b = gold THEN 'CC' WHEN pred_a = gold THEN 'CW' WHEN pred_b = gold THEN 'WC' ELSE 'WW' END"


def _long(spark, d):
    return tables.long_models(predictions(spark, d), {m: f"pred_{m}" for m in "abc"}, ("id", "gold", "lang", "source"))


@query(
    "agg_metrics",
    f"{LONG} SELECT model, count(*) AS count, round(avg(CAST(pred = gold AS INT)), 6) AS exact_accuracy, "
    f"round(avg(CAST(pred <> 'invalid' AS INT)), 6) AS format_accuracy, round(avg(CAST(pred <> 'invalid' AS INT)), 6) "
    f"AS parse_success_rate, round(avg(length(source)), 6) AS average_response_chars, round(avg(CAST(lang = 'en' AS "
    f"INT)), 6) AS repetition_rate FROM lng GROUP BY model"
)
def agg_metrics(spark, d):
    ok = F.col("pred") != "invalid"
    x = tables.metrics(
        _long(spark, d), ["model"], F.col("pred") == F.col("gold"), ok, ok, F.length("source"), F.col("lang") == "en"
    )
    return x.select("model", "count", *[R6(F.col(c)).alias(c) for c in x.columns[2:]])


@query("agg_distribution", f"{LONG} SELECT model, pred, count(*) AS n FROM lng GROUP BY model, pred")
def agg_distribution(spark, d):
    return tables.distribution(_long(spark, d), "model", "pred")


@query(
    "agg_crosstab",
    f"{WITH}, f AS (SELECT DISTINCT source FROM pred), c AS (SELECT gold, source, count(*) AS n FROM pred GROUP BY ALL) "
    f"SELECT g.gold, f.source, coalesce(c.n, 0) AS n FROM {PATTERN_SQL} g(gold) CROSS JOIN f LEFT JOIN c ON c.gold = "
    f"g.gold AND c.source = f.source"
)
def agg_crosstab(spark, d):
    return tables.crosstab(predictions(spark, d), "gold", "source", tables.labels(spark, name="gold"))


@query(
    "agg_confusion",
    f"{WITH}, c AS (SELECT gold, pred_a, count(*) AS n FROM pred WHERE pred_a <> 'invalid' GROUP BY ALL) SELECT g.gold, "
    f"p.pred_a, coalesce(c.n, 0) AS n FROM {PATTERN_SQL} g(gold) CROSS JOIN {PATTERN_SQL} p(pred_a) LEFT JOIN c ON "
    f"c.gold = g.gold AND c.pred_a = p.pred_a"
)
def agg_confusion(spark, d):
    return tables.confusion(predictions(spark, d), "gold", "pred_a")


_CLASS = f"{WITH}, c AS (SELECT gold, count(*) FILTER (pred_a <> 'invalid') AS support, count(*) FILTER (pred_a = gold) AS hits, count(*) FILTER (pred_a = 'invalid') AS n_invalid FROM pred GROUP BY gold)"


@query(
    "agg_per_class",
    f"{_CLASS} SELECT gold, support, round(hits / nullif(support, 0), 6) AS accuracy, n_invalid FROM c"
)
def agg_per_class(spark, d):
    return tables.per_class(predictions(spark, d), "gold", "pred_a").withColumn("accuracy", R6(F.col("accuracy")))


@query(
    "agg_per_class_macro",
    f"{_CLASS} SELECT round(avg(hits / nullif(support, 0)), 6) AS macro_accuracy, count(*) FILTER (support > 0) AS "
    f"classes FROM c"
)
def agg_per_class_macro(spark, d):
    return tables.macro(
        tables.per_class(predictions(spark, d), "gold", "pred_a")
    ).withColumn("macro_accuracy", R6(F.col("macro_accuracy")))


@query(
    "agg_feature_means_by_label",
    f"{WITH} SELECT gold, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, round(avg(length(source)), 6) AS "
    f"mean_source FROM pred GROUP BY gold"
)
def agg_feature_means_by_label(spark, d):
    return predictions(spark, d).groupBy("gold").agg(
        F.count("*").alias("n"), R6(F.avg("n_chars")).alias("mean_chars"),
        R6(F.avg(F.length("source"))).alias("mean_source")
    )


_PAIR = "count(*) AS n, count(*) FILTER (pred_a = gold AND pred_b = gold) AS cc, count(*) FILTER (pred_a = gold AND pred_b <> gold) AS cw, count(*) FILTER (pred_a <> gold AND pred_b = gold) AS wc, count(*) FILTER (pred_a <> gold AND pred_b <> gold) AS ww"
_PAIRED = "n, cc, cw, wc, ww, round((cc + cw) / n, 6) AS acc_a, round((cc + wc) / n, 6) AS acc_b, round((wc - cw) / n, 6) AS delta"


@query("agg_paired_correctness", f"{WITH} SELECT {_PAIRED} FROM (SELECT {_PAIR} FROM pred)")
def agg_paired_correctness(spark, d):
    x = tables.paired_correctness(predictions(spark, d), A(), B())
    return x.withColumns({c: R6(F.col(c)) for c in ("acc_a", "acc_b", "delta")})


@query(
    "agg_class_transition",
    f"{WITH} SELECT gold, {_PAIRED}, wc - cw AS net FROM (SELECT gold, {_PAIR} FROM pred GROUP BY gold)"
)
def agg_class_transition(spark, d):
    x = tables.paired_correctness(predictions(spark, d), A(), B(), ["gold"])
    return x.withColumns(
        {c: R6(F.col(c)) for c in ("acc_a", "acc_b", "delta")}
    ).withColumn("net", F.col("wc") - F.col("cw"))


@query("agg_per_class_compare", f"{WITH} SELECT gold, n, round((cc + cw) / n, 6) AS acc_left, round((cc + wc) / n, 6) AS acc_right, round(100.0 * (wc - cw) / n, 4) AS delta_pp FROM (SELECT gold, {_PAIR} FROM pred GROUP BY gold)".replace("100.0 *", "100.0::DOUBLE *"))
def agg_per_class_compare(spark, d):
    x = tables.paired_correctness(predictions(spark, d), A(), B(), ["gold"])
    return x.select(
        "gold",
        "n",
        R6(F.col("acc_a")).alias("acc_left"),
        R6(F.col("acc_b")).alias("acc_right"),
        F.round(100.0 * (F.col("wc") - F.col("cw")) / F.col("n"), 4).alias("delta_pp")
    )


@query("agg_feature_transition", f"""{WITH}, t AS (SELECT {TR} AS transition, * FROM pred), l AS (SELECT transition, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS v FROM t UNION ALL SELECT transition, 'toxic', toxic FROM t UNION ALL SELECT transition, 'quality', quality FROM t)
 SELECT transition, feature, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS low, max(v) AS high FROM l GROUP BY ALL""")
def agg_feature_transition(spark, d):
    x = tables.feature_transition(
        predictions(spark, d).withColumn("transition", tables.transition(A(), B())),
        "transition",
        ["n_chars", "toxic", "quality"]
    )
    return x.withColumns({"mean": R6(F.col("mean")), "median": R6(F.col("median"))})


_NINE = "(SELECT unnest(['KKK', 'KKN', 'KNK', 'KNN', 'NKK', 'NKN', 'NNK', 'NNN', 'invalid']))"


@query("agg_prediction_transition", f"""{WITH}, t AS (SELECT {TR} AS tr, pred_a, pred_b FROM pred), s AS (SELECT 'all' AS subset, pred_a, pred_b FROM t UNION ALL SELECT tr, pred_a, pred_b FROM t WHERE tr IN ('WC', 'CW')), c AS (SELECT subset, pred_a, pred_b, count(*) AS n FROM s GROUP BY ALL)
 SELECT u.subset, a."from", b."to", coalesce(c.n, 0) AS n FROM (SELECT unnest(['all', 'WC', 'CW'])) u(subset) CROSS JOIN {_NINE} a("from") CROSS JOIN {_NINE} b("to") LEFT JOIN c ON c.subset = u.subset AND c.pred_a = a."from" AND c.pred_b = b."to" """)
def agg_prediction_transition(spark, d):
    return tables.prediction_transition(
        predictions(spark, d).withColumn("tr", tables.transition(A(), B())), "pred_a", "pred_b", "tr"
    )


@query("agg_prompt_bias", f"""{LONG}, n AS (SELECT model, count(*) AS t FROM lng GROUP BY 1), g AS (SELECT model, label, sum(p) AS p, sum(g) AS g FROM (SELECT model, pred AS label, 1 AS p, 0 AS g FROM lng UNION ALL SELECT model, gold, 0, 1 FROM lng) GROUP BY ALL)
 SELECT model, label, round(p / t, 6) AS predicted, round(g / t, 6) AS "true", round((p - g) / t, 6) AS bias FROM g JOIN n USING (model)""")
def agg_prompt_bias(spark, d):
    x = tables.prompt_bias(_long(spark, d))
    return x.select("model", "label", *[R6(F.col(c)).alias(c) for c in ("predicted", "true", "bias")])


_SA = "{0}, g AS (SELECT {1}, model, count(*) AS n, avg(CAST(pred = gold AS INT)) AS acc FROM lng GROUP BY ALL HAVING count(*) >= 20) SELECT {2}, g.model, g.n, round(g.acc, 6) AS accuracy, round(g.acc - b.acc, 6) AS delta FROM g LEFT JOIN (SELECT * FROM g WHERE model = 'a') b ON {3}"


def _structure(spark, d, keys):
    x = tables.structure_accuracy(_long(spark, d).withColumn("correct", F.col("pred") == F.col("gold")), keys)
    return x.withColumns({"accuracy": R6(F.col("accuracy")), "delta": R6(F.col("delta"))})


@query("agg_structure_accuracy", _SA.format(LONG, "source", "g.source", "g.source = b.source"))
def agg_structure_accuracy(spark, d):
    return _structure(spark, d, ["source"])


@query(
    "agg_conditional_accuracy", _SA.format(LONG, "gold, lang", "g.gold, g.lang", "g.gold = b.gold AND g.lang = b.lang")
)
def agg_conditional_accuracy(spark, d):
    return _structure(spark, d, ["gold", "lang"])


@query("agg_class_bias", f"""{LONG}, t AS (SELECT lang, model, count(*) AS t FROM lng GROUP BY ALL), r AS (SELECT lang, pred, model, count(*) / any_value(t) AS rate FROM lng JOIN t USING (lang, model) GROUP BY lang, pred, model)
 SELECT lang, pred, model, round(rate, 6) AS rate FROM r WHERE (lang, pred) IN (SELECT (lang, pred) FROM r GROUP BY lang, pred HAVING max(rate) >= 0.02)""".replace("WHERE (lang, pred) IN (SELECT (lang, pred) FROM r GROUP BY lang, pred HAVING max(rate) >= 0.02)", "SEMI JOIN (SELECT lang, pred FROM r GROUP BY lang, pred HAVING max(rate) >= 0.02) q USING (lang, pred)"))
def agg_class_bias(spark, d):
    return tables.class_bias(_long(spark, d), "lang").withColumn("rate", R6(F.col("rate")))


@query(
    "agg_transition_by_structure",
    f"{WITH} SELECT source, n, wc, cw, round(wc / n, 6) AS wc_rate, round(cw / n, 6) AS cw_rate FROM (SELECT source, "
    f"{_PAIR} FROM pred GROUP BY source)"
)
def agg_transition_by_structure(spark, d):
    x = tables.paired_correctness(predictions(spark, d), A(), B(), ["source"])
    return x.select(
        "source", "n", "wc", "cw", R6(F.col("wc") / F.col("n")).alias("wc_rate"),
        R6(F.col("cw") / F.col("n")).alias("cw_rate")
    )


@query(
    "agreement_rate",
    f"{WITH} SELECT round(avg(CAST(pred_a = pred_b AS INT)), 6) AS agreement, count(*) FILTER (pred_a <> pred_b) AS "
    f"disagreements FROM pred"
)
def agreement_rate(spark, d):
    same = F.col("pred_a") == F.col("pred_b")
    return predictions(spark, d).agg(
        R6(F.avg(same.cast("double"))).alias("agreement"), F.count_if(~same).alias("disagreements")
    )


@query(
    "implied_agreement_gate",
    f"{WITH} SELECT round(avg(CAST(pred_a = pred_c AS INT)), 6) AS agreement, avg(CAST(pred_a = pred_c AS INT)) >= 0.95 "
    f"AS passed FROM pred"
)
def implied_agreement_gate(spark, d):
    r = F.avg((F.col("pred_a") == F.col("pred_c")).cast("double"))
    return predictions(spark, d).agg(R6(r).alias("agreement"), (r >= 0.95).alias("passed"))


# joins


@query(
    "join_paired_inner",
    f"{WITH}, l AS (SELECT id, pred_a FROM pred), r AS (SELECT id, pred_b FROM pred WHERE id % 10 <> 3) SELECT count(*) "
    f"FILTER (r.id IS NULL) AS left_only, count(*) FILTER (l.id IS NULL) AS right_only, count(*) FILTER (l.id IS NOT "
    f"NULL AND r.id IS NOT NULL) AS both FROM l FULL JOIN r ON l.id = r.id"
)
def join_paired_inner(spark, d):
    p = predictions(spark, d)
    return audit.paired_gate(p.select("id"), p.where("id % 10 <> 3").select("id"), "id")


@query(
    "join_multi_model",
    f"{LONG} SELECT id, gold, max(pred) FILTER (model = 'a') AS a, max(pred) FILTER (model = 'b') AS b, max(pred) "
    f"FILTER (model = 'c') AS c FROM lng GROUP BY id, gold"
)
def join_multi_model(spark, d):
    return _long(spark, d).groupBy("id", "gold").pivot("model", ["a", "b", "c"]).agg(F.max("pred"))


@query(
    "join_lookup",
    "SELECT o_orderpriority AS priority, count(*) AS orders, count(c_custkey) AS matched, round(avg(c_acctbal), 4) AS "
    "mean_balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"
)
def join_lookup(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("hit"), "c_acctbal")
    x, _ = audit.lookup(read(spark, d, "orders").select("o_custkey", "o_orderpriority"), c, "o_custkey")
    return x.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("orders"), F.count("hit").alias("matched"),
        F.round(F.avg("c_acctbal"), 4).alias("mean_balance")
    )


# information theory


@query(
    "entropy_nats",
    f"{WITH}, c AS (SELECT gold, count(*) AS n FROM pred GROUP BY 1) SELECT round(-sum(n / t * ln(n / t)), 6) AS "
    f"entropy FROM c, (SELECT sum(n) AS t FROM c)"
)
def entropy_nats(spark, d):
    return infotheory.entropy(predictions(spark, d), "gold").select(R6(F.col("entropy")).alias("entropy"))


def _mi_sql(log: str) -> str:
    return f"""{WITH}, c AS (SELECT source, gold, count(*) AS n FROM pred GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY source) AS nx, sum(n) OVER (PARTITION BY gold) AS ny, sum(n) OVER () AS t FROM c),
 s AS (SELECT sum(n / t * {log}(n * t / (nx * ny))) AS mi, -sum(n / t * {log}(nx / t)) AS hx, -sum(n / t * {log}(ny / t)) AS hy FROM m)"""


@query("mi_bits", f"{_mi_sql('log2')} SELECT round(mi, 6) AS mi FROM s")
def mi_bits(spark, d):
    return infotheory.mutual_information(
        predictions(spark, d), "source", "gold", "bits"
    ).select(R6(F.col("mi")).alias("mi"))


@query("mi_nats", f"{_mi_sql('ln')} SELECT round(mi, 6) AS mi FROM s")
def mi_nats(spark, d):
    return infotheory.mutual_information(predictions(spark, d), "source", "gold").select(R6(F.col("mi")).alias("mi"))


@query(
    "nmi",
    f"{_mi_sql('ln')} SELECT round(mi, 6) AS mi, round(hx, 6) AS h_x, round(hy, 6) AS h_y, round(mi / hx, 6) AS nmi_x, "
    f"round(mi / hy, 6) AS nmi_y FROM s"
)
def nmi(spark, d):
    x = infotheory.mutual_information(predictions(spark, d), "source", "gold")
    return x.select(*[R6(F.col(c)).alias(c) for c in x.columns])


_COND = f"""{WITH}, c AS (SELECT pred_a AS x, gold AS y, lang AS z, count(*) AS n FROM pred GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER (PARTITION BY x, z) AS nxz, sum(n) OVER (PARTITION BY y, z) AS nyz, sum(n) OVER () AS t FROM c)"""


@query("conditional_mi", f"{_COND} SELECT round(sum(n / t * ln(n * nz / (nxz * nyz))), 6) AS cmi FROM m")
def conditional_mi(spark, d):
    return infotheory.conditional(predictions(spark, d), "pred_a", "gold", "lang").select(R6(F.col("cmi")).alias("cmi"))


@query("conditional_entropy", f"{_COND} SELECT round(-sum(n / t * ln(nxz / nz)), 6) AS h_x_given_z FROM m")
def conditional_entropy(spark, d):
    return infotheory.conditional(
        predictions(spark, d), "pred_a", "gold", "lang"
    ).select(R6(F.col("h_x_given_z")).alias("h_x_given_z"))


# tests

_BC = f"{WITH}, bc AS (SELECT lang, count(*) FILTER (pred_a = gold AND pred_b <> gold) AS b, count(*) FILTER (pred_a <> gold AND pred_b = gold) AS c FROM pred GROUP BY lang)"


@query(
    "mcnemar_exact",
    f"{_BC} SELECT lang, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - "
    f"lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))) FROM (SELECT unnest(range(least(b, c) + 1)) "
    f"AS i))) END, 8) AS exact_p FROM bc"
)
def mcnemar_exact(spark, d):
    g = predictions(spark, d).groupBy("lang").agg(F.count_if(A() & ~B()).alias("b"), F.count_if(~A() & B()).alias("c"))
    return g.withColumn("exact_p", F.round(S.mcnemar_exact(F.col("b"), F.col("c")), 8))


@query(
    "mcnemar_chi2",
    f"{_BC} SELECT lang, b, c, round((abs(b - c) - 1) * (abs(b - c) - 1) / nullif(CAST(b + c AS DOUBLE), 0), 6) AS chi2 "
    f"FROM bc"
)
def mcnemar_chi2(spark, d):
    g = predictions(spark, d).groupBy("lang").agg(F.count_if(A() & ~B()).alias("b"), F.count_if(~A() & B()).alias("c"))
    return g.withColumn("chi2", R6(S.mcnemar_chi2(F.col("b"), F.col("c"))))


@query("mcnemar_p_values")
def mcnemar_p_values(spark, d):
    return significance.mcnemar(predictions(spark, d), A(), B(), ["lang"])


@query(
    "indicator_test",
    f"{WITH} SELECT source, count(*) FILTER (pred_a = 'invalid' AND pred_b <> 'invalid') AS b, count(*) FILTER (pred_a "
    f"<> 'invalid' AND pred_b = 'invalid') AS c FROM pred GROUP BY source"
)
def indicator_test(spark, d):
    x, y = F.col("pred_a") == "invalid", F.col("pred_b") == "invalid"
    return predictions(spark, d).groupBy("source").agg(F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"))


@query(
    "spearman",
    f"{WITH}, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS a, rank() "
    f"OVER (ORDER BY length(source) * 10 + toxic) + (count(*) OVER (PARTITION BY length(source) * 10 + toxic) - 1) / 2 "
    f"AS b FROM pred) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r"
)
def spearman(spark, d):
    x = predictions(spark, d).select("n_chars", (F.length("source") * 10 + F.col("toxic")).alias("other"))
    return significance.spearman(x, "n_chars", "other").withColumn("rho", R6(F.col("rho")))


@query("spearman_p")
def spearman_p(spark, d):
    x = significance.spearman(
        predictions(spark, d).select("n_chars", (F.length("source") * 10 + F.col("toxic")).alias("other")),
        "n_chars",
        "other"
    )
    return x.withColumn("p", S.correlation_p(F.col("rho"), F.col("n")))


@query("chi2_independence", f"""{WITH}, t AS (SELECT source, {TR} AS tr FROM pred), c AS (SELECT source AS x, tr AS y, count(*) AS o FROM t WHERE tr IN ('WC', 'CW') GROUP BY ALL), xs AS (SELECT x, sum(o) AS r FROM c GROUP BY 1), ys AS (SELECT y, sum(o) AS k FROM c GROUP BY 1), n AS (SELECT sum(o) AS t FROM c)
 SELECT round(sum((coalesce(o, 0) - r * k / t) * (coalesce(o, 0) - r * k / t) / (r * k / t)), 6) AS statistic, CAST((count(DISTINCT xs.x) - 1) * (count(DISTINCT ys.y) - 1) AS BIGINT) AS dof FROM xs CROSS JOIN ys CROSS JOIN n LEFT JOIN c ON c.x = xs.x AND c.y = ys.y""")
def chi2_independence(spark, d):
    t = predictions(spark, d).select(
        "source", tables.transition(A(), B()).alias("tr")
    ).where(F.col("tr").isin("WC", "CW"))
    return significance.chi2_independence(t, "source", "tr").withColumn("statistic", R6(F.col("statistic")))


@query("chi2_p_value")
def chi2_p_value(spark, d):
    t = predictions(spark, d).select(
        "source", tables.transition(A(), B()).alias("tr")
    ).where(F.col("tr").isin("WC", "CW"))
    x = significance.chi2_independence(t, "source", "tr")
    return x.withColumn("p", S.chi2_sf(F.col("statistic"), F.col("dof").cast("double")))


def _delta():
    return (B().cast("int") - A().cast("int")).cast("double")


#: Repetitions of the reference (BASELINE D6).
REPS, SHUFFLES = 10000, 1000


def _binomial_sql(n: str, p: str) -> str:
    """Logarithm of a binomial probability of k; p is inside (0, 1)."""
    return f"lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({p}) + ({n} - k) * ln(1 - {p})"


def _draw_sql(place: int) -> str:
    return f"(CAST(CAST('0x' || substr(md5('1:' || rep || ':{place}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {1 << 52}.0::DOUBLE"


def _levels_sql(source: str, weights: dict[int, str]) -> str:
    """The bootstrap of a few levels (SQL of a table of ``level``), by the same draws: one binomial number for each in turn."""
    counts = ", ".join(f"count(*) FILTER (level = {x}) AS c{i}" for i, x in enumerate(weights))
    out = [
        f"v AS (SELECT count(*) AS n, {counts} FROM {source})",
        f"s0 AS (SELECT rep, n AS rest, 0.0::DOUBLE AS total FROM (SELECT unnest(range({REPS})) AS rep), v)",
    ]
    for i, weight in enumerate(weights.values()):
        before = "".join(f" - c{j}" for j in range(i))
        p = f"(SELECT DISTINCT rest, (SELECT c{i} / (n{before}) FROM v) AS p FROM s{i})"
        cdf = f"sum(exp({_binomial_sql('rest', 'p')})) OVER (PARTITION BY rest ORDER BY k)"
        out.append(f"t{i} AS (SELECT rest, k, {cdf} AS cdf FROM (SELECT *, unnest(range(rest + 1)) AS k FROM {p}))")
        drawn = f"any_value(s.rest) - count(k) AS rest, any_value(s.total) + {weight} * count(k) AS total"
        met = f"t.rest = s.rest AND t.cdf < {_draw_sql(i + 1)}"
        out.append(f"s{i + 1} AS (SELECT rep, {drawn} FROM s{i} AS s LEFT JOIN t{i} AS t ON {met} GROUP BY rep)")
    out.append(f"m AS (SELECT total / n AS value FROM s{len(weights)}, v)")
    low, high = "quantile_cont(value, 0.025)", "quantile_cont(value, 0.975)"
    return (
        f"{LONG}, {', '.join(out)} SELECT count(*) AS reps, round(avg(value), 6) AS mean, round({low}, 6) AS low, "
        f"round({high}, 6) AS high, {low} < 0 AND {high} > 0 AS crosses_zero FROM m"
    )


def _signs_sql(where: str) -> str:
    """The paired difference over rows."""
    sign = "CAST(pred_b = gold AS INT) - CAST(pred_a = gold AS INT)"
    return _levels_sql(f"(SELECT {sign} AS level FROM pred WHERE {where})", {1: "1.0", -1: "-1.0"})


@query("bootstrap_paired_mean", _signs_sql("true"))
def bootstrap_paired_mean(spark, d):
    b = significance.interval(
        significance.bootstrap_signs(predictions(spark, d).select(_delta().alias("x")), "x", REPS)
    )
    return b.withColumns({c: R6(F.col(c)) for c in ("mean", "low", "high")})


def _weighted_sql(columns: str) -> str:
    """SQL of ``w``: each row of ``pred`` with its weight in each repetition."""
    mask = 2**32 - 1
    mixed = f"((xor(h, h >> 16) * {bootstrap.FACTOR}) & {mask})"
    word = lambda i: f"CAST('0x' || substr(md5('1:' || id), {i}, 8) AS BIGINT)"
    heavier = " + ".join(f"CAST(xor(h, h >> 16) >= {k} AS INT)" for k in bootstrap.LIMITS)
    return (
        f"WITH {PRED_SQL}, h0 AS (SELECT {columns}, rep, b, (a + rep * {bootstrap.STRIDE}) & {mask} AS h FROM "
        f"(SELECT *, {word(1)} AS a, {word(9)} AS b FROM pred), (SELECT unnest(range({REPS})) AS rep)), "
        f"h1 AS (SELECT * REPLACE (xor({mixed}, b) AS h) FROM h0), h2 AS (SELECT * REPLACE ({mixed} AS h) FROM h1), "
        f"h3 AS (SELECT * REPLACE ({mixed} AS h) FROM h2), w AS (SELECT *, {heavier} AS w FROM h3)"
    )


def _rank_sql(p: float) -> str:
    """SQL of a quantile from ``upto`` (weights up to a value) and ``total``."""
    at = f"({p}::DOUBLE * (any_value(total) - 1))"
    low, high = (f"min(x) FILTER (upto > {f}({p}::DOUBLE * (total - 1)))" for f in ("floor", "ceil"))
    return f"{low} + ({high} - {low}) * ({at} - floor({at}))"


@query(
    "bootstrap_statistics",
    _weighted_sql("CAST(n_chars AS DOUBLE) AS x") + ", c AS (SELECT rep, x, w, sum(w) OVER (PARTITION BY rep ORDER BY x) "
    "AS upto, sum(w) OVER (PARTITION BY rep) AS total FROM w WHERE w > 0) SELECT rep, "
    f"round({_rank_sql(0.5)}, 6) AS median, round({_rank_sql(0.1)}, 6) AS p10, "
    "round(sum(CASE WHEN x > 1000 THEN w ELSE 0 END) / sum(w), 6) AS fraction FROM c GROUP BY rep"
)
def bootstrap_statistics(spark, d):
    x = F.col("n_chars")
    stats = {
        "median": bootstrap.Quantile(x, 0.5), "p10": bootstrap.Quantile(x, 0.1), "fraction": bootstrap.share(x > 1000)
    }
    b = bootstrap.resample(predictions(spark, d), F.col("id"), stats, REPS)
    return b.withColumns({c: R6(F.col(c)) for c in stats})


@query(
    "bootstrap_two_sample",
    _weighted_sql("CAST(n_chars AS DOUBLE) AS x, toxic") + ", m AS (SELECT rep, sum(w * x) FILTER (toxic = 1) / "
    "sum(w) FILTER (toxic = 1) - sum(w * x) FILTER (toxic = 0) / sum(w) FILTER (toxic = 0) AS value FROM w GROUP BY rep) "
    "SELECT count(*) AS reps, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, "
    "round(quantile_cont(value, 0.975), 6) AS high, quantile_cont(value, 0.025) < 0 AND quantile_cont(value, 0.975) > 0 "
    "AS crosses_zero FROM m"
)
def bootstrap_two_sample(spark, d):
    """Difference of means of two samples; their rows are other units, so the samples are drawn independently."""
    mean = lambda k: bootstrap.Ratio(F.when(F.col("toxic") == k, F.col("n_chars")))
    b = bootstrap.resample(predictions(spark, d), F.col("id"), {"a": mean(0), "b": mean(1)}, REPS)
    b = significance.interval(b.select("rep", (F.col("b") - F.col("a")).alias("value")))
    return b.withColumns({c: R6(F.col(c)) for c in ("mean", "low", "high")})


_RIGHT = "(SELECT CAST(sum(CAST(pred = gold AS INT)) AS INT) AS level FROM lng GROUP BY id)"


@query("bootstrap_cluster", _levels_sql(_RIGHT, {3: "1.0", 2: "(2 / 3.0::DOUBLE)", 1: "(1 / 3.0::DOUBLE)"}))
def bootstrap_cluster(spark, d):
    """Questions are drawn with all three models' answers; a question counts how many of them are right."""
    x = _long(spark, d).groupBy("id").agg(F.count_if(F.col("pred") == F.col("gold")).cast("int").alias("level"))
    b = significance.interval(significance.bootstrap_levels(x, "level", {3: 1.0, 2: 2 / 3, 1: 1 / 3}, REPS))
    return b.withColumns({c: R6(F.col(c)) for c in ("mean", "low", "high")})


@query("bootstrap_region", _signs_sql("n_chars > 1000"))
def bootstrap_region(spark, d):
    x = predictions(spark, d).where("n_chars > 1000").select(_delta().alias("x"))
    b = significance.interval(significance.bootstrap_signs(x, "x", REPS))
    return b.withColumns({c: R6(F.col(c)) for c in ("mean", "low", "high")})


@query("permutation_test")
def permutation_test(spark, d):
    return permutation.permutation_test(predictions(spark, d), "source", "gold", SHUFFLES)


_LOG_WAYS = (
    "lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(j + 1) - "
    "lgamma(a - j + 1) - lgamma(b - j + 1) - lgamma(n - a - b + j + 1)"
)


@query(
    "permutation_expected",
    f"{WITH}, xs AS (SELECT source AS x, count(*) AS a FROM pred GROUP BY 1), ys AS (SELECT gold AS y, count(*) AS b FROM "
    f"pred GROUP BY 1), t AS (SELECT count(*) AS n FROM pred), c AS (SELECT source AS x, gold AS y, count(*) AS k FROM pred "
    f"GROUP BY ALL), o AS (SELECT sum(k / n::DOUBLE * ln(k * n::DOUBLE / (a * b))) AS observed FROM c JOIN xs USING (x) JOIN "
    f"ys USING (y), t), j AS (SELECT a, b, n, unnest(range(greatest(1, a + b - n), least(a, b) + 1)) AS j FROM xs, ys, t), e "
    f"AS (SELECT sum(exp({_LOG_WAYS}) * j / n::DOUBLE * ln(j * n::DOUBLE / (a * b))) AS expected FROM j) "
    "SELECT round(observed, 6) AS observed, round(expected, 6) AS expected, true AS agrees FROM o, e"
)
def permutation_expected(spark, d):
    """Observed value, the mean over all shuffles in closed form, and whether the shuffles' mean is within 5 standard errors."""
    cells = permutation.cells_of(predictions(spark, d), "source", "gold")
    null = permutation.shuffled(cells, SHUFFLES).agg(F.avg("mi").alias("m"), F.stddev_samp("mi").alias("s"))
    x = permutation.observed(cells).crossJoin(permutation.expected(cells)).crossJoin(null)  # one row each
    near = F.abs(F.col("m") - F.col("expected")) <= 5 * F.col("s") / SHUFFLES**0.5 + 1e-12
    return x.select(R6("mi").alias("observed"), R6("expected").alias("expected"), near.alias("agrees"))
