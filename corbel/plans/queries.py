"""Queries of the scorecard operators over the driver's tables, and the SQL that says the same.

Labels: line items returned (R) are bad; in gray variants N is gray.  The score mixes quantity, price and discount;
the baseline mixes tax and quantity.  Tags follow the year of shipping.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.functions.expressions import bin_index, derive, without_sentinels
from corbel.operators import metrics, sketches, stats
from corbel.operators.binning import BinModel, ChiMergeBinner
from corbel.operators.cleaning import CleanModel, FeatureCleaner
from corbel.operators.encoding import BinnerWoeEncoder, WoeEncoder, WoeModel
from corbel.operators.filters import TimeWindow, hash_sample, with_gray, with_month
from corbel.operators.scaling import LogitScale, pdo_scale
from corbel.operators.selection import CorrelationSelector, IVSelector, PSISelector, SelectModel
from corbel.plans.experiment import average_ranks, top_features
from corbel.plans.growth import LeafwiseClassifier
from corbel.plans.pipeline import DeriveModel, FeatureDerivation, Pipeline, PipelineModel, add_risk_score
from corbel.plans.report import binned_counts, compare_labels, compare_scores
from corbel.plans.trees import BoostedClassifier, from_lightgbm_dump, literal_trees
from corbel.sources.loans import preprocess, select_features, with_target
from corbel.streaming.monitor import PsiMonitor
from corbel.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ID = ["l_orderkey", "l_linenumber"]
#: Quantile edges are rounded on both sides: two engines interpolate alike only so far.
DIGITS = 9


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("l_shipdate")
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({
        "bad": (F.col("l_returnflag") == "R").cast("int"), "gray": F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", -1).otherwise(0),
        "tag": F.when(year <= 1998, "train").when(year == 1999, "test").otherwise("oot"),
        "score": unit((F.col("l_quantity") / 50 + F.col("l_extendedprice") / 120000 + F.col("l_discount") * 10) / 3), "baseline": unit((F.col("l_tax") * 5 + F.col("l_quantity") / 100) / 2),
    })


TX = """tx AS (
    SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS bad, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN -1 ELSE 0 END AS gray,
           CASE WHEN year(l_shipdate) <= 1998 THEN 'train' WHEN year(l_shipdate) = 1999 THEN 'test' ELSE 'oot' END AS tag,
           least(greatest((l_quantity / 50 + l_extendedprice / 120000 + l_discount * 10) / 3, 0::DOUBLE), 1::DOUBLE) AS score,
           least(greatest((l_tax * 5 + l_quantity / 100) / 2, 0::DOUBLE), 1::DOUBLE) AS baseline, strftime(l_shipdate, '%Y-%m') AS month
    FROM lineitem
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def unpivoted(features: list[str], keep: str = "", source: str = "tx") -> str:
    return " UNION ALL ".join(f"SELECT {keep}{', ' if keep else ''}'{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source}" for f in features)


# --- expressions and cleaning --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity * l_tax, 0), 6) AS ratio FROM lineitem")
def derive_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(derive(transactions(spark, sf_dir), {"ratio": "l_extendedprice / (l_quantity * l_tax)"}).select(*ID, "ratio"))


@query("SELECT l_orderkey, l_linenumber, round((l_discount - l_tax) * (l_discount + l_tax), 6) + 0.0::DOUBLE AS d1, round(-l_quantity + l_tax, 6) AS d2, round(l_tax - -l_discount, 6) AS d3, round(l_discount / nullif(l_discount + l_tax, 0), 6) AS d4 FROM lineitem")
def derive_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(transactions(spark, sf_dir), [("d1", "(l_discount - l_tax) * (l_discount + l_tax)"), ("d2", "-l_quantity + l_tax"), {"target_col": "d3", "expression": "l_tax--l_discount"}, ("d4", "l_discount / (l_discount + l_tax)")])
    return rounded(made.select(*ID, "d1", "d2", "d3", "d4"))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber <> 7 THEN l_quantity END, 1) * l_tax + 1, 6) AS filled FROM lineitem")
def derive_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transactions(spark, sf_dir).withColumn("q", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")))
    return rounded(derive(df, {"filled": "q * l_tax + 1"}, fill=1.0).select(*ID, "filled"))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinels where the quantity is 1 and NULLs in every seventh line."""
    return transactions(spark, sf_dir).withColumns({"q": F.when(F.col("l_quantity") == 1, -999.0).otherwise(F.col("l_quantity")), "p": F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice"))})


HOLED = TX + ", h AS (SELECT *, CASE WHEN l_quantity = 1 THEN -999 ELSE l_quantity END AS q, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS p FROM tx)"


@query(f"WITH {HOLED} SELECT l_orderkey, l_linenumber, CASE WHEN q NOT IN (-999, -9998, -9996) THEN q END AS q FROM h")
def sentinel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_sentinels(holed(spark, sf_dir).select(*ID, "q"), columns=["q"])


@query(f"""WITH {HOLED}, s AS (SELECT *, CASE WHEN q <> -999 THEN q END AS qq FROM h), m AS (
    SELECT quantile_cont(qq, 0.5) AS qm, quantile_cont(p, 0.5) AS pm, quantile_cont(qq, 0.25) AS q1, quantile_cont(qq, 0.75) AS q3, quantile_cont(p, 0.25) AS p1, quantile_cont(p, 0.75) AS p3 FROM s)
SELECT l_orderkey, l_linenumber, round(least(greatest(coalesce(qq, qm), q1 - 0.2::DOUBLE * (q3 - q1)), q3 + 0.2::DOUBLE * (q3 - q1)), 6) AS q,
       round(least(greatest(coalesce(p, pm), p1 - 0.2::DOUBLE * (p3 - p1)), p3 + 0.2::DOUBLE * (p3 - p1)), 6) AS p FROM s, m""")
def clean_impute_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed(spark, sf_dir)
    model = FeatureCleaner(outliers="iqr", iqr_factor=0.2).fit(df, "bad", ["q", "p"])
    return rounded(model.transform(df.select(*ID, "q", "p")))


@query(f"""WITH {HOLED}, u AS ({unpivoted(["l_quantity", "l_discount", "p"], source="h")})
SELECT feature, count(*) AS n, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*), 6) AS missing_rate, count(DISTINCT value) AS n_distinct,
       round(count(DISTINCT value) / count(value), 6) AS distinct_ratio, round(avg(value), 4) AS mean, round(var_samp(value) / 1000, 4) AS variance,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(max(value), 6) AS p100 FROM u GROUP BY feature""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.profile(holed(spark, sf_dir), ["l_quantity", "l_discount", "p"])
    q = lambda i: F.round(F.get("quantiles", F.lit(i)), 6)
    return t.select("feature", "n", "n_missing", F.round("missing_rate", 6).alias("missing_rate"), "n_distinct", F.round("distinct_ratio", 6).alias("distinct_ratio"), F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1000, 4).alias("variance"), q(1).alias("p25"), q(2).alias("p50"), q(4).alias("p100"))


# --- filters and counts --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TimeWindow("o_orderdate", "1996-01-01", "1997-12-31").filter(spark.read.parquet(f"{sf_dir}/orders.parquet")).select("o_orderkey", "o_orderdate")


@query(f"WITH {HOLED} SELECT l_orderkey, l_linenumber, CASE WHEN q <> -999 THEN q END AS q, p FROM h WHERE q <> -999 AND p IS NOT NULL")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed(spark, sf_dir).select(*ID, "bad", "q", "p")
    return FeatureCleaner(missing="drop_row").fit(df, "bad", ["q", "p"]).transform(df).drop("bad")


COUNTS = "count(*) FILTER (WHERE gray = 0) AS goods, count(*) FILTER (WHERE gray = 1) AS bads, count(*) FILTER (WHERE gray = -1) AS gray, count(*) FILTER (WHERE gray IN (0, 1)) AS total, count(*) AS total_with_gray, round(coalesce(count(*) FILTER (WHERE gray = 1) / nullif(count(*) FILTER (WHERE gray IN (0, 1)), 0), 0), 6) AS bad_rate"


@query(f"WITH {TX} SELECT tag, {COUNTS} FROM tx GROUP BY tag")
def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.sample_stats(transactions(spark, sf_dir), "gray", ["tag"]))


@query(f"WITH {TX} SELECT coalesce(tag, 'total') AS tag, {COUNTS} FROM tx GROUP BY ROLLUP (tag)")
def sample_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.sample_stats(transactions(spark, sf_dir), "gray", ["tag"], total="total"))


@query(f"WITH {TX} SELECT tag, month, {COUNTS} FROM tx GROUP BY tag, month")
def monthly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.sample_stats(with_month(transactions(spark, sf_dir), "l_shipdate"), "gray", ["tag", "month"]))


@query(f"WITH {HOLED} SELECT tag, feature, count(*) AS n, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*), 6) AS missing_rate FROM ({unpivoted(['p', 'l_tax'], 'tag', 'h')}) GROUP BY tag, feature")
def var_missing_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.missing_rates(holed(spark, sf_dir), ["p", "l_tax"], ["tag"]))


@query(f"WITH {TX}, g AS (SELECT tag AS dataset, gray FROM tx WHERE gray >= 0 UNION ALL SELECT d, gray FROM tx, (VALUES ('train'), ('test'), ('oot'), ('gray')) AS t(d) WHERE gray = -1) SELECT dataset, count(*) AS n, count(*) FILTER (WHERE gray = -1) AS n_gray FROM g GROUP BY dataset")
def gray_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transactions(spark, sf_dir).withColumn("tag", F.when(F.col("gray") == -1, "gray").otherwise(F.col("tag")))
    return with_gray(df, "tag", "gray", ["train", "test", "oot"]).groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("gray") == -1).alias("n_gray"))


@query()
def sample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_sample(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 100)


# --- bins, WOE, IV, PSI, correlation -------------------------------------------------------------------------------

EDGES = [None, 10.0, 20.0, 30.0, 40.0, None]


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS bin, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN CASE WHEN l_quantity < 20 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END END AS left_bin FROM lineitem")
def bin_cut_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return transactions(spark, sf_dir).select(*ID, bin_index(q, EDGES, "right").alias("bin"), bin_index(q, EDGES[1:-1], "left").alias("left_bin"))


@query(f"""WITH {TX}, e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 9)))) AS e FROM tx)
SELECT len(list_filter(e, lambda x: x <= score)) AS bin, count(*) AS n, round(min(score), 6) AS lo, round(max(score), 6) AS hi FROM tx, e GROUP BY 1""")
def bin_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transactions(spark, sf_dir)
    edges = stats.quantile_edges(df, ["score"], 10, digits=DIGITS).first().edges  # eleven numbers
    binned = df.withColumn("bin", bin_index(F.col("score"), edges[1:-1], "open").cast("long"))
    return rounded(binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")))


def woe_sql(features: list[str], source: str = "tx", label: str = "bad", where: str = "true") -> str:
    return f"""u AS ({unpivoted(features, label, f"(SELECT * FROM {source} WHERE {where})")}), tot AS (SELECT sum({label}) AS p, count(*) - sum({label}) AS n FROM {source} WHERE {where}),
w AS (SELECT feature, value, sum({label}) AS n_pos, count(*) - sum({label}) AS n_neg FROM u WHERE value IS NOT NULL GROUP BY feature, value),
woe AS (SELECT *, ln(dp / dn) AS woe, (dp - dn) * ln(dp / dn) AS iv_part FROM (SELECT feature, value, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, (n_pos + 0.001::DOUBLE) / (tot.p + 0.001::DOUBLE * count(*) OVER (PARTITION BY feature)) AS dp, (n_neg + 0.001::DOUBLE) / (tot.n + 0.001::DOUBLE * count(*) OVER (PARTITION BY feature)) AS dn FROM w, tot))"""


@query(f"WITH {TX}, {woe_sql(['l_quantity', 'l_discount', 'l_tax'])} SELECT feature, value, n_pos, n_neg, round(woe, 6) AS woe, round(iv_part, 9) AS iv_part FROM woe")
def woe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.woe_table(transactions(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "bad")
    return t.select("feature", "value", "n_pos", "n_neg", F.round("woe", 6).alias("woe"), F.round("iv_part", 9).alias("iv_part"))


@query(f"WITH {TX}, {woe_sql(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber'])} SELECT feature, round(sum(iv_part), 9) AS iv FROM woe GROUP BY feature")
def iv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.information_value(transactions(spark, sf_dir), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "bad"), 9)


@query(f"WITH {TX}, {woe_sql(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber'])} SELECT feature, round(sum(iv_part), 9) AS iv, sum(iv_part) BETWEEN 0.0001 AND 0.0005 AS kept FROM woe GROUP BY feature")
def iv_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = IVSelector(0.0001, 0.0005).fit(transactions(spark, sf_dir), "bad", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return rounded(spark.createDataFrame([(f, v, f in model.kept) for f, v in model.values.items()], "feature string, iv double, kept boolean"), 9)


MERGED = ["l_linenumber", "l_discount", "l_tax"]
#: The statistic of the neighbours i and i + 1 of lists of upper bounds, bad rows and rows.
_CHI = """list_transform(range(1, len(us)), lambda i: list_sum(list_transform([
        {'o': ps[i], 'e': ns[i] * (ps[i] + ps[i + 1]) / (ns[i] + ns[i + 1])}, {'o': ns[i] - ps[i], 'e': ns[i] * (1 - (ps[i] + ps[i + 1]) / (ns[i] + ns[i + 1]))},
        {'o': ps[i + 1], 'e': ns[i + 1] * (ps[i] + ps[i + 1]) / (ns[i] + ns[i + 1])}, {'o': ns[i + 1] - ps[i + 1], 'e': ns[i + 1] * (1 - (ps[i] + ps[i + 1]) / (ns[i] + ns[i + 1]))}
    ], lambda x: CASE WHEN x.e > 0 THEN power(x.o - x.e, 2) / x.e ELSE 0 END)))"""


@query(f"""WITH RECURSIVE {TX}, v AS (
    SELECT feature, value, sum(bad) AS p, count(*)::DOUBLE AS n FROM ({unpivoted(MERGED, 'bad')}) GROUP BY 1, 2
), o AS (
    SELECT *, lead(value) OVER w AS up, row_number() OVER w AS k, count(*) OVER (PARTITION BY feature) AS most FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)
), b AS (  -- each value up to the next one is a bin, and the last value belongs to the last bin
    SELECT feature, least(k, most - 1) AS k, max(coalesce(up, value)) AS u, sum(p)::DOUBLE AS p, sum(n) AS n FROM o GROUP BY 1, 2
), m AS (
    SELECT feature, list(u ORDER BY k) AS us, list(p ORDER BY k) AS ps, list(n ORDER BY k) AS ns FROM b GROUP BY 1
    UNION ALL
    SELECT feature, us[1:j - 1] || us[j + 1:], ps[1:j - 1] || [ps[j] + ps[j + 1]] || ps[j + 2:], ns[1:j - 1] || [ns[j] + ns[j + 1]] || ns[j + 2:]
    FROM (SELECT feature, us, ps, ns, list_min(chi) AS least, list_position(chi, list_min(chi)) AS j FROM (SELECT *, {_CHI} AS chi FROM m WHERE len(us) > 2))
    WHERE len(us) > 4 OR least < 2.705543454095404
), last AS (
    SELECT feature, us FROM m QUALIFY row_number() OVER (PARTITION BY feature ORDER BY len(us)) = 1
)
SELECT feature, CAST(i - 1 AS INTEGER) AS bin, us[i] AS upper FROM last, unnest(range(1, len(us))) AS t(i)""")
def chimerge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of chi-square bins of features with few values, merged step by step."""
    model = ChiMergeBinner(max_bins=4).fit(transactions(spark, sf_dir), "bad", MERGED)
    return spark.createDataFrame([(f, b, float(e)) for f in MERGED for b, e in enumerate(model.edges[f][1:-1])], "feature string, bin int, upper double")


#: A specification: derive, clean, bin and encode, drop, score on a scale.
SPEC = PipelineModel(
    (
        DeriveModel((("load", "l_tax * 100 + l_linenumber"),)),
        CleanModel((-999.0,), {"l_discount": "missing"}, {"q": 20.0}, {"p": (2000.0, 80000.0)}),
        WoeModel({"q": {0.0: -0.3, 1.0: 0.1, 2.0: 0.45}, "p": {0.0: 0.2, 1.0: -0.15}}, {"q": 0.1, "p": 0.02}, BinModel({"q": [None, 10.0, 30.0, None], "p": [None, 40000.0, None]})),
        SelectModel(["q", "p", "load"], {"l_tax": "low_iv"}),
        literal_trees([{"feature": "q", "threshold": 0.1, "left": {"feature": "load", "threshold": 6.5, "left": -0.4, "right": 0.05}, "right": 0.3}, {"feature": "p", "threshold": 0.0, "left": -0.1, "right": 0.2, "missing_left": True}], ["q", "p", "load"], scale=LogitScale(offset=600.0, factor=40.0)),
    ),
    ("q", "p", "l_tax", "l_linenumber", "l_discount"),
)


@query(f"""WITH {HOLED}, c AS (
    SELECT l_orderkey, l_linenumber, l_tax * 100 + l_linenumber AS load, CASE WHEN q = -999 THEN 20 ELSE q END AS q, CASE WHEN p IS NOT NULL THEN least(greatest(p, 2000), 80000) END AS p FROM h
), w AS (
    SELECT *, CASE WHEN q <= 10 THEN -0.3 WHEN q <= 30 THEN 0.1 ELSE 0.45 END AS wq, CASE WHEN p <= 40000 THEN 0.2 WHEN p IS NOT NULL THEN -0.15 END AS wp FROM c
)
SELECT l_orderkey, l_linenumber, round(600 - 40 * (CASE WHEN wq <= 0.1 THEN CASE WHEN load <= 6.5 THEN -0.4 ELSE 0.05 END ELSE 0.3 END + CASE WHEN coalesce(wp, -1) <= 0 THEN -0.1 ELSE 0.2 END), 6) + 0.0::DOUBLE AS risk_score FROM w""")
def specification_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a written specification, read back from its JSON: every kind of step."""
    df = holed(spark, sf_dir).select(*ID, "q", "p", "l_tax", "l_discount")
    return rounded(add_risk_score(df, SPEC.to_json()).select(*ID, "risk_score"))


@query(f"WITH {TX}, b AS (SELECT *, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS qb FROM tx), {woe_sql(['qb'], 'b')} SELECT l_orderkey, l_linenumber, round(woe, 6) + 0.0::DOUBLE AS l_quantity FROM b JOIN woe ON value = qb")
def woe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transactions(spark, sf_dir).select(*ID, "bad", "l_quantity")
    bins = BinModel({"l_quantity": EDGES})
    fitted = WoeEncoder().fit(bins.transform(df), "bad", ["l_quantity"])
    return rounded(WoeModel(fitted.woe, fitted.iv, bins).transform(df).drop("bad"))


def psi_sql(features: list[str], key: str, other: str) -> str:
    return f"""r AS ({unpivoted(features, "", "(SELECT * FROM tx WHERE tag = 'train')")}), o AS ({unpivoted(features, f"{key} AS k", f"(SELECT * FROM tx WHERE {other})")}),
e AS (SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda x: round(x, 9)))) AS e FROM r GROUP BY feature),
bins AS (SELECT feature, len(e) - 1 AS nb, unnest(range(len(e) - 1)) AS bin FROM e WHERE len(e) > 1),
rb AS (SELECT feature, least(len(list_filter(e, lambda x: x <= value)) - 1, len(e) - 2) AS bin, count(*) AS c FROM r JOIN e USING (feature) WHERE value BETWEEN e[1] AND e[-1] GROUP BY ALL),
ob AS (SELECT k, feature, least(len(list_filter(e, lambda x: x <= value)) - 1, len(e) - 2) AS bin, count(*) AS c FROM o JOIN e USING (feature) WHERE value BETWEEN e[1] AND e[-1] GROUP BY ALL),
p AS (SELECT feature, bin, (coalesce(c, 0) + 1e-4) / (sum(coalesce(c, 0)) OVER (PARTITION BY feature) + 1e-4 * nb) AS p FROM bins LEFT JOIN rb USING (feature, bin)),
q AS (SELECT k, feature, bin, (coalesce(c, 0) + 1e-4) / (sum(coalesce(c, 0)) OVER (PARTITION BY k, feature) + 1e-4 * nb) AS q FROM (SELECT DISTINCT k FROM o) ks CROSS JOIN bins LEFT JOIN ob USING (k, feature, bin))
SELECT k AS {key}, feature, round(greatest(0, sum((q - p) * ln(q / p))), 6) AS psi FROM q JOIN p USING (feature, bin) GROUP BY 1, 2"""


@query(f"WITH {TX}, {psi_sql(FEATURES + ['score'], 'tag', 'true')}")
def psi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transactions(spark, sf_dir)
    return rounded(stats.psi(df.filter("tag = 'train'"), df, [*FEATURES, "score"], ["tag"], digits=DIGITS))


@query(f"WITH {TX}, {psi_sql(FEATURES + ['score'], 'tag', 'true')}")
def psi_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a monitor's frozen bins, in one pass over the table."""
    df = transactions(spark, sf_dir)
    return rounded(PsiMonitor.fit(df.filter("tag = 'train'"), [*FEATURES, "score"], digits=DIGITS).psi(df, ["tag"]))


DAYS = "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))"


@query(f"WITH {TX}, {psi_sql(['score', 'l_tax'], 'first_day', 'true').replace('first_day AS k', DAYS + ' // 364 * 364 AS k')}")
def psi_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 52 weeks of a stream of line items, against bins frozen on the training years."""
    df = transactions(spark, sf_dir)
    monitor = PsiMonitor.fit(df.filter("tag = 'train'"), ["score", "l_tax"], digits=DIGITS)
    rows = df.select("score", "l_tax", F.timestamp_seconds(F.unix_date(F.col("l_shipdate").cast("date")) * 86400).alias("time"))
    ws = Workspace(spark, "stream")
    rows.write.parquet(ws.path("in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(ws.path("in"))
    out = monitor.stream(stream, "time", "364 days", "40000 days").select((F.unix_seconds("window.start") / 86400).cast("long").alias("first_day"), "feature", "psi")
    name = f"psi_{uuid.uuid4().hex}"
    out.writeStream.format("memory").queryName(name).option("checkpointLocation", ws.path("state")).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(name))


@query()
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of all tags from the sketches of each, and their index against the training years, without reading rows twice."""
    parts = Workspace(spark, "sketches").save(sketches.sketches(transactions(spark, sf_dir), [*FEATURES, "score"], ["tag"]), "parts")
    whole = sketches.sketch_quantiles(sketches.merged(parts), [0.0, 0.25, 0.5, 0.75, 1.0]).select("feature", "n", "n_missing", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.get("quantiles", F.lit(i)).alias("value")) for i, p in enumerate([0.0, 0.25, 0.5, 0.75, 1.0])])).alias("x")).select("feature", "n", "n_missing", "x.*")
    index = sketches.sketch_psi(parts.filter("tag = 'train'"), parts, ["tag"])
    return whole.join(index.groupBy("feature").agg(F.max("psi").alias("worst_psi")), "feature")


LATER = "tag <> 'train'"


@query(f"WITH {TX}, {psi_sql(['score', 'l_tax'], 'month', LATER)}")
def psi_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_month(transactions(spark, sf_dir), "l_shipdate")
    return rounded(stats.psi(df.filter("tag = 'train'"), df.filter("tag <> 'train'"), ["score", "l_tax"], ["month"], digits=DIGITS))


PAIRS = [(a, b) for i, a in enumerate([*FEATURES, "score"]) for b in [*FEATURES, "score"][i + 1 :]]


@query(f"WITH {TX} " + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 6) + 0.0::DOUBLE AS r FROM tx" for a, b in PAIRS))
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlations(transactions(spark, sf_dir), [*FEATURES, "score"]))


CORR = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, {i} AS place, corr({a}, {b}) AS r FROM tx" for i, (a, b) in enumerate(PAIRS))


@query(f"WITH {TX}, c AS ({CORR}) SELECT f1, f2, round(r, 6) AS r FROM c WHERE abs(r) > 0.3")
def high_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlations(transactions(spark, sf_dir), [*FEATURES, "score"], 0.3))


VARIANCES = " UNION ALL ".join(f"SELECT '{f}' AS feature, var_samp({f}) AS v FROM tx" for f in [*FEATURES, "score"])


@query(f"""WITH RECURSIVE {TX}, c AS ({CORR}), v AS ({VARIANCES}), p AS (
    SELECT f1, f2, abs(r) AS r, a.v >= b.v AS first, row_number() OVER (ORDER BY abs(r) DESC, place) AS k FROM c JOIN v a ON a.feature = f1 JOIN v b ON b.feature = f2 WHERE abs(r) > 0.5
), walk AS (
    SELECT 0 AS k, CAST([] AS VARCHAR[]) AS gone
    UNION ALL
    SELECT p.k, CASE WHEN list_contains(gone, f1) OR list_contains(gone, f2) THEN gone WHEN first THEN list_append(gone, f2) ELSE list_append(gone, f1) END FROM walk JOIN p ON p.k = walk.k + 1
), last AS (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)
SELECT feature, NOT list_contains(gone, feature) AS kept, round(coalesce((SELECT max(r) FROM p WHERE f1 = feature OR f2 = feature), 0), 6) AS strongest FROM v, last""")
def corr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = CorrelationSelector(0.5).fit(transactions(spark, sf_dir), "bad", [*FEATURES, "score"])
    return rounded(spark.createDataFrame([(f, f in model.kept, v) for f, v in model.values.items()], "feature string, kept boolean, strongest double"))


OUT = "tag = 'oot'"


@query(f"WITH {TX}, {psi_sql(FEATURES, 'tag', OUT).replace('SELECT k AS tag, feature, round(greatest', 'SELECT feature, greatest(0, sum((q - p) * ln(q / p))) <= 0.001 AS kept, round(greatest')}".replace("GROUP BY 1, 2", "GROUP BY feature"))
def psi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transactions(spark, sf_dir)
    model = PSISelector(0.001).fit(df.filter("tag = 'train'"), "bad", FEATURES, validation=df.filter("tag = 'oot'"))
    return rounded(spark.createDataFrame([(f, f in model.kept, v) for f, v in model.values.items()], "feature string, kept boolean, psi double"))


@query()
def chimerge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ChiMergeBinner(max_bins=5, special_values={"q": [-999.0]}).fit(holed(spark, sf_dir), "bad", ["q", "l_extendedprice", "l_linestatus"])
    return spark.createDataFrame([(f, b, text) for f in model.edges for b, text in model.table(f)], "feature string, bin int, range string")


@query(f"WITH {TX}, b AS (SELECT *, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS qb FROM tx), {woe_sql(['qb'], 'b')} SELECT 'l_quantity' AS feature, CAST(value AS INTEGER) AS bin, n_neg AS goods, n_pos AS bads, n_neg + n_pos AS total, round(n_pos / (n_neg + n_pos), 6) AS bad_rate, round(woe, 6) + 0.0::DOUBLE AS woe FROM woe")
def var_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, bins = transactions(spark, sf_dir), BinModel({"l_quantity": EDGES})
    fitted = WoeEncoder().fit(bins.transform(df), "bad", ["l_quantity"])
    return rounded(binned_counts(df, WoeModel(fitted.woe, fitted.iv, bins), "bad").drop("range"))


# --- metrics -------------------------------------------------------------------------------------------------------


def auc_sql(keys: str, source: str = "tx", y: str = "bad", s: str = "score") -> str:
    return f"""SELECT {keys}, coalesce(sum(p * (cb + n / 2)) / nullif(sum(p) * sum(n), 0), 0) AS auc FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cb FROM (
        SELECT {keys}, {s} AS s, sum({y})::DOUBLE AS p, (count(*) - sum({y}))::DOUBLE AS n FROM {source} WHERE {y} IN (0, 1) GROUP BY ALL)) GROUP BY ALL"""


def ks_sql(keys: str, source: str = "tx", y: str = "bad", s: str = "score") -> str:
    return f"""SELECT {keys}, coalesce(max(abs(cp / nullif(p, 0) - cn / nullif(n, 0))), 0) AS ks FROM (
    SELECT {keys}, sum(y) OVER w AS cp, sum(c - y) OVER w AS cn, sum(y) OVER (PARTITION BY {keys}) AS p, sum(c - y) OVER (PARTITION BY {keys}) AS n FROM (
        SELECT {keys}, k + CASE WHEN s >= (k + 1) * 0.01::DOUBLE AND k < 99 THEN 1 WHEN s < k * 0.01::DOUBLE THEN -1 ELSE 0 END AS bin, sum(y)::DOUBLE AS y, count(*)::DOUBLE AS c FROM (
            SELECT {keys}, {s} AS s, {y} AS y, least(99, floor({s} / 0.01::DOUBLE)) AS k FROM {source} WHERE {y} IN (0, 1)) GROUP BY ALL)
    WINDOW w AS (PARTITION BY {keys} ORDER BY bin ROWS UNBOUNDED PRECEDING)) GROUP BY ALL"""


def lift_sql(keys: str, percents: tuple[int, ...], source: str = "tx", y: str = "bad", s: str = "score") -> str:
    tops = ", ".join(f"coalesce(avg({y}) FILTER (WHERE {s} >= c{p}) / nullif(avg({y}), 0), 0) AS lift_{p}" for p in percents)
    cuts = ", ".join(f"round(quantile_cont({s}, {1 - p / 100}), 9) AS c{p}" for p in percents)
    return f"SELECT {keys}, {tops} FROM {source} JOIN (SELECT {keys}, {cuts} FROM {source} WHERE {y} IN (0, 1) GROUP BY ALL) USING ({keys}) WHERE {y} IN (0, 1) GROUP BY ALL"


def effect_sql(keys: str, percents: tuple[int, ...], source: str = "tx", y: str = "bad", s: str = "score") -> str:
    lifts = ", ".join(f"round(lift_{p}, 6) AS lift_{p}" for p in percents)
    return f"""SELECT {keys}, n, bads, round(auc, 6) AS auc, round(ks, 6) AS ks, {lifts} FROM (SELECT {keys}, count(*) AS n, CAST(sum({y}) AS BIGINT) AS bads FROM {source} WHERE {y} IN (0, 1) GROUP BY ALL)
JOIN ({auc_sql(keys, source, y, s)}) USING ({keys}) JOIN ({ks_sql(keys, source, y, s)}) USING ({keys}) JOIN ({lift_sql(keys, percents, source, y, s)}) USING ({keys})"""


@query(f"WITH {TX} SELECT tag, round(auc, 6) AS auc FROM ({auc_sql('tag')})")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(transactions(spark, sf_dir), "bad", "score", ["tag"]))


@query(f"WITH {TX} SELECT tag, round(auc, 6) AS auc FROM ({auc_sql('tag', s='l_discount')})")
def auc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(transactions(spark, sf_dir), "bad", "l_discount", ["tag"]))


@query(f"WITH {TX} SELECT tag, round(ks, 6) AS ks FROM ({ks_sql('tag')})")
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ks(transactions(spark, sf_dir), "bad", "score", ["tag"]))


@query(f"WITH {TX} SELECT tag, round(lift_10, 6) AS lift_10, round(lift_5, 6) AS lift_5 FROM ({lift_sql('tag', (10, 5))})")
def lift_at_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.lift_at(transactions(spark, sf_dir), "bad", "score", (10, 5), ["tag"], DIGITS))


@query(f"WITH {TX} {effect_sql('tag', (10, 5, 2, 1))}")
def effect_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.effect_table(transactions(spark, sf_dir), "bad", "score", ["tag"], digits=DIGITS))


@query(f"WITH {TX} {effect_sql('tag, month', (10, 5))}")
def effect_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.effect_table(with_month(transactions(spark, sf_dir), "l_shipdate"), "bad", "score", ["tag", "month"], (10, 5), DIGITS))


def lift_table_sql(source: str, y: str, key: str = "tag", baseline: str = "") -> str:
    base = f"LEFT JOIN (SELECT {key}, len(list_filter(e, lambda x: x <= {baseline})) AS bin, count(*) FILTER (WHERE {y} = 0) AS base_goods, count(*) FILTER (WHERE {y} = 1) AS base_bads FROM {source} JOIN e USING ({key}) GROUP BY ALL) USING ({key}, bin)" if baseline else ""
    more = ", coalesce(base_goods, 0) AS base_goods, coalesce(base_bads, 0) AS base_bads, round(coalesce(base_bads / nullif(base_goods + base_bads, 0), 0), 6) AS base_bad_rate" if baseline else ""
    return f"""e AS (SELECT {key}, list_sort(list_distinct(list_transform(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda x: round(x, 9))))[2:-2] AS e, count(*) AS n_all, count(*) FILTER (WHERE {y} = 1) AS ab, count(*) FILTER (WHERE {y} = 0) AS ag FROM {source} GROUP BY ALL),
c AS (SELECT {key}, len(list_filter(e, lambda x: x <= score)) AS bin, min(score) AS lo, max(score) AS hi, count(*) FILTER (WHERE {y} = 0) AS goods, count(*) FILTER (WHERE {y} = 1) AS bads FROM {source} JOIN e USING ({key}) GROUP BY ALL),
f AS (SELECT {key}, bin, lo, hi, coalesce(goods, 0) AS goods, coalesce(bads, 0) AS bads, n_all, ab, ag FROM (SELECT {key}, n_all, ab, ag, unnest(range(len(e) + 1)) AS bin FROM e) LEFT JOIN c USING ({key}, bin))
SELECT {key}, CAST(bin AS INTEGER) AS bin, round(lo, 6) AS min, round(hi, 6) AS max, goods, bads, goods + bads AS total, round((goods + bads) / n_all, 6) AS total_pct, round(coalesce(bads / nullif(goods + bads, 0), 0), 6) AS bad_rate,
       round(coalesce(sum(bads) OVER w / nullif(ab, 0), 0) - coalesce(sum(goods) OVER w / nullif(ag, 0), 0), 6) + 0.0::DOUBLE AS ks, round(coalesce(bads / nullif(goods + bads, 0) / nullif(ab / nullif(ab + ag, 0), 0), 0), 6) AS lift,
       round(coalesce(sum(bads) OVER w / nullif(sum(goods + bads) OVER w, 0) / nullif(ab / nullif(ab + ag, 0), 0), 0), 6) AS cum_lift{more}
FROM f {base} WINDOW w AS (PARTITION BY {key} ORDER BY bin ROWS UNBOUNDED PRECEDING)"""


@query(f"WITH {TX}, {lift_table_sql('tx', 'bad')}")
def score_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.lift_table(transactions(spark, sf_dir), "bad", "score", ["tag"], digits=DIGITS))


@query(f"WITH {TX}, {lift_table_sql('tx', 'bad', baseline='baseline')}")
def score_lift_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.lift_table(transactions(spark, sf_dir), "bad", "score", ["tag"], baseline="baseline", digits=DIGITS))


@query(f"WITH {TX}, g AS (SELECT tag AS dataset, gray, score FROM tx WHERE gray >= 0 UNION ALL SELECT d, gray, score FROM tx, (VALUES ('train'), ('test'), ('oot'), ('gray')) AS t(d) WHERE gray = -1), {lift_table_sql('g', 'gray', 'dataset')}")
def score_lift_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transactions(spark, sf_dir).withColumn("tag", F.when(F.col("gray") == -1, "gray").otherwise(F.col("tag")))
    return rounded(metrics.lift_table(with_gray(df, "tag", "gray", ["train", "test", "oot"]), "gray", "score", ["dataset"], digits=DIGITS))


@query(f"""WITH {TX}, c AS (SELECT tag, 10 AS pct, round(quantile_cont(score, 0.1), 9) AS cn, round(quantile_cont(baseline, 0.1), 9) AS co FROM tx GROUP BY tag
    UNION ALL SELECT tag, 20, round(quantile_cont(score, 0.2), 9), round(quantile_cont(baseline, 0.2), 9) FROM tx GROUP BY tag)
SELECT tag, CAST(pct AS DOUBLE) AS pct, count(*) FILTER (WHERE score <= cn) AS new_reject, count(*) FILTER (WHERE score > cn) AS new_pass, count(*) FILTER (WHERE score <= cn AND bad = 1) AS new_reject_bad, count(*) FILTER (WHERE score > cn AND bad = 0) AS new_pass_good,
       count(*) FILTER (WHERE baseline <= co) AS old_reject, count(*) FILTER (WHERE baseline > co) AS old_pass, count(*) FILTER (WHERE baseline <= co AND score > cn) AS swap_in, count(*) FILTER (WHERE baseline > co AND score <= cn) AS swap_out,
       count(*) FILTER (WHERE baseline <= co AND score > cn) - count(*) FILTER (WHERE baseline > co AND score <= cn) AS net FROM tx JOIN c USING (tag) GROUP BY ALL""")
def swap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.swap_table(transactions(spark, sf_dir), "bad", "score", "baseline", keys=["tag"], digits=DIGITS)


@query(f"WITH {TX}, m AS (SELECT tag, bad, 'score' AS model, score AS value FROM tx UNION ALL SELECT tag, bad, 'baseline', baseline FROM tx) {effect_sql('tag, model', (10,), 'm', 'bad', 'value')}")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare_scores(transactions(spark, sf_dir), "bad", ["score", "baseline"], ["tag"], DIGITS))


@query(f"WITH {TX}, m AS (SELECT tag, score AS s, 'bad' AS label, bad AS y FROM tx UNION ALL SELECT tag, score, 'gray', gray FROM tx) {effect_sql('tag, label', (10,), 'm', 'y', 's')}")
def mob_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare_labels(transactions(spark, sf_dir), ["bad", "gray"], "score", ["tag"], DIGITS))


@query(f"""WITH {TX}, h AS (SELECT *, CASE WHEN score >= (SELECT round(quantile_cont(score, 0.5), 9) FROM tx) THEN 1 ELSE 0 END AS high FROM tx), u AS ({unpivoted(FEATURES, "high", "h")}),
e AS (SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda x: round(x, 9))))[2:-2] AS e FROM u GROUP BY feature),
b AS (SELECT feature, len(list_filter(e, lambda x: x <= value)) AS bin, sum(high)::DOUBLE AS p, (count(*) - sum(high))::DOUBLE AS n FROM u JOIN e USING (feature) GROUP BY ALL)
SELECT feature, round(max(d), 6) AS ks FROM (SELECT feature, abs(sum(p) OVER w / sum(p) OVER (PARTITION BY feature) - sum(n) OVER w / sum(n) OVER (PARTITION BY feature)) AS d FROM b WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)) GROUP BY feature""")
def feature_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.feature_ks(transactions(spark, sf_dir), FEATURES, "score", digits=DIGITS))


@query(f"WITH {TX}, u AS ({unpivoted(FEATURES)}) SELECT feature, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max, round(1 - count(value) / count(*), 6) AS missing_rate, round(count(DISTINCT value) / count(value), 6) AS distinct_ratio FROM u GROUP BY feature")
def var_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.profile(transactions(spark, sf_dir), FEATURES)
    names = ("min", "p25", "p50", "p75", "max")
    return rounded(t.select("feature", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)], "missing_rate", "distinct_ratio"))


@query(f"WITH {TX}, t AS (SELECT *, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM tx) SELECT l_orderkey, l_linenumber, round(600 - 50 * (ln(p) - ln(1 - p)), 6) AS points FROM t")
def scale_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transactions(spark, sf_dir).select(*ID, LogitScale().of_probability(F.col("score")).alias("points")))


@query(f"WITH {TX}, t AS (SELECT *, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM tx) SELECT l_orderkey, l_linenumber, round(600 - 20 / ln(2) * ln(50) - 20 / ln(2) * (ln(p) - ln(1 - p)), 6) AS points FROM t")
def scale_pdo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transactions(spark, sf_dir).select(*ID, pdo_scale(pdo=20.0).of_probability(F.col("score")).alias("points")))


# --- models --------------------------------------------------------------------------------------------------------

TREES = [
    {"feature": "l_quantity", "threshold": 24.0, "left": {"feature": "p", "threshold": 30000.0, "left": -0.4, "right": 0.1, "missing_left": True}, "right": 0.3},
    {"feature": "l_discount", "threshold": 0.05, "mode": "lt", "left": -0.2, "right": {"feature": "l_tax", "threshold": 0.04, "left": 0.15, "right": 0.25}},
]


@query(f"WITH {HOLED} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(CASE WHEN l_quantity <= 24 THEN CASE WHEN coalesce(p <= 30000, true) THEN -0.4 ELSE 0.1 END ELSE 0.3 END + CASE WHEN l_discount < 0.05::DOUBLE THEN -0.2 ELSE CASE WHEN l_tax <= 0.04::DOUBLE THEN 0.15 ELSE 0.25 END END))), 6) AS risk_score FROM h")
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(literal_trees(TREES, ["l_quantity", "p", "l_discount", "l_tax"]).transform(holed(spark, sf_dir)).select(*ID, "risk_score"))


#: A dump with the three kinds of missing values and a split by category.
DUMP = {
    "feature_names": ["l_quantity", "p", "l_discount", "l_linenumber"],
    "tree_info": [
        {"tree_structure": {"split_feature": 1, "threshold": 30000.0, "decision_type": "<=", "missing_type": "NaN", "default_left": False, "left_child": {"leaf_value": -0.4}, "right_child": {"split_feature": 3, "threshold": "1||3||6", "decision_type": "==", "missing_type": "NaN", "left_child": {"leaf_value": 0.35}, "right_child": {"leaf_value": 0.1}}}},
        {"tree_structure": {"split_feature": 2, "threshold": 0.05, "decision_type": "<=", "missing_type": "Zero", "default_left": False, "left_child": {"leaf_value": -0.2}, "right_child": {"leaf_value": 0.3}}},
        {"tree_structure": {"split_feature": 1, "threshold": 20000.0, "decision_type": "<=", "missing_type": "None", "default_left": False, "left_child": {"leaf_value": 0.15}, "right_child": {"split_feature": 0, "threshold": 24.0, "decision_type": "<=", "missing_type": "None", "left_child": {"leaf_value": -0.05}, "right_child": {"leaf_value": 0.25}}}},
    ],
}


@query(f"""WITH {HOLED} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(
    CASE WHEN p <= 30000 THEN -0.4 WHEN l_linenumber IN (1, 3, 6) THEN 0.35 ELSE 0.1 END
    + CASE WHEN l_discount <= 0.05::DOUBLE AND l_discount <> 0 THEN -0.2 ELSE 0.3 END
    + CASE WHEN coalesce(p, 0) <= 20000 THEN 0.15 WHEN l_quantity <= 24 THEN -0.05 ELSE 0.25 END))), 6) AS risk_score FROM h""")
def dump_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a dumped model, as its library gives them."""
    return rounded(from_lightgbm_dump(DUMP).transform(holed(spark, sf_dir)).select(*ID, "risk_score"))


_SOFT = lambda g, h: f"power(greatest(abs({g}) - 0.1, 0), 2) / ({h} + 1)"
_GAIN = f"{_SOFT('lg', 'lh')} + {_SOFT('g - lg', 'h - lh')} - {_SOFT('g', 'h')}"


@query(f"""WITH {TX}, t AS (
    SELECT l_orderkey, l_linenumber, 0.5 - bad AS g, [CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)] AS x FROM tx
), c1 AS (
    SELECT f, v, sum(n) OVER w AS ln, sum(s) OVER w AS lg, sum(n) OVER w * 0.25 AS lh, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS g, sum(n) OVER (PARTITION BY f) * 0.25 AS h
    FROM (SELECT f, x[f] AS v, count(*) AS n, sum(g) AS s FROM t, unnest([1, 2, 3]) AS u(f) GROUP BY 1, 2) WINDOW w AS (PARTITION BY f ORDER BY v)
), r1 AS (
    SELECT f AS f1, v AS v1 FROM c1 WHERE ln >= 20 AND n - ln >= 20 ORDER BY {_GAIN} DESC, f, v LIMIT 1
), t1 AS (
    SELECT t.*, x[f1] <= v1 AS side FROM t, r1
), c2 AS (
    SELECT side, f, v, sum(n) OVER w AS ln, sum(s) OVER w AS lg, sum(n) OVER w * 0.25 AS lh, sum(n) OVER (PARTITION BY side, f) AS n, sum(s) OVER (PARTITION BY side, f) AS g, sum(n) OVER (PARTITION BY side, f) * 0.25 AS h
    FROM (SELECT side, f, x[f] AS v, count(*) AS n, sum(g) AS s FROM t1, unnest([1, 2, 3]) AS u(f) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY side, f ORDER BY v)
), r2 AS (
    SELECT side AS side2, f AS f2, v AS v2 FROM c2 WHERE ln >= 20 AND n - ln >= 20 ORDER BY {_GAIN} DESC, side DESC, f, v LIMIT 1
), leaf AS (
    SELECT l_orderkey, l_linenumber, g, CASE WHEN side <> side2 THEN 0 WHEN x[f2] <= v2 THEN 1 ELSE 2 END AS k FROM t1, r2
), val AS (
    SELECT k, -sign(sum(g)) * greatest(abs(sum(g)) - 0.1, 0) / (count(*) * 0.25 + 1) * 0.3 AS m FROM leaf GROUP BY k
)
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-m)), 6) AS risk_score FROM leaf JOIN val USING (k)""")
def leafwise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tree of a model grown by leaves: three leaves, by the two best splits."""
    df = transactions(spark, sf_dir).select(*ID, "bad", "l_quantity", "l_discount", "l_tax")
    model = LeafwiseClassifier(trees=1, leaves=3, rate=0.3, start=0.5, subsample=1.0, columns=1.0).fit(df, "bad", ["l_quantity", "l_discount", "l_tax"])
    return rounded(model.transform(df).select(*ID, "risk_score"))


@query()
def leafwise_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model grown by leaves with early stopping: later shipments validate, all are scored."""
    df = transactions(spark, sf_dir).select(*ID, "bad", "tag", "l_linestatus", *FEATURES)
    model = LeafwiseClassifier(trees=8, leaves=15, rate=0.2, patience=4).fit(df.filter("tag = 'train'"), "bad", [*FEATURES, "l_linestatus"], validation=df.filter("tag = 'test'"))
    return rounded(model.transform(df).select(*ID, "risk_score"))


@query()
def pipeline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed(spark, sf_dir).select(*ID, "bad", "q", "p", "l_discount", "l_tax")
    steps = [FeatureDerivation((("unit", "p / q"),)), FeatureCleaner(), BinnerWoeEncoder(max_bins=5), IVSelector(0.0, 1.0), CorrelationSelector(0.9), BoostedClassifier(trees=5, depth=3, scale=pdo_scale())]
    return Pipeline(steps).fit(df, "bad", ["q", "p", "l_discount", "l_tax"]).score(df).select(*ID, F.round("risk_score", 6).alias("risk_score"))


LOANS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Fully Paid' WHEN 'P' THEN 'Charged Off' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Current' ELSE 'Default' END END AS loan_status, o_totalprice AS loan_amnt FROM orders"


@query(f"WITH l AS ({LOANS}) SELECT id, loan_amnt, CASE WHEN loan_status = 'Fully Paid' THEN 0 ELSE 1 END AS target FROM l WHERE loan_status <> 'Current'")
def loan_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled loans with their target and the columns left when ids, the status and what is known only later are gone."""
    orders, status = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderstatus")
    open_ = F.when(F.col("o_orderkey") % 3 == 0, "Current").otherwise("Default")
    raw = orders.select(F.col("o_orderkey").alias("id"), F.when(status == "F", "Fully Paid").when(status == "P", "Charged Off").when(status == "O", open_).alias("loan_status"), F.col("o_totalprice").alias("loan_amnt"), F.lit(1.0).alias("hardship_amount"), F.lit("Y").alias("debt_settlement_flag"))
    return with_target(raw).select("id", *select_features(raw.columns, "all"), "target")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 36 WHEN 'F' THEN 60 END::DOUBLE AS term, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 10 WHEN o_orderpriority LIKE '3%' THEN 3 END::DOUBLE AS emp_length, round(CAST(o_orderkey % 30 AS DOUBLE) + 0.5, 6) AS int_rate FROM orders""")
def loan_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c, first = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    term = F.when(c == "O", " 36 months").when(c == "F", " 60 months").otherwise("n/a")
    years = F.when(first == "1", "< 1 year").when(first == "2", "10+ years").when(first == "3", "3 years").otherwise("n/a")
    raw = orders.select("o_orderkey", term.alias("term"), years.alias("emp_length"), F.concat((F.col("o_orderkey") % 30 + 0.5).cast("double").cast("string"), F.lit("%")).alias("int_rate"))
    return rounded(preprocess(raw))


IMPORTANCE = "SELECT s.n_name AS experiment, p_type AS feature, sum(l_extendedprice) AS importance FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY ALL"


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by nation and kind of part, as if they were importances by experiment and feature."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    sold = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return sold.groupBy(F.col("n_name").alias("experiment"), F.col("p_type").alias("feature")).agg(F.sum("l_extendedprice").alias("importance"))


@query(f"WITH i AS ({IMPORTANCE}), r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY round(importance, 2) DESC, feature) AS rank, sum(importance) OVER (PARTITION BY experiment) AS t FROM i) SELECT experiment, feature, CAST(rank AS INTEGER) AS rank, round(importance * 100 / t, 6) AS pct FROM r WHERE rank <= 5")
def topn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(top_features(importances(spark, sf_dir).withColumn("importance", F.round("importance", 2)), 5).drop("importance"))


@query(f"WITH i AS ({IMPORTANCE}), r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY round(importance, 2) DESC, feature) AS rank FROM i), n AS (SELECT count(DISTINCT experiment) AS runs FROM i) SELECT feature, round((sum(rank) + (max(runs) - count(*)) * 6) / max(runs), 6) AS avg_rank, count(*) AS n_top FROM r, n WHERE rank <= 5 GROUP BY feature")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(average_ranks(importances(spark, sf_dir).withColumn("importance", F.round("importance", 2)), 5))
