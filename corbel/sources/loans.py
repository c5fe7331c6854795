"""The consumer-loan file: projection, cleaning of its strings, target; and a seeded synthetic table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.functions.expressions import lookup

#: Statuses of the file by outcome.
BAD_STATUSES = ("Charged Off", "Default", "Does not meet the credit policy. Status:Charged Off")
PAID_STATUSES = ("Fully Paid", "Does not meet the credit policy. Status:Fully Paid")
#: Years of employment by the file's words.
EMPLOYMENT_YEARS = {"< 1 year": 0.0, "1 year": 1.0, "2 years": 2.0, "3 years": 3.0, "4 years": 4.0, "5 years": 5.0, "6 years": 6.0, "7 years": 7.0, "8 years": 8.0, "9 years": 9.0, "10+ years": 10.0}
#: Columns used by default, and columns known only after the outcome.
SELECTED = ("acc_now_delinq", "addr_state", "annual_inc", "delinq_2yrs", "dti", "earliest_cr_line", "emp_length", "fico_range_high", "fico_range_low", "grade", "home_ownership", "installment", "int_rate", "loan_amnt", "mort_acc", "num_actv_rev_tl", "num_tl_90g_dpd_24m", "open_acc", "pct_tl_nvr_dlq", "pub_rec", "pub_rec_bankruptcies", "purpose", "revol_bal", "revol_util", "sub_grade", "term", "tot_coll_amt", "tot_cur_bal", "total_acc", "total_rev_hi_lim", "verification_status")
LEAKING = ("collection_recovery_fee", "debt_settlement_flag", "debt_settlement_flag_date", "disbursement_method", "hardship_amount", "hardship_dpd", "hardship_end_date", "hardship_flag", "hardship_last_payment_amount", "hardship_length", "hardship_loan_status", "hardship_payoff_balance", "hardship_reason", "hardship_start_date", "hardship_status", "hardship_type", "last_credit_pull_d", "last_fico_range_high", "last_fico_range_low", "last_pymnt_amnt", "last_pymnt_d", "next_pymnt_d", "orig_projected_additional_accrued_interest", "out_prncp", "out_prncp_inv", "recoveries", "settlement_amount", "settlement_date", "settlement_percentage", "settlement_status", "settlement_term", "total_pymnt", "total_pymnt_inv", "total_rec_int", "total_rec_late_fee", "total_rec_prncp")
_IDS = ("id", "member_id", "url", "loan_status")


def preprocess(df: DataFrame) -> DataFrame:
    """Digits of ``term``, years of ``emp_length``, numbers of percent strings, where these columns are; bad cells are NULL."""
    ways = {
        "term": lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("double"),
        "emp_length": lambda c: lookup(c, EMPLOYMENT_YEARS),
        "int_rate": lambda c: F.rtrim(c.cast("string"), F.lit("% ")).try_cast("double"),
        "revol_util": lambda c: F.rtrim(c.cast("string"), F.lit("% ")).try_cast("double"),
    }
    return df.withColumns({n: f(F.col(n)) for n, f in ways.items() if n in df.columns})


def with_target(df: DataFrame, name: str = "target") -> DataFrame:
    """Settled loans only: 1 for bad outcomes, 0 for paid ones."""
    return df.filter(F.col("loan_status").isin(*BAD_STATUSES, *PAID_STATUSES)).withColumn(name, F.col("loan_status").isin(*BAD_STATUSES).cast("int"))


def select_features(columns: Sequence[str], use: str | Sequence[str] = "selected", drop_leaking: bool = True) -> list[str]:
    """Sorted feature names: "selected", "all" or given ones, without ids, the status and, by default, leaking ones."""
    wanted = SELECTED if use == "selected" else columns if use == "all" else use
    gone = {*_IDS, *(LEAKING if drop_leaking else ())}
    return sorted(c for c in set(wanted) & set(columns) if c not in gone)


def load(spark: SparkSession, path: str, use: str | Sequence[str] = "selected", drop_leaking: bool = True, fraction: float | None = None, seed: int = 42, schema: str | None = None) -> DataFrame:
    """Features and ``target`` of a CSV file with a header; name ``schema`` for large files, inferring reads them twice."""
    reader = spark.read.option("header", True)
    raw = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    out = preprocess(with_target(raw)).select(*select_features(raw.columns, use, drop_leaking), "target")
    return out if fraction is None else out.sample(fraction, seed)


#: What the columns mean.
DICTIONARY = {
    "loan_amnt": "amount asked for", "term": "months to pay", "int_rate": "interest in percent", "installment": "monthly payment", "grade": "lender's grade", "emp_length": "years employed", "home_ownership": "housing", "annual_inc": "yearly income",
    "verification_status": "whether income was checked", "dti": "debt to income", "revol_bal": "revolving balance", "revol_util": "revolving use in percent", "delinq_2yrs": "delinquencies in two years", "fico_range_low": "lower bound of the score", "fico_range_high": "upper bound of the score", "open_acc": "open accounts", "total_acc": "all accounts", "purpose": "use of the loan",
    "sub_grade": "lender's finer grade", "earliest_cr_line": "month of the first credit line", "pub_rec": "derogatory public records", "addr_state": "state of residence", "acc_now_delinq": "accounts now delinquent", "tot_cur_bal": "current balance of all accounts",
    "tot_coll_amt": "collections ever owed", "total_rev_hi_lim": "limit of revolving credit", "mort_acc": "mortgage accounts", "num_actv_rev_tl": "active revolving accounts", "num_tl_90g_dpd_24m": "accounts 90 days late in two years",
    "pct_tl_nvr_dlq": "percent of accounts never late", "pub_rec_bankruptcies": "bankruptcies on record",
}


def described(df: DataFrame) -> DataFrame:
    """The meanings as column metadata."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": DICTIONARY[c]}) if c in DICTIONARY else F.col(c) for c in df.columns])


def synthetic(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """amount, age, income, freq, noise1, noise2 and y, all from one seed; one value in twenty is -999."""
    rows = spark.range(n).select(
        F.exp(6 + 0.8 * F.randn(seed)).alias("amount"), F.least(F.greatest(F.lit(18.0), 35 + 10 * F.randn(seed + 1)), F.lit(65.0)).alias("age"), F.exp(8 + 0.7 * F.randn(seed + 2)).alias("income"),
        F.floor(-3 * F.ln(1 - F.rand(seed + 3))).cast("double").alias("freq"), F.randn(seed + 4).alias("noise1"), F.randn(seed + 5).alias("noise2"), F.rand(seed + 6).alias("u"), *[F.rand(seed + 7 + i).alias(f"m{i}") for i in range(3)],
    )
    p = 1 / (1 + F.exp(-(0.5 * F.ln("amount") + 0.02 * F.col("age") - 2.2)))
    marked = [F.when(F.col(f"m{i}") < 0.05, -999.0).otherwise(F.col(c)).alias(c) for i, c in enumerate(("amount", "age", "income"))]
    return rows.select(*marked, "freq", "noise1", "noise2", (F.col("u") < p).cast("int").alias("y"))
