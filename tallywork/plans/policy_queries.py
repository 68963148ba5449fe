"""Queries of policies by tenant: each tenant's files of two dates are written from the driver's tables, read again, and judged by the set in force.

Tenants whose nation's key leaves the same remainder by three have the same first set; the second set is that of the next remainder, and a fifth of the
tenants have no second one. One account id so has different groups, sides and classes of tax in one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import close, variance
from ..operators.policies import effective, in_force, policy_runs
from ..sources import readers
from ..sources.staging import new_path, staged
from .close_queries import _settled_of
from .derive import PAIRS_SQL, TB_SQL, _values, in_cents, money, policy, table
from .derive import tb as trial_balance

Q, S = {}, {}

#: Rows of the three sets by kind of file.
SETS = {
    "account_mapping": [
        (0, "110", "Working capital"), (0, "600-A", "Income"), (0, "600-N", "Income"), (0, "820", "Tax"), (1, "110", "Receivables"), (1, "600-A", "Sales"), (1, "600-N", "Sales"), (1, "600-R", "Sales"), (1, "820", "Payables"),
        (2, "110", "Working capital"), (2, "600-R", "Income"),
    ],
    "mapping_policy": [(0, "Assets", "Working capital"), (0, "Revenue", "Income"), (0, "Liabilities", "Payables"), (1, "Assets", "Receivables"), (1, "Revenue", "Sales"), (1, "Liabilities", "Payables"), (1, "Liabilities", "Tax"), (2, "Assets", "Cash")],
    "balance_policy": [(0, "110", "debit", "yes"), (0, "900", "nil", "no"), (1, "110", "credit", "no"), (1, "820", "credit", "no"), (2, "600-A", "nil", "yes"), (2, "910", "any", "yes")],
    "gst_mapping": [
        (0, "600-A", "taxable_sales"), (0, "600-N", "taxable_sales"), (0, "600-R", "taxable_sales"), (0, "820", "gst"), (0, "110", "bas_excluded"), (1, "600-A", "taxable_sales"), (1, "600-N", "gst_free"), (1, "600-R", "mixed"), (1, "820", "gst"),
        (2, "600-A", "gst_collected"), (2, "820", "gst"), (2, "110", "bas_excluded"),
    ],
}
#: Sections under review by set: least change, and per cent.
REVIEWED = [(0, "Revenue", "1000", "15"), (1, "Assets", "50000", "20"), (2, "Revenue", "20000", "5"), (2, "Liabilities", "100", "1")]
#: The dates of a tenant's first and second set.
DATES = ["1993-01-01", "1995-07-01"]
OWNERS_SQL = f"owners AS (SELECT n_name AS tenant, n_nationkey AS nation, CAST(f AS DATE) AS effective_from, (n_nationkey + s) % 3 AS variant FROM nation CROSS JOIN {_values([(d, i) for i, d in enumerate(DATES)])} v(f, s) WHERE s = 0 OR n_nationkey % 5 <> 4)"


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {OWNERS_SQL} SELECT * FROM owners".replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))


def write_sets(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Every tenant's files of one kind, in folders by tenant and date."""
    contract = readers.CONTRACTS[kind]
    heads = list(contract.columns)
    rows = policy(spark, SETS[kind], "variant int, " + ", ".join(f"c{i} string" for i in range(len(heads))))
    lines = rows.select("variant", F.lit(1).alias("seq"), F.concat_ws(",", *[f"c{i}" for i in range(len(heads))]).alias("value"))
    head = policy(spark, [(v, 0, ",".join(heads)) for v in range(3)], "variant int, seq int, value string")
    path = new_path(spark, f"sets-{kind}")
    out = owners(spark, sf_dir).join(head.unionByName(lines), "variant").select("tenant", F.col("effective_from").cast("string").alias("from"), "seq", "value")
    out.repartition("tenant", "from").sortWithinPartitions("tenant", "from", "seq").drop("seq").write.partitionBy("tenant", "from").option("lineSep", "\n").text(path)
    return path


def loaded(spark: SparkSession, sf_dir: str, kind: str, periods: DataFrame) -> DataFrame:
    """One kind's policy by period, from the files that pass."""
    return effective(readers.read_sets(spark, write_sets(spark, sf_dir, kind), readers.CONTRACTS[kind])[0], periods)


#: sets: which set is in force in a tenant's period
FORCE_SQL = f"""{TB_SQL}, {OWNERS_SQL}, d AS (SELECT DISTINCT tenant, report_date FROM tb),
  force AS (SELECT tenant, report_date, max(effective_from) AS effective_from, max_by(variant, effective_from) AS variant FROM d JOIN owners USING (tenant) WHERE effective_from <= report_date GROUP BY ALL),
  gforce AS (SELECT tenant, report_date, max(effective_from) AS effective_from, max_by(variant, effective_from) AS variant FROM d JOIN owners USING (tenant) WHERE effective_from <= report_date AND variant <> 2 GROUP BY ALL)"""


def _set(kind: str, columns: str, name: str, force: str = "force") -> str:
    return f"{name} AS (SELECT tenant, report_date, {columns} FROM {force} JOIN {_values(SETS[kind])} s(variant, {columns}) USING (variant))"


POLICY_SQL = f"""{FORCE_SQL}, {_set("account_mapping", "account_id, review_group", "mapped")}, {_set("mapping_policy", "section, review_group", "permitted")}, {_set("balance_policy", "account_id, e, m", "expected")}, {_set("gst_mapping", "account_id, gst_class", "classed", "gforce")},
  g AS (SELECT tenant, report_date, -sum(CASE WHEN gst_class = 'taxable_sales' THEN net ELSE 0 END) AS sales, -sum(CASE WHEN gst_class = 'gst' THEN net ELSE 0 END) AS tax, CASE WHEN day(report_date) = 31 THEN 10000 ELSE 0 END AS settled FROM tb JOIN classed USING (tenant, report_date, account_id) GROUP BY tenant, report_date),
  pf AS (SELECT p.tenant, p.report_date, p.account_id, e, m, coalesce(ytd, 0) AS n, coalesce(net, 0) AS v FROM expected p LEFT JOIN tb USING (tenant, report_date, account_id)),
  every AS (SELECT 'account_mapping' AS control, tenant, report_date, account_id, 'account has no review group' AS reason FROM tb JOIN force USING (tenant, report_date) ANTI JOIN mapped USING (tenant, report_date, account_id)
  UNION ALL SELECT 'mapping_compatibility', tenant, report_date, account_id, 'section permits: ' || coalesce((SELECT string_agg(x.review_group, ', ' ORDER BY x.review_group) FROM permitted x WHERE x.tenant = j.tenant AND x.report_date = j.report_date AND x.section = j.section), 'nothing') FROM (SELECT * FROM tb JOIN mapped USING (tenant, report_date, account_id)) j ANTI JOIN permitted USING (tenant, report_date, section, review_group)
  UNION ALL SELECT 'balance_policy', tenant, report_date, account_id, 'balance is not ' || e FROM pf WHERE e = 'debit' AND n < 0 OR e = 'credit' AND n > 0 OR e = 'nil' AND n <> 0
  UNION ALL SELECT 'balance_policy', tenant, report_date, account_id, 'no movement where one is expected' FROM pf WHERE m = 'yes' AND v = 0
  UNION ALL SELECT 'gst_reasonableness', tenant, report_date, NULL, 'recorded tax differs from a tenth of the taxable amounts' FROM g WHERE abs(10 * (tax + settled) - sales) * 2 > 10 * (20000 + abs(tax))
  UNION ALL SELECT 'gst_not_run', tenant, report_date, NULL, 'not classed: ' || string_agg(account_name, ', ' ORDER BY account_name) FROM (SELECT t.*, gst_class FROM tb t JOIN gforce USING (tenant, report_date) LEFT JOIN classed USING (tenant, report_date, account_id)) WHERE net <> 0 AND (gst_class IS NULL OR gst_class = 'mixed') GROUP BY tenant, report_date)"""


@query(f"WITH {POLICY_SQL} SELECT f.control, f.tenant, f.report_date, f.account_id, review_group, reason FROM every f LEFT JOIN mapped USING (tenant, report_date, account_id)")
def tenant_policy_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenant and period by the tenant's own mapping, permitted pairs, expected balances and classes of tax, from files.

    One of the three sets of classes mixes `gst` with a side, so its files are refused and the tenant's set before it goes on.
    """
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    periods = t.select("tenant", "report_date").distinct()
    mapped, permitted, expected, classes = (staged(loaded(spark, sf_dir, kind, periods), f"policy-{kind}") for kind in SETS)
    parts = [
        close.mapping(t, mapped), close.mapping_compatibility(t, mapped, permitted), close.balance_policy(t, expected), close.gst_reasonableness(t, classes, _settled_of(t), "100", "0.5"), close.gst_not_run(t, classes),
    ]
    return close.enrich(close.union(parts), mapped).select("control", "tenant", "report_date", "account_id", "review_group", "reason")


@query(f"WITH {FORCE_SQL} SELECT tenant, report_date, 'account_mapping' AS control, CASE WHEN f.variant IS NULL THEN 'SKIPPED' ELSE 'RAN' END AS state FROM d LEFT JOIN force f USING (tenant, report_date) UNION ALL SELECT tenant, report_date, 'gst_reasonableness', CASE WHEN f.variant IS NULL THEN 'SKIPPED' ELSE 'RAN' END FROM d LEFT JOIN gforce f USING (tenant, report_date)")
def tenant_policy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a tenant has no mapping, or no classes of tax, in force, the control is skipped."""
    periods = staged(trial_balance(spark, sf_dir).select("tenant", "report_date").distinct(), "periods")
    return policy_runs(periods, {"account_mapping": loaded(spark, sf_dir, "account_mapping", periods), "gst_reasonableness": loaded(spark, sf_dir, "gst_mapping", periods)})


@query(f"WITH {OWNERS_SQL} SELECT tenant, CAST(effective_from AS VARCHAR) AS effective_from, 'SIDES' AS code FROM owners WHERE variant = 2")
def tenant_gst_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that class accounts both `gst` and by side are refused as a whole."""
    bad = readers.read_sets(spark, write_sets(spark, sf_dir, "gst_mapping"), readers.CONTRACTS["gst_mapping"])[1]
    return bad.select(readers.of_folder(F.col("file"), "tenant").alias("tenant"), readers.of_folder(F.col("file"), "from").alias("effective_from"), "code")


@query(f"""WITH {PAIRS_SQL}, {OWNERS_SQL}, force AS (SELECT tenant, report_date, max_by(variant, effective_from) AS variant FROM dates JOIN owners USING (tenant) WHERE effective_from <= report_date GROUP BY ALL),
  lim AS (SELECT tenant, report_date, section, CAST(a AS BIGINT) * 100 AS a, CAST(b AS BIGINT) AS b FROM force JOIN {_values(REVIEWED)} r(variant, section, a, b) USING (variant))
  SELECT tenant, report_date, account_id, cur - pri AS delta FROM pairs JOIN lim USING (tenant, report_date, section) WHERE abs(cur - pri) >= a AND (pri = 0 OR 100 * abs(cur - pri) >= abs(pri) * b) AND cur <> pri""")
def tenant_variance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20 with each tenant's own sections and limits, in force by date."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    limits = policy(spark, REVIEWED, "variant int, section string, a string, b string").join(owners(spark, sf_dir), "variant")
    limits = limits.select("tenant", "effective_from", "section", money(F.col("a").cast("long") * 100).alias("minimum_absolute"), F.col("b").cast("decimal(6,2)").alias("minimum_percent"))
    return variance.variance_findings(t, effective(limits, t)).select("tenant", "report_date", "account_id", in_cents("delta").alias("delta"))


@query(f"WITH {FORCE_SQL} SELECT tenant, report_date, effective_from FROM force")
def sets_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of join of periods and a tenant's sets."""
    return in_force(trial_balance(spark, sf_dir), owners(spark, sf_dir))
