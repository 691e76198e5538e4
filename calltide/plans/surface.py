"""The library in SQL: views of the call logs, and operators as SQL functions and table functions with named parameters.

``install`` names the tables; after it ``SELECT * FROM calltide_gates(moment => ..., days => 3)`` and the like need no Python.
All functions are SQL bodies, which Catalyst inlines: filters and columns are pushed through them as through any view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calltide.operators.gates import Limits
from calltide.operators.relevance import DECAY_DAYS

_LIMITS = Limits()

#: Scalar functions: name, parameters, result, body.
SCALARS = (
    ("calltide_recency", f"happened TIMESTAMP_NTZ, moment TIMESTAMP_NTZ, decay_days DOUBLE DEFAULT {DECAY_DAYS}", "DOUBLE", "coalesce(greatest(0D, 1D - timestampdiff(MICROSECOND, happened, moment) / 86400000000D / decay_days), 0D)"),
    ("calltide_band", "value DOUBLE, abort_above DOUBLE, warn_above DOUBLE", "STRING", "CASE WHEN value IS NULL THEN 'unknown' WHEN value > abort_above THEN 'abort' WHEN value > warn_above THEN 'warn' ELSE 'ok' END"),
    ("calltide_hits", "body STRING, markers ARRAY<STRING>", "INT", "aggregate(markers, 0, (n, m) -> n + CAST(contains(lower(coalesce(body, '')), m) AS INT))"),
    ("calltide_score", "body STRING, markers ARRAY<STRING>, cap INT DEFAULT 4", "DOUBLE", "least(calltide_hits(body, markers) / CAST(cap AS DOUBLE), 1D)"),
)
#: Table functions over the views: name, parameters, columns, body.
TABLES = (
    (
        "calltide_gates", f"moment TIMESTAMP_NTZ, days INT DEFAULT {_LIMITS.window_days}, abort_above DOUBLE DEFAULT {_LIMITS.ratio_abort}, warn_above DOUBLE DEFAULT {_LIMITS.ratio_warn}",
        "wrapped_calls BIGINT, baseline_calls BIGINT, ratio DOUBLE, hours DOUBLE, ratio_status STRING",
        """WITH w AS (SELECT 'wrapped' AS side, cost_usd, maintenance_hours FROM calltide_metrics WHERE ts >= moment - make_dt_interval(days) AND ts <= moment
                     UNION ALL SELECT 'baseline', cost_usd, NULL FROM calltide_baseline WHERE ts >= moment - make_dt_interval(days) AND ts <= moment),
                s AS (SELECT count_if(side = 'wrapped') AS wrapped_calls, count_if(side = 'baseline') AS baseline_calls,
                        CAST(sum(CAST(cost_usd AS DECIMAL(28,8))) FILTER (WHERE side = 'wrapped') AS DOUBLE) / nullif(count(cost_usd) FILTER (WHERE side = 'wrapped'), 0) AS a,
                        CAST(sum(CAST(cost_usd AS DECIMAL(28,8))) FILTER (WHERE side = 'baseline') AS DOUBLE) / nullif(count(cost_usd) FILTER (WHERE side = 'baseline'), 0) AS b,
                        coalesce(CAST(sum(CAST(maintenance_hours AS DECIMAL(28,8))) AS DOUBLE), 0D) AS hours FROM w),
                r AS (SELECT *, CASE WHEN a <> 0 AND b > 0 THEN a / b END AS ratio FROM s)
           SELECT wrapped_calls, baseline_calls, ratio, hours, calltide_band(ratio, abort_above, warn_above) FROM r""",
    ),
    (
        "calltide_search", "needle STRING", "seq BIGINT, label STRING, query STRING, response STRING",
        "SELECT seq, label, query, response FROM calltide_calls WHERE trim(needle) = '' OR contains(lower(coalesce(query, '')), lower(needle)) OR contains(lower(coalesce(label, '')), lower(needle)) OR contains(lower(coalesce(response, '')), lower(needle))",
    ),
    (
        "calltide_latest", "per_label INT DEFAULT 1", "label STRING, place INT, seq BIGINT",
        "SELECT label, place, seq FROM (SELECT label, seq, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS place FROM calltide_calls) WHERE place <= per_label",
    ),
)


def install(spark: SparkSession, calls: DataFrame, metrics: DataFrame, baseline: DataFrame) -> None:
    """Create the views calltide_calls (seq, label, query, response), calltide_metrics (ts, cost_usd, maintenance_hours) and
    calltide_baseline (ts, cost_usd), and all functions, for this session; what was there under these names is replaced."""
    for name, rows in (("calls", calls), ("metrics", metrics), ("baseline", baseline)):
        rows.createOrReplaceTempView(f"calltide_{name}")
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
