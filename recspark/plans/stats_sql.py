"""DuckDB SQL for the two-sample t-test (oracle side of ``ab.ab_ttest``).

The p-value integrates the Student-t density with Simpson's rule (2000
intervals) and the critical value is found by bisection in a recursive CTE;
both agree with the continued-fraction implementation to far below the 6
decimals compared.
"""

_DENS = ("exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) "
         "* pow(1 + pow({x}, 2) / {df}, -({df} + 1) / 2)")
_W = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def _cdf_half(upper: str, df: str) -> str:
    """∫_0^upper of the t density (Simpson, 2000 intervals)."""
    return (f"({upper} / 2000.0 / 3.0) * sum({_W} * "
            + _DENS.format(df=df, x=f"(i * {upper} / 2000.0)") + ")")


def ttest_sql(values_sql: str, confidence: float = 0.95, keys: str = "metric") -> str:
    """``values_sql`` must yield (``keys``, g in control/treatment, value)."""
    q = (1 + confidence) / 2
    return f"""
WITH RECURSIVE vals AS ({values_sql}),
s AS (SELECT {keys},
        count(value) FILTER (WHERE g = 'control') AS n_c, count(value) FILTER (WHERE g = 'treatment') AS n_t,
        avg(value) FILTER (WHERE g = 'control') AS m_c, avg(value) FILTER (WHERE g = 'treatment') AS m_t,
        var_samp(value) FILTER (WHERE g = 'control') AS vs_c, var_samp(value) FILTER (WHERE g = 'treatment') AS vs_t,
        var_pop(value) FILTER (WHERE g = 'control') AS vp_c, var_pop(value) FILTER (WHERE g = 'treatment') AS vp_t
      FROM vals GROUP BY {keys}),
s2 AS (SELECT *, (n_c + n_t - 2)::DOUBLE AS df,
              ((n_c - 1) * vs_c + (n_t - 1) * vs_t) / (n_c + n_t - 2)::DOUBLE AS sp2 FROM s),
s3 AS (SELECT *, sqrt(sp2 * (1.0 / n_c + 1.0 / n_t)) AS se_diff, sqrt(vp_c / n_c + vp_t / n_t) AS se_ci,
              (m_t - m_c) / sqrt(sp2 * (1.0 / n_c + 1.0 / n_t)) AS t FROM s2),
pv AS (SELECT {keys}, greatest(0.0, 2 * (0.5 - {_cdf_half('abs(t)', 'df')})) AS p_value
       FROM s3, range(0, 2001) r(i) GROUP BY {keys}, t, df),
bis({keys}, it, lo, hi) AS (
  SELECT {keys}, 0, 0.0::DOUBLE, 64.0::DOUBLE FROM s3
  UNION ALL
  SELECT b.{keys}, b.it + 1,
         CASE WHEN c.cdf < {q!r} THEN (b.lo + b.hi) / 2 ELSE b.lo END,
         CASE WHEN c.cdf < {q!r} THEN b.hi ELSE (b.lo + b.hi) / 2 END
  FROM bis b JOIN s3 ON s3.{keys} = b.{keys},
       LATERAL (SELECT 0.5 + {_cdf_half('((b.lo + b.hi) / 2)', 's3.df')} AS cdf FROM range(0, 2001) r(i)) c
  WHERE b.it < 60),
crit AS (SELECT {keys}, (lo + hi) / 2 AS crit FROM bis WHERE it = 60)
SELECT s3.{keys}, m_c AS control_mean, m_t AS treatment_mean, m_t - m_c AS absolute_difference,
       (m_t - m_c) / m_c * 100 AS relative_lift_pct, t AS t_statistic, df, pv.p_value,
       pv.p_value < {1 - confidence!r} AS is_significant, {confidence!r} AS confidence_level,
       m_t - crit.crit * se_ci AS ci_low, m_t + crit.crit * se_ci AS ci_high,
       (m_t - m_c) - crit.crit * se_diff AS diff_ci_low, (m_t - m_c) + crit.crit * se_diff AS diff_ci_high,
       n_c AS sample_size_control, n_t AS sample_size_treatment
FROM s3 JOIN pv ON pv.{keys} = s3.{keys} JOIN crit ON crit.{keys} = s3.{keys}"""


TTEST_ROUND = ["control_mean", "treatment_mean", "absolute_difference", "relative_lift_pct",
               "t_statistic", "df", "p_value", "confidence_level", "ci_low", "ci_high",
               "diff_ci_low", "diff_ci_high"]


def simpson_p_sql(t: str, df: str) -> str:
    """Scalar subquery: two-sided p of ``t`` with ``df`` degrees of freedom."""
    return f"(SELECT greatest(0.0, 2 * (0.5 - {_cdf_half(f'abs({t})', df)})) FROM range(0, 2001) r(i))"
