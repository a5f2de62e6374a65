"""Queries on simulated totals, accumulation and change. The random numbers are whole-number arithmetic, so SQL draws the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.student import quantile
from ..operators import uncertainty as U
from ..operators import windows as W
from .registry import query
from .roles import SEG, normal_steps, rounded, rounding, segments

KEY = ["granule", "line", "part", "tile_num"]
_KEYS = "granule, line, part, tile_num"


def _drawn(n: int, columns: str = "*") -> str:
    return f"d AS (SELECT {columns}, unnest(generate_series(1, {n})) AS sim FROM seg)"


@query(f"""WITH {SEG}, {_drawn(1000, _KEYS + ', agb, agb_sd')}, {normal_steps('d', _KEYS)}, s AS (SELECT tile_num, sim, sum(greatest(agb + agb_sd * z, 0) * 0.09) AS t FROM z4 GROUP BY 1, 2),
q AS (SELECT tile_num, avg(t) AS mean, stddev_pop(t) AS sd, quantile_cont(t, 0.5) AS median, quantile_cont(t, 0.025) AS low, quantile_cont(t, 0.975) AS high, quantile_cont(t, 0.75) - quantile_cont(t, 0.25) AS iqr, count(*) AS n_draws FROM s GROUP BY 1)
SELECT tile_num, {rounding('mean sd median low high iqr cv uncertainty')}, n_draws FROM (SELECT *, sd / mean AS cv, 100 * (high - low) / 2 / mean AS uncertainty FROM q)""")
def mc_zonal(spark, sf_dir):
    """Totals by tile of a thousand draws of every pixel, none below 0."""
    return rounded(U.simulated_totals(segments(spark, sf_dir), ["tile_num"], KEY, "agb", "agb_sd", 0.09))


_T50 = quantile(49)
_CLASS = f"""{_drawn(50, _KEYS + ', agb, agb_sd, land_cover, kendall')}, {normal_steps('d', _KEYS)}, s AS (SELECT land_cover, kendall, sim, sum(0.5 * (agb + agb_sd * z) * 0.09 * 1e-9) AS t FROM z4 GROUP BY 1, 2, 3),
c AS (SELECT land_cover, kendall, avg(t) AS mean, stddev_samp(t) AS sd FROM s GROUP BY 1, 2), b AS (SELECT *, mean - {_T50} * sd / sqrt(50) AS ci_low, mean + {_T50} * sd / sqrt(50) AS ci_high, mean - {_T50} * sd AS pi_low, mean + {_T50} * sd AS pi_high FROM c)"""
_BOUNDS = ["mean", "ci_low", "ci_high", "pi_low", "pi_high"]


def _class_totals(spark, sf_dir):
    return U.class_totals(segments(spark, sf_dir), ["land_cover", "kendall"], KEY, "agb", "agb_sd")


def _pico(df, digits=6):
    """In thousands of tons, so that rounding leaves digits."""
    return rounded(df.withColumns({c: F.col(c) * 1e6 for c in [*_BOUNDS, "sd"] if c in df.columns}), digits)


@query(f"WITH {SEG}, {_CLASS} SELECT land_cover, kendall, {', '.join(f'round({c} * 1e6, 6) AS {c}' for c in [*_BOUNDS, 'sd'])} FROM b")
def mc_class_totals(spark, sf_dir):
    """Carbon of each class with t-based bounds."""
    return _pico(_class_totals(spark, sf_dir))


@query(f"WITH {SEG}, {_CLASS} SELECT kendall, {', '.join(f'round(sum({c}) * 1e6, 6) AS {c}' for c in _BOUNDS)} FROM b GROUP BY 1")
def mc_sums_by_trend(spark, sf_dir):
    """Class totals summed over land covers, bounds with them."""
    return _pico(U.class_sums(_class_totals(spark, sf_dir), ["kendall"], _BOUNDS))


@query(f"WITH {SEG}, {_CLASS} SELECT {', '.join(f'round(sum({c}) * 1e6, 5) AS {c}' for c in _BOUNDS)} FROM b")
def mc_grand_total(spark, sf_dir):
    """All classes: the bounds are sums of bounds."""
    return _pico(U.class_sums(_class_totals(spark, sf_dir), [], _BOUNDS), 5)


_T5 = quantile(4)


@query(f"""WITH {SEG}, {_drawn(5, _KEYS + ', agb, agb_sd, age')}, {normal_steps('d', _KEYS, 1, 'x')}, {normal_steps('x4', _KEYS, 2, 'y')}, s AS (SELECT *, 0.5 * (agb + agb_sd * x) AS c, CASE WHEN age + 3 * y > 0 THEN 0.5 * (agb + agb_sd * x) / (age + 3 * y) ELSE 0 END AS r FROM y4),
m AS (SELECT {_KEYS}, agb, avg(c) AS carbon_mean, stddev_samp(c) AS carbon_sd, avg(r) AS accumulation_mean, stddev_samp(r) AS accumulation_sd FROM s GROUP BY ALL)
SELECT {_KEYS}, {rounding('carbon_mean carbon_sd carbon_low carbon_high accumulation_mean accumulation_sd accumulation_pi_low accumulation_pi_high', 5)} FROM (SELECT *, carbon_mean - {_T5} * carbon_sd / sqrt(5) AS carbon_low, carbon_mean + {_T5} * carbon_sd / sqrt(5) AS carbon_high,
accumulation_mean - {_T5} * accumulation_sd * sqrt(1.2) AS accumulation_pi_low, accumulation_mean + {_T5} * accumulation_sd * sqrt(1.2) AS accumulation_pi_high FROM m)""")
def mc_carbon(spark, sf_dir):
    """Carbon and its accumulation in every pixel by five draws, with t-based bounds."""
    df = segments(spark, sf_dir).select(*KEY, F.col("agb").alias("biomass_mean"), F.col("agb_sd").alias("biomass_std"), F.col("age").cast("double").alias("age_mean"), F.lit(3.0).alias("age_std"))
    out = U.carbon_accumulation(df, KEY)
    return rounded(out.select(*KEY, *"carbon_mean carbon_sd carbon_low carbon_high accumulation_mean accumulation_sd accumulation_pi_low accumulation_pi_high".split()), 5)


@query(f"""WITH {SEG}, {_drawn(50, _KEYS + ', agb, agb_sd')}, {normal_steps('d', _KEYS)}, m AS (SELECT {_KEYS}, agb, agb_sd, avg(agb + agb_sd * z) AS sim_mean, stddev_pop(agb + agb_sd * z) AS sim_sd FROM z4 GROUP BY ALL)
SELECT {_KEYS}, {rounding('sim_mean sim_sd ci_low pi_high', 5)} FROM (SELECT *, sim_mean - {_T50} * sim_sd / sqrt(50) AS ci_low, sim_mean + {_T50} * sqrt(agb_sd * agb_sd + sim_sd * sim_sd / 50) AS pi_high FROM m)""")
def mc_two_band(spark, sf_dir):
    """Every pixel's mean and deviation over fifty draws."""
    out = U.two_band(segments(spark, sf_dir).select(*KEY, "agb", "agb_sd"), KEY, "agb", "agb_sd")
    return rounded(out.select(*KEY, "sim_mean", "sim_sd", "ci_low", "pi_high"), 5)


@query(f"""WITH {SEG}, {_drawn(50, _KEYS + ', agb, agb_sd')}, {normal_steps('d', _KEYS)}, s AS (SELECT sim, sum(agb + agb_sd * z) * 0.09 * 1e-9 AS t FROM z4 GROUP BY 1), m AS (SELECT avg(t) AS mean, stddev_samp(t) AS sd FROM s), o AS (SELECT sum(agb_sd * agb_sd) * (0.09 * 1e-9) * (0.09 * 1e-9) AS own FROM seg)
SELECT {', '.join(f'round({c} * 1e6, 5) AS {c}' for c in ('mean', 'sd', 'ci_low', 'ci_high', 'pi_low', 'pi_high'))} FROM (SELECT *, mean - {_T50} * sd / sqrt(50) AS ci_low, mean + {_T50} * sd / sqrt(50) AS ci_high, mean - {_T50} * sqrt(own + sd * sd / 50) AS pi_low, mean + {_T50} * sqrt(own + sd * sd / 50) AS pi_high FROM m, o)""")
def mc_two_band_total(spark, sf_dir):
    return _pico(U.two_band_total(segments(spark, sf_dir), KEY, "agb", "agb_sd"), 5)


@query(f"""WITH {SEG}, a AS (SELECT kendall, avg(agb) FILTER (year = 1997) AS m1, avg(agb_sd) FILTER (year = 1997) AS s1, avg(agb) FILTER (year = 2000) AS m2, avg(agb_sd) FILTER (year = 2000) AS s2 FROM seg GROUP BY 1), d AS (SELECT *, unnest(generate_series(1, 10000)) AS sim FROM a), {normal_steps('d', 'kendall', 1, 'x')}, {normal_steps('x4', 'kendall', 2, 'y')},
v AS (SELECT kendall, m1, greatest(m2 + coalesce(s2, 0) * y, 0) - greatest(m1 + coalesce(s1, 0) * x, 0) AS d FROM y4), q AS (SELECT kendall, avg(d) AS change, stddev_samp(d) AS change_sd, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, 100 * avg(d) / any_value(m1) AS percent, count(*) FILTER (d > 0) / 10000 AS p_increase, count(*) FILTER (d < 0) / 10000 AS p_decrease FROM v GROUP BY 1)
SELECT kendall, {rounding('change change_sd median low high percent p_increase p_decrease')}, low > 0 OR high < 0 AS significant FROM q""")
def mc_change(spark, sf_dir):
    """Change between two years by ten thousand draws."""
    at = lambda c, y: F.avg(F.when(F.col("year") == y, F.col(c)))
    a = segments(spark, sf_dir).groupBy("kendall").agg(at("agb", 1997).alias("mean1"), at("agb_sd", 1997).alias("sd1"), at("agb", 2000).alias("mean2"), at("agb_sd", 2000).alias("sd2"))
    return rounded(U.simulated_change(a, ["kendall"]))


@query("WITH s AS (SELECT unnest(generate_series(1, 30)) AS n), k AS (SELECT n, unnest(generate_series(1, n)) AS i FROM s) SELECT CAST(n AS INTEGER) AS n, n > 9 AND abs(avg(10.0 + 5.0 / i) / avg(CASE WHEN i <= n - 9 THEN 10.0 + 5.0 / i END) - 1) <= 0.05 AS converged FROM k GROUP BY n")
def convergence(spark, sf_dir):
    """Whether runs of growing length have settled: the mean over all against that without the latest nine."""
    rows = [(n, W.converged([10.0 + 5.0 / i for i in range(1, n + 1)])) for n in range(1, 31)]
    return spark.createDataFrame(rows, "n int, converged boolean")
