"""Posteriors over prior tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwave.operators import inference as N
from quietwave.operators.covariance import mean_vectors
from workbook.registry import R, ctes, query, rnd, sims, table

_LP = "d AS (SELECT event_id AS id, event_type AS event, value AS x, CASE WHEN value > 100 THEN '-inf'::DOUBLE ELSE -pow(value - 25, 2) / 200 END AS logp FROM events)"
_WT = "t AS (SELECT event, max(logp) AS m FROM d GROUP BY event), e AS (SELECT d.*, exp(logp - m) AS w FROM d JOIN t USING (event)), p AS (SELECT *, w / sum(w) OVER (PARTITION BY event) AS weight FROM e)"


def weighted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.col("value").alias("x"))
    logp = F.when(F.col("x") > 100, F.lit(float("-inf"))).otherwise(-F.pow(F.col("x") - 25, F.lit(2.0)) / 200)
    return N.posterior_weights(e.withColumn("logp", logp), ["event"])


@query("posterior_weights", f"WITH {_LP}, {_WT} SELECT id, event, {R('weight', 9)} AS weight FROM p")
def posterior_weights(spark, sf_dir):
    return weighted(spark, sf_dir).select("id", "event", rnd("weight", 9).alias("weight"))


@query("weighted_posterior_summary", f"""WITH {_LP}, {_WT}, c AS (SELECT event, x, sum(weight) OVER (PARTITION BY event ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS mass FROM p WHERE weight > 0), q AS (SELECT unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q)
SELECT event, q, {R('min(x)', 4)} AS value, {R('(SELECT sum(weight * x) FROM p WHERE p.event = c.event)', 5)} AS mean FROM c JOIN q ON mass >= q GROUP BY event, q""")
def weighted_posterior_summary(spark, sf_dir):
    w = weighted(spark, sf_dir)
    mean = w.groupBy("event").agg(F.sum(F.col("weight") * F.col("x")).alias("mean"))
    return N.weighted_quantiles(w, ["event"], "x", "id").join(mean, "event").select("event", "q", rnd("value", 4).alias("value"), rnd("mean", 5).alias("mean"))


@query("nearest_statistics_posterior", ctes("sims") + f""", o AS (SELECT ens AS event, [avg(theta[1]), avg(theta[2]), avg(theta[3]), avg(theta[4]), avg(theta[5]), avg(theta[6])] AS t FROM sims GROUP BY ens),
r AS (SELECT event, id, list_distance(theta, t) AS d, row_number() OVER (PARTITION BY event ORDER BY list_distance(theta, t), id) AS k FROM sims CROSS JOIN o) SELECT event, id, k::INTEGER AS rank, {R('d')} AS distance FROM r WHERE k <= 15""")
def nearest_statistics_posterior(spark, sf_dir):
    s = sims(spark, sf_dir)
    observed = mean_vectors(s.select("ens", "theta"), ["ens"], "theta").select(F.col("ens").alias("event"), "theta")
    return N.nearest_draws(s, observed, "id", "event", "theta", 15).select("event", "id", "rank", rnd("distance").alias("distance"))


@query("nearest_statistics_indexed", ctes("sims") + f""", o AS (SELECT id % 7 AS event, id AS oid, list_transform(theta, lambda t: t * 1.5) AS t FROM sims WHERE id % 5 = 0),
r AS (SELECT event, oid, id, list_distance(theta, t) AS d, row_number() OVER (PARTITION BY oid ORDER BY list_distance(theta, t), id) AS k FROM sims CROSS JOIN o)
SELECT nullif(event, 0) AS event, k::INTEGER AS rank, count(*) AS n, {R('sum(d)', 5)} AS distance, sum(id)::BIGINT AS ids FROM r WHERE k <= 8 GROUP BY 1, 2""")
def nearest_statistics_indexed(spark, sf_dir):
    """Small blocks, so that the index prunes, and many observed rows of one (also a null) event."""
    s = sims(spark, sf_dir)
    observed = s.where("id % 5 = 0").select(F.nullif(F.pmod("id", F.lit(7)), F.lit(0)).alias("event"), F.transform("theta", lambda t: t * 1.5).alias("theta"))
    found = N.nearest_draws(s, observed, "id", "event", "theta", 8, block_rows=60, pivots=5, part_rows=20)
    return found.groupBy("event", "rank").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("distance"), 5).alias("distance"), F.sum("id").alias("ids"))
