"""Agent and recipient signals, calibration, thresholds in money, the exact KS law, hash trees, unseen kinds of fraud."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.feature_queries import features, feats_sql
from checks.tables import duck, transactions
from paywarden.operators import calibrate as ca
from paywarden.operators import drift as dr
from paywarden.operators import features as ft
from paywarden.operators import hash_tree as ht
from paywarden.operators import unseen as un
from paywarden.operators.flows import agent_fraud_exposure, cash_out_speed
from paywarden.session import materialise


def x1(spark, d):
    """Two thirds of the transactions get a verdict, up to eight days later."""
    tx = transactions(spark, d)
    verdicts = tx.filter("event_id % 3 <> 0").select(
        "transaction_id", F.col("is_fraud").alias("label"), F.expr("timestamp + make_interval(0, 0, 0, event_id % 9)").alias("labeled_at"))
    r = agent_fraud_exposure(tx, verdicts)
    return r.select("transaction_id", "cashouts", "frauds", F.round("cashout_usd", 4).alias("cashout_usd"), F.round("fraud_usd", 4).alias("fraud_usd"),
                    F.round("exposure", 6).alias("exposure"))


X1_SQL = duck("""
WITH r AS MATERIALIZED (SELECT transaction_id, agent_id, timestamp, tx_type, round(amount_usd * 1e6)::bigint AS cents,
       CASE WHEN event_id % 3 <> 0 AND is_fraud = 1 THEN timestamp + (event_id % 9)::int * INTERVAL 1 DAY END AS known FROM tx WHERE agent_id IS NOT NULL),
j AS (SELECT r.transaction_id, c.cents, c.known <= r.timestamp AS fraud
      FROM r LEFT JOIN r c ON c.agent_id = r.agent_id AND c.tx_type = 'CASH_OUT' AND (c.timestamp, c.transaction_id) < (r.timestamp, r.transaction_id)
       AND c.timestamp >= r.timestamp - INTERVAL 7 DAYS)
SELECT transaction_id, count(cents) AS cashouts, count(*) FILTER (WHERE fraud) AS frauds, round(coalesce(sum(cents), 0) / 1e6, 4) AS cashout_usd,
  round(coalesce(sum(cents) FILTER (WHERE fraud), 0) / 1e6, 4) AS fraud_usd,
  round(coalesce(coalesce(sum(cents) FILTER (WHERE fraud), 0) / nullif(sum(cents), 0), 0), 6) AS exposure
FROM j GROUP BY transaction_id""")


def x2(spark, d):
    r = cash_out_speed(transactions(spark, d))
    return r.select("transaction_id", F.round("cash_out_usd", 4).alias("cash_out_usd"), F.round("matched_usd", 4).alias("matched_usd"),
                    F.round("stayed_s", 3).alias("stayed_s"))


# every pair of lot and cash-out whose intervals overlap
X2_SQL = duck("""
WITH m AS (SELECT transaction_id, user_id, epoch_us(timestamp) AS us, tx_type = 'CASH_OUT' AS o, round(amount_usd * 1e6)::bigint AS cents FROM tx
           WHERE tx_type IN ('CASH_OUT', 'P2P_RECEIVE', 'CASH_IN') AND status = 'SUCCESS'),
f AS (SELECT *, sum(CASE WHEN o THEN cents ELSE 0 END) OVER w AS paid, sum(CASE WHEN o THEN 0 ELSE cents END) OVER w AS got FROM m
      WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, paid - greatest(max(paid - got) OVER (PARTITION BY user_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING), 0) AS spent FROM f),
outs AS (SELECT *, coalesce(lag(spent) OVER (PARTITION BY user_id ORDER BY us, transaction_id), 0) AS from_ FROM s WHERE o),
pairs AS (SELECT a.transaction_id, least(a.spent, l.got) - greatest(a.from_, l.got - l.cents) AS part, a.us - l.us AS stayed
          FROM outs a JOIN s l ON l.user_id = a.user_id AND NOT l.o AND l.got > a.from_ AND l.got - l.cents < a.spent)
SELECT transaction_id, round(max(outs.cents) / 1e6, 4) AS cash_out_usd, round(coalesce(sum(part), 0) / 1e6, 4) AS matched_usd,
  round(sum(part::double * stayed) / sum(part) / 1e6, 3) AS stayed_s
FROM outs LEFT JOIN pairs USING (transaction_id) GROUP BY transaction_id""")


def scores(spark, d):
    """A score of some hundred distinct values that rises with amount and balance share."""
    df = features(spark, d)
    raw = 1 / (1 + F.exp(-(F.col("log_amount_usd") + F.col("amount_to_balance") + F.col("is_night") - 5)))
    return df.select("transaction_id", "user_id", "amount_usd", "is_fraud", (F.floor(raw * 400 + 1e-9) / 400).alias("score"))


SCORES = """
sc AS (SELECT transaction_id, user_id, amount_usd, is_fraud,
         floor(1 / (1 + exp(-(log_amount_usd + amount_to_balance + is_night - 5))) * 400 + 1e-9) / 400 AS score FROM feats)"""


def c1(spark, d):
    df = scores(spark, d)
    blocks = ca.isotonic(df, "score", "is_fraud", ranges=7)
    done = ca.calibrated(df, blocks, "score")
    return done.groupBy("score").agg(F.round(F.max("probability"), 9).alias("probability"), F.count("*").alias("n"))


# the value at a score is the largest over starts of the smallest mean over ends
C1_SQL = feats_sql("""
SELECT score, round(max(low), 9) AS probability, max(n)::bigint AS n FROM (
  SELECT p.score, p.n, (SELECT NULL) AS x, m.low FROM pts p JOIN mins m ON m.a <= p.i AND m.b = p.i) GROUP BY score""", more=SCORES.strip() + """,
pts AS MATERIALIZED (SELECT score, row_number() OVER (ORDER BY score) AS i, n, pos, sum(n) OVER (ORDER BY score) AS cn, sum(pos) OVER (ORDER BY score) AS cp
        FROM (SELECT score, count(*) AS n, sum(is_fraud) AS pos FROM sc GROUP BY score)),
mins AS MATERIALIZED (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM (
          SELECT x.i AS a, y.i AS b, (y.cp - x.cp + x.pos) / (y.cn - x.cn + x.n) AS mean FROM pts x JOIN pts y ON y.i >= x.i))""")


def c2(spark, d):
    r = ca.avoidance_curve(scores(spark, d), "score", "is_fraud")
    return r.select("threshold", F.round("avoided_usd", 3).alias("avoided_usd"), "caught", "disturbed", F.round("disturbed_per_10000", 6).alias("disturbed_per_10000"))


# counted anew for every threshold
C2_SQL = feats_sql("""
SELECT t.score AS threshold, round(sum(CASE WHEN is_fraud = 1 THEN round(amount_usd * 1e6)::bigint ELSE 0 END) / 1e6, 3) AS avoided_usd,
  count(*) FILTER (WHERE is_fraud = 1) AS caught, count(DISTINCT user_id) FILTER (WHERE is_fraud = 0) AS disturbed,
  round(10000 * count(DISTINCT user_id) FILTER (WHERE is_fraud = 0) / (SELECT count(DISTINCT user_id) FROM sc WHERE is_fraud = 0), 6) AS disturbed_per_10000
FROM (SELECT DISTINCT score FROM sc) t JOIN sc ON sc.score >= t.score GROUP BY t.score""", more=SCORES.strip().replace("sc AS (", "sc AS MATERIALIZED ("))


def g4_exact(spark, d):
    """Amounts of an operator's app and agent payments, day by day: small samples, where the exact law matters."""
    tx = transactions(spark, d).select(F.concat_ws(" ", "operator", F.col("timestamp").cast("date").cast("string")).alias("feature"),
                                       F.floor("amount_usd").cast("double").alias("value"), "access_channel")
    r = dr.ks_2samp_exact(dr.value_table(tx.filter("access_channel = 'APP'"), tx.filter("access_channel = 'AGENT'")))
    return r.filter("n_ref > 0 AND n_cur > 0").select("feature", F.round("ks_d", 9).alias("ks_d"), F.round("ks_p", 9).alias("ks_p"), "n_ref", "n_cur")


# the lattice walked diagonal by diagonal
G4_EXACT_SQL = duck("""
WITH RECURSIVE v AS (SELECT concat_ws(' ', operator, timestamp::date::varchar) AS feature, floor(amount_usd) AS value, access_channel = 'APP' AS r FROM tx
     WHERE access_channel IN ('APP', 'AGENT')),
c AS (SELECT feature, value, count(*) FILTER (WHERE r) AS a, count(*) FILTER (WHERE NOT r) AS b FROM v GROUP BY ALL),
u AS (SELECT *, sum(a) OVER w AS ua, sum(b) OVER w AS ub, sum(a) OVER (PARTITION BY feature) AS n, sum(b) OVER (PARTITION BY feature) AS m FROM c
      WINDOW w AS (PARTITION BY feature ORDER BY value)),
k AS MATERIALIZED (SELECT feature, n::bigint AS n, m::bigint AS m, max(abs(ua * m - ub * n))::bigint AS reach FROM u WHERE n > 0 AND m > 0 GROUP BY ALL),
p AS (
  SELECT feature, n, m, reach, 0::bigint AS s, 0::bigint AS i, 0::double AS v FROM k WHERE reach > 0
  UNION ALL
  SELECT feature, n, m, reach, s + 1, i2, CASE WHEN abs(i2 * m - (s + 1 - i2) * n) >= reach THEN 1 ELSE sum(part) / (s + 1) END
  FROM (SELECT feature, n, m, reach, s, i + 1 AS i2, v * (i + 1) AS part FROM p WHERE i < n
        UNION ALL SELECT feature, n, m, reach, s, i, v * (s + 1 - i) FROM p WHERE s - i < m) GROUP BY feature, n, m, reach, s, i2)
SELECT feature, round(reach / (n * m), 9) AS ks_d, round(coalesce(v, 1), 9) AS ks_p, n AS n_ref, m AS n_cur
FROM k LEFT JOIN (SELECT feature, v FROM p WHERE s = n + m) USING (feature)""").replace("WITH tx AS", "WITH RECURSIVE tx AS", 1).replace(
    "RECURSIVE v AS (SELECT concat_ws", "v AS (SELECT concat_ws", 1)


def k8_tree(spark, d):
    """The tree over one chain per user: its last transaction stands for the tip."""
    tips = transactions(spark, d).groupBy("user_id").agg(F.sha2(F.max("transaction_id"), 256).alias("tip"), F.count("*").alias("n"))
    leaf = ht.leaves(tips, ["user_id"])
    nodes = ht.hash_tree(leaf)
    proved = ht.proofs(leaf, nodes)
    # a leaf's own row also says how many digests prove it, and whether they do
    top = ht.root(nodes)
    known = proved.select(F.lit(0).alias("level"), "idx", F.size("proof").alias("steps"), (ht.proved_root() == F.lit(top)).alias("proved"))
    return nodes.join(known, ["level", "idx"], "left").select("level", "idx", "digest", "steps", "proved")


K8_TREE_SQL = duck("""
WITH RECURSIVE l AS (SELECT user_id, sha256(max(transaction_id)) AS tip, count(*)::varchar AS n, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM tx GROUP BY user_id),
t AS (
  SELECT 0 AS level, idx, sha256(concat('L', len(user_id), ':', user_id, len(tip), ':', tip, len(n), ':', n)) AS digest, (SELECT count(*) FROM l) AS here FROM l
  UNION ALL
  SELECT level + 1, idx // 2, CASE WHEN count(*) = 2 THEN sha256('N' || min_by(digest, idx) || max_by(digest, idx)) ELSE min(digest) END, (here + 1) // 2
  FROM t WHERE here > 1 GROUP BY level, idx // 2, here),
steps AS (SELECT l.idx, count(*) FILTER (WHERE s.idx IS NOT NULL) AS steps
  FROM l CROSS JOIN (SELECT DISTINCT level, here FROM t WHERE here > 1) v LEFT JOIN t s ON s.level = v.level AND s.idx = xor(l.idx >> v.level, 1) GROUP BY l.idx)
SELECT level, t.idx, digest, CASE WHEN level = 0 THEN steps END AS steps, CASE WHEN level = 0 THEN true END AS proved
FROM t LEFT JOIN steps ON level = 0 AND steps.idx = t.idx""").replace("WITH tx AS", "WITH RECURSIVE tx AS", 1).replace("RECURSIVE l AS (SELECT user_id", "l AS (SELECT user_id", 1)


def u1(spark, d):
    """Each kind of fraud left out of the training once; features as they are."""
    df = features(spark, d).withColumn("y", F.col("is_fraud"))
    rows = materialise(df.select("transaction_id", "y", "fraud_type", *ft.FEATURE_NAMES), "unseen")
    fits = un.leave_one_kind_out(rows, ft.FEATURE_NAMES)
    r = un.unseen_recall(rows, fits)
    return r.select("fraud_type", "n", *[F.round(c, 6).alias(c) for c in ("recall_unseen", "recall_seen", "marked_legitimate")])


def build() -> dict:
    return {"x1_agent_fraud_exposure": (x1, X1_SQL), "x2_cash_out_speed": (x2, X2_SQL), "c1_isotonic": (c1, C1_SQL),
            "c2_avoidance_curve": (c2, C2_SQL), "g4_ks_exact": (g4_exact, G4_EXACT_SQL),
            "k8_hash_tree": (k8_tree, K8_TREE_SQL), "u1_unseen_kinds": (u1, None)}
