"""DuckDB SQL for every oracle-checked query (same parquet tables as views).

Each SQL text is a brute-force statement of the operator's meaning: global
windows, plain joins, ``ASOF JOIN``. Doubles are compared after rounding to
4 places with ``floor(x * 1e4 + 0.4999877) / 1e4`` on both sides: identical IEEE
operations in both engines, and a cut that exact decimal halves (averages of
cents over 2^k rows) never sit on, so a one-ulp difference between the
engines' float sums cannot flip a digit.
"""

from __future__ import annotations

from liftlens.params import LEARNING_WAVE, OPTIMIZED_WAVE

AS_OF = "1997-01-01"
WAVE2_AS_OF = "1998-01-01"
SNAPSHOT_DATES = ("1997-01-01", "1998-01-01", "1999-01-01")
COUPON = 20000.0
BUDGET = 5000000.0
MARGIN = 0.3


def stable(cols: list[str]) -> str:
    return ", ".join(f"FLOOR({c} * 10000.0::DOUBLE + 0.4999877::DOUBLE) / 10000.0::DOUBLE AS {c}" for c in cols)


def final(body: str, doubles: list[str]) -> str:
    if not doubles:
        return body
    return f"SELECT * REPLACE ({stable(doubles)}) FROM ({body}) AS q"


def md5_bucket(expr: str, salt: str | None) -> str:
    s = f"'{salt}::' || CAST({expr} AS VARCHAR)" if salt else f"CAST({expr} AS VARCHAR)"
    return f"(('0x' || substr(md5({s}), 1, 8))::BIGINT % 100000)"


def md5_u32(expr: str, salt: str | None) -> str:
    s = f"'{salt}::' || CAST({expr} AS VARCHAR)" if salt else f"CAST({expr} AS VARCHAR)"
    return f"(('0x' || substr(md5({s}), 1, 8))::BIGINT)"


U32 = 4294967296


def _mul32(x: str, c: int) -> str:
    return f"((({x})::HUGEINT * {c}) % {U32})::BIGINT"


def _rotl32(x: str, r: int) -> str:
    return f"(((({x}) << {r}) | (({x}) >> {32 - r})) & {U32 - 1})"


def _byte(hx: str, i: str) -> str:
    return f"(('0x' || substr({hx}, 2 * ({i}) + 1, 2))::BIGINT)"


def spark_hash(s: str) -> str:
    """Spark's ``hash`` of a string: Murmur3 x86 32-bit, seed 42, over the UTF-8 bytes; whole 4-byte
    little-endian words first, then each trailing byte (sign-extended) on its own, then the finaliser.
    Written with list lambdas, 32-bit arithmetic done in BIGINT/HUGEINT modulo 2^32."""
    hx = f"hex({s})"
    n = f"(length({hx}) // 2)"
    words = (f"list_transform(range({n} // 4), lambda w: {_byte(hx, '4 * w')} + {_byte(hx, '4 * w + 1')} * 256"
             f" + {_byte(hx, '4 * w + 2')} * 65536 + {_byte(hx, '4 * w + 3')} * 16777216)")
    tail = (f"list_transform(range(({n} // 4) * 4, {n}), lambda i: CASE WHEN {_byte(hx, 'i')} >= 128"
            f" THEN {_byte(hx, 'i')} + {U32 - 256} ELSE {_byte(hx, 'i')} END)")
    k1 = (f"list_transform(list_transform(list_concat({words}, {tail}), lambda x: {_mul32('x', 0xcc9e2d51)}),"
          f" lambda y: {_mul32(_rotl32('y', 15), 0x1b873593)})")
    h = (f"list_reduce(list_concat([42::BIGINT], {k1}),"
         f" lambda h, k: ({_rotl32('xor(h, k)', 13)} * 5 + {0xe6546b64}) % {U32})")
    f1 = f"list_transform([xor({h}, {n})], lambda a: {_mul32('xor(a, a >> 16)', 0x85ebca6b)})[1]"
    f2 = f"list_transform([{f1}], lambda b: {_mul32('xor(b, b >> 13)', 0xc2b2ae35)})[1]"
    f3 = f"list_transform([{f2}], lambda c: xor(c, c >> 16))[1]"
    return f"list_transform([{f3}], lambda d: CASE WHEN d >= {U32 // 2} THEN d - {U32} ELSE d END)[1]"


def murmur_bucket(expr: str, salt: str | None) -> str:
    s = f"'{salt}::' || CAST({expr} AS VARCHAR)" if salt else f"CAST({expr} AS VARCHAR)"
    return f"(abs({spark_hash(s)}) % 100000)"


def score_expr(col: str = "customer_id", salt: str = "SCORE") -> str:
    return f"(({md5_bucket(col, salt)} - 30000) / 100000.0::DOUBLE)"


LINES = """lines AS (SELECT l_orderkey, COUNT(*) AS n_lines, MAX(l_discount) AS max_discount
  FROM lineitem GROUP BY l_orderkey)"""
TXN = """txn AS (SELECT o.o_custkey AS customer_id, o.o_orderdate AS txn_date, o.o_totalprice AS amount,
  CAST(COALESCE(l.n_lines, 0) AS BIGINT) AS n_items, o.o_orderpriority AS category, o.o_orderkey AS txn_id
  FROM orders o LEFT JOIN lines l ON o.o_orderkey = l.l_orderkey)"""
CUST = """cust AS (SELECT c_custkey AS customer_id, c_mktsegment AS age_group,
  'Tier' || CAST(1 + c_nationkey % 3 AS VARCHAR) AS city_tier,
  CASE c_custkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'web' ELSE 'store' END AS channel_pref FROM customer)"""
REDEMPTIONS = """red AS (SELECT o.o_custkey AS customer_id, o.o_orderdate AS redeemed_ts FROM orders o
  WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.05))"""

RFM_COLS = ("customer_id, txn_count, total_spend, avg_basket_value, max_basket_value, avg_items, category_diversity, "
            "last_txn_date, first_txn_date, recency_days, tenure_days, frequency_per_month, monetary_per_month")
RFM_DOUBLES = ["total_spend", "avg_basket_value", "max_basket_value", "avg_items", "frequency_per_month",
               "monetary_per_month"]


def rfm(name: str, as_of: str) -> str:
    return f"""{name}_agg AS (SELECT customer_id, COUNT(*) AS txn_count, SUM(amount) AS total_spend,
  AVG(amount) AS avg_basket_value, MAX(amount) AS max_basket_value, AVG(n_items) AS avg_items,
  COUNT(DISTINCT category) AS category_diversity, MAX(txn_date) AS last_txn_date, MIN(txn_date) AS first_txn_date
  FROM txn WHERE txn_date < TIMESTAMP '{as_of}' GROUP BY customer_id),
{name}_d AS (SELECT *, CAST(date_diff('day', CAST(last_txn_date AS DATE), DATE '{as_of}') AS INTEGER) AS recency_days,
  CAST(date_diff('day', CAST(first_txn_date AS DATE), DATE '{as_of}') AS INTEGER) AS tenure_days FROM {name}_agg),
{name} AS (SELECT {RFM_COLS.replace('frequency_per_month, monetary_per_month', '')}
  txn_count / greatest(tenure_days / 30.0::DOUBLE, 1.0::DOUBLE) AS frequency_per_month,
  total_spend / greatest(tenure_days / 30.0::DOUBLE, 1.0::DOUBLE) AS monetary_per_month FROM {name}_d)"""


def feat(name: str, as_of: str) -> str:
    """A1 + J1 + E2 at an as-of date (needs txn, cust)."""
    return rfm(f"{name}_rfm", as_of) + f""",
{name} AS (SELECT r.*, c.age_group, c.city_tier, c.channel_pref,
  CASE WHEN r.txn_count >= 3 THEN 'known_full' ELSE 'known_sparse' END AS data_tier
  FROM {name}_rfm r JOIN cust c ON r.customer_id = c.customer_id)"""


def seg(name: str, feat_name: str) -> str:
    """Quartile tiers of monthly spend by rank."""
    return f"""{name}_r AS (SELECT customer_id,
  ROW_NUMBER() OVER (ORDER BY monetary_per_month DESC, customer_id) AS r, COUNT(*) OVER () AS n FROM {feat_name}),
{name} AS (SELECT customer_id, CAST(((r - 1) * 4) // n AS INTEGER) AS segment_id,
  CASE ((r - 1) * 4) // n WHEN 0 THEN 'High Value' WHEN 1 THEN 'Medium-High Value'
  WHEN 2 THEN 'Medium Value' ELSE 'Low Value' END AS value_tier FROM {name}_r)"""


def assign(name: str, seg_name: str, campaign: str, as_of: str, coupon: float = COUPON, bucket=md5_bucket) -> str:
    u = f"({bucket('customer_id', campaign)} / 100000.0::DOUBLE)"
    return f"""{name} AS (SELECT customer_id, segment_id, value_tier,
  CASE WHEN {u} < 0.8::DOUBLE THEN 'treatment' ELSE 'holdout' END AS "group",
  '{campaign}' AS campaign_id,
  CASE WHEN {u} < 0.8::DOUBLE THEN {coupon}::DOUBLE ELSE 0.0::DOUBLE END AS coupon_value,
  TIMESTAMP '{as_of}' AS assigned_ts FROM {seg_name})"""


def outcomes(name: str, asg: str, lo: str, hi_days: int = 90) -> str:
    """J11 over sales and redemptions in [assigned_ts, assigned_ts + 90 days)."""
    return f"""{name}_s AS (SELECT a.campaign_id, a.customer_id, COUNT(*) AS n_sales, SUM(t.amount) AS spend
  FROM {asg} a JOIN txn t ON t.customer_id = a.customer_id
  AND t.txn_date >= a.assigned_ts AND t.txn_date < a.assigned_ts + INTERVAL {hi_days} DAY
  GROUP BY a.campaign_id, a.customer_id),
{name}_r AS (SELECT DISTINCT a.campaign_id, a.customer_id FROM {asg} a JOIN red r ON r.customer_id = a.customer_id
  AND r.redeemed_ts >= a.assigned_ts AND r.redeemed_ts < a.assigned_ts + INTERVAL {hi_days} DAY),
{name} AS (SELECT a.customer_id, a.campaign_id, a."group", a.value_tier, a.coupon_value,
  CAST(COALESCE(s.n_sales, 0) > 0 AS INTEGER) AS purchased,
  CAST(a."group" = 'treatment' AND COALESCE(s.n_sales, 0) > 0 AND r.customer_id IS NOT NULL AS INTEGER) AS redeemed,
  COALESCE(s.spend, 0.0::DOUBLE) AS spend
  FROM {asg} a LEFT JOIN {name}_s s ON s.campaign_id = a.campaign_id AND s.customer_id = a.customer_id
  LEFT JOIN {name}_r r ON r.campaign_id = a.campaign_id AND r.customer_id = a.customer_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = [LINES, TXN, CUST]
WAVE1 = BASE + [REDEMPTIONS, feat("f", AS_OF), seg("s", "f"), assign("asg", "s", LEARNING_WAVE, AS_OF),
                outcomes("oc", "asg", AS_OF)]
SCORED = """scored AS (SELECT f.customer_id, s.value_tier, f.avg_basket_value, {score} AS uplift_score
  FROM f LEFT JOIN s ON f.customer_id = s.customer_id)""".format(score=score_expr("f.customer_id"))
EVAL = """ev AS (SELECT oc.customer_id, {score} AS uplift_score, oc."group", oc.purchased FROM oc)""".format(
    score=score_expr("oc.customer_id"))

FEAT_DOUBLES = RFM_DOUBLES


def _q() -> dict[str, str]:
    q: dict[str, str] = {}
    q["rfm_features"] = final(with_(*BASE, rfm("r", AS_OF)) + f"SELECT {RFM_COLS} FROM r", RFM_DOUBLES)
    q["customers_enriched"] = final(with_(*BASE, feat("f", AS_OF)) + "SELECT * FROM f", FEAT_DOUBLES)
    q["unknown_customers"] = with_(*BASE, feat("f", AS_OF)) + """SELECT c.customer_id, c.age_group, c.city_tier,
  c.channel_pref, 'unknown' AS data_tier FROM cust c ANTI JOIN f ON c.customer_id = f.customer_id"""
    routed = """routed AS (SELECT customer_id, age_group, data_tier FROM f UNION ALL
  SELECT c.customer_id, c.age_group, 'unknown' FROM cust c ANTI JOIN f ON c.customer_id = f.customer_id)"""
    q["routing_counts"] = with_(*BASE, feat("f", AS_OF), routed) + \
        "SELECT data_tier, COUNT(*) AS n FROM routed GROUP BY data_tier"
    q["data_tier_by_attribute"] = with_(*BASE, feat("f", AS_OF), routed) + \
        "SELECT age_group, data_tier, COUNT(*) AS n FROM routed GROUP BY age_group, data_tier"
    q.update(_batch2())
    return q


def econ(name: str, src: str, margin: float = MARGIN, coupon: float = COUPON) -> str:
    """PF5 + E7 (eligible rows with economics)."""
    return f"""{name} AS (SELECT customer_id, value_tier, avg_basket_value, uplift_score,
  uplift_score * avg_basket_value * {margin}::DOUBLE AS exp_incr_margin,
  LEAST(GREATEST(0.3::DOUBLE + uplift_score, 0.05::DOUBLE), 0.9::DOUBLE) AS p_redeem,
  LEAST(GREATEST(0.3::DOUBLE + uplift_score, 0.05::DOUBLE), 0.9::DOUBLE) * {coupon}::DOUBLE AS exp_cost,
  (uplift_score * avg_basket_value * {margin}::DOUBLE)
    / GREATEST(LEAST(GREATEST(0.3::DOUBLE + uplift_score, 0.05::DOUBLE), 0.9::DOUBLE) * {coupon}::DOUBLE, 1e-6::DOUBLE)
    AS roi_per_dollar
  FROM {src} WHERE uplift_score > 0.0::DOUBLE)"""


def ranked(name: str, src: str) -> str:
    """W0 the brute-force way: a global window in ROI order with an exact decimal running cost."""
    return f"""{name} AS (SELECT *, ROW_NUMBER() OVER w AS roi_rank,
  SUM(CAST(exp_cost AS DECIMAL(20,6))) OVER w AS cum_cost FROM {src}
  WINDOW w AS (ORDER BY roi_per_dollar DESC, customer_id ROWS UNBOUNDED PRECEDING))"""


def scored(name: str, f: str, s: str) -> str:
    return f"""{name} AS (SELECT {f}.customer_id, {s}.value_tier, {f}.avg_basket_value,
  {score_expr(f + '.customer_id')} AS uplift_score FROM {f} LEFT JOIN {s} ON {f}.customer_id = {s}.customer_id)"""


def lift_sql(oc: str, measured: str, coupon: float = COUPON) -> str:
    t, h = "\"group\" = 'treatment'", "\"group\" = 'holdout'"
    return f"""SELECT campaign_id, n_treated, n_holdout,
  round_even(rt - rh, 4) AS incr_purchase_rate,
  round_even(st - sh, 2) AS incr_spend_per_head,
  round_even((st - sh) * {MARGIN}::DOUBLE, 2) AS incr_margin_per_head,
  round_even(cost, 2) AS coupon_cost,
  round_even((st - sh) * {MARGIN}::DOUBLE * n_treated - cost, 2) AS total_incremental_margin,
  round_even(CASE WHEN cost <> 0 THEN ((st - sh) * {MARGIN}::DOUBLE * n_treated - cost) / cost END, 2) AS roi,
  TIMESTAMP '{measured}' AS measured_ts
  FROM (SELECT campaign_id, COUNT(*) FILTER (WHERE {t}) AS n_treated, COUNT(*) FILTER (WHERE {h}) AS n_holdout,
    AVG(purchased) FILTER (WHERE {t}) AS rt, AVG(purchased) FILTER (WHERE {h}) AS rh,
    AVG(spend) FILTER (WHERE {t}) AS st, AVG(spend) FILTER (WHERE {h}) AS sh,
    CAST(SUM(redeemed) FILTER (WHERE {t}) AS DOUBLE) * {coupon}::DOUBLE * 1.0::DOUBLE AS cost
    FROM {oc} GROUP BY campaign_id) g"""


LIFT_DOUBLES = ["incr_purchase_rate", "incr_spend_per_head", "incr_margin_per_head", "coupon_cost",
                "total_incremental_margin", "roi"]
ECON_DOUBLES = ["avg_basket_value", "uplift_score", "exp_incr_margin", "p_redeem", "exp_cost", "roi_per_dollar"]
OFFER_DOUBLES = ["uplift_score", "exp_incr_margin", "exp_cost", "roi_per_dollar", "coupon_value"]
SNAP_DOUBLES = ["frequency_per_month", "monetary_per_month", "total_spend", "avg_basket_value",
                "max_basket_value", "avg_items"]
SNAP_COLS = ("customer_id, feature_ts, recency_days, tenure_days, frequency_per_month, monetary_per_month, "
             "txn_count, total_spend, avg_basket_value, max_basket_value, avg_items, category_diversity, "
             "age_group, city_tier, channel_pref, segment_id, value_tier")


def wave2_ctes() -> list[str]:
    """Optimised wave at 1998-01-01: scores -> economics -> allocation -> E3 split -> outcomes."""
    u = f"({md5_bucket('customer_id', OPTIMIZED_WAVE)} / 100000.0::DOUBLE)"
    return [feat("f2", WAVE2_AS_OF), seg("s2", "f2"), scored("sc2", "f2", "s2"), econ("e2", "sc2"),
            ranked("rk2", "e2 WHERE exp_incr_margin > exp_cost"),
            f"""al2 AS (SELECT * FROM rk2 WHERE cum_cost <= CAST({BUDGET} AS DECIMAL(20,6)))""",
            f"""asg2 AS (SELECT customer_id, CAST(NULL AS INTEGER) AS segment_id, value_tier,
  CASE WHEN {u} < 0.8::DOUBLE THEN 'treatment' ELSE 'holdout' END AS "group", '{OPTIMIZED_WAVE}' AS campaign_id,
  CASE WHEN {u} < 0.8::DOUBLE THEN {COUPON}::DOUBLE ELSE 0.0::DOUBLE END AS coupon_value,
  TIMESTAMP '{WAVE2_AS_OF}' AS assigned_ts FROM al2)""",
            outcomes("oc2", "asg2", WAVE2_AS_OF)]


def qini_ctes(src: str = "ev", by: str = "") -> list[str]:
    part = f"PARTITION BY {by} " if by else ""
    sel = f"{by}, " if by else ""
    t, h = "\"group\" = 'treatment'", "\"group\" = 'holdout'"
    return [f"""cw AS (SELECT {sel}customer_id, uplift_score, "group", purchased,
  ROW_NUMBER() OVER w AS row_idx, COUNT(*) OVER ({part}) AS n,
  CAST(SUM(CASE WHEN {t} THEN purchased ELSE 0 END) OVER w AS BIGINT) AS t_cum,
  CAST(SUM(CASE WHEN {h} THEN purchased ELSE 0 END) OVER w AS BIGINT) AS c_cum,
  CAST(SUM(CASE WHEN {t} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS nt_raw,
  CAST(SUM(CASE WHEN {h} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS nc_raw,
  CAST(SUM(CASE WHEN {t} THEN purchased ELSE 0 END) OVER ({part}) AS BIGINT) AS tt,
  CAST(SUM(CASE WHEN {h} THEN purchased ELSE 0 END) OVER ({part}) AS BIGINT) AS ct,
  CAST(SUM(CASE WHEN {t} THEN 1 ELSE 0 END) OVER ({part}) AS BIGINT) AS ntt,
  CAST(SUM(CASE WHEN {h} THEN 1 ELSE 0 END) OVER ({part}) AS BIGINT) AS nct
  FROM {src} WINDOW w AS ({part}ORDER BY uplift_score DESC, customer_id ROWS UNBOUNDED PRECEDING))""",
            f"""curve AS (SELECT {sel}customer_id, uplift_score, "group", purchased, row_idx, n, row_idx / n AS x,
  t_cum, c_cum, GREATEST(nt_raw, 1) AS nt_cum, GREATEST(nc_raw, 1) AS nc_cum,
  t_cum - c_cum * (GREATEST(nt_raw, 1) / GREATEST(nc_raw, 1)) AS qini,
  CASE WHEN row_idx = n THEN tt - ct * (GREATEST(ntt, 1) / GREATEST(nct, 1))
       WHEN n > 1 THEN (row_idx - 1) * ((tt - ct * (GREATEST(ntt, 1) / GREATEST(nct, 1))) / (n - 1))
       ELSE 0.0::DOUBLE END AS random FROM cw)"""]


QINI_COEF = """SELECT {sel}COUNT(*) AS n,
  (SUM(qini) - MAX(CASE WHEN row_idx = 1 THEN qini END) / 2) / COUNT(*) - MAX(CASE WHEN row_idx = n THEN qini END) / 2
    AS qini_coef,
  MAX(CASE WHEN row_idx = n THEN qini END) AS qini_end FROM curve {grp}"""

LEDGER_WAVES = (("PRIOR_A", "1996-11-15"), ("PRIOR_B", "1996-12-02"), ("PRIOR_C", "1996-12-20"))


def ledger_ctes() -> list[str]:
    """Allocations at the three prior decision days (features as of each day, stand-in score)."""
    ctes, parts = [], []
    for i, (w, d) in enumerate(LEDGER_WAVES):
        ctes += [feat(f"lf{i}", d),
                 f"""ls{i} AS (SELECT customer_id, CAST(NULL AS VARCHAR) AS value_tier, avg_basket_value,
  {score_expr('customer_id')} AS uplift_score FROM lf{i})""",
                 econ(f"le{i}", f"ls{i}"), ranked(f"lr{i}", f"le{i} WHERE exp_incr_margin > exp_cost")]
        parts.append(f"""SELECT customer_id, '{w}' AS campaign_id, TIMESTAMP '{d}' AS decision_ts FROM lr{i}
  WHERE cum_cost <= CAST({BUDGET} AS DECIMAL(20,6))""")
    return ctes + ["ledger AS (" + "\n  UNION ALL ".join(parts) + ")"]


CAPPED = """capped AS (SELECT customer_id, COUNT(*) AS n_recent_offers FROM ledger
  WHERE decision_ts >= DATE '1997-01-01' - INTERVAL 30 DAY GROUP BY customer_id HAVING COUNT(*) >= 2)"""


def snaps_ctes(with_tiers: bool = True, dates=SNAPSHOT_DATES) -> list[str]:
    ctes, parts = [], []
    for i, d in enumerate(dates):
        ctes.append(feat(f"f{i}x", d))
        if with_tiers:
            ctes.append(seg(f"s{i}x", f"f{i}x"))
            parts.append(f"""SELECT f.customer_id, TIMESTAMP '{d}' AS feature_ts, f.recency_days, f.tenure_days,
  f.frequency_per_month, f.monetary_per_month, f.txn_count, f.total_spend, f.avg_basket_value, f.max_basket_value,
  f.avg_items, f.category_diversity, f.age_group, f.city_tier, f.channel_pref, s.segment_id, s.value_tier
  FROM f{i}x f LEFT JOIN s{i}x s ON f.customer_id = s.customer_id""")
        else:
            parts.append(f"""SELECT customer_id, TIMESTAMP '{d}' AS feature_ts, recency_days, txn_count,
  monetary_per_month, data_tier FROM f{i}x""")
    ctes.append("snaps AS (" + "\n  UNION ALL ".join(parts) + ")")
    return ctes


def _batch2() -> dict[str, str]:
    q: dict[str, str] = {}
    prof = """SELECT age_group, COUNT(*) AS size, AVG(recency_days) AS recency, AVG(frequency_per_month) AS freq,
  AVG(monetary_per_month) AS monetary, AVG(avg_basket_value) AS basket FROM f GROUP BY age_group"""
    pd_ = ["recency", "freq", "monetary", "basket"]
    q["segment_profile"] = final(with_(*BASE, feat("f", AS_OF)) + prof, pd_)
    q["value_tiers"] = final(with_(*BASE, feat("f", AS_OF), f"p AS ({prof})") + """SELECT *,
  CAST(ROW_NUMBER() OVER (ORDER BY monetary DESC, age_group) AS INTEGER) AS tier_rank,
  CASE LEAST(ROW_NUMBER() OVER (ORDER BY monetary DESC, age_group), 6) WHEN 1 THEN 'High Value'
    WHEN 2 THEN 'Medium-High Value' WHEN 3 THEN 'Medium Value' ELSE 'Low Value' END AS value_tier FROM p""", pd_)
    q["tier_profile"] = final(with_(*BASE, feat("f", AS_OF), seg("s", "f")) + """SELECT s.value_tier,
  COUNT(*) AS n_customers, AVG(f.recency_days) AS avg_recency, AVG(f.frequency_per_month) AS avg_freq,
  AVG(f.monetary_per_month) AS avg_monthly_spend, AVG(f.avg_basket_value) AS avg_basket
  FROM s JOIN f USING (customer_id) GROUP BY s.value_tier""",
                              ["avg_recency", "avg_freq", "avg_monthly_spend", "avg_basket"])
    q["tier_lookup"] = with_(*BASE, feat("f", AS_OF), f"p AS ({prof})", """tiers AS (SELECT age_group,
  ROW_NUMBER() OVER (ORDER BY monetary DESC, age_group) AS r FROM p)""") + """SELECT customer_id, c.age_group,
  CASE r WHEN 1 THEN 'High Value' WHEN 2 THEN 'Medium-High Value' WHEN 3 THEN 'Medium Value' ELSE 'Low Value' END AS value_tier
  FROM cust c LEFT JOIN tiers t ON c.age_group = t.age_group"""
    q["overview_counts"] = with_(*BASE, feat("f", AS_OF)) + """SELECT (SELECT COUNT(*) FROM cust) AS n_total,
  (SELECT COUNT(*) FROM f) AS n_known,
  (SELECT COUNT(*) FROM cust c ANTI JOIN f ON c.customer_id = f.customer_id) AS n_unknown"""
    q["assign_nearest"] = """WITH e AS (SELECT vec_id, label, UNNEST(embedding) AS v,
  generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label AS centre_id, d, AVG(v) AS cv FROM e GROUP BY label, d),
dist AS (SELECT e.vec_id, c.centre_id, SUM((e.v - c.cv) * (e.v - c.cv)) AS d2 FROM e JOIN c ON e.d = c.d
  GROUP BY e.vec_id, c.centre_id),
best AS (SELECT vec_id, centre_id FROM dist QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d2, centre_id) = 1)
SELECT m.vec_id, m.label, CAST(b.centre_id AS INTEGER) AS centre_id FROM embeddings m JOIN best b ON m.vec_id = b.vec_id"""
    q["eligible_by_tier"] = with_(*BASE, feat("f", AS_OF), seg("s", "f")) + \
        "SELECT customer_id, segment_id, value_tier FROM s WHERE value_tier IN ('High Value', 'Medium-High Value')"
    q["assign_groups_md5"] = final(with_(*WAVE1) + "SELECT * FROM asg", ["coupon_value"])
    q["murmur_groups"] = final(with_(*BASE, feat("f", AS_OF), seg("s", "f"),
                                     assign("asg", "s", LEARNING_WAVE, AS_OF, bucket=murmur_bucket))
                               + "SELECT * FROM asg", ["coupon_value"])
    h = md5_u32("customer_id", LEARNING_WAVE)
    q["assign_groups_exact"] = final(with_(*BASE, feat("f", AS_OF), seg("s", "f"), f"""rk AS (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY value_tier ORDER BY {h}, customer_id) AS r,
  COUNT(*) OVER (PARTITION BY value_tier) AS n FROM s)""") + f"""SELECT customer_id, segment_id, value_tier,
  CASE WHEN r <= FLOOR(n * 0.8::DOUBLE + 0.5::DOUBLE) THEN 'treatment' ELSE 'holdout' END AS "group",
  '{LEARNING_WAVE}' AS campaign_id,
  CASE WHEN r <= FLOOR(n * 0.8::DOUBLE + 0.5::DOUBLE) THEN {COUPON}::DOUBLE ELSE 0.0::DOUBLE END AS coupon_value,
  TIMESTAMP '{AS_OF}' AS assigned_ts FROM rk""", ["coupon_value"])
    q["balance_check"] = final(with_(*WAVE1) + """SELECT value_tier, treatment, holdout,
  ROUND(treatment / (treatment + holdout), 3) AS treatment_pct
  FROM (SELECT value_tier, NULLIF(COUNT(*) FILTER (WHERE "group" = 'treatment'), 0) AS treatment,
    NULLIF(COUNT(*) FILTER (WHERE "group" = 'holdout'), 0) AS holdout FROM asg GROUP BY value_tier) b""",
                               ["treatment_pct"])
    q["attribute_outcomes"] = final(with_(*WAVE1) + "SELECT * FROM oc", ["coupon_value", "spend"])
    q["outcome_summary"] = final(with_(*WAVE1) + """SELECT campaign_id, "group", COUNT(*) AS n,
  AVG(purchased) AS purchase_rate, AVG(spend) AS avg_spend, AVG(redeemed) AS redemption_rate,
  CAST(SUM(redeemed) AS BIGINT) AS redemptions FROM oc GROUP BY campaign_id, "group\"""",
                                 ["purchase_rate", "avg_spend", "redemption_rate"])
    ate_sel = """COUNT(*) FILTER (WHERE "group" = 'treatment') AS n_treated,
  COUNT(*) FILTER (WHERE "group" = 'holdout') AS n_holdout,
  AVG(purchased) FILTER (WHERE "group" = 'treatment') AS treatment_rate,
  AVG(purchased) FILTER (WHERE "group" = 'holdout') AS holdout_rate,
  AVG(purchased) FILTER (WHERE "group" = 'treatment') - AVG(purchased) FILTER (WHERE "group" = 'holdout') AS ate"""
    ate_d = ["treatment_rate", "holdout_rate", "ate"]
    q["ate"] = final(with_(*WAVE1) + f"SELECT campaign_id, {ate_sel} FROM oc GROUP BY campaign_id", ate_d)
    q["ate_by_tier"] = final(with_(*WAVE1) + f"SELECT campaign_id, value_tier, {ate_sel} FROM oc "
                             "GROUP BY campaign_id, value_tier", ate_d)
    q["incremental_lift"] = final(with_(*WAVE1) + lift_sql("oc", "1997-04-01"), LIFT_DOUBLES)
    lbw = lift_sql("oc", "1997-04-01") + "\nUNION ALL\n" + lift_sql("oc2", "1998-04-01")
    q["lift_by_wave"] = final(with_(*WAVE1, *wave2_ctes()) + lbw, LIFT_DOUBLES)
    q["latest_lift"] = final(with_(*WAVE1, *wave2_ctes(), f"lw AS ({lbw})") +
                             "SELECT * FROM lw ORDER BY measured_ts DESC, campaign_id DESC LIMIT 1", LIFT_DOUBLES)
    hs = md5_u32("customer_id", "SPLIT")
    q["stratified_split"] = with_(*WAVE1, f"""sp AS (SELECT customer_id, "group",
  ROW_NUMBER() OVER (PARTITION BY "group" ORDER BY {hs}, customer_id) AS r,
  COUNT(*) OVER (PARTITION BY "group") AS n FROM oc)""") + """SELECT customer_id, "group",
  CASE WHEN r <= (n * 2000 + 9999) // 10000 THEN 'eval' ELSE 'train' END AS split FROM sp"""
    ev = WAVE1 + [EVAL]
    curve_d = ["uplift_score", "x", "qini", "random"]
    q["qini_data"] = final(with_(*WAVE1, scored("scored", "f", "s")) + """SELECT u.customer_id, u.uplift_score,
  o."group", o.purchased FROM scored u JOIN oc o USING (customer_id)
  WHERE o.campaign_id = 'WAVE_01_LEARNING'""", ["uplift_score"])
    q["qini_curve"] = final(with_(*ev, *qini_ctes()) + "SELECT * FROM curve", curve_d)
    q["qini_coefficient"] = final(with_(*ev, *qini_ctes()) + QINI_COEF.format(sel="", grp=""),
                                  ["qini_coef", "qini_end"])
    q["qini_curve_long"] = final(with_(*ev, *qini_ctes()) + """SELECT row_idx, x * 100 AS pct, qini AS y,
  'Model' AS series FROM curve UNION ALL SELECT row_idx, x * 100 AS pct, random AS y, 'Random' AS series FROM curve""",
                                 ["pct", "y"])
    dec = """dc AS (SELECT *, CAST(GREATEST(CASE WHEN n > 1 THEN ((score_rank - 1) * 10 + n - 2) // (n - 1) ELSE 0 END - 1, 0)
  AS INTEGER) AS uplift_decile FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY uplift_score, customer_id) AS score_rank,
  COUNT(*) OVER () AS n FROM ev))"""
    q["uplift_deciles"] = final(with_(*ev, dec) + """SELECT customer_id, "group", purchased, uplift_score,
  score_rank, uplift_decile FROM dc""", ["uplift_score"])
    q["decile_lift"] = final(with_(*ev, dec) + """SELECT uplift_decile, COUNT(*) AS n,
  COUNT(*) FILTER (WHERE "group" = 'treatment') AS n_treated, COUNT(*) FILTER (WHERE "group" = 'holdout') AS n_holdout,
  COALESCE(AVG(purchased) FILTER (WHERE "group" = 'treatment'), 0.0) AS treated_rate,
  COALESCE(AVG(purchased) FILTER (WHERE "group" = 'holdout'), 0.0) AS holdout_rate,
  COALESCE(AVG(purchased) FILTER (WHERE "group" = 'treatment'), 0.0)
    - COALESCE(AVG(purchased) FILTER (WHERE "group" = 'holdout'), 0.0) AS observed_uplift
  FROM dc GROUP BY uplift_decile""", ["treated_rate", "holdout_rate", "observed_uplift"])
    sc = BASE + [feat("f", AS_OF), seg("s", "f"), scored("scored", "f", "s")]
    q["score_summary"] = final(with_(*sc) + """SELECT COUNT(uplift_score) AS n, AVG(uplift_score) AS mean_uplift,
  STDDEV_SAMP(uplift_score) AS std_uplift, MIN(uplift_score) AS min_uplift, MAX(uplift_score) AS max_uplift,
  AVG(CASE WHEN uplift_score > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_positive,
  QUANTILE_CONT(uplift_score, 0.25) AS p25_uplift, QUANTILE_CONT(uplift_score, 0.5) AS p50_uplift,
  QUANTILE_CONT(uplift_score, 0.75) AS p75_uplift, QUANTILE_CONT(uplift_score, 0.9) AS p90_uplift FROM scored""",
                               ["mean_uplift", "std_uplift", "min_uplift", "max_uplift", "share_positive",
                                "p25_uplift", "p50_uplift", "p75_uplift", "p90_uplift"])
    q["score_histogram"] = final(with_(*sc, """b AS (SELECT MIN(uplift_score) AS lo, MAX(uplift_score) AS hi
  FROM scored)""") + """SELECT bin, lo + (bin - 1) * ((hi - lo) / 40) AS bin_lo, lo + bin * ((hi - lo) / 40) AS bin_hi,
  n FROM (SELECT CAST(CASE WHEN hi > lo THEN LEAST(FLOOR((uplift_score - lo) * 40 / (hi - lo)) + 1, 40) ELSE 1 END
  AS INTEGER) AS bin, COUNT(*) AS n, ANY_VALUE(lo) AS lo, ANY_VALUE(hi) AS hi FROM scored, b GROUP BY 1) t""",
                                 ["bin_lo", "bin_hi"])
    al = sc + [econ("e", "scored"), ranked("rk", "e WHERE exp_incr_margin > exp_cost"),
               f"al AS (SELECT * FROM rk WHERE cum_cost <= CAST({BUDGET} AS DECIMAL(20,6)))"]
    q["offer_economics"] = final(with_(*sc, econ("e", "scored")) + "SELECT * FROM e", ECON_DOUBLES)
    q["allocate_budget"] = final(with_(*al) + """SELECT customer_id, value_tier, uplift_score, exp_incr_margin,
  exp_cost, roi_per_dollar, roi_rank, CAST(cum_cost AS DOUBLE) AS cum_cost FROM al""",
                                 ["uplift_score", "exp_incr_margin", "exp_cost", "roi_per_dollar", "cum_cost"])
    summ = ["expected_spend", "expected_margin", "expected_roi"]
    q["allocation_summary"] = final(with_(*al) + """SELECT COUNT(*) AS customers_offered,
  COALESCE(SUM(exp_cost), 0.0) AS expected_spend, COALESCE(SUM(exp_incr_margin), 0.0) AS expected_margin,
  COALESCE(SUM(exp_incr_margin), 0.0) / GREATEST(COALESCE(SUM(exp_cost), 0.0), 1.0) AS expected_roi FROM al""", summ)
    q["budget_sweep"] = final(with_(*al[:-1], """grid AS (SELECT CAST(i * 250000 AS DOUBLE) AS budget
  FROM range(1, 41) t(i))""") + """SELECT g.budget, COUNT(r.customer_id) AS customers_offered,
  COALESCE(SUM(r.exp_cost), 0.0) AS expected_spend, COALESCE(SUM(r.exp_incr_margin), 0.0) AS expected_margin,
  COALESCE(SUM(r.exp_incr_margin), 0.0) / GREATEST(COALESCE(SUM(r.exp_cost), 0.0), 1.0) AS expected_roi
  FROM grid g LEFT JOIN rk r ON r.cum_cost <= CAST(g.budget AS DECIMAL(20,6)) GROUP BY g.budget""",
                              ["budget", *summ])
    grid_parts = []
    for m in (0.2, 0.3, 0.4):
        for c in (10000.0, 20000.0):
            tag = f"{int(m * 10)}_{int(c)}"
            grid_parts.append((m, c, tag))
    gctes = []
    for m, c, tag in grid_parts:
        gctes.append(econ(f"e{tag}", "scored", margin=m, coupon=c))
        gctes.append(ranked(f"r{tag}", f"e{tag} WHERE exp_incr_margin > exp_cost"))
    gctes.append("""bgrid AS (SELECT CAST(i * 1250000 AS DOUBLE) AS budget FROM range(1, 9) t(i))""")
    sel = []
    for m, c, tag in grid_parts:
        sel.append(f"""SELECT {m}::DOUBLE AS margin_rate, {c}::DOUBLE AS coupon_value, g.budget,
  COUNT(r.customer_id) AS customers_offered, COALESCE(SUM(r.exp_cost), 0.0) AS expected_spend,
  COALESCE(SUM(r.exp_incr_margin), 0.0) AS expected_margin,
  COALESCE(SUM(r.exp_incr_margin), 0.0) / GREATEST(COALESCE(SUM(r.exp_cost), 0.0), 1.0) AS expected_roi
  FROM bgrid g LEFT JOIN r{tag} r ON r.cum_cost <= CAST(g.budget AS DECIMAL(20,6)) GROUP BY g.budget""")
    q["budget_sweep_grid"] = final(with_(*sc, *gctes) + "\nUNION ALL\n".join(sel),
                                   ["margin_rate", "coupon_value", "budget", *summ])
    ev_ctes = ["""users AS (SELECT DISTINCT user_id AS customer_id, CAST(NULL AS INTEGER) AS segment_id,
  CAST(NULL AS VARCHAR) AS value_tier FROM events
  WHERE ts < TIMESTAMP '2024-01-15' AND event_type IN ('view', 'click'))""",
               assign("asg", "users", "WAVE_EVENTS", "2024-01-15", coupon=5.0),
               """txn AS (SELECT user_id AS customer_id, ts AS txn_date, value AS amount FROM events
  WHERE event_type = 'purchase')""",
               """red AS (SELECT CAST(NULL AS BIGINT) AS customer_id, CAST(NULL AS TIMESTAMP) AS redeemed_ts WHERE false)""",
               outcomes("oc", "asg", "2024-01-15", hi_days=1)]
    q["event_outcomes"] = final(with_(*ev_ctes) + "SELECT * FROM oc", ["coupon_value", "spend"])
    q["event_lift"] = final(with_(*ev_ctes) + lift_sql("oc", "2024-01-16", coupon=5.0), LIFT_DOUBLES)
    cl = ["recency_days", "frequency_per_month", "monetary_per_month", "avg_basket_value", "category_diversity",
          "avg_items"]
    logs = {"monetary_per_month", "avg_basket_value"}
    xs = ", ".join((f"ln(1 + COALESCE(CAST({c} AS DOUBLE), 0.0)) AS {c}" if c in logs
                    else f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}") for c in cl)
    st = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in cl)
    zs = ", ".join(f"(x.{c} - st.m_{c}) / (CASE WHEN st.s_{c} = 0 OR st.s_{c} IS NULL THEN 1.0 ELSE st.s_{c} END) "
                   f"AS z_{c}" for c in cl)
    q["cluster_vectors"] = final(with_(*BASE, feat("f", AS_OF), f"x AS (SELECT customer_id, {xs} FROM f)",
                                       f"st AS (SELECT {st} FROM x)") + f"SELECT x.customer_id, {zs} FROM x, st",
                                 [f"z_{c}" for c in cl])
    q["recent_offers"] = with_(*BASE, feat("f", AS_OF), *ledger_ctes(), CAPPED) + "SELECT * FROM capped"
    q["frequency_cap"] = final(with_(*sc, *ledger_ctes(), CAPPED, econ("e", "scored"),
                                     ranked("rk", "e WHERE exp_incr_margin > exp_cost "
                                                  "AND customer_id NOT IN (SELECT customer_id FROM capped)")) +
                               f"""SELECT customer_id, value_tier, uplift_score, exp_incr_margin, exp_cost,
  roi_per_dollar, {COUPON}::DOUBLE AS coupon_value, '{OPTIMIZED_WAVE}' AS campaign_id,
  TIMESTAMP '{AS_OF}' AS decision_ts FROM rk WHERE cum_cost <= CAST({BUDGET} AS DECIMAL(20,6))""", OFFER_DOUBLES)
    q["reserve_holdout_channels"] = with_(*BASE, *wave2_ctes()[:6]) + f"""SELECT customer_id, value_tier,
  '{OPTIMIZED_WAVE}' AS campaign_id,
  CASE WHEN {md5_bucket('customer_id', OPTIMIZED_WAVE)} / 100000.0::DOUBLE < 0.8::DOUBLE THEN 'treatment'
    ELSE 'holdout' END AS "group",
  CASE WHEN {md5_bucket('customer_id', OPTIMIZED_WAVE)} / 100000.0::DOUBLE < 0.8::DOUBLE
    THEN (CASE {md5_bucket('customer_id', None)} % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'email' ELSE 'sms' END)
    ELSE 'none' END AS channel FROM al2"""
    q["latest_snapshot"] = final(with_(*BASE, *snaps_ctes(True)) + f"""SELECT {SNAP_COLS} FROM snaps
  QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY feature_ts DESC) = 1""", SNAP_DOUBLES)
    q["kmeans_facts"] = with_(*BASE, feat("f", AS_OF)) + \
        "SELECT COUNT(*) AS n_customers, CAST(4 AS BIGINT) AS n_segments, true AS nearest_mean FROM f"
    q["feature_history"] = final(with_(*BASE, *[feat(f"f{i}x", d) for i, d in enumerate(SNAPSHOT_DATES)]) + " UNION ALL ".join(
        f"SELECT *, TIMESTAMP '{d}' AS feature_ts FROM f{i}x" for i, d in enumerate(SNAPSHOT_DATES)), FEAT_DOUBLES)
    q["asof_weekly_features"] = final(with_(*BASE, """weeks AS (SELECT TIMESTAMP '1996-01-01' + to_days(CAST(7 * i AS INTEGER)) AS w
  FROM range(157) t(i))""", """newest AS (SELECT txn_id, customer_id, txn_date, w FROM txn LEFT JOIN weeks ON w <= txn_date
  QUALIFY ROW_NUMBER() OVER (PARTITION BY txn_id ORDER BY w DESC NULLS LAST) = 1)""",
                                              """states AS (SELECT n.txn_id, COUNT(*) AS txn_count, SUM(t.amount) AS spend,
  date_diff('day', CAST(MAX(t.txn_date) AS DATE), CAST(ANY_VALUE(n.w) AS DATE)) AS recency,
  date_diff('day', CAST(MIN(t.txn_date) AS DATE), CAST(ANY_VALUE(n.w) AS DATE)) AS tenure
  FROM newest n JOIN txn t ON t.customer_id = n.customer_id AND t.txn_date < n.w GROUP BY n.txn_id)""") + """SELECT n.txn_id AS o_orderkey,
  n.customer_id, n.txn_date, CASE WHEN txn_count > 0 THEN n.w END AS feature_ts, CAST(recency AS INTEGER) AS recency_days, txn_count,
  spend / GREATEST(tenure / 30.0::DOUBLE, 1.0::DOUBLE) AS monetary_per_month
  FROM newest n LEFT JOIN states USING (txn_id) WHERE n.customer_id IN (SELECT customer_id FROM cust)""", ["monetary_per_month"])
    own = [f"""own{i} AS (SELECT * REPLACE (assigned_ts + to_days(CAST(customer_id % 180 + {later} AS INTEGER))
  + to_minutes(customer_id * 7919 % 1440) AS assigned_ts) FROM own{i}_base)""" for i, later in enumerate((0, 45))]
    q["attribute_own_times"] = final(with_(*BASE, REDEMPTIONS, feat("f", AS_OF), seg("s", "f"), assign("own0_base", "s", "WAVE_OWN_A", AS_OF),
                                           assign("own1_base", "s", "WAVE_OWN_B", AS_OF), *own,
                                           "own AS (SELECT * FROM own0 UNION ALL SELECT * FROM own1)", outcomes("oc", "own", AS_OF))
                                     + "SELECT * FROM oc", ["coupon_value", "spend"])
    q["asof_features"] = final(with_(*BASE, *snaps_ctes(False)) + """SELECT t.txn_id AS o_orderkey, t.customer_id,
  t.txn_date, s.feature_ts, s.recency_days, s.txn_count, s.monetary_per_month
  FROM txn t ASOF LEFT JOIN snaps s ON t.customer_id = s.customer_id AND t.txn_date >= s.feature_ts""",
                               ["monetary_per_month"])
    q["publish_snapshot_merge"] = final(with_(*BASE, *snaps_ctes(False), """old AS (SELECT customer_id, feature_ts,
  txn_count, monetary_per_month, 'existing' AS source FROM snaps WHERE feature_ts < TIMESTAMP '1999-01-01')""",
                                              """new AS (SELECT customer_id, feature_ts, txn_count, monetary_per_month,
  'new' AS source FROM snaps WHERE (feature_ts = TIMESTAMP '1998-01-01' AND data_tier = 'known_full')
  OR feature_ts = TIMESTAMP '1999-01-01')""") + """SELECT * FROM new UNION ALL
  SELECT * FROM old ANTI JOIN new USING (customer_id, feature_ts)""", ["monetary_per_month"])
    q["published_snapshots"] = q["publish_snapshot_merge"]
    q["rewritten_waves"] = q["attribute_outcomes"]
    q["logged_runs"] = with_(*WAVE1) + """SELECT CAST(v AS INTEGER) AS version, COUNT(*) AS n_train,
  CASE v WHEN 3 THEN 'later' END AS note, campaign_id, CAST(SUM(purchased) AS BIGINT) AS n_eval
  FROM oc, range(1, 4) t(v) GROUP BY v, campaign_id"""
    q["customers_sketch"] = final("SELECT d AS feature_ts, COUNT(DISTINCT o_custkey) AS n_exact, 0.01625::DOUBLE AS stated_error, true AS within FROM ("
                                  + " UNION ALL ".join(f"SELECT TIMESTAMP '{d}' AS d" for d in SNAPSHOT_DATES)
                                  + ") t LEFT JOIN orders ON o_orderdate < d GROUP BY d", ["stated_error"])
    q["score_quantile_sketch"] = final(with_(*sc) + """SELECT p::DOUBLE AS p, n, 0.0165::DOUBLE AS stated_error, true AS within
  FROM (VALUES (0.25), (0.5), (0.75), (0.9)) t(p), (SELECT COUNT(uplift_score) AS n FROM scored) u""", ["p", "stated_error"])
    q["prefix_sum"] = """SELECT o_orderkey, ROW_NUMBER() OVER w AS row_idx,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS running_total, COUNT(*) OVER () AS n_rows
  FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING)"""
    split = md5_u32("customer_id", "SPLIT")
    evs = " UNION ALL ".join(
        f"""SELECT {v} AS version, customer_id, {score_expr('customer_id', salt)} AS uplift_score, "group", purchased
  FROM sp WHERE r <= (n * 2000 + 9999) // 10000""" for v, salt in ((1, "SCORE"), (2, "SCORE_B"), (3, "SCORE_C")))
    q["champion"] = final(with_(*WAVE1, f"""sp AS (SELECT customer_id, "group", purchased,
  ROW_NUMBER() OVER (PARTITION BY "group" ORDER BY {split}, customer_id) AS r,
  COUNT(*) OVER (PARTITION BY "group") AS n FROM oc)""", f"ev3 AS ({evs})", *qini_ctes("ev3", "version"),
                                f"qc AS ({QINI_COEF.format(sel='version, ', grp='GROUP BY version')})") +
                          """SELECT CAST(version AS INTEGER) AS champion_version, qini_coef FROM qc
  ORDER BY COALESCE(qini_coef, -1e9) DESC, version ASC LIMIT 1""", ["qini_coef"])
    return q


ORACLE_SQL = _q()
