"""The same queries as SQL for DuckDB."""

from __future__ import annotations

_EVENTS = """ev AS (
  SELECT epoch_us(ts) // 1000 AS timestamp, user_id AS visitorid, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'addtocart' ELSE 'transaction' END AS event,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, CASE WHEN event_type = 'purchase' THEN event_id END AS transactionid, CAST(ts AS DATE) AS event_date
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
_PROPS = """props AS (
  SELECT epoch_us(ts) // 1000 AS timestamp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, CASE WHEN event_type = 'signup' THEN 'categoryid' ELSE 'available' END AS property,
         CAST(CASE WHEN event_type = 'signup' THEN user_id % 25 ELSE user_id % 2 END AS VARCHAR) AS value
  FROM events WHERE event_type IN ('signup', 'error'))"""
_TREE = """tree AS (
  SELECT CAST(n_nationkey AS BIGINT) AS categoryid, CAST(n_regionkey + 100 AS BIGINT) AS parentid FROM nation
  UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), NULL FROM region)"""
_DISTINCT = "d AS (SELECT DISTINCT * FROM ev)"
_ENRICHED = """snaps AS (SELECT itemid, timestamp, max(TRY_CAST(value AS BIGINT)) AS categoryid FROM props WHERE property = 'categoryid' GROUP BY ALL),
enriched AS (SELECT d.*, s.categoryid FROM d ASOF LEFT JOIN snaps s ON d.itemid = s.itemid AND d.timestamp >= s.timestamp)"""
_LATEST = "latest AS (SELECT itemid, CAST(arg_max(TRY_CAST(value AS BIGINT), timestamp) AS BIGINT) AS categoryid FROM props WHERE property = 'categoryid' GROUP BY itemid)"


def _tagged(source: str, timeout_s: int) -> str:
    return f"""flagged AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR timestamp - lag(timestamp) OVER w > {timeout_s * 1000} THEN timestamp END AS starts FROM {source} WINDOW w AS (PARTITION BY visitorid ORDER BY timestamp)),
tagged AS (SELECT * EXCLUDE (starts), visitorid || '-' || max(starts) OVER (PARTITION BY visitorid ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS session_id FROM flagged)"""


_SESSIONS = """sess AS (SELECT session_id, visitorid, make_timestamp(min(timestamp) * 1000) AS start_time, make_timestamp(max(timestamp) * 1000) AS end_time, count(*) AS event_count,
  bool_or(event = 'transaction') AS has_purchase, CAST(make_timestamp(min(timestamp) * 1000) AS DATE) AS session_date FROM tagged GROUP BY session_id, visitorid)"""
_PAIRS = """items AS (SELECT DISTINCT session_id, CASE event WHEN 'view' THEN 'view' ELSE 'purchase' END AS pair_type, itemid FROM tagged WHERE event IN ('view', 'transaction') AND itemid IS NOT NULL),
pairs AS (SELECT a.itemid AS item_a, b.itemid AS item_b, count(*) AS weight, a.pair_type FROM items a JOIN items b USING (session_id, pair_type) WHERE a.itemid < b.itemid GROUP BY ALL HAVING count(*) >= 2)"""
_FUNNEL = """counts AS (SELECT categoryid, event_date, count(*) FILTER (event = 'view') AS views, count(*) FILTER (event = 'addtocart') AS carts, count(*) FILTER (event = 'transaction') AS purchases
  FROM enriched WHERE categoryid IS NOT NULL GROUP BY ALL),
funnel AS (SELECT *, CASE WHEN views > 0 THEN carts / views ELSE 0.0::DOUBLE END AS cart_rate, CASE WHEN carts > 0 THEN purchases / carts ELSE 0.0::DOUBLE END AS purchase_rate FROM counts)"""
_FEATURES = """ic AS (SELECT itemid, count(*) FILTER (event = 'view') AS views, count(*) FILTER (event = 'addtocart') AS carts, count(*) FILTER (event = 'transaction') AS purchases FROM enriched GROUP BY itemid),
cc AS (SELECT categoryid, count(*) FILTER (event = 'view') AS cv, count(*) FILTER (event = 'transaction') AS cp FROM enriched WHERE categoryid IS NOT NULL GROUP BY categoryid),
features AS (SELECT itemid, categoryid, views, carts, purchases, views AS popularity, CASE WHEN views > 0 THEN purchases / views ELSE 0.0::DOUBLE END AS item_purchase_rate,
  CASE WHEN cv > 0 THEN cp / cv ELSE 0.0::DOUBLE END AS category_purchase_rate FROM ic LEFT JOIN latest USING (itemid) LEFT JOIN cc USING (categoryid))"""
_BROWSED = """agg AS (SELECT session_id, count(*) AS event_count, count(*) FILTER (event = 'view') AS n_views, count(*) FILTER (event = 'addtocart') AS n_carts, count(DISTINCT itemid) AS n_items,
  count(DISTINCT categoryid) AS n_categories FROM tagged WHERE event <> 'transaction' GROUP BY session_id),
fs AS (SELECT s.session_id, visitorid, start_time, CAST(hour(start_time) AS INT) AS start_hour, a.event_count, n_views, n_carts, n_items, n_categories,
  CASE WHEN n_items > 0 THEN n_views / n_items ELSE 0.0::DOUBLE END AS views_per_item, has_purchase, n_carts > 0 AND NOT has_purchase AS abandoned FROM sess s JOIN agg a USING (session_id))"""


def _q(select: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)}\n{select}" if parts else select


def _count(check: str, table: str, column: str, query: str) -> str:
    return f"SELECT '{check}' AS check_name, '{table}' AS table_name, '{column}' AS column_name, count(*) AS violations FROM ({query})"


_GOLD = (
    "raw_events AS (SELECT *, 1 AS _loaded_at FROM tagged)",
    "raw_sessions AS (SELECT * FROM sess)",
    "raw_category_tree AS (SELECT * FROM tree)",
    "item_latest AS (SELECT * FROM latest)",
    "cooccur_pairs AS (SELECT * FROM pairs)",
    "fct_sessions AS (SELECT session_id, visitorid FROM sess)",
    "fct_funnel AS (SELECT * FROM funnel)",
    "dim_categories AS (SELECT * FROM tree)",
    "dim_items AS (SELECT itemid, categoryid FROM latest)",
    "feature_table AS (SELECT * FROM features)",
    "feature_sessions AS (SELECT * FROM fs)",
    "feature_cooccur AS (SELECT item_a || '-' || item_b || '-' || pair_type AS pair_id, item_a, item_b FROM pairs)",
)
# The 37 checks: columns that hold no null, columns without repeats, and the others.
_FILLED = {
    "raw_events": ("visitorid", "itemid", "event", "_loaded_at"), "raw_sessions": ("session_id", "visitorid", "event_count", "has_purchase"), "raw_category_tree": ("categoryid",), "item_latest": ("itemid",),
    "fct_sessions": ("session_id", "visitorid"), "fct_funnel": ("categoryid", "event_date"), "dim_categories": ("categoryid",), "dim_items": ("itemid",), "feature_table": ("itemid",),
    "feature_sessions": ("session_id", "visitorid"), "feature_cooccur": ("pair_id", "item_a", "item_b"),
}
_DISTINCT_COLUMNS = (
    ("raw_sessions", "session_id"), ("raw_category_tree", "categoryid"), ("item_latest", "itemid"), ("fct_sessions", "session_id"), ("dim_categories", "categoryid"), ("dim_items", "itemid"), ("feature_table", "itemid"),
    ("feature_sessions", "session_id"), ("feature_cooccur", "pair_id"),
)


def _all_checks() -> list[str]:
    out = [_count("not_null", t, c, f"SELECT 1 FROM {t} WHERE {c} IS NULL") for t, columns in _FILLED.items() for c in columns]
    out += [_count("unique", t, c, f"SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1") for t, c in _DISTINCT_COLUMNS]
    out += [_count("accepted_values", t, c, f"SELECT 1 FROM {t} WHERE {c} NOT IN ({', '.join(repr(v) for v in values)})") for t, c, values in (("raw_events", "event", ("view", "addtocart", "transaction")), ("cooccur_pairs", "pair_type", ("view", "purchase")))]
    out += [_count("accepted_range", t, c, f"SELECT 1 FROM {t} WHERE {c} < {least}") for t, c, least in (("raw_sessions", "event_count", 1), ("cooccur_pairs", "weight", 2))]
    return out + [_count("relationships", t, "categoryid", f"SELECT 1 FROM {t} ANTI JOIN dim_categories USING (categoryid) WHERE categoryid IS NOT NULL") for t in ("fct_funnel", "dim_items")]


def oracle_sql() -> dict[str, str]:
    silver = (_EVENTS, _PROPS, _DISTINCT, _ENRICHED)
    half, day = 1800, 86_400

    def with_sessions(timeout_s: int, source: str = "d") -> tuple[str, ...]:
        return (*(silver if source == "enriched" else (_EVENTS, _DISTINCT)), _tagged(source, timeout_s), _SESSIONS)

    sess = "SELECT * FROM sess"
    risk = (*with_sessions(half, "enriched"), _BROWSED)
    pair_day = (_EVENTS, _DISTINCT, _tagged("d", day), _PAIRS)
    bought = "SELECT CASE WHEN item_a = 10 THEN item_b ELSE item_a END AS rec_item_id, CAST(weight AS DOUBLE) AS score FROM pairs WHERE (item_a = 10 OR item_b = 10) AND pair_type = 'purchase'"
    ratings = "r AS (SELECT visitorid, itemid, CAST(sum(CASE event WHEN 'view' THEN 1 WHEN 'addtocart' THEN 3 ELSE 5 END) AS DOUBLE) AS rating FROM ev GROUP BY ALL)"
    neighbours = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS item_id, b.vec_id AS rec_item_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rec_item_id) AS INT) AS rank FROM p QUALIFY rank <= 20"""
    return {
        "bronze_events": _q("SELECT * FROM ev", _EVENTS),
        "bronze_item_properties": _q("SELECT * FROM props", _PROPS),
        "bronze_category_tree": _q("SELECT * FROM tree", _TREE),
        "events_window": _q("SELECT * FROM ev WHERE event_date >= DATE '2024-01-10' AND event_date < DATE '2024-01-15'", _EVENTS),
        "dedupe_events": _q("SELECT * FROM d", _EVENTS, _DISTINCT),
        "point_in_time_category": _q("SELECT * FROM enriched", *silver),
        "point_in_time_bucketed": _q("SELECT * FROM enriched", *silver),
        "latest_item_snapshot": _q("SELECT * FROM latest", _PROPS, _LATEST),
        "tag_sessions": _q("SELECT * FROM tagged", _EVENTS, _tagged("ev", half)),
        "build_sessions": _q(sess, *with_sessions(half)),
        "build_sessions_day": _q(sess, *with_sessions(day)),
        "fct_sessions": _q("SELECT session_id, visitorid, start_time, end_time, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS duration_seconds, event_count, has_purchase FROM sess", *with_sessions(half)),
        "sessions_native": _q(sess, *with_sessions(half)),
        "cooccur_pairs": _q("SELECT * FROM pairs", *pair_day),
        "feature_cooccur": _q("SELECT item_a || '-' || item_b || '-' || pair_type AS pair_id, item_a, item_b, pair_type, weight FROM pairs", *pair_day),
        "basket_pairs": "WITH b AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS i FROM lineitem WHERE l_partkey IS NOT NULL) SELECT a.i AS item_a, b.i AS item_b, count(*) AS weight FROM b a JOIN b USING (s) WHERE a.i < b.i GROUP BY ALL HAVING count(*) >= 2",
        "fct_funnel": _q("SELECT * FROM funnel", *silver, _FUNNEL),
        "funnel_tail": _q("SELECT * FROM funnel WHERE event_date >= (SELECT max(event_date) FROM funnel) - 3", *silver, _FUNNEL),
        "dim_categories": _q("SELECT *, parentid IS NULL AS is_root FROM tree", _TREE),
        "dim_items": _q("SELECT itemid, categoryid, parentid FROM latest LEFT JOIN tree USING (categoryid)", _PROPS, _LATEST, _TREE),
        "feature_table": _q("SELECT * FROM features", *silver, _LATEST, _FEATURES),
        "feature_sessions": _q("SELECT * FROM fs", *risk),
        "feature_sessions_day": _q("SELECT * FROM fs", *with_sessions(day, "enriched"), _BROWSED),
        "funnel_stats": _q("SELECT categoryid AS category_id, * EXCLUDE (categoryid) FROM funnel WHERE categoryid = 5 AND event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", *silver, _FUNNEL),
        "funnel_by_category": _q("SELECT categoryid, CAST(sum(views) AS BIGINT) AS views, CAST(sum(carts) AS BIGINT) AS carts, CAST(sum(purchases) AS BIGINT) AS purchases FROM funnel GROUP BY categoryid ORDER BY views DESC, categoryid LIMIT 12", *silver, _FUNNEL),
        "top_items": _q("SELECT * FROM features WHERE views >= 5 ORDER BY item_purchase_rate DESC, views DESC, itemid LIMIT 20", *silver, _LATEST, _FEATURES),
        "recommend_fallback": _q(f"SELECT *, CAST(row_number() OVER (ORDER BY score DESC, rec_item_id) AS INT) AS rank FROM ({bought}) ORDER BY rank LIMIT 20", *pair_day),
        "pipeline_health": "SELECT event_type AS task_name, ts AS started_at, event_id AS run_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
        "implicit_ratings": _q("SELECT * FROM r", _EVENTS, ratings),
        "basket_ratings": "SELECT o_custkey AS visitorid, l_partkey AS itemid, CAST(count(*) * 5 AS DOUBLE) AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
        "popular_items": _q("SELECT itemid, sum(rating) AS popularity FROM r GROUP BY itemid ORDER BY popularity DESC, itemid LIMIT 30", _EVENTS, ratings),
        "item_sequences": _q("SELECT session_id, string_agg(CAST(itemid AS VARCHAR), ',' ORDER BY timestamp, itemid) AS items FROM tagged GROUP BY session_id HAVING count(*) >= 2", _EVENTS, _tagged("ev", day)),
        "top_n_neighbors": neighbours,
        "recommend_stored": f"SELECT rec_item_id, score, rank, 'als' AS method, 'model' AS source FROM ({neighbours}) WHERE item_id = 10 AND rank <= 15",
        "time_split": _q("SELECT session_id, start_time, row_number() OVER (ORDER BY start_time, session_id) <= floor(count(*) OVER () * 0.8 + 1e-9) AS is_train FROM fs WHERE n_carts > 0", *risk),
        "classifier_metrics": _q(
            """SELECT round(CASE WHEN sum(n) FILTER (s >= 0.5) > 0 THEN sum(p) FILTER (s >= 0.5) / sum(n) FILTER (s >= 0.5) ELSE 0 END, 4) AS precision, round(sum(p) FILTER (s >= 0.5) / sum(p), 4) AS recall,
round((sum(p * (below + (n + 1) / 2)) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 4) AS auc FROM ranked""",
            *with_sessions(day, "enriched"), _BROWSED,
            "scored AS (SELECT least(round(n_views / 4.0, 6), 1.0) AS s, count(*) AS n, count(*) FILTER (abandoned) AS p FROM fs WHERE n_carts > 0 GROUP BY s)",
            "ranked AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below FROM scored)",
        ),
        "dq_not_null": _q(" UNION ALL ".join((_count("not_null", "enriched", "categoryid", "SELECT 1 FROM enriched WHERE categoryid IS NULL"), _count("not_null", "enriched", "transactionid", "SELECT 1 FROM enriched WHERE transactionid IS NULL"), _count("not_null", "tree", "parentid", "SELECT 1 FROM tree WHERE parentid IS NULL"))), *silver, _TREE),
        "dq_unique": _q(" UNION ALL ".join((_count("unique", "lineitem", "l_orderkey", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1"), _count("unique", "latest", "itemid", "SELECT itemid FROM latest GROUP BY 1 HAVING count(*) > 1"), _count("unique", "enriched", "timestamp", "SELECT timestamp FROM enriched GROUP BY 1 HAVING count(*) > 1"))), *silver, _LATEST),
        "dq_accepted_values": _q(" UNION ALL ".join((_count("accepted_values", "events", "event_type", "SELECT 1 FROM events WHERE event_type NOT IN ('view', 'addtocart', 'transaction')"), _count("accepted_values", "pairs", "pair_type", "SELECT 1 FROM pairs WHERE pair_type NOT IN ('view', 'purchase')"))), *pair_day),
        "dq_accepted_range": _q(" UNION ALL ".join((_count("accepted_range", "customer", "c_acctbal", "SELECT 1 FROM customer WHERE c_acctbal < 0"), _count("accepted_range", "pairs", "weight", "SELECT 1 FROM pairs WHERE weight < 2"))), *pair_day),
        "dq_relationships": _q(" UNION ALL ".join((_count("relationships", "latest", "categoryid", "SELECT 1 FROM latest WHERE categoryid IS NOT NULL AND categoryid NOT IN (SELECT categoryid FROM tree)"), _count("relationships", "enriched", "visitorid", "SELECT 1 FROM enriched WHERE visitorid IS NOT NULL AND visitorid NOT IN (SELECT categoryid FROM tree)"))), *silver, _LATEST, _TREE),
        "dq_freshness": """WITH h AS (SELECT event_type AS table_name, round((epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(max(ts)) // 1000) / 1000 / 3600, 6) AS age_hours FROM events GROUP BY 1)
SELECT *, CASE WHEN age_hours > 48 THEN 'error' WHEN age_hours > 26 THEN 'warn' ELSE 'pass' END AS status FROM h""",
        "dq_all": _q(" UNION ALL ".join(_all_checks()), *silver, _tagged("enriched", day), _SESSIONS, _PAIRS, _LATEST, _TREE, _FUNNEL, _FEATURES, _BROWSED, *_GOLD),
        "incremental_pairs": _q("SELECT * FROM pairs", _EVENTS, _DISTINCT, _tagged("d", 6 * 3600), _PAIRS),
        "incremental_latest": _q("SELECT * FROM latest", _PROPS, _LATEST),
        "incremental_equals_full": _q(sess, _EVENTS, _DISTINCT, _tagged("d", half), _SESSIONS),
    }
