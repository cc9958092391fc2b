"""The same queries as plain SQL over the raw tables, in correlated form.

They share no method with the library: each series value is a subquery over all events.
"""

STAGING = {
    "stg_events": """
SELECT e.event_id, e.ts, e.user_id, e.event_type,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, n.n_name AS company,
  concat('user', CAST(e.user_id AS STRING), '@example.com') AS email,
  CASE WHEN e.event_id % 20 < 7 THEN 'Web' WHEN e.event_id % 20 < 14 THEN 'Presentation'
       WHEN e.event_id % 20 < 18 THEN 'Room-and-Web' ELSE 'Multi-room-and-Web' END AS c_type,
  CASE WHEN e.event_id % 17 < 6 THEN 2 WHEN e.event_id % 17 < 12 THEN 3 WHEN e.event_id % 17 < 16 THEN 4
       ELSE 10 + CAST(e.user_id % 5 AS INT) END AS c_users,
  CASE e.user_id % 5 WHEN 0 THEN 'Mac OSX' WHEN 1 THEN 'Windows' WHEN 2 THEN 'Linux'
       WHEN 3 THEN 'ios' ELSE 'Android' END AS c_os
FROM events e
JOIN customer c ON c.c_custkey = e.user_id
JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "user_events": """
SELECT ts AS timestamp,
  CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'dialin' WHEN 'error' THEN 'support_ticket'
       WHEN 'signup' THEN 'register'
       WHEN 'purchase' THEN CASE WHEN k % 3 <> 0 THEN 'rating' ELSE 'comment' END END AS type,
  email AS "user",
  company,
  CAST(CASE WHEN event_type IN ('click', 'view') THEN k END AS BIGINT) AS call_duration,
  CASE WHEN event_type = 'click' AND k <> 0 THEN c_type END AS call_type,
  CAST(CASE WHEN event_type = 'click' THEN c_users END AS BIGINT) AS call_num_users,
  CASE WHEN event_type = 'click' AND k <> 1 THEN c_os END AS call_os,
  CAST(CASE WHEN event_type = 'purchase' AND k % 3 <> 0 THEN 1 + k % 5 END AS BIGINT) AS rating,
  CASE WHEN event_type = 'purchase' AND k % 3 = 0 AND k <> 99
       THEN concat('comment ', CAST(k AS STRING)) END AS comment,
  CASE WHEN event_type IN ('click', 'purchase') THEN CAST(event_id AS STRING) END AS session_id,
  CAST(NULL AS BIGINT) AS dialin_duration,
  CASE WHEN event_type = 'error' THEN concat(email, '-', CAST(event_id AS STRING)) END AS ticket_number,
  CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'Video' WHEN 1 THEN 'Audio' ELSE 'Network' END
       END AS ticket_driver
FROM stg_events""",
    "company_events": """
SELECT o.o_orderdate AS timestamp, 'purchased' AS type, n.n_name AS company, l.n AS purchased,
  CAST(NULL AS BIGINT) AS provisioned, CAST(NULL AS STRING) AS serial_number, CAST(NULL AS STRING) AS box_name
FROM (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
UNION ALL
SELECT l.l_shipdate, 'provisioned', n.n_name, CAST(NULL AS BIGINT), CAST(1 AS BIGINT),
  concat('A', CAST(100000 + l.l_orderkey AS STRING)), CAST(NULL AS STRING)
FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE l.l_returnflag <> 'R'""",
    "companies": "SELECT n_name AS company FROM nation",
    "user_directory": """
SELECT concat('user', CAST(c.c_custkey AS STRING), '@example.com') AS email, n.n_name AS company,
  CAST(c.c_custkey % 365 AS INT) AS "offset", CAST(c.c_custkey % 121 AS INT) AS delay_minutes
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "users": """
SELECT email, company,
  TIMESTAMP '2024-01-30 12:00:00' - to_days("offset") - to_minutes(delay_minutes) AS reg_date
FROM user_directory""",
    "call_records": """
SELECT ts AS timestamp, email AS "user", company, CAST(k AS BIGINT) AS call_duration, c_type AS call_type,
  CAST(c_users AS BIGINT) AS call_num_users, c_os AS call_os, CAST(event_id AS STRING) AS session_id,
  CAST(CASE WHEN k % 2 = 0 THEN 1 + k % 5 END AS BIGINT) AS rating,
  CASE WHEN k % 7 = 0 THEN concat('comment ', CAST(k AS STRING)) WHEN k % 7 = 1 THEN '' END AS comment,
  CAST(CASE WHEN k < 40 THEN k END AS BIGINT) AS dialin_length
FROM stg_events WHERE event_type = 'click'""",
    "purchase_records": """
SELECT n.n_name AS company, o.o_orderdate AS timestamp, o.o_orderkey AS purchase_id,
  CAST(o.o_orderkey % 16 AS INT) AS qty, CAST(2 + o.o_orderkey % 13 AS INT) AS lag_days
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "projects": """
SELECT CAST(o.o_orderkey AS STRING) AS id,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'Pilot' WHEN 1 THEN 'Pro Eval' WHEN 2 THEN 'Global Launch'
       WHEN 3 THEN 'QBR' ELSE 'Case Study' END AS name,
  n.n_name AS company, CASE WHEN o.o_orderkey % 97 <> 0 THEN o.o_orderdate END AS date
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderpriority = '1-URGENT'""",
    "renewal_inputs": """
SELECT n_name AS company, CAST(DATE '2024-01-30' + (30 + (n_nationkey * 37) % 91) AS TIMESTAMP) AS due,
  CAST(10 + (n_nationkey * 29) % 91 AS INT) AS health
FROM nation""",
    "totals": """
SELECT company,
  CAST(COALESCE(SUM(purchased) FILTER (WHERE type = 'purchased'), 0) AS BIGINT) AS purchased,
  CAST(COALESCE(SUM(provisioned) FILTER (WHERE type = 'provisioned'), 0) AS BIGINT) AS provisioned
FROM company_events WHERE type IN ('purchased', 'provisioned') GROUP BY company""",
    "renewals": """
SELECT company AS id, company, purchased * 2499 AS amount, health, due
FROM totals LEFT JOIN renewal_inputs USING (company)""",
    "event_bodies": """
SELECT event_id, ts, CASE event_id % 8
  WHEN 0 THEN '{}'
  WHEN 1 THEN concat('{"company":"', company, '","purchased":', CAST(k AS STRING), '}')
  WHEN 2 THEN concat('{"type":"purchased","purchased":', CAST(k AS STRING), '}')
  WHEN 3 THEN concat('{"type":"purchased","company":"', company, '"}')
  WHEN 4 THEN concat('{"type":"provisioned","company":"', company, '"}')
  WHEN 5 THEN concat('{"type":"purchased","company":"', company, '","purchased":', CAST(k AS STRING), '}')
  WHEN 6 THEN concat('{"type":"provisioned","company":"', company, '","provisioned":null}')
  ELSE concat('{"type":"call","user":"', email, '","company":"', company, '","call_duration":',
              CAST(k AS STRING), '}') END AS body
FROM stg_events""",
    "validated": """
SELECT event_id, body, CASE
  WHEN body IS NULL OR len(json_keys(body)) = 0 THEN 'No event data provided'
  WHEN NOT list_contains(json_keys(body), 'type') THEN 'Event type is required'
  WHEN json_extract_string(body, '$.type') IN ('purchased', 'provisioned')
    AND NOT list_contains(json_keys(body), 'company') THEN 'Company is required for company events'
  WHEN json_extract_string(body, '$.type') = 'purchased'
    AND NOT list_contains(json_keys(body), 'purchased') THEN 'Purchased field is required for purchased events'
  WHEN json_extract_string(body, '$.type') = 'provisioned'
    AND NOT list_contains(json_keys(body), 'provisioned')
    THEN 'Provisioned field is required for provisioned events' END AS error
FROM event_bodies""",
    "routed": """
SELECT event_id, body, error, CASE WHEN error IS NOT NULL THEN 'rejects'
  WHEN json_extract_string(body, '$.type') IN ('purchased', 'provisioned') THEN 'company_events'
  ELSE 'user_events' END AS target
FROM validated""",
    "numbered_boxes": """
SELECT *, row_number() OVER (PARTITION BY company ORDER BY timestamp, serial_number) AS n
FROM company_events WHERE type = 'provisioned'""",
    "breakdown": """
SELECT company, 'type' AS dimension, call_type AS key, COUNT(*) AS calls FROM recent_calls
WHERE call_type IS NOT NULL GROUP BY company, call_type
UNION ALL
SELECT company, 'users', CAST(call_num_users AS VARCHAR), COUNT(*) FROM recent_calls
WHERE call_num_users IS NOT NULL GROUP BY company, call_num_users
UNION ALL
SELECT company, 'os', call_os, COUNT(*) FROM recent_calls
WHERE call_os IS NOT NULL GROUP BY company, call_os""",
    "recent_calls": """
SELECT * FROM user_events WHERE type = 'call'
  AND timestamp >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY""",
    "ranked_comments": """
SELECT *, row_number() OVER (PARTITION BY company ORDER BY timestamp DESC, "user", comment) AS rank,
  date_diff('millisecond', date_trunc('millisecond', timestamp), TIMESTAMP '2024-01-30 12:00:00') AS age_ms
FROM user_events
WHERE type = 'comment' AND comment IS NOT NULL
  AND timestamp >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY""",
}

USER_DAY, COMPANY_DAY, SHORT_DAY = "2024-01-30", "2001-08-01", "2024-01-20"
_LABEL = "strftime(day, '%b %d') AS label"


def _needs(text: str) -> list[str]:
    """The staged tables a text reads, dependencies first."""
    found: list[str] = []

    def visit(sql: str) -> None:
        words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split())
        for name, body in STAGING.items():
            if name in words and name not in found:
                visit(body)
                found.append(name)

    visit(text)
    return list(dict.fromkeys(found))


def _with(text: str, **ctes: str) -> str:
    everything = " ".join([text, *ctes.values()])
    parts = [f"{n} AS ({STAGING[n]})" for n in _needs(everything)]
    parts += [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return f"WITH {', '.join(parts)}\n{text}" if parts else text


def _spine(day: str, days: int) -> str:
    return (
        f"SELECT company, CAST(unnest(generate_series(DATE '{day}' - {days - 1}, DATE '{day}', INTERVAL 1 DAY))"
        " AS DATE) AS day FROM companies"
    )


def _one(table: str, aggregate: str, condition: str) -> str:
    return f"(SELECT {aggregate} FROM {table} e WHERE e.company = s.company AND {condition})"


_UP_TO = "CAST(e.timestamp AS DATE) <= s.day"
_WEEK = f"CAST(e.timestamp AS DATE) >= s.day - 6 AND {_UP_TO}"


def _sum(kind: str) -> str:
    condition = f"e.type = '{kind}' AND e.{kind} IS NOT NULL AND {_UP_TO}"
    return f"CAST({_one('company_events', f'COALESCE(SUM({kind}), 0)', condition)} AS BIGINT)"


def _week_count(kind: str) -> str:
    return _one("user_events", "COUNT(*)", f"e.type = '{kind}' AND {_WEEK}")


_PURCHASED, _PROVISIONED = _sum("purchased"), _sum("provisioned")
_PCT = (
    f"CASE WHEN {_PURCHASED} > 0 THEN "
    f"ROUND(CAST({_PROVISIONED} AS DOUBLE) / CAST({_PURCHASED} AS DOUBLE) * 100, 2) END"
)
_CALLS, _DIALINS, _TICKETS = _week_count("call"), _week_count("dialin"), _week_count("support_ticket")
_REGISTERED = _one("user_events", "COUNT(*)", f"e.type = 'register' AND {_UP_TO}")
_ACTIVE = _one("user_events", 'COUNT(DISTINCT "user")', f"e.type IN ('call', 'dialin') AND {_WEEK}")
_RATED = f"e.type = 'rating' AND e.rating IS NOT NULL AND {_WEEK}"
# Two decimals of the exact binary value, ties to even.
_AVG = f"CAST(printf('%.2f', {_one('user_events', 'AVG(rating)', _RATED)}) AS DOUBLE)"
_NUM = _one("user_events", "COUNT(rating)", _RATED)


def _series(values: str, day: str, days: int = 30) -> str:
    return _with(f"SELECT s.company, s.day, {values}, {_LABEL} FROM spine s", spine=_spine(day, days))


def _ratings(day: str, days: int = 30) -> str:
    return _series(f"{_AVG} AS avg_rating, {_NUM} AS num_rating", day, days)


_RATINGS_CTES = {
    "spine": _spine(USER_DAY, 30),
    "rating_series": f"SELECT s.company, s.day, {_AVG} AS avg_rating, {_NUM} AS num_rating FROM spine s",
    "rating_head": (
        "SELECT c.company, r.avg_rating, r.num_rating FROM companies c LEFT JOIN rating_series r "
        "ON r.company = c.company AND r.day = (SELECT MAX(day) FROM rating_series x "
        "WHERE x.company = c.company AND x.avg_rating IS NOT NULL)"
    ),
}
_HEADLINES = {
    "user_day": _spine(USER_DAY, 1),
    "company_day": _spine(COMPANY_DAY, 1),
    "user_head": (
        f"SELECT s.company, {_CALLS} AS calls, {_DIALINS} AS dialins, {_TICKETS} AS support_tickets, "
        f"{_REGISTERED} AS total_registered, {_ACTIVE} AS sdau FROM user_day s"
    ),
    "company_head": (
        f"SELECT s.company, {_PURCHASED} AS total_purchased, {_PROVISIONED} AS total_provisioned, "
        f"{_PCT} AS pct_provisioned FROM company_day s"
    ),
}

_BOUGHT = (
    "SELECT c.company, CAST(COALESCE((SELECT SUM(purchased) FROM company_events e "
    "WHERE e.company = c.company AND e.type = 'purchased' AND e.purchased IS NOT NULL), 0) AS BIGINT) AS purchased "
    "FROM companies c"
)
_OVERVIEW = "SELECT company, purchased, purchased * 2499 AS acv, '$' || format('{:,}', purchased * 2499) || '.00' AS acv_text FROM bought"

_EVENT_NULLS = {
    "call_duration": "BIGINT", "call_type": "VARCHAR", "call_num_users": "BIGINT", "call_os": "VARCHAR",
    "rating": "BIGINT", "comment": "VARCHAR", "session_id": "VARCHAR", "dialin_duration": "BIGINT",
    "ticket_number": "VARCHAR", "ticket_driver": "VARCHAR",
}


def _event(kind: str, source: str, condition: str = "TRUE", timestamp: str = "timestamp", **given: str) -> str:
    columns = [f"{given.get(n, 'NULL')}::{t} AS {n}" for n, t in _EVENT_NULLS.items()]
    return (
        f"SELECT {timestamp} AS timestamp, '{kind}' AS type, \"user\", company, {', '.join(columns)} "
        f"FROM {source} WHERE {condition}"
    )


_FAN_OUT = " UNION ALL ".join(
    [
        _event("call", "call_records", call_duration="call_duration", call_type="call_type",
               call_num_users="call_num_users", call_os="call_os", session_id="session_id"),
        _event("load", "call_records", timestamp="timestamp - INTERVAL 1 MINUTE"),
        _event("rating", "call_records", "rating IS NOT NULL AND rating <> 0", rating="rating",
               session_id="session_id"),
        _event("comment", "call_records", "comment IS NOT NULL AND comment <> ''", comment="comment",
               session_id="session_id"),
        _event("dialin", "call_records", "dialin_length IS NOT NULL AND dialin_length <> 0",
               call_duration="dialin_length"),
    ]
)

_NORMALISED = " UNION ALL ".join(
    [
        _event("register", "user_events", "type = 'register'"),
        _event("support_ticket", "user_events", "type = 'support_ticket'", ticket_number="ticket_number",
               ticket_driver="ticket_driver"),
        _event("rating", "user_events", "type = 'rating'", rating="rating", session_id="session_id"),
        _event("call", "user_events", "type = 'call'", call_duration="call_duration", call_type="call_type",
               call_num_users="call_num_users", call_os="call_os", session_id="session_id"),
        _event("dialin", "user_events", "type = 'dialin'", call_duration="call_duration", session_id="session_id"),
        _event("comment", "user_events", "type = 'comment'", comment="comment", session_id="session_id"),
    ]
)

_TREND = (
    "SELECT s.company || ':7DAU:' || CAST(s.day AS VARCHAR) AS id, '7DAU' AS metric, s.company, "
    f"CAST({_ACTIVE} AS DOUBLE) AS value, CAST(s.day AS TIMESTAMP) AS date FROM days s UNION ALL "
    "SELECT s.company || ':CPW:' || CAST(s.day AS VARCHAR), 'CPW', s.company, "
    f"CAST({_CALLS} AS DOUBLE), CAST(s.day AS TIMESTAMP) FROM days s"
)
_TREND_DAYS = (
    f"SELECT company, DATE '{USER_DAY}' - n AS day FROM companies, (VALUES (0), (7), (14), (21), (28)) v(n)"
)

_COMMENTS = """
SELECT company, rank, CAST(timestamp AS DATE) AS comment_date, "user", comment, timestamp,
  CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS posted_at,
  split_part("user", '@', 1) AS user_name,
  CASE WHEN split_part("user", '@', 1) = '' THEN '?' ELSE upper(left("user", 1)) END AS user_initial,
  CASE WHEN age_ms >= 86400000 THEN CAST(age_ms // 86400000 AS VARCHAR) || 'd ago'
       WHEN age_ms >= 3600000 THEN CAST(age_ms // 3600000 AS VARCHAR) || 'h ago'
       ELSE 'Just now' END AS age,
  rank <= 3 AS recent
FROM ranked_comments WHERE rank <= 50"""

_STATUS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS total_documents, COUNT(*) AS real_documents, "
    f"FALSE AS has_placeholder FROM {t}"
    for t in ("company_events", "companies", "projects", "user_events")
) + (
    " UNION ALL SELECT 'renewals', COUNT(*), COUNT(*), FALSE FROM renewal_inputs"
    " UNION ALL SELECT 'users', COUNT(*), COUNT(*), FALSE FROM user_directory"
)

_DISPLAY = """
SELECT timestamp, "user", strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS datetime_text,
  CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS iso_text,
  strftime(timestamp, '%b %d') AS day_label, strftime(timestamp, '%m/%d') AS short_date,
  split_part("user", '@', 1) AS user_name, upper(left("user", 1)) AS user_initial,
  format('{:,}', call_duration * 2499) AS thousands,
  CASE WHEN call_duration IS NULL OR call_duration = 0 THEN 'TBD'
       ELSE '$' || format('{:,}', call_duration * 2499) END AS money,
  '$' || format('{:,}', call_duration * 2499) || '.00' AS money_cents,
  CASE WHEN rating IS NULL OR rating = 0 THEN '0%' ELSE printf('%.1f%%', rating * 1001 / 16.0::DOUBLE) END AS percent,
  CAST(printf('%.2f', rating * 1001 / 16.0::DOUBLE) AS DOUBLE) AS rounded
FROM user_events"""

_UPDATED_COMPANIES = (
    "SELECT c.name AS id, c.name, earliest_reg, COALESCE(t.purchased, 0) AS boxes_bought, "
    "COALESCE(t.provisioned, 0) AS boxes_prov FROM (SELECT company AS name, MIN(reg_date) AS earliest_reg "
    "FROM users GROUP BY company) c LEFT JOIN totals t ON t.company = c.name"
)

_DIRECTORY = 'SELECT email, company, "offset" FROM user_directory ORDER BY email'


def oracle_sql() -> dict[str, str]:
    texts = {
        "stg_user_events": _with("SELECT * FROM user_events"),
        "stg_company_events": _with("SELECT * FROM company_events"),
        "calendar_spine": _with("SELECT * FROM spine", spine=_spine(USER_DAY, 30)),
        "calls_count_7d_window_30d": _series(f"{_CALLS} AS calls", USER_DAY),
        "dialin_count_7d_window_30d": _series(f"{_DIALINS} AS dialins", USER_DAY),
        "support_tickets_7d_window_30d": _series(f"{_TICKETS} AS support_tickets", USER_DAY),
        "users_registered_cumulative_30d": _series(f"{_REGISTERED} AS total_registered", USER_DAY),
        "boxes_purchased_cumulative_30d": _series(f"{_PURCHASED} AS total_purchased", COMPANY_DAY),
        "boxes_provisioned_cumulative_30d": _series(f"{_PROVISIONED} AS total_provisioned", COMPANY_DAY),
        "boxes_provisioned_pct_cumulative_30d": _series(f"{_PCT} AS pct_provisioned", COMPANY_DAY),
        "ratings_average_7d_window_30d": _ratings(USER_DAY),
        "users_active_7d_window_30d": _series(f"{_ACTIVE} AS sdau", USER_DAY),
        "headline_ratings": _with("SELECT * FROM rating_head", **_RATINGS_CTES),
        "headline_values": _with(
            "SELECT * FROM user_head JOIN company_head USING (company)", **_HEADLINES
        ),
        "calls_count_short_spine": _series(f"{_CALLS} AS calls", SHORT_DAY, 10),
        "users_active_short_spine": _series(f"{_ACTIVE} AS sdau", SHORT_DAY, 10),
        "ratings_average_short_spine": _ratings(SHORT_DAY, 10),
        "users_registered_short_spine": _series(f"{_REGISTERED} AS total_registered", SHORT_DAY, 10),
        "users_active_long_spine": _series(f"{_ACTIVE} AS sdau", USER_DAY, 90),
        "calls_breakdown_7d": _with("SELECT company, dimension, key, calls FROM breakdown"),
        "comments_recent_7d": _with(_COMMENTS),
        "customer_overview": _with(_OVERVIEW, bought=_BOUGHT),
        "single_company_card": _with(
            f"SELECT s.company, s.day, {_CALLS} AS calls, {_LABEL} FROM spine s WHERE s.company = 'NATION_3'",
            spine=_spine(USER_DAY, 30),
        ),
        "company_scorecard": _with(
            "SELECT company, purchased, purchased * 2499 AS acv, total_purchased, pct_provisioned, avg_rating, "
            "num_rating, total_provisioned, sdau, dialins, total_registered, calls, support_tickets "
            "FROM bought JOIN user_head USING (company) JOIN company_head USING (company) "
            "JOIN rating_head USING (company)",
            **_HEADLINES,
            **_RATINGS_CTES,
            bought=_BOUGHT,
        ),
        "fan_out_calls": _with(_FAN_OUT),
        "provision_devices": _with(
            "SELECT timestamp + to_days(lag_days) AS timestamp, 'provisioned' AS type, company, "
            "CAST(NULL AS BIGINT) AS purchased, CAST(1 AS BIGINT) AS provisioned, "
            "'A' || CAST(purchase_id AS VARCHAR) || '-' || CAST(unit AS VARCHAR) AS serial_number, "
            "CAST(NULL AS VARCHAR) AS box_name "
            "FROM (SELECT *, unnest(generate_series(1, qty)) AS unit FROM purchase_records)"
        ),
        "name_boxes": _with(
            "SELECT timestamp, type, company, purchased, provisioned, serial_number, company || '.room.' || "
            "CASE WHEN n < 10 THEN '0' ELSE '' END || CAST(n AS VARCHAR) AS box_name FROM numbered_boxes"
        ),
        "enrich_users": _with("SELECT * FROM users"),
        "build_companies": _with(
            "SELECT company AS name, MIN(reg_date) AS earliest_reg, CAST(0 AS BIGINT) AS boxes_bought, "
            "CAST(0 AS BIGINT) AS boxes_prov FROM users GROUP BY company"
        ),
        "registration_events": _with(
            _event("register", "regs"),
            regs='SELECT email AS "user", company, reg_date AS timestamp FROM users',
        ),
        "number_tickets": _with(
            "SELECT * REPLACE (\"user\" || '-' || CAST((SELECT COUNT(*) FROM user_events x "
            "WHERE x.type = 'support_ticket' AND x.\"user\" = t.\"user\" AND x.timestamp < t.timestamp) AS VARCHAR) "
            "AS ticket_number) FROM user_events t WHERE type = 'support_ticket'"
        ),
        "company_totals": _with("SELECT * FROM totals"),
        "build_renewals": _with("SELECT * FROM renewals"),
        "trending_snapshot": _with(_TREND, days=_TREND_DAYS),
        "clamp_future": _with(
            "SELECT * REPLACE (CASE WHEN timestamp > TIMESTAMP '2024-01-30 12:00:00' "
            "THEN TIMESTAMP '2024-01-30 12:00:00' ELSE timestamp END AS timestamp) FROM user_events"
        ),
        "normalise_events": _with(_NORMALISED),
        "home_projects": _with(
            "SELECT *, strftime(date, '%m/%d') AS formatted_date FROM projects WHERE date IS NOT NULL "
            "ORDER BY date, id LIMIT 3"
        ),
        "home_renewals": _with(
            "SELECT *, strftime(due, '%m/%d') AS formatted_date, CASE WHEN amount IS NULL OR amount = 0 "
            "THEN 'TBD' ELSE '$' || format('{:,}', amount) END AS formatted_amount FROM renewals "
            "WHERE due IS NOT NULL ORDER BY due, id LIMIT 3"
        ),
        "home_trends": _with(
            "SELECT *, strftime(date, '%m/%d') AS formatted_date, CASE WHEN value IS NULL OR value = 0 THEN '0%' "
            "ELSE printf('%.1f%%', value) END AS change FROM trends ORDER BY date DESC, id LIMIT 3",
            days=_TREND_DAYS,
            trends=_TREND,
        ),
        "update_by_field": _with(_UPDATED_COMPANIES),
        "update_by_field_unmatched": _with(
            "SELECT email, company FROM user_directory d WHERE NOT EXISTS (SELECT 1 FROM user_events e "
            "WHERE e.type = 'register' AND e.\"user\" = d.email)"
        ),
        "append_events": _with("SELECT *, CAST(timestamp AS DATE) AS event_date FROM user_events"),
        "replace_collection": _with("SELECT * FROM users"),
        "rewrite_collection": _with(_UPDATED_COMPANIES),
        "truncate_table": _with(
            "SELECT COUNT(*) AS appended, CAST(0 AS BIGINT) AS remaining FROM user_events"
        ),
        "clear_collection": _with("SELECT COUNT(*) AS deleted, CAST(0 AS BIGINT) AS remaining FROM users"),
        "display_texts": _with(_DISPLAY),
        "upsert_by_id": _with(
            "SELECT COALESCE(s.id, d.email) AS id, CASE WHEN d.email IS NULL THEN s.company "
            "WHEN d.\"offset\" <> 0 THEN d.company END AS company, s.reg_date, d.email "
            "FROM (SELECT \"user\" AS id, MAX(company) AS company, MIN(timestamp) AS reg_date FROM user_events "
            "WHERE type = 'register' GROUP BY \"user\") s FULL OUTER JOIN user_directory d ON d.email = s.id"
        ),
        "user_directory": _with(_DIRECTORY),
        "user_directory_first_100": _with(f"{_DIRECTORY} LIMIT 100"),
        "table_status": _with(_STATUS),
        "validate_events": _with("SELECT * FROM validated"),
        "route_events": _with("SELECT event_id, error, target FROM routed"),
        "ingested_user_events": _with(
            _event("call", "raw", "target = 'user_events'", "CAST(NULL AS TIMESTAMP)",
                   call_duration="json_extract_string(body, '$.call_duration')"),
            raw="SELECT *, json_extract_string(body, '$.user') AS \"user\", "
                "json_extract_string(body, '$.company') AS company FROM routed",
        ),
        "ingest_stream": _with(
            "SELECT json_extract_string(body, '$.type') AS type, json_extract_string(body, '$.user') AS \"user\", "
            "json_extract_string(body, '$.company') AS company, "
            "CAST(json_extract_string(body, '$.call_duration') AS BIGINT) AS call_duration, "
            "CAST(json_extract_string(body, '$.purchased') AS BIGINT) AS purchased, "
            "CAST(json_extract_string(body, '$.provisioned') AS BIGINT) AS provisioned "
            "FROM routed WHERE target <> 'rejects'"
        ),
        "company_totals_stream": _with(
            "SELECT json_extract_string(body, '$.company') AS company, "
            "CAST(SUM(CASE WHEN json_extract_string(body, '$.type') = 'purchased' "
            "THEN COALESCE(CAST(json_extract_string(body, '$.purchased') AS BIGINT), 0) ELSE 0 END) AS BIGINT) "
            "AS boxes_bought, "
            "CAST(SUM(CASE WHEN json_extract_string(body, '$.type') = 'provisioned' "
            "THEN COALESCE(CAST(json_extract_string(body, '$.provisioned') AS BIGINT), 0) ELSE 0 END) AS BIGINT) "
            "AS boxes_prov "
            "FROM routed WHERE target = 'company_events' GROUP BY 1"
        ),
    }
    clamped = (
        "SELECT * REPLACE (LEAST(timestamp, TIMESTAMP '2024-01-30 12:00:00') AS timestamp) FROM call_records"
    )
    counts = {
        "company_events": "SELECT COUNT(*) + SUM(qty) FROM purchase_records",
        "companies": "SELECT COUNT(DISTINCT company) FROM user_directory",
        "projects": "SELECT COUNT(*) FROM projects",
        "renewals": "SELECT COUNT(DISTINCT company) FROM purchase_records",
        "trending": "SELECT 10 * COUNT(DISTINCT company) FROM user_directory",
        "user_events": "SELECT (SELECT COUNT(*) FROM users) "
        "+ (SELECT COUNT(*) FROM user_events WHERE type = 'support_ticket') "
        "+ (SELECT 2 * COUNT(*) + COUNT(NULLIF(rating, 0)) + COUNT(NULLIF(comment, '')) + COUNT(NULLIF(dialin_length, 0)) FROM clamped)",
        "users": "SELECT COUNT(*) FROM users",
    }
    texts |= {
        "calls_count_in_order": _with(
            f"SELECT s.company, s.day, {_CALLS} AS calls, row_number() OVER (PARTITION BY s.company ORDER BY s.day) AS position FROM spine s",
            spine=_spine(USER_DAY, 30),
        ),
        "calls_breakdown_in_order": _with(
            "SELECT company, dimension, key, calls, row_number() OVER (PARTITION BY company, dimension ORDER BY "
            "CASE WHEN dimension = 'users' THEN CAST(key AS BIGINT) ELSE -calls END, key) AS position FROM breakdown"
        ),
        "project_dates": _with(
            "SELECT id, company, COALESCE(strftime(date, '%m/%d'), CASE WHEN CAST(id AS BIGINT) % 2 = 0 "
            "THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(CAST(id AS BIGINT) % 300 AS INT)), '%m/%d') END, 'No date') "
            "AS formatted_date FROM projects"
        ),
        "ingest_whole_bodies": _with(
            "SELECT *, CAST(timestamp AS DATE) AS event_date FROM user_events UNION ALL BY NAME "
            "SELECT *, CAST(timestamp AS DATE) AS event_date FROM company_events"
        ),
        "ingest_rejects": _with("SELECT body, error FROM routed WHERE target = 'rejects'"),
        "replayed_rejects": _with(
            "SELECT json_extract_string(body, '$.type') AS type, json_extract_string(body, '$.company') AS company, "
            "CAST(json_extract_string(body, '$.purchased') AS BIGINT) AS purchased, CAST(NULL AS VARCHAR) AS error "
            "FROM routed WHERE target = 'company_events' "
            "UNION ALL SELECT 'purchased', json_extract_string(body, '$.company'), "
            "CAST(json_extract_string(body, '$.purchased') AS BIGINT), NULL FROM routed WHERE error = 'Event type is required' "
            "UNION ALL SELECT NULL, NULL, NULL, error FROM routed "
            "WHERE target = 'rejects' AND error <> 'Event type is required'"
        ),
        "reload_counts": _with(
            " UNION ALL ".join(f"SELECT '{name}' AS table_name, CAST(({text}) AS BIGINT) AS rows" for name, text in counts.items()),
            clamped=clamped,
        ),
        "compacted_events": texts["append_events"],
        "merge_collection": texts["upsert_by_id"],
    }
    # Where a table is kept changes nothing in what is asked of it.
    stored = {
        "stored_scorecard": "company_scorecard",
        "stored_boxes_provisioned_pct": "boxes_provisioned_pct_cumulative_30d",
        "stored_users_active": "users_active_7d_window_30d",
        "stored_comments": "comments_recent_7d",
    }
    return texts | {name: texts[plain] for name, plain in stored.items()}
