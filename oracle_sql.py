"""DuckDB oracle SQL for every query in ``__spark_entry__.queries()``.

Written independently of the Spark code, in the application's own SQL
style (joins with fan-out, correlated subqueries, COUNT(DISTINCT)). The CTEs
in ``FIXTURE`` map the driver's test tables (pre-registered views) onto the
eight logical tables and the request logs, as documented in FIXTURES.md. The
logical ``orders`` table is called ``shop_orders`` here because ``orders`` is
the test table it is built from.
"""

from __future__ import annotations

from coffer.sources.fixtures import DAMAGE

FIXTURE = r"""
WITH
users AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS username,
         CASE WHEN c_custkey = 0 THEN 'admin' WHEN c_custkey % 40 = 7 THEN 'team_leader' ELSE 'participant' END AS role,
         CASE WHEN c_custkey = 0 OR c_custkey % 10 = 9 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS team_id,
         CAST(floor(c_acctbal) AS BIGINT) AS balance,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey % 1000 AS BIGINT)) AS created_at
  FROM customer),
teams AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS id, n.n_name AS name,
         CASE WHEN n.n_nationkey % 5 <> 0 THEN
           (SELECT min(l.id) FROM users l WHERE l.role = 'team_leader' AND l.team_id = n.n_nationkey) END AS leader_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(n.n_nationkey AS BIGINT)) AS created_at
  FROM nation n),
products AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS description,
         CAST(floor(p_retailprice / 10) AS BIGINT) AS price,
         p_type AS category,
         CAST(CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_partkey % 97 = 5 THEN NULL ELSE p_size END AS BIGINT) AS stock_quantity,
         CAST(p_size AS BIGINT) AS initial_stock,
         p_partkey % 11 <> 0 AS is_active,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey % 500 AS BIGINT)) AS created_at
  FROM part),
ev AS (
  SELECT event_id, user_id, ts, CAST(floor(value * 10) AS BIGINT) AS v,
         CASE event_type WHEN 'signup' THEN 'earn' WHEN 'purchase' THEN 'purchase' WHEN 'click' THEN 'donation_sent'
              WHEN 'view' THEN 'donation_received' WHEN 'error' THEN 'admin_adjustment' END AS type
  FROM events),
transactions AS (
  SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS user_id, type,
         CAST(CASE WHEN type = 'earn' THEN v WHEN type IN ('purchase', 'donation_sent') THEN -v
                   WHEN type = 'donation_received' THEN 0 WHEN event_id % 2 = 0 THEN v ELSE -v END AS BIGINT) AS amount,
         CASE WHEN type = 'earn' THEN 'Redeemed code: RC' || CAST(event_id % 1000 AS VARCHAR)
              ELSE (CASE WHEN event_id % 20 = 0 THEN 'Test ' ELSE '' END) || type || ' ' || CAST(event_id AS VARCHAR)
         END AS description,
         CASE WHEN type <> 'earn' THEN CAST(event_id AS BIGINT) END AS reference_id,
         ts AS created_at
  FROM ev),
store_lines AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)) AS id,
         CAST(o_custkey AS BIGINT) AS user_id, CAST(l_partkey AS BIGINT) AS product_id, l_suppkey,
         CAST(floor(l_quantity / 10) + 1 AS BIGINT) AS quantity, l_returnflag, l_linenumber, o_orderstatus,
         o_orderpriority, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
shop_orders AS (
  SELECT s.id, s.user_id, u.team_id, s.product_id, s.quantity, p.price * s.quantity AS total_price,
         CASE s.o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'cancelled' END AS status,
         s.o_orderstatus = 'F' AS verified, s.created_at
  FROM store_lines s JOIN users u ON u.id = s.user_id JOIN products p ON p.id = s.product_id
  WHERE s.l_returnflag <> 'R' AND u.team_id IS NOT NULL),
donations AS (
  SELECT s.id, s.user_id AS donor_id,
         (SELECT min(l.id) FROM users l WHERE l.role = 'team_leader' AND l.team_id = sp.s_nationkey) AS recipient_id,
         u.team_id AS donor_team_id, CAST(sp.s_nationkey AS BIGINT) AS recipient_team_id, s.product_id,
         p.price * s.quantity AS amount, s.quantity,
         CASE WHEN s.l_linenumber = 1 THEN '' ELSE s.o_orderpriority END AS message, s.created_at
  FROM store_lines s JOIN supplier sp ON sp.s_suppkey = s.l_suppkey JOIN users u ON u.id = s.user_id
       JOIN products p ON p.id = s.product_id
  WHERE s.l_returnflag = 'R' AND sp.s_nationkey <> u.team_id),
inv_events AS (
  SELECT team_id, product_id, quantity, 'purchase' AS kind, id AS reference_id, created_at, id AS event_id
  FROM shop_orders
  UNION ALL
  SELECT recipient_team_id, product_id, quantity, 'donation', '0', created_at, id FROM donations),
team_inventory AS (
  SELECT CAST(team_id AS VARCHAR) || ':' || CAST(product_id AS VARCHAR) AS id, team_id, product_id,
         CAST(sum(quantity) AS BIGINT) AS quantity,
         CASE WHEN bool_or(kind = 'donation') THEN 'donation' ELSE 'purchase' END AS obtained_from,
         first(reference_id ORDER BY created_at DESC, event_id DESC) AS reference_id,
         max(created_at) AS created_at
  FROM inv_events GROUP BY team_id, product_id),
money_codes AS (
  SELECT n AS id, 'RC' || CAST(n AS VARCHAR) AS code, CAST(100 + (n % 50) * 10 AS BIGINT) AS amount,
         CASE WHEN n % 7 = 0 THEN min(user_id) END AS used_by,
         CASE WHEN n % 7 = 0 THEN min(created_at) END AS used_at,
         min(created_at) AS created_at
  FROM (SELECT id % 1000 AS n, user_id, created_at FROM transactions WHERE type = 'earn') GROUP BY n),
redemption_requests AS (
  SELECT CAST(event_id AS BIGINT) AS request_id, CAST(user_id AS BIGINT) AS user_id,
         'RC' || CAST(event_id % 1000 AS VARCHAR) AS code, ts AS requested_at
  FROM events WHERE event_type = 'signup'),
store_requests AS (
  SELECT s.id AS request_id, s.user_id, CASE WHEN s.l_returnflag = 'R' THEN 'donate' ELSE 'purchase' END AS kind,
         CASE WHEN s.l_returnflag = 'R' THEN CAST(sp.s_nationkey AS BIGINT) END AS recipient_team_id,
         s.product_id, s.quantity, CASE WHEN s.l_linenumber = 1 THEN '' ELSE s.o_orderpriority END AS message,
         s.created_at AS requested_at
  FROM store_lines s JOIN supplier sp ON sp.s_suppkey = s.l_suppkey),
stock_adjustments AS (
  SELECT CAST(event_id AS BIGINT) AS request_id, CAST(user_id AS BIGINT) AS product_id,
         CASE WHEN event_id % 4 = 0 THEN 'set' ELSE 'adjust' END AS type,
         CAST(event_id % 41 - 15 AS BIGINT) AS adjustment, ts AS requested_at
  FROM events WHERE event_type = 'error'),
leader_requests AS (
  SELECT CAST(e.event_id AS BIGINT) AS request_id, CAST(e.user_id AS BIGINT) AS leader_id, u.team_id,
         e.ts AS requested_at
  FROM events e LEFT JOIN users u ON u.id = e.user_id WHERE e.event_type = 'view'),
product_edits AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, p_brand AS description, p_type AS category,
         CAST(floor(p_retailprice / 10) + 1 AS BIGINT) AS price,
         CAST(CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size END AS BIGINT) AS stock_quantity, CAST(0 AS BIGINT) AS request_id,
         TIMESTAMP '2024-01-01 00:00:00' AS edited_at
  FROM part WHERE p_partkey % 13 = 0
  UNION ALL
  SELECT CAST(user_id AS BIGINT), CASE WHEN event_id % 23 = 1 THEN '' ELSE 'edited ' || CAST(event_id % 50 AS VARCHAR) END,
         CASE WHEN event_id % 3 <> 0 THEN 'text' END, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'goods' END,
         CAST(event_id % 90 - 5 AS BIGINT), CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 60 - 4 END AS BIGINT), CAST(event_id AS BIGINT), ts
  FROM events WHERE event_type = 'signup'),
user_requests AS (
  SELECT CAST(event_id AS BIGINT) AS request_id, CASE WHEN event_id % 25 <> 0 THEN CAST(e.user_id AS BIGINT) END AS user_id,
         CASE WHEN event_id % 41 = 3 THEN '' WHEN event_id % 25 = 0 THEN 'new' || CAST(event_id % 1000 AS VARCHAR)
              WHEN event_id % 10 = 1 THEN 'alias' || CAST(event_id % 130 AS VARCHAR) ELSE coalesce(u.username, 'nobody') END AS username,
         CASE WHEN event_id % 67 = 5 THEN 'owner' WHEN event_id % 3 = 0 THEN 'team_leader' WHEN event_id % 97 = 2 THEN 'admin'
              ELSE 'participant' END AS role,
         CAST(CASE WHEN event_id % 83 = 1 THEN 999 WHEN event_id % 11 = 4 THEN NULL WHEN event_id % 4 = 1 THEN event_id % 25
                   ELSE u.team_id END AS BIGINT) AS team_id,
         CAST(CASE WHEN event_id % 4 = 2 THEN event_id % 500 - 50 END AS BIGINT) AS balance, e.ts AS requested_at
  FROM events e LEFT JOIN users u ON u.id = e.user_id WHERE event_type = 'click'),
new_users AS (
  SELECT id, username, role, team_id, balance + ((id % 3) - 1) * 50 AS balance, created_at FROM users)
"""


def _q(body: str) -> str:
    return FIXTURE + body


RANKING_BASE = r"""
, flows AS (
  SELECT user_id, sum(greatest(amount, 0)) FILTER (type = 'earn') + coalesce(sum(least(amount, 0)) FILTER (type = 'earn'), 0) AS got,
         sum(abs(amount)) FILTER (type = 'purchase') AS bought, sum(abs(amount)) FILTER (type = 'donation_sent') AS gave
  FROM transactions GROUP BY user_id),
of_team AS (
  SELECT u.team_id, count(*) AS heads, sum(f.got) AS got, sum(f.bought) AS bought, sum(f.gave) AS gave
  FROM flows f RIGHT JOIN users u ON f.user_id = u.id WHERE u.team_id IS NOT NULL GROUP BY u.team_id),
totals AS (
  SELECT teams.id, teams.name AS team_name, coalesce(heads, 0)::BIGINT AS member_count, coalesce(got, 0)::BIGINT AS total_earned,
         (coalesce(bought, 0) + coalesce(gave, 0))::BIGINT AS total_spent, coalesce(gave, 0)::BIGINT AS total_donated
  FROM of_team RIGHT JOIN teams ON of_team.team_id = teams.id),
scored AS (
  SELECT totals.*, total_earned - total_spent AS current_balance,
         coalesce(round(100.0::DOUBLE * (total_donated::DOUBLE / nullif(greatest(total_earned, 0), 0)::DOUBLE)), 0)::BIGINT AS donation_score
  FROM totals)
"""

ORACLE: dict[str, str] = {}

ORACLE["team_rankings"] = _q(RANKING_BASE + r"""
, ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY donation_score DESC, team_name, id) AS BIGINT) AS position
             FROM scored)
SELECT id, team_name, member_count, total_earned, total_spent, total_donated, current_balance, donation_score,
       position, CASE position WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal,
       least(donation_score, 100) AS progress
FROM ranked
""")

ORACLE["team_rankings_pct"] = _q(RANKING_BASE + r"""
SELECT id, team_name, member_count, total_earned, total_donated, total_spent,
       current_balance AS calculated_balance,
       CASE WHEN total_earned > 0
            THEN CAST((total_donated * 20000 + total_earned) // (2 * total_earned) AS DOUBLE) / 100
            ELSE 0 END AS donation_score_percent
FROM scored
""")

ORACLE["ranking_explain"] = _q(RANKING_BASE + r"""
SELECT id, team_name, member_count, total_earned, total_spent, total_donated, current_balance,
       '(' || CAST(total_donated AS VARCHAR) || ' / ' || CAST(total_earned AS VARCHAR) || ') * 100' AS formula,
       donation_score AS result
FROM scored
""")

STOCK_STATUS = ("CASE WHEN COALESCE(stock_quantity, 0) <= 0 THEN 'sold_out' "
                "WHEN COALESCE(stock_quantity, 0) <= 5 THEN 'low' ELSE 'in_stock' END")
FMT = "'%d/%m/%y %H:%M:%S'"

ORACLE["scan_products"] = _q(f"SELECT *, {STOCK_STATUS} AS stock_status FROM products")
ORACLE["user_ledger"] = _q("SELECT * FROM transactions")
ORACLE["table_counts"] = _q(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {src}"
    for t, src in [("users", "users"), ("teams", "teams"), ("products", "products"), ("orders", "shop_orders"),
                   ("transactions", "transactions"), ("money_codes", "money_codes"),
                   ("team_inventory", "team_inventory"), ("donations", "donations")]))
ORACLE["user_directory"] = _q("""
SELECT u.*, t.name AS team_name, COALESCE(t.name, 'Unassigned') AS team_label, replace(u.role, '_', ' ') AS role_label
FROM users u LEFT JOIN teams t ON u.team_id = t.id""")
ORACLE["team_leaders"] = _q("""
SELECT t.id, t.name, t.leader_id, u.username AS leader_name, u.role AS leader_role
FROM teams t LEFT JOIN users u ON t.leader_id = u.id""")
ORACLE["team_directory"] = _q("""
SELECT t.id, t.name, t.leader_id, t.created_at, u.username AS leader_name,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM users m WHERE m.team_id = t.id) AS member_count,
       COALESCE(u.username, 'No leader assigned') AS leader_label
FROM teams t LEFT JOIN users u ON t.leader_id = u.id""")
ORACLE["team_list"] = _q("SELECT id, name FROM teams")
ORACLE["team_members"] = _q("""
SELECT u.team_id, u.id, u.username, u.role, u.balance, COALESCE(t.leader_id = u.id, false) AS is_leader
FROM users u LEFT JOIN teams t ON t.id = u.team_id WHERE u.team_id IS NOT NULL""")
ORACLE["users_by_role"] = _q("SELECT role, CAST(COUNT(*) AS BIGINT) AS count FROM users GROUP BY role")
ORACLE["ledger_type_counts"] = _q("""
SELECT CAST(COUNT(*) AS BIGINT) AS total_transactions,
       CAST(COUNT(CASE WHEN type = 'earn' THEN 1 END) AS BIGINT) AS earn_count,
       CAST(COUNT(CASE WHEN type = 'donation_sent' THEN 1 END) AS BIGINT) AS donation_sent_count,
       CAST(COUNT(CASE WHEN type = 'purchase' THEN 1 END) AS BIGINT) AS purchase_count
FROM transactions""")
ORACLE["deletable_users"] = _q("""
SELECT id, username, role,
       CASE WHEN role = 'admin' THEN 'admin'
            WHEN EXISTS (SELECT 1 FROM transactions tr WHERE tr.user_id = u.id) THEN 'has_transactions' END AS reason,
       role <> 'admin' AND NOT EXISTS (SELECT 1 FROM transactions tr WHERE tr.user_id = u.id) AS can_delete
FROM users u""")
ORACLE["code_listing"] = _q(f"""
SELECT mc.*, u.username AS used_by_username,
       CASE WHEN mc.used_by IS NOT NULL THEN 'Used' ELSE 'Available' END AS status,
       COALESCE(u.username, '-') AS used_by_label,
       strftime(mc.created_at, {FMT}) AS created_text,
       COALESCE(strftime(mc.used_at, {FMT}), '-') AS used_text
FROM money_codes mc LEFT JOIN users u ON mc.used_by = u.id""")
ORACLE["available_codes"] = _q("SELECT * FROM money_codes WHERE used_by IS NULL")
ORACLE["store_catalog"] = _q(f"""
SELECT id, name, description, price, category, COALESCE(stock_quantity, 0) AS stock_quantity, is_active, created_at,
       {STOCK_STATUS} AS stock_status
FROM products WHERE is_active = true""")
ORACLE["catalog_categories"] = _q("SELECT DISTINCT category FROM products WHERE is_active = true")
ORACLE["donatable_products"] = _q("""
SELECT id, name, price, stock_quantity, category FROM products WHERE is_active = true AND stock_quantity > 0""")
ORACLE["stock_status"] = _q(f"""
SELECT id, name, is_active, stock_quantity, COALESCE(stock_quantity, 0) AS stock_shown, {STOCK_STATUS} AS stock_status
FROM products""")
ORACLE["test_ledger_rows"] = _q(r"""
SELECT u.team_id, t.name AS team_name, u.username AS leader_name, tr.id AS transaction_id, tr.type, tr.amount,
       tr.description, tr.created_at
FROM transactions tr JOIN users u ON tr.user_id = u.id JOIN teams t ON u.team_id = t.id
WHERE tr.description LIKE 'Test%'
   OR tr.user_id IN (SELECT id FROM users WHERE username LIKE 'test_%')""")
ORACLE["team_finance"] = _q("""
, fin AS (
  SELECT u.team_id,
         sum(CASE WHEN tr.type = 'earn' THEN tr.amount ELSE 0 END) AS earned,
         sum(CASE WHEN tr.type = 'purchase' THEN abs(tr.amount) ELSE 0 END) AS spent,
         sum(CASE WHEN tr.type = 'donation_sent' THEN abs(tr.amount) ELSE 0 END) AS donated,
         sum(CASE WHEN tr.type = 'donation_received' THEN tr.amount ELSE 0 END) AS received
  FROM transactions tr JOIN users u ON tr.user_id = u.id WHERE u.team_id IN (SELECT id FROM teams)
  GROUP BY u.team_id),
bal AS (SELECT team_id, sum(balance) AS current_balance FROM users WHERE team_id IS NOT NULL GROUP BY team_id)
SELECT t.id AS team_id, t.name AS team_name,
       CAST(COALESCE(f.earned, 0) AS BIGINT) AS earned, CAST(COALESCE(f.spent, 0) AS BIGINT) AS spent,
       CAST(COALESCE(f.donated, 0) AS BIGINT) AS donated, CAST(COALESCE(f.received, 0) AS BIGINT) AS received,
       CAST(COALESCE(b.current_balance, 0) AS BIGINT) AS current_balance,
       CAST(COALESCE(f.earned, 0) + COALESCE(f.received, 0) AS BIGINT) AS total_income
FROM teams t LEFT JOIN fin f ON f.team_id = t.id LEFT JOIN bal b ON b.team_id = t.id""")
ORACLE["team_member_stats"] = _q("""
SELECT t.id AS team_id, CAST(count(u.id) AS BIGINT) AS member_count,
       CASE WHEN count(u.id) > 0 THEN CAST(floor(CAST(sum(u.balance) AS DOUBLE) / count(u.id) + 0.5) AS BIGINT) END
         AS average_balance,
       CAST(count(CASE WHEN u.role = 'team_leader' THEN 1 END) AS BIGINT) AS leader_count
FROM teams t LEFT JOIN users u ON u.team_id = t.id GROUP BY t.id""")
LEDGER_SUM = "CAST(COALESCE((SELECT sum(tr.amount) FROM transactions tr WHERE tr.user_id = u.id), 0) AS BIGINT)"
ORACLE["recomputed_balances"] = _q(f"""
SELECT u.id, u.username, u.role, u.team_id, {LEDGER_SUM} AS balance, u.created_at FROM users u""")
ORACLE["balance_audit"] = _q(f"""
SELECT id, username, stored_balance, ledger_balance, stored_balance - ledger_balance AS difference
FROM (SELECT u.id, u.username, u.balance AS stored_balance, {LEDGER_SUM} AS ledger_balance FROM users u)
WHERE stored_balance <> ledger_balance""")
FEED_COLS = f"""viewer_id, scope, rank, id, user_id, username, type, amount, description, reference_id, created_at,
       (CASE WHEN amount > 0 THEN '+' ELSE '' END) || '$' || CAST(abs(amount) AS VARCHAR) AS amount_text,
       CASE WHEN type IN ('earn', 'donation_received') THEN 'earn' ELSE 'spend' END AS flow,
       strftime(created_at, {FMT}) AS created_text"""
ORACLE["activity_feed"] = _q(f"""
, fl AS (SELECT tr.*, u.username, u.team_id AS author_team_id FROM transactions tr JOIN users u ON tr.user_id = u.id),
team_rows AS (
  SELECT v.id AS viewer_id, 'team' AS scope, f.*,
         CAST(row_number() OVER (PARTITION BY v.id ORDER BY f.created_at DESC, f.id DESC) AS BIGINT) AS rank
  FROM users v JOIN fl f ON f.author_team_id = v.team_id
  WHERE v.role <> 'admin' AND v.team_id IS NOT NULL),
own_rows AS (
  SELECT v.id AS viewer_id, 'user' AS scope, f.*,
         CAST(row_number() OVER (PARTITION BY v.id ORDER BY f.created_at DESC, f.id DESC) AS BIGINT) AS rank
  FROM users v JOIN fl f ON f.user_id = v.id
  WHERE NOT (v.role <> 'admin' AND v.team_id IS NOT NULL))
SELECT {FEED_COLS} FROM team_rows WHERE rank <= 20
UNION ALL
SELECT {FEED_COLS} FROM own_rows WHERE rank <= 10""")
DETAIL = """SELECT t.name AS team_name, u.team_id, tr.user_id, u.username, tr.id, tr.type, tr.amount, tr.description,
       tr.created_at
FROM transactions tr JOIN users u ON tr.user_id = u.id JOIN teams t ON u.team_id = t.id"""
ORACLE["ledger_detail"] = _q(DETAIL)
ORACLE["ledger_sample"] = _q(DETAIL + " ORDER BY t.name, tr.created_at DESC, tr.id DESC LIMIT 20")
BOARD = """
, board AS (
  SELECT o.id, o.user_id, o.team_id, o.product_id, o.quantity, o.total_price, o.status, o.verified, o.created_at,
         u.username, t.name AS team_name, p.name AS product_name, 'purchase' AS type,
         CAST(NULL AS VARCHAR) AS recipient_team_name, CAST(NULL AS VARCHAR) AS message
  FROM shop_orders o JOIN users u ON o.user_id = u.id JOIN teams t ON o.team_id = t.id
       JOIN products p ON o.product_id = p.id
  UNION ALL
  SELECT d.id, NULL, NULL, NULL, d.quantity, d.amount, 'verified', true, d.created_at,
         du.username, dt.name, p.name, 'donation', rt.name, d.message
  FROM donations d JOIN users du ON d.donor_id = du.id JOIN teams dt ON d.donor_team_id = dt.id
       JOIN teams rt ON d.recipient_team_id = rt.id JOIN products p ON d.product_id = p.id)
"""
ORACLE["admin_orders"] = _q(BOARD + "SELECT * FROM board")
ORACLE["order_board_summary"] = _q(BOARD + """
SELECT CAST(count(CASE WHEN NOT verified THEN 1 END) AS BIGINT) AS pending_count,
       CAST(count(CASE WHEN verified THEN 1 END) AS BIGINT) AS verified_count,
       CAST(COALESCE(sum(total_price), 0) AS BIGINT) AS total_sales
FROM board""")
ORACLE["user_orders"] = _q("""
SELECT o.*, p.name AS product_name, p.description FROM shop_orders o JOIN products p ON o.product_id = p.id""")
ORACLE["team_purchases"] = _q("""
SELECT o.*, p.name AS product_name, p.description, u.username
FROM shop_orders o JOIN products p ON o.product_id = p.id JOIN users u ON o.user_id = u.id""")
ORACLE["team_purchase_summary"] = _q("""
SELECT team_id, CAST(count(*) AS BIGINT) AS order_count, CAST(sum(total_price) AS BIGINT) AS total_spent,
       CAST(count(CASE WHEN verified THEN 1 END) AS BIGINT) AS verified_count,
       CAST(count(CASE WHEN NOT verified THEN 1 END) AS BIGINT) AS pending_count
FROM shop_orders GROUP BY team_id""")
ORACLE["received_donations"] = _q("""
SELECT * FROM (
  SELECT d.*, p.name AS product_name, dt.name AS donor_team_name, du.username AS donor_username,
         CAST(row_number() OVER (PARTITION BY d.recipient_team_id ORDER BY d.created_at DESC, d.id DESC) AS BIGINT)
           AS rank,
         COALESCE(trim(d.message) <> '', false) AS has_message
  FROM donations d JOIN products p ON d.product_id = p.id JOIN teams dt ON d.donor_team_id = dt.id
       JOIN users du ON d.donor_id = du.id)
WHERE rank <= 10""")
ROLLUP = """
, held AS (
  SELECT team_id, product_id, quantity, created_at,
         row_number() OVER w AS nth, sum(quantity) OVER w AS so_far, max(created_at) OVER w AS newest, lead(id) OVER w AS following
  FROM team_inventory WHERE quantity > 0 WINDOW w AS (PARTITION BY team_id, product_id ORDER BY id)),
rollup AS (
  SELECT held.team_id, products.id AS product_id, products.name AS product_name, products.description, products.price, products.category,
         held.so_far::BIGINT AS total_quantity, held.nth AS entries_count, held.newest AS last_obtained
  FROM products, held WHERE held.product_id = products.id AND held.following IS NULL)
"""
ORACLE["team_inventory"] = _q(ROLLUP + "SELECT * FROM rollup")
ORACLE["inventory_summary"] = _q(ROLLUP + """
SELECT team_id, CAST(sum(total_quantity) AS BIGINT) AS total_items, CAST(count(*) AS BIGINT) AS product_types,
       CAST(sum(total_quantity * price) AS BIGINT) AS total_value,
       CAST(count(DISTINCT category) AS BIGINT) AS category_count
FROM rollup GROUP BY team_id""")
ORACLE["inventory_history"] = _q("""
SELECT ti.*, p.name AS product_name, p.price, ti.quantity * p.price AS total_value
FROM team_inventory ti JOIN products p ON ti.product_id = p.id WHERE ti.quantity > 0""")
ORACLE["lookup_user"] = _q("""
SELECT r.request_id, r.user_id, u.username, u.role, u.team_id, u.balance
FROM redemption_requests r LEFT JOIN users u ON u.id = r.user_id""")
ORACLE["login_lookup"] = _q("""
SELECT r.request_id, r.username, u.id AS user_id, u.role, u.team_id,
       (SELECT name FROM teams WHERE teams.id = u.team_id) AS team_name, u.balance,
       CASE WHEN coalesce(r.username, '') = '' THEN 'username_required' WHEN u.id IS NULL THEN 'unknown' END AS reason
FROM user_requests r LEFT JOIN (SELECT * FROM users WHERE username <> '') u USING (username)""")
ORACLE["test_ledger_rows_named"] = _q(r"""
, called AS (
  SELECT id, team_id, CASE WHEN id % 37 = 5 THEN 'test_' || id WHEN id % 41 = 6 THEN 'Test_' || id WHEN id % 43 = 7 THEN 'test' ELSE username END AS nick
  FROM users)
SELECT c.team_id, t.name AS team_name, nick AS leader_name, tr.id AS transaction_id, tr.type, tr.amount, tr.description, tr.created_at
FROM called c JOIN teams t ON t.id = c.team_id JOIN transactions tr ON tr.user_id = c.id
WHERE regexp_matches(nick, '^test.') OR starts_with(tr.description, 'Test')""")
ORACLE["donation_targets"] = _q("""
SELECT r.request_id, r.user_id, u.team_id AS donor_team_id, r.recipient_team_id, t.name AS recipient_name,
       COALESCE(t.id IS NOT NULL AND t.id <> u.team_id, false) AS is_valid_target
FROM store_requests r LEFT JOIN users u ON u.id = r.user_id LEFT JOIN teams t ON t.id = r.recipient_team_id
WHERE r.kind = 'donate'""")
ORACLE["affordable_quantity"] = _q("""
SELECT r.request_id, r.user_id, r.product_id, u.balance, p.price, p.stock_quantity,
       CAST(least(COALESCE(p.stock_quantity, 0),
                  CASE WHEN p.price > 0 THEN floor(u.balance / p.price) ELSE COALESCE(p.stock_quantity, 0) END)
            AS BIGINT) AS max_quantity,
       u.balance >= p.price AS can_afford
FROM store_requests r JOIN users u ON u.id = r.user_id JOIN products p ON p.id = r.product_id""")

# --- checks (on tables with damaged rows mixed in) --------------------------------
DAMAGED = "".join(
    f", d{name} AS (SELECT * REPLACE ({', '.join(f'{sql} AS {col}' for col, sql in by.items())}) FROM {'shop_orders' if name == 'orders' else name})"
    for name, by in DAMAGE.items()) + "\n"
_REQUIRED = [("users", "dusers", ["username", "role"]), ("teams", "dteams", ["name"]),
             ("products", "dproducts", ["name", "price"]),
             ("orders", "dorders", ["user_id", "team_id", "product_id", "total_price"]),
             ("transactions", "dtransactions", ["user_id", "type", "amount"]),
             ("money_codes", "dmoney_codes", ["code", "amount"]),
             ("team_inventory", "dteam_inventory", ["team_id", "product_id", "quantity", "obtained_from"]),
             ("donations", "ddonations", ["donor_id", "donor_team_id", "recipient_team_id", "product_id", "amount",
                                         "quantity"])]
ORACLE["check_not_null"] = _q(DAMAGED + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM {src}"
    for name, src, cols in _REQUIRED for c in cols))
_DOMAIN = [("users", "dusers", "role", "'admin', 'team_leader', 'participant'"),
           ("orders", "dorders", "status", "'pending', 'verified', 'cancelled'"),
           ("transactions", "dtransactions", "type",
            "'earn', 'purchase', 'donation_sent', 'donation_received', 'admin_adjustment'"),
           ("team_inventory", "dteam_inventory", "obtained_from", "'purchase', 'donation'")]
ORACLE["check_domain"] = _q(DAMAGED + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
    f"CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({vals})) AS BIGINT) AS bad_count FROM {src}"
    for name, src, c, vals in _DOMAIN))
ORACLE["check_unique"] = _q(DAMAGED + """
SELECT 'users' AS table_name, 'username' AS key_columns, username AS key_value, CAST(count(*) AS BIGINT) AS dup_count
FROM dusers WHERE username IS NOT NULL GROUP BY username HAVING count(*) > 1
UNION ALL
SELECT 'teams', 'name', name, count(*) FROM dteams WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1
UNION ALL
SELECT 'money_codes', 'code', code, count(*) FROM dmoney_codes WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1
UNION ALL
SELECT 'team_inventory', 'team_id,product_id', CAST(team_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR), count(*)
FROM dteam_inventory WHERE team_id IS NOT NULL AND product_id IS NOT NULL GROUP BY team_id, product_id HAVING count(*) > 1""")
_FK = [("users", "dusers", "team_id", "teams", "dteams"), ("teams", "dteams", "leader_id", "users", "dusers"),
       ("orders", "dorders", "user_id", "users", "dusers"), ("orders", "dorders", "team_id", "teams", "dteams"),
       ("orders", "dorders", "product_id", "products", "dproducts"),
       ("transactions", "dtransactions", "user_id", "users", "dusers"),
       ("money_codes", "dmoney_codes", "used_by", "users", "dusers"),
       ("team_inventory", "dteam_inventory", "team_id", "teams", "dteams"),
       ("team_inventory", "dteam_inventory", "product_id", "products", "dproducts"),
       ("donations", "ddonations", "donor_id", "users", "dusers"),
       ("donations", "ddonations", "recipient_id", "users", "dusers"),
       ("donations", "ddonations", "donor_team_id", "teams", "dteams"),
       ("donations", "ddonations", "recipient_team_id", "teams", "dteams"),
       ("donations", "ddonations", "product_id", "products", "dproducts")]
ORACLE["check_foreign_keys"] = _q(DAMAGED + " UNION ALL ".join(
    f"SELECT '{child}' AS child_table, '{c}' AS column_name, '{parent}' AS parent_table, "
    f"CAST(count(*) AS BIGINT) AS orphan_count FROM {csrc} x "
    f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {psrc} p WHERE p.id = x.{c})"
    for child, csrc, c, parent, psrc in _FK))
_KEYS = [("users", "dusers", "username"), ("teams", "dteams", "name"), ("money_codes", "dmoney_codes", "code"),
         ("team_inventory", "dteam_inventory", "team_id,product_id")]
ORACLE["rule_violations"] = _q(DAMAGED + " UNION ALL ".join(
    [f"SELECT 'not_null' AS rule, '{name}' AS table_name, '{c}' AS column_names, CAST(NULL AS VARCHAR) AS parent_table, "
     f"(SELECT CAST(count(*) AS BIGINT) FROM {src} WHERE {c} IS NULL) AS violations" for name, src, cols in _REQUIRED for c in cols]
    + [f"SELECT 'domain', '{name}', '{c}', NULL, (SELECT count(*) FROM {src} WHERE {c} NOT IN ({vals}))" for name, src, c, vals in _DOMAIN]
    + [f"SELECT 'unique', '{name}', '{cols}', NULL, (SELECT count(*) FROM (SELECT {cols} FROM {src} "
       f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols.split(','))} GROUP BY ALL HAVING count(*) > 1))"
       for name, src, cols in _KEYS]
    + [f"SELECT 'foreign_key', '{child}', '{c}', '{parent}', (SELECT count(*) FROM {csrc} x LEFT JOIN {psrc} p ON p.id = x.{c} "
       f"WHERE p.id IS NULL AND x.{c} IS NOT NULL)" for child, csrc, c, parent, psrc in _FK]))
ORACLE["leader_status"] = _q("""
, labels(fits, status) AS (VALUES (true, '✅ OK'), (false, '⚠️ Leader role mismatch')),
led AS (SELECT t.id, t.name, t.leader_id, w.username, w.role, coalesce(w.role = 'team_leader', true) AS fits
        FROM users w RIGHT JOIN teams t ON w.id = t.leader_id WHERE t.leader_id IS NOT NULL)
SELECT id AS team_id, name AS team_name, leader_id, username AS leader_name, role AS leader_role, status FROM led NATURAL JOIN labels
UNION ALL
SELECT id, name, NULL, NULL, NULL, '❌ No Leader' FROM teams WHERE leader_id IS NULL""")
ORACLE["duplicate_leaders"] = _q("""
, named AS (SELECT team_id, list(username) AS names FROM (SELECT * FROM users WHERE role = 'team_leader') GROUP BY ALL)
SELECT team_id, len(names)::BIGINT AS leader_count, array_to_string(list_sort(names), ', ') AS leaders FROM named WHERE len(names) >= 2""")
ORACLE["double_redemptions"] = _q("""
SELECT code, CAST(count(*) AS BIGINT) AS redemptions, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
       CAST(sum(amount) AS BIGINT) AS total_amount
FROM (SELECT regexp_extract(description, '^Redeemed code: (.+)$', 1) AS code, user_id, amount
      FROM transactions WHERE type = 'earn')
WHERE code <> '' GROUP BY code HAVING count(*) > 1""")
ORACLE["guard_product_requests"] = _q("""
SELECT id, name, price, stock_quantity, reject_reason, reject_reason IS NULL AS accepted
FROM (SELECT id, name, price, stock_quantity,
             CASE WHEN name IS NULL OR name = '' THEN 'name_required'
                  WHEN price IS NULL OR price <= 0 THEN 'price_not_positive'
                  WHEN stock_quantity IS NULL OR stock_quantity < 0 THEN 'stock_negative_or_missing' END
               AS reject_reason
      FROM products)""")

# --- set-based jobs -----------------------------------------------------------------
ORACLE["inventory_state"] = _q("SELECT * FROM team_inventory")
ORACLE["inventory_upsert"] = ORACLE["inventory_state"]
ORACLE["inventory_upsert_stored"] = ORACLE["inventory_state"]
ORACLE["sync_leaders"] = _q("""
, claims AS (
  SELECT team_id, id AS user_id, 1 AS turn FROM users WHERE role = 'team_leader'
  UNION ALL SELECT id, leader_id, 2 FROM teams),
chosen AS (SELECT team_id, user_id FROM claims QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY turn, user_id) = 1)
SELECT teams.id AS team_id, teams.name AS team_name, chosen.user_id AS leader_id, users.username AS leader_name
FROM teams JOIN chosen ON chosen.team_id = teams.id LEFT JOIN users ON users.id = chosen.user_id""")
ORACLE["insert_if_absent"] = _q("""
, cand AS (SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)),
fresh AS (SELECT name FROM cand WHERE name NOT IN (SELECT name FROM teams))
SELECT id, name, false AS inserted FROM teams
UNION ALL
SELECT CAST((SELECT max(id) FROM teams) + row_number() OVER (ORDER BY name) AS BIGINT), name, true FROM fresh""")
_EDIT_REASON = """CASE WHEN coalesce(name, '') = '' THEN 'name_required' WHEN price IS NULL OR price <= 0 THEN 'price_not_positive'
            WHEN stock_quantity < 0 THEN 'stock_negative' END"""
ORACLE["guard_product_edits"] = _q(f"SELECT *, {_EDIT_REASON} AS reject_reason FROM product_edits")
ORACLE["apply_product_edits"] = _q(f"""
, sound AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edited_at DESC, request_id DESC) AS back FROM product_edits WHERE {_EDIT_REASON} IS NULL),
stocks AS (SELECT id, stock_quantity FROM sound WHERE stock_quantity IS NOT NULL QUALIFY back = min(back) OVER (PARTITION BY id))
SELECT p.id, coalesce(e.name, p.name) AS name,
       CASE WHEN e.id IS NULL THEN p.description ELSE coalesce(e.description, '') END AS description,
       coalesce(e.price, p.price) AS price,
       CASE WHEN e.id IS NULL THEN p.category ELSE coalesce(nullif(e.category, ''), 'item') END AS category,
       coalesce(s.stock_quantity, p.stock_quantity) AS stock_quantity, p.initial_stock, p.is_active, p.created_at
FROM products p LEFT JOIN sound e ON e.id = p.id AND e.back = 1 LEFT JOIN stocks s ON s.id = p.id""")
ORACLE["toggle_products"] = _q("""
, switches AS (
  SELECT user_id, coalesce(CASE WHEN event_id % 17 <> 0 THEN event_id % 3 <> 0 END, false) AS switched
  FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT p.* REPLACE (coalesce(s.switched, p.is_active) AS is_active) FROM products p LEFT JOIN switches s ON s.user_id = p.id""")
ORACLE["generated_codes"] = _q("""
, drawn AS (
  SELECT id AS request_id, 1::INTEGER AS n, amount, used_at,
         ('0x' || substr(md5(id::VARCHAR || '-1-0'), 1, 12))::BIGINT % 2176782336 AS v
  FROM money_codes WHERE used_by IS NOT NULL)
SELECT request_id, n, 'RC' || (epoch_us(used_at) // 1000)::VARCHAR || list_aggregate(list_transform(range(5, -1, -1),
         lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((v // (36 ** k)::BIGINT) % 36 + 1)::INTEGER, 1)), 'string_agg', '') AS code,
       amount, used_at AS created_at
FROM drawn""")
ORACLE["verify_orders"] = _q("""
, vr AS (SELECT DISTINCT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)) AS order_id
         FROM lineitem WHERE l_linestatus = 'F')
SELECT o.id, o.user_id, o.team_id, o.product_id, o.quantity, o.total_price,
       CASE WHEN vr.order_id IS NOT NULL THEN 'verified' ELSE o.status END AS status,
       (vr.order_id IS NOT NULL OR o.verified) AS verified, o.created_at
FROM shop_orders o LEFT JOIN vr ON vr.order_id = o.id""")
ORACLE["balance_changes"] = _q("""
SELECT o.id AS user_id, 'admin_adjustment' AS type, n.balance - o.balance AS amount,
       CASE WHEN n.balance - o.balance > 0 THEN 'Admin added $' || CAST(n.balance - o.balance AS VARCHAR) || ' to balance'
            ELSE 'Admin removed $' || CAST(abs(n.balance - o.balance) AS VARCHAR) || ' from balance' END
         AS description,
       o.balance AS old_balance, n.balance AS new_balance
FROM users o JOIN new_users n ON n.id = o.id WHERE n.balance <> o.balance""")
ORACLE["sample_ledger"] = _q("""
, lt AS (SELECT t.id AS team_id, t.name AS team_name, u.id AS user_id
         FROM teams t JOIN users u ON t.leader_id = u.id WHERE u.role = 'team_leader')
SELECT team_id, user_id, 'earn' AS type, CAST(100000 * team_id AS BIGINT) AS amount,
       'Test money code for ' || team_name AS description FROM lt
UNION ALL
SELECT team_id, user_id, 'donation_sent', CAST(-(100000 * team_id * 0.1) AS BIGINT),
       'Test donation from ' || team_name || ' to other teams' FROM lt WHERE team_id <= 4
UNION ALL
SELECT team_id, user_id, 'purchase', CAST(-(100000 * team_id * 0.05) AS BIGINT),
       'Test purchase by ' || team_name FROM lt WHERE team_id % 2 = 1""")
ORACLE["reset_users"] = _q("""
SELECT id, username, role, team_id, CAST(0 AS BIGINT) AS balance, created_at FROM users WHERE role = 'admin'""")
ORACLE["reset_teams"] = _q("""
SELECT id, CASE id WHEN 1 THEN 'A그룹' WHEN 2 THEN 'B그룹' WHEN 3 THEN 'C그룹' WHEN 4 THEN 'D그룹'
                   WHEN 5 THEN 'E그룹' WHEN 6 THEN 'Z그룹' ELSE name END AS name,
       CAST(NULL AS BIGINT) AS leader_id, created_at
FROM teams""")
ORACLE["delete_products"] = _q("""
, refd AS (SELECT p.id,
                  EXISTS (SELECT 1 FROM shop_orders o WHERE o.product_id = p.id)
                  OR EXISTS (SELECT 1 FROM donations d WHERE d.product_id = p.id)
                  OR EXISTS (SELECT 1 FROM team_inventory i WHERE i.product_id = p.id) AS referenced
           FROM products p WHERE NOT p.is_active)
SELECT id AS product_id, NOT referenced AS deleted, CASE WHEN referenced THEN 'referenced' END AS reason FROM refd""")

ORACLE["delete_unsold_products"] = _q("""
, kept AS (
  SELECT product_id FROM shop_orders WHERE product_id % 3 <> 1 OR product_id % 5 = 0
  UNION SELECT product_id FROM donations WHERE product_id % 3 <> 1 OR product_id % 7 = 0
  UNION SELECT product_id FROM team_inventory WHERE product_id % 3 <> 1 OR product_id % 13 = 0)
SELECT id AS product_id, id NOT IN (SELECT product_id FROM kept) AS deleted,
       CASE WHEN id IN (SELECT product_id FROM kept) THEN 'referenced' END AS reason
FROM products WHERE is_active = false""")
ORACLE["reset_store"] = _q("""
SELECT 'users' AS table_name, count(*) AS row_count FROM users WHERE role = 'admin'
UNION ALL SELECT 'teams', count(*) FROM teams
UNION ALL SELECT unnest(['products', 'orders', 'transactions', 'money_codes', 'team_inventory', 'donations']), CAST(0 AS BIGINT)""")

REDEEM = """
, rq AS (
  SELECT r.*, (r.code IS NOT NULL AND r.code <> '') AS given,
         COALESCE(u.role IN ('team_leader', 'admin'), false) AS role_ok
  FROM redemption_requests r LEFT JOIN users u ON u.id = r.user_id),
elig AS (SELECT request_id, row_number() OVER (PARTITION BY code ORDER BY requested_at, request_id) AS rn
         FROM rq WHERE given AND role_ok),
res AS (
  SELECT rq.*, COALESCE(e.rn = 1 AND mc.id IS NOT NULL, false) AS accepted, mc.id AS mc_id, mc.amount AS mc_amount
  FROM rq LEFT JOIN elig e ON e.request_id = rq.request_id
          LEFT JOIN money_codes mc ON mc.code = rq.code AND mc.used_by IS NULL)
"""
ORACLE["redeem_codes"] = _q(REDEEM + """
SELECT request_id, user_id, code, requested_at, accepted,
       CASE WHEN NOT given THEN 'code_required' WHEN NOT role_ok THEN 'forbidden'
            WHEN NOT accepted THEN 'invalid_or_used' END AS reason,
       CASE WHEN accepted THEN mc_amount END AS amount, CASE WHEN accepted THEN mc_id END AS code_id
FROM res""")
ORACLE["redeem_ledger"] = _q(REDEEM + """
SELECT request_id AS id, user_id, 'earn' AS type, CAST(mc_amount AS BIGINT) AS amount,
       'Redeemed code: ' || code AS description, CAST(NULL AS BIGINT) AS reference_id, requested_at AS created_at
FROM res WHERE accepted""")
ORACLE["redeem_code_state"] = _q(REDEEM + """
SELECT mc.id, mc.code, mc.amount, COALESCE(mc.used_by, w.user_id) AS used_by,
       COALESCE(mc.used_at, w.requested_at) AS used_at, mc.created_at
FROM money_codes mc LEFT JOIN (SELECT * FROM res WHERE accepted) w ON w.mc_id = mc.id""")
ORACLE["redeem_balances"] = _q(REDEEM + """
SELECT u.id, CAST(u.balance + COALESCE((SELECT sum(mc_amount) FROM res WHERE accepted AND res.user_id = u.id), 0)
                  AS BIGINT) AS balance
FROM users u""")

# --- streams: their end tables equal the batch twins --------------------------------
ORACLE["stream_team_totals"] = _q(RANKING_BASE + """
SELECT id, team_name, member_count, total_earned, total_spent, total_donated, current_balance FROM scored""")
ORACLE["stream_redeem"] = ORACLE["redeem_codes"]
ORACLE["stream_ranking"] = ORACLE["team_rankings"]
ORACLE["post_redemptions"] = _q(REDEEM + """
SELECT id, user_id, type, amount, description, reference_id, created_at FROM transactions
UNION ALL
SELECT CAST((SELECT max(id) FROM transactions) + row_number() OVER (ORDER BY requested_at, request_id) AS BIGINT), user_id, 'earn',
       CAST(mc_amount AS BIGINT), 'Redeemed code: ' || code, NULL, requested_at
FROM res WHERE accepted""")

# --- file sources and sinks: a round trip keeps the rows ------------------------------
ORACLE["src_products_csv"] = _q("""
SELECT name, COALESCE(description, '') AS description, price, COALESCE(NULLIF(category, ''), 'item') AS category,
       stock_quantity, initial_stock, is_active
FROM products""")
ORACLE["src_users_csv"] = _q("SELECT username, role, team_id, balance FROM users")
ORACLE["sink_json"] = ORACLE["store_catalog"]
ORACLE["users_after_delete"] = _q("""
SELECT * FROM users u
WHERE u.role = 'admin' OR EXISTS (SELECT 1 FROM transactions tr WHERE tr.user_id = u.id)""")

# --- stock requests: each product's requests applied one after the other, all products in step -----------------------
STOCK_FOLD = r"""
, numbered AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.product_id ORDER BY s.requested_at, s.request_id) AS n,
         p.id IS NOT NULL AS known, COALESCE(p.stock_quantity, 0) AS stock0
  FROM stock_adjustments s LEFT JOIN products p ON p.id = s.product_id),
judged AS (
  SELECT product_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS type,
         CAST(NULL AS BIGINT) AS adjustment, CAST(NULL AS TIMESTAMP) AS requested_at, CAST(NULL AS BIGINT) AS held,
         CAST(NULL AS VARCHAR) AS reason, CAST(stock0 AS BIGINT) AS stock, CAST(NULL AS BOOLEAN) AS switched
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT product_id, n, request_id, type, adjustment, requested_at, held, reason,
         CASE WHEN reason IS NOT NULL THEN held WHEN type = 'set' THEN adjustment ELSE held + adjustment END,
         CASE WHEN reason IS NOT NULL THEN switched
              WHEN type = 'set' THEN CASE WHEN adjustment > 0 THEN true ELSE switched END
              WHEN held + adjustment <= 0 THEN false
              WHEN held <= 0 THEN true ELSE switched END
  FROM (SELECT r.product_id, r.n, r.request_id, r.type, r.adjustment, r.requested_at, j.stock AS held, j.switched,
               CASE WHEN r.type = 'set' THEN CASE WHEN r.adjustment < 0 THEN 'negative_stock' END
                    WHEN NOT r.known THEN 'product_not_found'
                    WHEN j.stock + r.adjustment < 0 THEN 'below_zero' END AS reason
        FROM judged j JOIN numbered r ON r.product_id = j.product_id AND r.n = j.n + 1))
"""


def _recursive(body: str) -> str:
    return _q(body).replace("WITH", "WITH RECURSIVE", 1)


ORACLE["stock_adjust"] = _recursive(STOCK_FOLD + r"""
SELECT request_id, product_id, type, adjustment, requested_at, reason IS NULL AS accepted, reason,
       CASE WHEN type = 'adjust' AND reason IS DISTINCT FROM 'product_not_found' THEN held END AS stock_before,
       CASE WHEN reason IS NULL THEN stock END AS stock_after
FROM judged WHERE n > 0""")
ORACLE["stock_adjust_products"] = _recursive(STOCK_FOLD + r"""
, final AS (
  SELECT product_id, arg_max(stock, n) AS stock, arg_max(switched, n) AS switched
  FROM judged WHERE n > 0 AND reason IS NULL GROUP BY product_id)
SELECT p.* REPLACE (CASE WHEN f.product_id IS NULL THEN p.stock_quantity ELSE f.stock END AS stock_quantity,
                    COALESCE(f.switched, p.is_active) AS is_active)
FROM products p LEFT JOIN final f ON f.product_id = p.id""")
ORACLE["stream_stock"] = _recursive(STOCK_FOLD + r"""
SELECT j.request_id, j.product_id, j.type, j.adjustment, j.requested_at, j.reason IS NULL AS accepted, j.reason,
       CASE WHEN j.type = 'adjust' AND j.reason IS DISTINCT FROM 'product_not_found' THEN j.held END AS stock_before,
       CASE WHEN j.reason IS NULL THEN j.stock END AS stock_after,
       CASE WHEN p.id IS NOT NULL THEN COALESCE(j.switched, p.is_active) END AS is_active
FROM judged j LEFT JOIN products p ON p.id = j.product_id WHERE j.n > 0""")

# Leader and user requests one after the other; the state is one row of maps (only people who can matter are in it).
_RELEVANT = """(SELECT id FROM users WHERE role = 'team_leader' UNION SELECT leader_id FROM teams"""
LEADER_FOLD = r"""
, turns AS (SELECT *, row_number() OVER (ORDER BY requested_at, request_id) AS n FROM leader_requests
            WHERE team_id IS NOT NULL AND leader_id IS NOT NULL),
steps AS (
  SELECT 0::BIGINT AS n,
         (SELECT map(list(id), list({'role': role, 'team': team_id})) FROM users
          WHERE id IN """ + _RELEVANT + r""" UNION SELECT leader_id FROM turns)) AS people,
         (SELECT map(list(id), list(leader_id)) FROM teams) AS leads
  UNION ALL
  SELECT n, map_from_entries(list_transform(map_entries(people), lambda e: struct_pack(k := e.key, v := {
              'role': CASE WHEN e.key = new_leader THEN 'team_leader' WHEN list_contains(out, e.key) THEN 'participant' ELSE e.value.role END,
              'team': e.value.team}))),
         map_from_entries(list_transform(map_entries(leads), lambda e: struct_pack(k := e.key, v :=
              CASE WHEN e.key = team THEN new_leader WHEN list_contains(out, e.value) THEN NULL ELSE e.value END)))
  FROM (SELECT t.n, t.team_id AS team, t.leader_id AS new_leader, s.people, s.leads,
               list_transform(list_filter(map_entries(s.people), lambda e: e.value.role = 'team_leader' AND e.value.team = t.team_id),
                              lambda e: e.key) AS out
        FROM steps s JOIN turns t ON t.n = s.n + 1)),
closing AS (SELECT arg_max(people, n) AS people, arg_max(leads, n) AS leads FROM steps)
"""
ORACLE["assign_leaders"] = _recursive(LEADER_FOLD + """
SELECT t.* REPLACE (c.leads[t.id] AS leader_id) FROM teams t, closing c""")
ORACLE["assign_leaders_roles"] = _recursive(LEADER_FOLD + """
SELECT u.id, coalesce(c.people[u.id].role, u.role) AS role, u.team_id FROM users u, closing c""")

USER_FOLD = r"""
, turns AS (SELECT r.*, row_number() OVER (ORDER BY r.requested_at, r.request_id) AS n, h.id AS holder,
                   x.id IS NOT NULL AS known, r.team_id IS NULL OR t.id IS NOT NULL AS placed
            FROM user_requests r LEFT JOIN users h ON h.username = r.username LEFT JOIN users x ON x.id = r.user_id LEFT JOIN teams t ON t.id = r.team_id),
steps AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS request_id, NULL::BIGINT AS who, NULL::VARCHAR AS reason, NULL::BIGINT AS gain, NULL::TIMESTAMP AS asked_at,
         (SELECT max(id) FROM users) AS top,
         (SELECT map(list(id), list({'name': username, 'role': role, 'team': team_id, 'balance': balance, 'since': created_at})) FROM users
          WHERE id IN """ + _RELEVANT + r""" UNION SELECT user_id FROM turns)) AS people,
         (SELECT map(list(id), list(leader_id)) FROM teams) AS leads,
         MAP {'': '-'} AS names
  UNION ALL
  SELECT n, request_id, who, reason, CASE WHEN reason IS NULL AND user_id IS NOT NULL THEN balance - old.balance END, requested_at,
         CASE WHEN reason IS NULL AND user_id IS NULL THEN top + 1 ELSE top END,
         CASE WHEN reason IS NOT NULL THEN people ELSE map_from_entries(list_append(
              list_transform(list_filter(map_entries(people), lambda e: e.key <> who), lambda e: struct_pack(k := e.key, v := {
                'name': e.value.name, 'role': CASE WHEN list_contains(out, e.key) THEN 'participant' ELSE e.value.role END,
                'team': e.value.team, 'balance': e.value.balance, 'since': e.value.since})),
              struct_pack(k := who, v := {'name': username, 'role': role, 'team': team_id,
                'balance': CASE WHEN user_id IS NULL THEN 0 ELSE coalesce(balance, old.balance) END, 'since': coalesce(old.since, requested_at)}))) END,
         CASE WHEN reason IS NOT NULL THEN leads ELSE map_from_entries(list_transform(map_entries(leads), lambda e: struct_pack(k := e.key, v :=
              CASE WHEN appoints AND e.key = team_id THEN who WHEN list_contains(out, e.value) THEN NULL
                   WHEN e.value = who AND old.role = 'team_leader'
                        AND (role <> 'team_leader' OR (old.team IS NOT NULL AND old.team IS DISTINCT FROM team_id)) THEN NULL
                   ELSE e.value END))) END,
         CASE WHEN reason IS NOT NULL OR names[username] IS NOT NULL THEN names ELSE map_concat(names, map([username], [claimant])) END
  FROM (SELECT *, CASE WHEN reason IS NULL AND appoints THEN
                 list_transform(list_filter(map_entries(people), lambda e: e.key <> who AND e.value.role = 'team_leader' AND e.value.team = team_id),
                                lambda e: e.key) ELSE [] END AS out
        FROM (SELECT t.*, s.top, s.people, s.leads, s.names, coalesce(t.user_id, s.top + 1) AS who, s.people[t.user_id] AS old,
                     coalesce(t.role = 'team_leader' AND t.team_id IS NOT NULL, false) AS appoints,
                     coalesce('u' || t.user_id::VARCHAR, 'r' || t.request_id::VARCHAR) AS claimant,
                     CASE WHEN coalesce(t.username, '') = '' OR coalesce(t.role, '') = '' THEN 'username_and_role_required'
                          WHEN t.user_id IS NOT NULL AND NOT t.known THEN 'user_not_found'
                          WHEN t.role NOT IN ('admin', 'team_leader', 'participant') THEN 'invalid_role'
                          WHEN NOT t.placed THEN 'team_not_found'
                          WHEN coalesce('u' || t.holder::VARCHAR, s.names[t.username], '') NOT IN ('', coalesce('u' || t.user_id::VARCHAR, 'r' || t.request_id::VARCHAR))
                            THEN 'username_taken' END AS reason
              FROM steps s JOIN turns t ON t.n = s.n + 1))),
closing AS (SELECT arg_max(people, n) AS people, arg_max(leads, n) AS leads FROM steps),
everyone AS (
  SELECT id, username, role, team_id, balance, created_at FROM users, closing WHERE people[id] IS NULL
  UNION ALL
  SELECT e.key, e.value.name, e.value.role, e.value.team, e.value.balance, e.value.since FROM (SELECT unnest(map_entries(people)) AS e FROM closing))
"""
ORACLE["edit_users"] = _recursive(USER_FOLD + "SELECT * FROM everyone")
ORACLE["edit_users_teams"] = _recursive(USER_FOLD + "SELECT t.* REPLACE (c.leads[t.id] AS leader_id) FROM teams t, closing c")
ORACLE["edit_users_results"] = _recursive(USER_FOLD + """
SELECT t.request_id, CASE WHEN s.reason IS NULL THEN s.who ELSE t.user_id END AS user_id, s.reason IS NULL AS accepted, s.reason
FROM steps s JOIN turns t ON t.n = s.n""")
ORACLE["edit_users_ledger"] = _recursive(USER_FOLD + """
SELECT request_id, who AS user_id, 'admin_adjustment' AS type, gain AS amount,
       CASE WHEN gain > 0 THEN 'Admin added $' || gain::VARCHAR || ' to balance' ELSE 'Admin removed $' || (-gain)::VARCHAR || ' from balance' END AS description,
       asked_at AS created_at
FROM steps WHERE gain <> 0""")
