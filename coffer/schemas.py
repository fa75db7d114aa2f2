"""Logical tables of a team economy: explicit StructTypes, never inferred.

Ids and money are BIGINT (aggregates stay BIGINT, never strings); timestamps
carry no zone (TIMESTAMP_NTZ, UTC by convention). Order and donation ids are
strings: the request logs this library folds key them by a composite text id.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values of the domain (must equal the application's) -------------
ROLES = ("admin", "team_leader", "participant")
ORDER_STATUSES = ("pending", "verified", "cancelled")
LEDGER_TYPES = ("earn", "purchase", "donation_sent", "donation_received", "admin_adjustment")
INVENTORY_SOURCES = ("purchase", "donation")
DEFAULT_CATEGORY = "item"
LOW_STOCK_LIMIT = 5
FEED_SIZE_PERSONAL = 10
FEED_SIZE_TEAM = 20
RECEIVED_DONATIONS_SHOWN = 10
LEDGER_SAMPLE_SIZE = 20
DATE_FORMAT = "dd/MM/yy HH:mm:ss"
# -----------------------------------------------------------------------------

L, S, B, TS = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


USERS = _struct(
    ("id", L, False), ("username", S, False), ("role", S, False), ("team_id", L, True),
    ("balance", L, False), ("created_at", TS, True),
)
TEAMS = _struct(("id", L, False), ("name", S, False), ("leader_id", L, True), ("created_at", TS, True))
PRODUCTS = _struct(
    ("id", L, False), ("name", S, False), ("description", S, True), ("price", L, False),
    ("category", S, True), ("stock_quantity", L, True), ("initial_stock", L, True),
    ("is_active", B, True), ("created_at", TS, True),
)
ORDERS = _struct(
    ("id", S, False), ("user_id", L, False), ("team_id", L, False), ("product_id", L, False),
    ("quantity", L, False), ("total_price", L, False), ("status", S, False), ("verified", B, False),
    ("created_at", TS, True),
)
TRANSACTIONS = _struct(
    ("id", L, False), ("user_id", L, False), ("type", S, False), ("amount", L, False),
    ("description", S, True), ("reference_id", L, True), ("created_at", TS, True),
)
MONEY_CODES = _struct(
    ("id", L, False), ("code", S, False), ("amount", L, False), ("used_by", L, True),
    ("used_at", TS, True), ("created_at", TS, True),
)
TEAM_INVENTORY = _struct(
    ("id", S, False), ("team_id", L, False), ("product_id", L, False), ("quantity", L, False),
    ("obtained_from", S, False), ("reference_id", S, True), ("created_at", TS, True),
)
DONATIONS = _struct(
    ("id", S, False), ("donor_id", L, False), ("recipient_id", L, True), ("donor_team_id", L, False),
    ("recipient_team_id", L, False), ("product_id", L, False), ("amount", L, False),
    ("quantity", L, False), ("message", S, True), ("created_at", TS, True),
)

TABLE_SCHEMAS = {
    "users": USERS, "teams": TEAMS, "products": PRODUCTS, "orders": ORDERS,
    "transactions": TRANSACTIONS, "money_codes": MONEY_CODES, "team_inventory": TEAM_INVENTORY,
    "donations": DONATIONS,
}

# CSV inputs (header row). The users file carries a password hash column that is
# never loaded: the schema below names it so the column can be pruned on read.
PRODUCTS_CSV = _struct(
    ("name", S, True), ("description", S, True), ("price", L, True), ("category", S, True),
    ("stock_quantity", L, True), ("initial_stock", L, True), ("is_active", B, True),
)
USERS_CSV = _struct(
    ("username", S, True), ("password_hash", S, True), ("role", S, True), ("team_id", L, True),
    ("balance", L, True),
)

# Required columns (NOT NULL in the application's DDL) and value domains.
NOT_NULL = {
    "users": ("username", "role"),
    "teams": ("name",),
    "products": ("name", "price"),
    "orders": ("user_id", "team_id", "product_id", "total_price"),
    "transactions": ("user_id", "type", "amount"),
    "money_codes": ("code", "amount"),
    "team_inventory": ("team_id", "product_id", "quantity", "obtained_from"),
    "donations": ("donor_id", "donor_team_id", "recipient_team_id", "product_id", "amount", "quantity"),
}
DOMAINS = {
    ("users", "role"): ROLES,
    ("orders", "status"): ORDER_STATUSES,
    ("transactions", "type"): LEDGER_TYPES,
    ("team_inventory", "obtained_from"): INVENTORY_SOURCES,
}
UNIQUE_KEYS = {
    "users": ("username",),
    "teams": ("name",),
    "money_codes": ("code",),
    "team_inventory": ("team_id", "product_id"),
}
# (child table, child column, parent table); parent key is always ``id``. NULL passes.
FOREIGN_KEYS = (
    ("users", "team_id", "teams"),
    ("teams", "leader_id", "users"),
    ("orders", "user_id", "users"),
    ("orders", "team_id", "teams"),
    ("orders", "product_id", "products"),
    ("transactions", "user_id", "users"),
    ("money_codes", "used_by", "users"),
    ("team_inventory", "team_id", "teams"),
    ("team_inventory", "product_id", "products"),
    ("donations", "donor_id", "users"),
    ("donations", "recipient_id", "users"),
    ("donations", "donor_team_id", "teams"),
    ("donations", "recipient_team_id", "teams"),
    ("donations", "product_id", "products"),
)
