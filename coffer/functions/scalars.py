"""Scalar column expressions shared by operators. All JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coffer.schemas import DATE_FORMAT, LOW_STOCK_LIMIT

# Fixed display values.
MEDALS = {1: "gold", 2: "silver", 3: "bronze"}
UNASSIGNED_TEAM = "Unassigned"
NO_USER = "-"
NO_LEADER = "No leader assigned"
CODE_USED, CODE_AVAILABLE = "Used", "Available"
STOCK_SOLD_OUT, STOCK_LOW, STOCK_OK = "sold_out", "low", "in_stock"
PROGRESS_CAP = 100


def half_up(x: Column) -> Column:
    """JavaScript ``Math.round`` on a double: round half toward +infinity."""
    return F.floor(x + F.lit(0.5))


def donation_score(donated: Column, earned: Column) -> Column:
    """``Math.round(donated / earned * 100)`` in double arithmetic, 0 when nothing was earned."""
    ratio = donated.cast("double") / earned.cast("double") * F.lit(100.0)
    return F.when(earned > 0, half_up(ratio)).otherwise(F.lit(0)).cast("bigint")


def score_pct(donated: Column, earned: Column) -> Column:
    """``ROUND(donated::numeric / earned * 100, 2)`` in exact decimal, 0 when nothing was earned."""
    exact = donated.cast("decimal(38,10)") / earned.cast("decimal(38,10)") * F.lit(100)
    return F.when(earned > 0, F.round(exact, 2)).otherwise(F.lit(0)).cast("decimal(12,2)")


def progress(score: Column) -> Column:
    """Progress-bar width: the score capped at 100."""
    return F.least(score, F.lit(PROGRESS_CAP))


def medal(position: Column) -> Column:
    """'gold', 'silver', 'bronze' for positions 1-3, else NULL."""
    out = F.lit(None).cast("string")
    for k in sorted(MEDALS, reverse=True):
        out = F.when(position == k, F.lit(MEDALS[k])).otherwise(out)
    return out


def stock_status(stock: Column) -> Column:
    """Stock bucket: ≤ 0 sold out, ≤ 5 low, else in stock (missing stock counts as 0)."""
    s = F.coalesce(stock, F.lit(0))
    return (F.when(s <= 0, STOCK_SOLD_OUT).when(s <= LOW_STOCK_LIMIT, STOCK_LOW).otherwise(STOCK_OK))


def js_default(c: Column, default) -> Column:
    """JavaScript ``c || default`` on a column: NULL and falsy values take the default."""
    lit = F.lit(default)
    if isinstance(default, str):
        return F.coalesce(F.nullif(c, F.lit("")), lit)
    return F.coalesce(F.nullif(c, F.lit(0)), lit)


def format_ts(ts: Column) -> Column:
    """Display form of a timestamp, 'dd/MM/yy HH:mm:ss'."""
    return F.date_format(ts, DATE_FORMAT)


def role_label(role: Column) -> Column:
    """Replace the first '_' of a role by a space (roles hold one '_' at most)."""
    return F.regexp_replace(role, "_", " ")


def signed_amount(amount: Column) -> Column:
    """Feed display: '+$N' for income, '$N' otherwise (the sign is carried by the class)."""
    return F.concat(F.when(amount > 0, F.lit("+")).otherwise(F.lit("")), F.lit("$"), F.abs(amount).cast("string"))


def flow_class(ledger_type: Column) -> Column:
    """Feed colour class: income types are 'earn', everything else 'spend'."""
    return F.when(ledger_type.isin("earn", "donation_received"), "earn").otherwise("spend")


def max_affordable(stock: Column, balance: Column, price: Column) -> Column:
    """min(stock, floor(balance / price)); price 0 buys the whole stock."""
    have = F.coalesce(stock, F.lit(0))
    per_money = F.when(price > 0, F.floor(balance / price)).otherwise(have)
    return F.least(have, per_money).cast("bigint")
