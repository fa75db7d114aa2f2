"""Hand-made tables for unit tests (made-up rows only)."""

import datetime as dt

from coffer.schemas import DONATIONS, MONEY_CODES, ORDERS, PRODUCTS, TEAM_INVENTORY, TEAMS, TRANSACTIONS, USERS
from coffer.sources.tables import Tables

T0 = dt.datetime(2024, 1, 1)


def ts(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def make_tables(spark, users=(), teams=(), products=(), orders=(), transactions=(), money_codes=(),
                team_inventory=(), donations=()):
    def df(rows, schema):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return Tables(users=df(users, USERS), teams=df(teams, TEAMS), products=df(products, PRODUCTS),
                  orders=df(orders, ORDERS), transactions=df(transactions, TRANSACTIONS),
                  money_codes=df(money_codes, MONEY_CODES), team_inventory=df(team_inventory, TEAM_INVENTORY),
                  donations=df(donations, DONATIONS))
