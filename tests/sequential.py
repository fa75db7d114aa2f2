"""Plain-Python sequential models of the write handlers: the test oracles.

Each processes requests one at a time in (requested_at, request_id) order,
as the application's handlers do. Used only on small fixtures in tests.
"""

from __future__ import annotations

import math

ALLOWED = ("team_leader", "admin")


def _null(v) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v))


def admission(users, products, teams, requests, role_guard=True, credits=()):
    """users/products/teams/requests: lists of dicts. Returns {request_id: (accepted, reason)}.

    ``credits`` (credit_id, user_id, amount, credited_at) top balances up in order; at equal
    times a credit comes before a request."""
    ud = {u["id"]: u for u in users}
    bal = {u["id"]: u["balance"] for u in users}
    prods = {p["id"]: {"price": p["price"], "stock": 0 if _null(p["stock_quantity"]) else p["stock_quantity"],
                       "active": bool(p["is_active"]) if not _null(p["is_active"]) else False} for p in products}
    team_ids = {t["id"] for t in teams}
    out = {}
    events = [((c["credited_at"], 0, str(c["credit_id"])), "credit", c) for c in credits]
    events += [((r["requested_at"], 1, str(r["request_id"])), "request", r) for r in requests]
    for _, what, r in sorted(events, key=lambda e: e[0]):
        if what == "credit":
            if r["user_id"] in bal:
                bal[r["user_id"]] += r["amount"]
            continue
        rid, u = r["request_id"], ud.get(r["user_id"])
        donate = r["kind"] == "donate"
        q = r["quantity"]

        def reject(reason):
            out[rid] = (False, reason)

        if role_guard and (u is None or u["role"] not in ALLOWED):
            reject("forbidden"); continue
        if u is None:
            reject("user_not_found"); continue
        if _null(r["product_id"]) or _null(q) or q <= 0 or (donate and _null(r["recipient_team_id"])):
            reject("invalid_input"); continue
        if donate and not _null(u["team_id"]) and r["recipient_team_id"] == u["team_id"]:
            reject("own_team"); continue
        p = prods.get(r["product_id"])
        if p is None or not p["active"]:
            reject("product_not_found"); continue
        if p["stock"] < q:
            reject("insufficient_stock"); continue
        total = p["price"] * q
        if bal[u["id"]] < total:
            reject("insufficient_balance"); continue
        if donate and r["recipient_team_id"] not in team_ids:
            reject("recipient_not_found"); continue
        if _null(u["team_id"]):
            reject("no_team"); continue
        bal[u["id"]] -= total
        p["stock"] -= q
        if p["stock"] <= 0:
            p["active"] = False
        out[rid] = (True, None)
    return out


def leader_assignment(users, teams, requests):
    """Apply leader requests one by one; demoting a user clears it from teams.leader_id (trigger)."""
    role = {u["id"]: u["role"] for u in users}
    team_of = {u["id"]: u["team_id"] for u in users}
    leader = {t["id"]: t["leader_id"] for t in teams}
    for r in sorted(requests, key=lambda r: (r["requested_at"], r["request_id"])):
        t, new = r["team_id"], r["leader_id"]
        if _null(t) or _null(new):
            continue
        for uid in list(role):
            if team_of[uid] == t and role[uid] == "team_leader":
                role[uid] = "participant"
                for tid in leader:
                    if leader[tid] == uid:
                        leader[tid] = None
        if t in leader:
            leader[t] = new
        if new in role:
            role[new] = "team_leader"
    return role, leader


def stock_fold(products, adjustments):
    """Stock 'set'/'adjust' requests per product in order. Returns (products, results)."""
    state = {p["id"]: {"stock": p["stock_quantity"], "active": p["is_active"]} for p in products}
    results = {}
    for r in sorted(adjustments, key=lambda r: (r["requested_at"], r["request_id"])):
        rid, pid, a = r["request_id"], r["product_id"], r["adjustment"]
        s = state.get(pid)
        if _null(a):
            results[rid] = (False, "adjustment_required"); continue
        if r["type"] == "set":
            if a < 0:
                results[rid] = (False, "negative_stock"); continue
            if s is None:
                results[rid] = (True, None); continue  # UPDATE of a missing row changes nothing
            s["stock"] = a
            if a > 0:
                s["active"] = True
            results[rid] = (True, None)
        else:
            if s is None:
                results[rid] = (False, "product_not_found"); continue
            old = 0 if _null(s["stock"]) else s["stock"]
            new = old + a
            if new < 0:
                results[rid] = (False, "below_zero"); continue
            s["stock"] = new
            if new > 0 and old <= 0:
                s["active"] = True
            elif new <= 0:
                s["active"] = False
            results[rid] = (True, None)
    return state, results


def user_fold(users, teams, requests):
    """User creates and edits one by one. Returns (results, users, leader by team, ledger rows)."""
    people = {u["id"]: dict(u) for u in users}
    leader = {t["id"]: t["leader_id"] for t in teams}
    owner = {u["username"]: ("user", u["id"]) for u in users}
    stored, top = set(people), max(people, default=0)
    results, ledger = {}, []

    def clear(uid):
        for t in leader:
            if leader[t] == uid:
                leader[t] = None

    for r in sorted(requests, key=lambda r: (r["requested_at"], r["request_id"])):
        rid, uid, name, role, team = r["request_id"], r["user_id"], r["username"], r["role"], r["team_id"]
        claim = ("new", rid) if uid is None else ("user", uid)
        reason = ("username_and_role_required" if not name or not role else "user_not_found" if uid is not None and uid not in stored
                  else "invalid_role" if role not in ("admin", "team_leader", "participant") else "team_not_found" if team is not None and team not in leader
                  else "username_taken" if owner.setdefault(name, claim) != claim else None)
        if reason:
            results[rid] = (uid, False, reason)
            continue
        old = people.get(uid)
        if uid is None:
            uid = top = top + 1
            people[uid] = {"id": uid, "balance": 0, "created_at": r["requested_at"]}
        elif r["balance"] is not None and r["balance"] != old["balance"]:
            ledger.append((rid, uid, r["balance"] - old["balance"]))
            people[uid]["balance"] = r["balance"]
        was = (old["role"], old["team_id"]) if old is not None else (None, None)
        people[uid].update(username=name, role=role, team_id=team)
        if was[0] == "team_leader" and was != (role, team) and (was[1] is not None or role != "team_leader"):
            clear(uid)
        if role == "team_leader" and team is not None:
            for other in people.values():
                if other["id"] != uid and other["team_id"] == team and other["role"] == "team_leader":
                    other["role"] = "participant"
                    clear(other["id"])
            leader[team] = uid
        results[rid] = (uid, True, None)
    return results, people, leader, ledger
