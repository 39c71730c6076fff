"""Plain replay of the feature rules, one transaction after the other, for small fixtures."""
import math
from collections import defaultdict
from datetime import datetime

DEBIT = {"P2P_SEND", "CASH_OUT", "MERCHANT_PAYMENT", "AIRTIME", "BILL_PAYMENT", "CARD_TOPUP", "CARD_PURCHASE"}


def seconds(ts):
    return (ts - datetime(1970, 1, 1)).total_seconds()


def replay(rows, profiles):
    """Stateful features that depend on the past, by definition over the list of earlier rows."""
    rows = sorted(rows, key=lambda r: (r["timestamp"], r["transaction_id"]))
    by_user, out = defaultdict(list), {}
    by_device, by_wallet, by_agent = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        t, u = seconds(r["timestamp"]), r["user_id"]
        past = by_user[u]
        p2p = r["tx_type"] in ("P2P_SEND", "P2P_RECEIVE")
        wallet = r["counterparty_id"] if p2p else None
        age = lambda q: t - seconds(q["timestamp"])
        day = [q for q in past if age(q) <= 86400]
        f = {}
        n = len(past)
        la = [math.log1p(q["amount_usd"]) for q in past]
        if n >= 3:
            mean = sum(la) / n
            std = math.sqrt(max(sum(x * x for x in la) / n - mean ** 2, 0)) + 0.25
            f["amount_zscore_user"] = max(-10, min(10, (math.log1p(r["amount_usd"]) - mean) / std))
            mx = sum(math.cos(2 * math.pi * q["timestamp"].hour / 24) for q in past) / n
            my = sum(math.sin(2 * math.pi * q["timestamp"].hour / 24) for q in past) / n
            size = math.hypot(mx, my)
            diff = abs(math.atan2(my, mx) - 2 * math.pi * r["timestamp"].hour / 24) % (2 * math.pi)
            f["hour_deviation_user"] = min(diff, 2 * math.pi - diff) / math.pi * size if size > 0.1 else 0.0
        else:
            f["amount_zscore_user"] = f["hour_deviation_user"] = 0.0
        f["tx_count_1h"] = sum(age(q) <= 3600 for q in past)
        f["tx_count_24h"] = len(day)
        f["tx_count_7d"] = sum(seconds(past[-1]["timestamp"]) - seconds(q["timestamp"]) <= 7 * 86400 for q in past) if past else 0
        f["debit_count_1h"] = sum(age(q) <= 3600 and q["tx_type"] in DEBIT for q in past)
        f["log_debit_sum_24h"] = math.log1p(sum(q["amount_usd"] for q in day if q["tx_type"] in DEBIT))
        f["log_secs_since_last_tx"] = math.log1p(age(past[-1]) if past else 30 * 86400)
        f["failed_count_24h"] = sum(q["status"] != "SUCCESS" for q in day)
        uses = sum(q["device_id"] == r["device_id"] for q in past)
        f["is_new_device"] = float(n > 0 and uses == 0)
        f["log_device_prior_uses"] = math.log1p(uses)
        f["n_devices_user"] = len({q["device_id"] for q in past})
        f["device_n_users"] = min(len({q["user_id"] for q in by_device[r["device_id"]]} - {u}), 20)
        f["is_new_province"] = float(n > 0 and all(q["location_province"] != r["location_province"] for q in past))
        f["is_new_counterparty"] = float(wallet is not None and all(
            q["counterparty_id"] != wallet for q in past if q["tx_type"] in ("P2P_SEND", "P2P_RECEIVE")))
        f["counterparty_n_users"] = math.log1p(len({q["user_id"] for q in by_wallet[wallet]} - {u})) if wallet else 0.0
        agent = r["agent_id"]
        f["is_new_agent"] = float(agent is not None and all(q["agent_id"] != agent for q in past))
        f["agent_n_users_24h"] = math.log1p(len({q["user_id"] for q in by_agent[agent] if age(q) <= 86400} - {u})) if agent else 0.0
        f["is_new_merchant"] = float(r["merchant_id"] is not None and all(q["merchant_id"] != r["merchant_id"] for q in past))
        nights = sum(q["timestamp"].hour <= 5 for q in past)
        f["user_night_ratio"] = (nights + 0.05) / (n + 1)
        f["log_history_days"] = math.log1p(age(past[0]) / 86400) if past else 0.0
        f["log_user_tx_count"] = math.log1p(n)
        tops = [q for q in past if q["tx_type"] == "CARD_TOPUP" and q["status"] == "SUCCESS"]
        topped = r["tx_type"] == "CARD_PURCHASE" and tops
        f["log_mins_since_topup"] = math.log1p(age(tops[-1]) / 60) if topped else math.log1p(43200)
        f["purchase_to_topup_ratio"] = min(r["amount_usd"] / (tops[-1]["amount_usd"] + 1), 5.0) if topped else 0.0
        out[r["transaction_id"]] = f
        past.append(r)
        by_device[r["device_id"]].append(r)
        if wallet:
            by_wallet[wallet].append(r)
        if agent:
            by_agent[agent].append(r)
    return out


def ledger(rows, wallet0, card0):
    out, wallet, card = {}, defaultdict(lambda: wallet0), defaultdict(lambda: card0)
    for r in sorted(rows, key=lambda r: (r["timestamp"], r["transaction_id"])):
        u, a, kind = r["user_id"], r["amount_usd"], r["tx_type"]
        side = card if kind == "CARD_PURCHASE" else wallet
        before, status = side[u], "SUCCESS"
        if kind in ("P2P_RECEIVE", "CASH_IN"):
            wallet[u] += a
        elif a > before + 1e-9:
            status = "FAILED_INSUFFICIENT_FUNDS"
        else:
            side[u] -= a
            if kind == "CARD_TOPUP":
                card[u] += a
        out[r["transaction_id"]] = (round(before, 6), round(side[u], 6), status)
    return out
