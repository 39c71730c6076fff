"""The 58 features on a stream, exact inside a micro-batch: every row sees all earlier rows of its user,
device, wallet and agent, also those of its own batch, and its user's blocked rows as failures.

Two stateful operators in a chain, each a map-side explode and one shuffle:

    crowd    key (kind, entity)   users of a device or wallet; users of an agent in the last 24 hours
    past     key user             the user's counters, prior uses of entities, rows of the last 7 days

What leaves a window is taken out by the row that comes after it; timers of the watermark take out what no
row comes after, so idle agents and users keep only what the features never forget (prior uses, sums).
Kept for good are one entry per (user, entity), per (wallet, user), at most 21 users per device, and one
row of counters per user: state grows with new relations, not with traffic. Every call to the state is a round
trip to the JVM, so entries are kept in buckets of some hundred (`Packed`), and a batch reads and writes the
buckets it touches, whatever a key holds. What an operator only hands on or takes apart itself passes it as JSON,
as Spark converts every column of every row one by one.

Rows of a key are taken in (time, id) order within a batch. A row older than ones of earlier batches is
late: it counts what arrived before it, its gaps are never negative, and beyond the watermark it is
dropped. Absent users are one user, absent devices and provinces are entities like any other. A key's rows
of one micro-batch are sorted in memory; bound the batch at the source (`maxFilesPerTrigger`,
`maxOffsetsPerTrigger`).
"""
from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paywarden.functions.columns import DAY_US, HOUR_US, epoch_us
from paywarden.operators.features import (AGENT, CENTS, DEVICE, INPUT_COLUMNS, MERCHANT, META_COLUMNS, PROVINCE, WALLET,
                                          _feature_columns, with_profile)
from paywarden.schema import DEBIT_TYPES, P2P_TYPES

WATERMARK = "1 day"
WEEK_US = 7 * DAY_US
DEVICE_USERS = 21                   # the feature counts 20 others at most
KINDS = [DEVICE, PROVINCE, WALLET, AGENT, MERCHANT]
TIME_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
SUMS = ["la_sum", "la_sq", "amt_sum", "sin_sum", "cos_sum"]
COUNTS = ["n", "nights", "devices", "past_c1h", "past_d1h", "past_c24h", "past_s24h", "past_f24h", "past_c7d"]
LATEST = ["buffer_7d", "last_us", "first_us", "topup_us"]
CARRIED = [("amount", "double"), ("la", "double"), ("cents", "long"), ("debit", "int"), ("night", "int"), ("sin", "double"),
           ("cos", "double"), ("topup", "int"), ("status", "string"), ("province", "string"), ("merchant", "string")]
DOUBLES = [n for n, t in CARRIED if t == "double"]
LINK = "kind string, entity string, who string, event_time timestamp, us long, id string, carried string, body string"
PAST = ("us long, action string, topup_usd double, "
        + ", ".join([*(f"{n} double" for n in SUMS), *(f"{n} long" for n in COUNTS + LATEST),
                     *(f"prior_{k} long" for k in KINDS), *(f"others_{k} long" for k in (DEVICE, WALLET, AGENT))]))
PAST_NAMES = [c.split()[0] for c in PAST.split(", ")]
STATE = [*SUMS, "n", "nights", "devices", *LATEST, "topup_usd"]
BUCKET = 256                        # entries of a bucket before there are twice as many buckets
LINKED = [*(c.split()[0] for c in LINK.split(", ")), "others"]
WHO, US, ID = (LINKED.index(n) for n in ("who", "us", "id"))
Linked = Row(*LINKED)
Past = Row("event_time", "body", "past")


def entity_key(kind: str, entity: str | None) -> str:
    return kind if entity is None else f"{kind}:{entity}"


def links(tx: DataFrame, extra: list[str]) -> DataFrame:
    """One row per device, wallet and agent a transaction touches; the device's row carries the transaction."""
    angle = 2 * F.pi() * F.hour("timestamp") / 24
    values = {
        "amount": F.col("amount_usd"), "la": F.log1p("amount_usd"), "cents": F.round(F.col("amount_usd") * CENTS).cast("long"),
        "debit": F.col("tx_type").isin(DEBIT_TYPES).cast("int"), "night": (F.hour("timestamp") <= 5).cast("int"),
        "sin": F.sin(angle), "cos": F.cos(angle), "topup": (F.col("tx_type") == "CARD_TOPUP").cast("int"), "status": F.col("status"),
        "province": F.col("location_province"), "merchant": F.col("merchant_id")}
    carried = {"carried": F.to_json(F.struct(*[values[n].cast(t).alias(n) for n, t in CARRIED])),
               "body": F.to_json(F.struct(*INPUT_COLUMNS, *extra), TIME_FORMAT)}

    def link(kind: str, entity: Column) -> Column:
        own = [c if kind == DEVICE else F.lit(None).cast("string") for c in carried.values()]
        return F.struct(F.lit(kind).alias("kind"), entity.alias("entity"), *[c.alias(n) for n, c in zip(carried, own)])

    rows = F.array(link(DEVICE, F.col("device_id")), link(WALLET, F.when(F.col("tx_type").isin(P2P_TYPES), F.col("counterparty_id"))),
                   link(AGENT, F.col("agent_id")))
    each = tx.select(F.coalesce("user_id", F.lit("")).alias("who"), F.col("timestamp").cast("timestamp").alias("event_time"),
                     epoch_us("timestamp").alias("us"), F.col("transaction_id").alias("id"),
                     F.inline(F.filter(rows, lambda r: r.entity.isNotNull() | (r.kind == DEVICE))))
    return each.select(*LINKED[:-1])


def carried_values(text: str) -> dict:
    """What `links` packed: absent values are null, numbers that JSON lacks are texts."""
    found = dict.fromkeys([n for n, _ in CARRIED]) | json.loads(text)
    for n in DOUBLES:
        if isinstance(found[n], str):
            found[n] = float(found[n])
    return found


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=itemgetter(US, ID))


def aligned_ms(us: int, step_us: int) -> int:
    """The end of the step behind a time, so that a key has a bounded number of timers."""
    return (us // step_us + 1) * step_us // 1000


class Packed:
    """Numbers by name in a map state of buckets. The key's number of names, which the caller keeps, gives the
    number of buckets: with twice as many names they are dealt anew, so a batch reads and writes no more than the
    buckets it touches."""

    SCHEMA = ("bucket int", "entries string")

    def __init__(self, state):
        self.state = state

    @staticmethod
    def buckets_for(n: int) -> int:
        return 1 << max(0, -(-n // BUCKET) - 1).bit_length()

    def open(self, n: int) -> None:
        """Of the key at hand, which holds `n` names."""
        self.stored = self.n = n
        self.buckets = self.buckets_for(n)
        self.held: dict[int, dict[str, int]] = {}
        self.changed: set[int] = set()

    def place(self, name: str) -> int:
        at = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.buckets
        if at not in self.held:
            found = self.state.getValue((at,)) if self.stored else None         # a new key has none
            self.held[at] = json.loads(found[0]) if found else {}
        return at

    def get(self, name: str) -> int | None:
        return self.held[self.place(name)].get(name)

    def put(self, name: str, value: int) -> None:
        entries = self.held[at := self.place(name)]
        self.n += name not in entries
        entries[name] = value
        self.changed.add(at)

    def drop(self, name: str) -> None:
        del self.held[at := self.place(name)][name]
        self.n -= 1
        self.changed.add(at)

    def all(self) -> dict[str, int]:
        if self.stored and len(self.held) < self.buckets:
            for (at,), (text,) in self.state.iterator():
                if at not in self.held:
                    self.held[at] = json.loads(text)
        return {name: value for entries in self.held.values() for name, value in entries.items()}

    def save(self) -> None:
        buckets = self.buckets_for(self.n)
        if buckets != self.buckets:
            entries = self.all()
            self.changed = set(range(max(buckets, self.buckets)))
            self.buckets, self.held = buckets, {at: {} for at in self.changed}
            for name, value in entries.items():
                self.held[self.place(name)][name] = value
        for at in sorted(self.changed):
            if self.held[at]:
                self.state.updateValue((at,), (json.dumps(self.held[at], separators=(",", ":")),))
            elif self.stored:
                self.state.removeKey((at,))


class Crowd(StatefulProcessor):
    """Others at a device, wallet or agent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.users = Packed(handle.getMapState("users", *Packed.SCHEMA))
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows, timerValues):
        kind, batch = key[0], in_order(rows)
        size = self.size.get()          # every call to the state is a round trip: none to ask whether it exists
        self.users.open(size[0] if size else 0)
        yield from self.at_agent(batch) if kind == AGENT else self.ever(kind, batch)
        self.save()

    def save(self) -> None:
        self.users.save()
        if self.users.n != self.users.stored:
            self.size.update((self.users.n,))

    def ever(self, kind: str, batch: list[Row]) -> Iterator[Row]:
        users = self.users
        for r in batch:
            known = users.get(r[WHO]) is not None
            yield Linked(*r, users.n - known)
            if not known and (kind != DEVICE or users.n < DEVICE_USERS):
                users.put(r[WHO], r[US])

    def at_agent(self, batch: list[Row]) -> Iterator[Row]:
        last = self.users.all()
        stored = dict(last)
        visits = deque(sorted((us, who) for who, us in last.items()))
        for r in batch:
            at, own = r[US], r[WHO]
            while visits and visits[0][0] < at - DAY_US:
                us, who = visits.popleft()
                if last.get(who) == us:
                    del last[who]
            yield Linked(*r, len(last) - (own in last))
            if at >= last.get(own, at):
                last[own] = at
                visits.append((at, own))
        for who in stored.keys() - last.keys():
            self.users.drop(who)
        for who, us in last.items():
            if stored.get(who) != us:
                self.users.put(who, us)
        if last:
            self.handle.registerTimer(aligned_ms(max(last.values()) + DAY_US, HOUR_US))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        gone = timerValues.getCurrentWatermarkInMs() * 1000 - DAY_US
        size = self.size.get()
        self.users.open(size[0] if size else 0)
        for who in [who for who, us in self.users.all().items() if us < gone]:
            self.users.drop(who)
        self.save()
        return iter([])

    def close(self) -> None:
        pass


class UserPast(StatefulProcessor):
    """The running past of a user; `decide(row, past)` gives the action on a row whose status isn't known."""

    def __init__(self, decide: Callable[[dict, dict], str] | None):
        self.decide = decide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = ", ".join(f"{n} {'double' if n in SUMS or n == 'topup_usd' else 'long'}" for n in STATE)
        self.counters = handle.getValueState("counters", f"{kinds}, entities long")
        self.uses = Packed(handle.getMapState("uses", *Packed.SCHEMA))
        self.recent = handle.getValueState("recent", "rows string")     # us, cents, debit, failed

    def handleInputRows(self, key, rows, timerValues):
        linked: dict[str, dict[str, tuple]] = {}
        batch = []
        for r in rows:
            kind, entity, _, _, _, id, _, body, others = r
            linked.setdefault(id, {})[kind] = (entity, others)
            if body is not None:
                batch.append(r)
        counters = self.counters.get()
        s = dict(zip(STATE, counters)) if counters else {
            n: 0.0 if n in SUMS else 0 if n in ("n", "nights", "devices") else None for n in STATE}
        kept = self.recent.get() if counters else None
        recent = deque(map(tuple, json.loads(kept[0]))) if kept else deque()
        uses = self.uses
        uses.open(counters[-1] if counters else 0)

        def use(entity: str) -> int:
            """Earlier uses; counts this one."""
            n = uses.get(entity) or 0
            uses.put(entity, n + 1)
            return n

        for r in in_order(batch):
            _, entity, who, event_time, at, id, carried, body, others = r
            v = carried_values(carried)
            own = linked[id]
            while recent and recent[0][0] < at - WEEK_US:
                recent.popleft()
            row = {"who": who, "event_time": event_time, "us": at, "id": id, "body": body, **s}
            c7d = c24h = f24h = s24h = c1h = d1h = 0
            for us, cents, debit, failed in reversed(recent):
                if us < at - WEEK_US:
                    break
                c7d += 1
                if us >= at - DAY_US:
                    c24h += 1
                    f24h += failed
                    s24h += cents if debit else 0
                if us >= at - HOUR_US:
                    c1h += 1
                    d1h += debit
            row |= {"past_c1h": c1h, "past_d1h": d1h, "past_c24h": c24h, "past_s24h": s24h, "past_f24h": f24h, "past_c7d": c7d}
            touched = {DEVICE: entity_key(DEVICE, entity), PROVINCE: entity_key(PROVINCE, v["province"])}
            touched |= {k: entity_key(k, own[k][0]) for k in (WALLET, AGENT) if k in own}
            if v["merchant"] is not None:
                touched[MERCHANT] = entity_key(MERCHANT, v["merchant"])
            for k in KINDS:
                row[f"prior_{k}"] = use(touched[k]) if k in touched else None
            for k in (DEVICE, WALLET, AGENT):
                row[f"others_{k}"] = own[k][1] if k in own else None
            if row["prior_D"] == 0:
                s["devices"] += 1
            row["devices"] = s["devices"]
            action = None
            if v["status"] is None:
                whole = {"kind": DEVICE, "entity": entity, "who": who, "event_time": event_time, "us": at, "id": id, **v, "body": body, "others": others}
                action = self.decide(whole, row) if self.decide else "APPROVE"
            row["action"] = action
            yield Past(event_time, body, json.dumps({n: row[n] for n in PAST_NAMES}))

            success = v["status"] == "SUCCESS" if v["status"] is not None else action != "BLOCK"
            amount, la = (0.0 if x is None else x for x in (v["amount"], v["la"]))
            s["n"] += 1
            s["la_sum"] += la
            s["la_sq"] += la * la
            s["amt_sum"] += amount
            s["nights"] += v["night"] or 0
            s["sin_sum"] += v["sin"] or 0.0
            s["cos_sum"] += v["cos"] or 0.0
            s["buffer_7d"] = c7d + 1
            s["last_us"] = at if s["last_us"] is None else max(s["last_us"], at)
            s["first_us"] = at if s["first_us"] is None else min(s["first_us"], at)
            if v["topup"] and success:
                s["topup_us"], s["topup_usd"] = at, v["amount"]
            recent.append((at, v["cents"] or 0, v["debit"] or 0, int(not success)))
            if len(recent) > 1 and recent[-2][0] > at:        # a late row takes its place
                recent = deque(sorted(recent))
        uses.save()
        self.counters.update((*(s[n] for n in STATE), uses.n))
        if recent:
            self.recent.update((json.dumps(list(recent), separators=(",", ":")),))
            self.handle.registerTimer(aligned_ms(recent[-1][0] + WEEK_US, DAY_US))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        gone = timerValues.getCurrentWatermarkInMs() * 1000 - WEEK_US
        kept = self.recent.get()
        if kept:
            rows = json.loads(kept[0])
            left = [r for r in rows if r[0] >= gone]
            if not left:
                self.recent.clear()
            elif len(left) < len(rows):
                self.recent.update((json.dumps(left, separators=(",", ":")),))
        return iter([])

    def close(self) -> None:
        pass


def online_features(tx: DataFrame, users: DataFrame, period_start: str, decide: Callable[[dict, dict], str] | None = None, *,
                    extra: tuple[str, ...] = (), watermark: str = WATERMARK, precise: bool = False) -> DataFrame:
    """Meta columns, `known_user`, `action` and the 58 features of a stream of transactions, as
    `build_features` gives them for the whole table.

    `decide(row, past)` sees a row's own values and its running past, and returns APPROVE, VERIFY or BLOCK
    where the status is null; a block counts as a failure for the rows that follow, at once. `users` is a
    static table.
    """
    wanted = [n for n in ("is_fraud", "fraud_type") if n in tx.columns and n not in extra] + list(extra)
    carried = [n for n in wanted if n not in INPUT_COLUMNS]
    kept = tx.select(*INPUT_COLUMNS, *carried)
    body = kept.select(F.struct("*").alias("b")).schema["b"].dataType
    touched = links(kept, carried).withWatermark("event_time", watermark)
    crowd = touched.groupBy("kind", "entity").transformWithState(
        Crowd(), outputStructType=f"{LINK}, others long", outputMode="append", timeMode="EventTime", eventTimeColumnName="event_time")
    past = crowd.groupBy("who").transformWithState(
        UserPast(decide), outputStructType="event_time timestamp, body string, past string", outputMode="append", timeMode="EventTime", eventTimeColumnName="event_time")
    past = past.select("body", F.from_json("past", PAST).alias("past")).select("body", "past.*")
    history = past.withColumns({
        "tx": F.from_json("body", body, TIME_FORMAT), "at": F.col("us"),
        "topup": F.when(F.col("topup_us").isNotNull(), F.struct(F.col("topup_us").alias("us"), F.col("topup_usd").alias("usd")))})
    history = with_profile(history.withColumn("user_id", F.col("tx.user_id")), users)
    features = _feature_columns(epoch_us(F.lit(period_start).cast("timestamp_ntz")))
    kind = "double" if precise else "float"
    meta = [n for n in META_COLUMNS if n in INPUT_COLUMNS or n in carried]
    return history.select(*[F.col(f"tx.{n}").alias(n) for n in meta], *[F.col(f"tx.{n}").alias(n) for n in wanted if n not in meta],
                          "known_user", "action", *[c.cast(kind).alias(n) for n, c in features.items()])
