"""What a front end stores and asks around a question: turns, users, what may be called a record, kept charts."""

from __future__ import annotations

import secrets
from collections import OrderedDict
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from .elt import upsert
from .query import DATE_AGGREGATIONS, Query
from .store import Store

TURN = "turn_id string, user_id string, session_id string, turn_index int, created_at timestamp, prompt string, response string, status string, resolved_json string, model string, error string, station_id string"
USER = "user_id string, username string, email string, display_name string, created_at timestamp, last_seen_at timestamp, is_active boolean, temp_unit string, home_location string"
LATE_DAYS = 3
KEPT_CHARTS = 50


def record_turn(store: Store, turn: dict[str, object], name: str = "chat_history") -> None:
    """Adds one turn to the stored history as files of its own; what is there isn't read or written again."""
    row = store.spark.createDataFrame([tuple(turn.get(c.split()[0]) for c in TURN.split(", "))], TURN)
    store.append(name, row)


def see_user(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users after some are seen: new ones are added (Fahrenheit unless they say else), known ones get the time,
    and what they left empty is filled."""
    new = seen.join(users.select("user_id"), "user_id", "left_anti").select("user_id", "username", "email", "display_name", F.col("seen_at").alias("created_at"), F.col("seen_at").alias("last_seen_at"), F.lit(True).alias("is_active"), F.coalesce("temp_unit", F.lit("F")).alias("temp_unit"), "home_location")
    fills = ("email", "display_name", "temp_unit", "home_location")
    s = seen.select("user_id", "seen_at", *[F.col(c).alias(f"s_{c}") for c in fills])
    known = users.join(s, "user_id", "left").withColumns({"last_seen_at": F.coalesce("seen_at", "last_seen_at")} | {c: F.coalesce(c, f"s_{c}") for c in fills}).select(*users.columns)
    return known.unionByName(new.select(*users.columns))


def set_prefs(users: DataFrame, user_id: str, temp_unit: str, home_location: str | None) -> DataFrame:
    """The user's unit and home, replaced; ValueError for a unit other than F or C."""
    if temp_unit not in ("F", "C"):
        raise ValueError("the unit is F or C")
    change = users.sparkSession.createDataFrame([(user_id, temp_unit, home_location)], "user_id string, temp_unit string, home_location string")
    return upsert(users, change.join(users.select("user_id"), "user_id", "left_semi"), ["user_id"])


def resolved_today(history: DataFrame, today: date) -> DataFrame:
    """One row: answered turns since midnight."""
    return history.filter((F.col("created_at") >= F.to_timestamp(F.lit(today.isoformat()))) & (F.col("status") == "resolved")).agg(F.count("*").alias("n"))


def holds_record(q: Query) -> bool:
    """Whether an answer may be called a record: an extreme or a date of the whole record, or days that met one."""
    if q.aggregation in ("record_high", "record_low"):
        return True
    return q.aggregation in ("max", "min", "top", "bottom", *DATE_AGGREGATIONS) and q.start == v.ALL_TIME


def meaningless(q: Query) -> str | None:
    """Why a valid query shouldn't be asked: the total of a metric that is averaged."""
    if v.NATURAL.get(q.metric or "") == "mean" and "sum" in (q.aggregation, q.period_aggregation):
        return f"a total of {q.metric} means nothing: use its mean" + ("; heating and cooling add up as HDD and CDD" if q.metric in v.TEMPERATURES else "")
    return None


def may_be_late(q: Query, today: date) -> bool:
    """Whether the last days of a period may not have come in yet; not of the whole record, nor of months without these days."""
    first = today - timedelta(days=LATE_DAYS)
    return (q.end or "") >= first.isoformat() and q.start != v.ALL_TIME and (not q.months or bool({first.month, today.month} & set(q.months)))


def spoken_of(made: dict[str, object]) -> dict[str, object]:
    """A payload without the rows that a sentence shouldn't list: of a ranking the first rank and the number of rows."""
    if made["aggregation"] not in ("top", "bottom"):
        return made
    rows = made["rows"]
    return {k: x for k, x in made.items() if k != "rows"} | {"rank_1": [r for r in rows if r["rank"] == 1], "table_rows": len(rows)}


class KeptCharts:
    """The latest charts' texts by a key that is hard to guess; older ones go."""

    def __init__(self, most: int = KEPT_CHARTS):
        self.most, self.held = most, OrderedDict()

    def keep(self, name: str, text: str) -> str:
        key = secrets.token_hex(4)
        self.held[key] = (name, text)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return key

    def read(self, key: str, name: str) -> str:
        """The text; KeyError if it isn't held under this name."""
        held = self.held.get(key)
        if held is None or held[0] != name:
            raise KeyError(f"{name} of {key}")
        return held[1]
