"""Sequential operators whose state depends on their own output, each one step function (state, row) -> (state, rows out).

A batch plan runs the step over each key's rows in arrival order (applyInPandas over an iterator of sorted rows); a stream runs the same step in
a stateful processor. State is a small dictionary, so both keep only that between rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def _frame(rows: list[dict], names: list[str], kinds: list[str]) -> pd.DataFrame:
    """Rows as pandas, with longs that may be null."""
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n, k in zip(names, kinds) if k == "long"})


def run_fold(df: DataFrame, key: list[str], order: list[str], step: Step, schema: str, finish: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """``step`` over each key's rows in order. Rows are sorted inside partitions by (key, order) and streamed, so no key's rows are gathered.

    Null keys form one key. Rows alike in order keep the order of their other columns. An empty input gives an empty output.
    """
    names, kinds = ([s.split()[i].strip("`") for s in schema.split(", ")] for i in (0, 1))

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, fresh = {}, None, True
        for pdf in batches:
            out: list[dict] = []
            for row in pdf.to_dict("records"):
                at = tuple(row[k] for k in key)
                if fresh or at != current:
                    if not fresh and finish:
                        out += finish(state)
                    state, current, fresh = {}, at, False
                state, more = step(state, row)
                out += more
            if out:
                yield _frame(out, names, kinds)
        if not fresh and finish and (tail := finish(state)):
            yield _frame(tail, names, kinds)

    rest = sorted(c for c, t in df.dtypes if c not in key + order and not t.startswith(("array", "map", "struct")))
    return df.repartition(*key).sortWithinPartitions(*key, *order, *rest).mapInPandas(over, schema)


def rate_limit(hz: float, per_id: dict[int, float] | None = None) -> Step:
    """A frame passes if 1e6 / hz microseconds lie between it and the last that passed; an identifier's own rate of 0 blocks it."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        limit = (per_id or {}).get(row["can_id"], hz)
        if limit <= 0 and row["can_id"] in (per_id or {}):
            return state, []
        if limit > 0 and "last" in state and row["ts_us"] - state["last"] < 1e6 / limit:
            return state, []
        return {"last": row["ts_us"]}, [{"frame_id": row["frame_id"], "can_id": row["can_id"], "ts_us": row["ts_us"]}]

    return step


def dead_band(threshold: float) -> Step:
    """A value is published if it lies at least ``threshold`` from the last published one."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        if "value" in state and abs(row["value"] - state["value"]) < threshold:
            return state, []
        return {"value": row["value"]}, [{"can_id": row["can_id"], "ts_us": row["ts_us"], "value": row["value"]}]

    return step


def ewma(alpha: float = 0.1) -> Step:
    """Exponentially weighted mean and variance, the mean moved before the score is taken."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        x = float(row["value"])
        if not state:
            state = {"mean": x, "var": 0.0}
            return state, [{"can_id": row["can_id"], "frame_id": row["frame_id"], "score": 0.0}]
        mean = state["mean"] + alpha * (x - state["mean"])
        var = (1 - alpha) * (state["var"] + alpha * (x - state["mean"]) ** 2)
        score = abs(x - mean) / var**0.5 if var > 1e-12 else 0.0
        return {"mean": mean, "var": var}, [{"can_id": row["can_id"], "frame_id": row["frame_id"], "score": round(score, 9)}]

    return step


def iso_tp(strict_ids: bool = True) -> Step:
    """Payloads out of single, first and consecutive frames of one identifier; a wrong sequence number drops the session. ``strict_ids``: only diagnostic identifiers."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        ident, data = row["can_id"], [int(x) for x in row["data"]]
        if strict_ids and not (ident == 0x7DF or 0x7E0 <= ident <= 0x7EF) or not data:
            return state, []
        kind, low = data[0] >> 4, data[0] & 0x0F
        done = lambda ts, payload: [{"can_id": ident, "ts_us": ts, "payload": bytes(payload).hex()}]
        if kind == 0:
            if not 0 < low <= len(data) - 1:
                return state, []
            return {}, done(row["ts_us"], data[1 : 1 + low])
        if kind == 1:
            total = low << 8 | data[1] if len(data) >= 8 else 0
            return (state, []) if total < 8 else ({"total": total, "seq": 1, "ts": row["ts_us"], "buf": data[2:8]}, [])
        if kind != 2 or not state:
            return state, []
        if low != state["seq"] & 0x0F:
            return {}, []
        buf = state["buf"] + data[1 : 1 + state["total"] - len(state["buf"])]
        if len(buf) >= state["total"]:
            return {}, done(state["ts"], buf)
        return state | {"seq": state["seq"] + 1, "buf": buf}, []

    return step


def can_tp(timeout_us: int = 1_000_000) -> Step:
    """The full transport layer: sequence numbers run 1 to 15, errors and sessions past the timeout give messages too, flow control is ignored."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        ident, data, now = row["can_id"], [int(x) for x in row["data"]], row["ts_us"]
        message = lambda ts, payload=b"", error="": {"can_id": ident, "ts_us": ts, "payload": bytes(payload).hex(), "error": error}
        out = []
        if state and now - state["last"] > timeout_us:
            out.append(message(state["ts"], error="CAN TP session timeout"))
            state = {}
        if not data:
            return state, out
        kind, low = data[0] >> 4, data[0] & 0x0F
        if kind == 0 and 0 < low <= min(7, len(data) - 1):
            return {}, [*out, message(now, data[1 : 1 + low])]
        if kind == 1 and len(data) >= 3 and (total := low << 8 | data[1]) >= 8:
            return {"total": total, "sn": 1, "ts": now, "last": now, "buf": data[2 : 2 + total]}, out
        if kind != 2 or not state:
            return state, out
        if low != state["sn"]:
            return {}, [*out, message(state["ts"], error=f"CAN TP sequence number error (expected {state['sn']}, got {low})")]
        buf = state["buf"] + data[1 : 1 + state["total"] - len(state["buf"])]
        if len(buf) >= state["total"]:
            return {}, [*out, message(state["ts"], buf)]
        return state | {"sn": state["sn"] % 15 + 1, "last": now, "buf": buf}, out

    return step


def segment(payload: bytes) -> list[bytes]:
    """The frames that carry a payload: one up to 7 bytes, else a first frame and consecutive ones; over 4095 bytes are cut off, none give none."""
    if len(payload) <= 7:
        return [bytes([len(payload)]) + payload] if payload else []
    total = min(len(payload), 4095)
    out = [bytes([0x10 | total >> 8, total & 0xFF]) + payload[:6]]
    for i, at in enumerate(range(6, total, 7)):
        out.append(bytes([0x20 | i % 15 + 1]) + payload[at : min(at + 7, total)])
    return out


def alerts(rules: list[dict[str, Any]]) -> Step:
    """New identifiers, lengths other than the first, and rates off the learnt one, as rules {name, type, percent}. State: the first length, a count, the last two times and the sum of 15 intervals."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        n, now, out = state.get("n", 0) + 1, row["ts_us"], []
        hit = lambda rule: out.append({"rule": rule["name"], "frame_id": row["frame_id"], "can_id": row["can_id"], "ts_us": now})
        for rule in rules:
            if rule["type"] == "NewCanId" and n == 1 or rule["type"] == "DlcChange" and n > 1 and row["dlc"] != state["dlc"]:
                hit(rule)
            if rule["type"] == "RateAnomaly" and n >= 18 and state["t1"] > state["t2"] and state["sum"] > 0:
                base = 15e6 / state["sum"]
                if abs(1e6 / (state["t1"] - state["t2"]) - base) / base * 100 > rule["percent"]:
                    hit(rule)
        total = state.get("sum", 0) + (now - state["t1"] if 2 <= n <= 16 else 0)
        return {"n": n, "dlc": state.get("dlc", row["dlc"]), "t1": now, "t2": state.get("t1", now), "sum": total}, out

    return step


def uds_sequence(steps: list[dict[str, Any]]) -> Step:
    """Requests and their answers over a trace. steps: {name, rx, sid, timeout_us, retries, stop}; each waits for its service's answer, a refusal or flow control, from the time the step before ended."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        state = state or {"at": 0, "since": row["ts_us"], "retries": 0}
        out = []
        while state["at"] < len(steps) and row["ts_us"] - state["since"] > steps[state["at"]]["timeout_us"]:
            s = steps[state["at"]]
            since = state["since"] + s["timeout_us"]
            if state["retries"] < s["retries"]:
                state = state | {"since": since, "retries": state["retries"] + 1}
            else:
                out.append({"step": s["name"], "status": "Timeout", "retries": state["retries"], "elapsed_us": s["timeout_us"]})
                state = {"at": state["at"] + 1, "since": since, "retries": 0}
        data = [int(x) for x in row["data"]]
        if state["at"] >= len(steps) or not data or row["can_id"] != steps[state["at"]]["rx"]:
            return state, out
        s = steps[state["at"]]
        positive, negative = data[0] == s["sid"] | 0x40, data[0] == 0x7F and len(data) >= 3 and data[1] == s["sid"]
        if not (positive or negative or data[0] & 0xF0 == 0x30):
            return state, out
        out.append({"step": s["name"], "status": "NegResponse" if negative and not positive else "Pass", "retries": state["retries"], "elapsed_us": row["ts_us"] - state["since"]})
        at = len(steps) if negative and not positive and s["stop"] else state["at"] + 1
        return {"at": at, "since": row["ts_us"], "retries": 0}, out

    return step


def liveness(deadlines: dict[int, float]) -> Step:
    """Offline and online events of identifiers with a learnt deadline in microseconds, seen from the frame that ends the gap."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        limit, out = deadlines.get(row["can_id"]), []
        if limit and state and row["ts_us"] - state["last"] > limit:
            out = [{"can_id": row["can_id"], "ts_us": int(state["last"] + limit), "event": "offline"}, {"can_id": row["can_id"], "ts_us": row["ts_us"], "event": "online"}]
        return {"last": row["ts_us"]}, out

    return step


def lin_feed(dlc: int, sync: int = 0x55) -> Step:
    """Frames out of a byte stream: bytes before a sync byte are skipped, a split frame waits for the rest."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        buf, out = state.get("buf", []) + [int(x) for x in row["data"]], []
        while len(buf) >= 4:
            if sync not in buf:
                buf = []
                break
            buf = buf[buf.index(sync) :]
            if len(buf) < dlc + 3:
                break
            out.append({"can_id": row["can_id"], "ts_us": row["ts_us"], "pid": buf[1], "payload": bytes(buf[2 : 2 + dlc]).hex(), "checksum": buf[2 + dlc]})
            buf = buf[dlc + 3 :]
        return {"buf": buf}, out

    return step


def head_pairs(near_us: int) -> Step:
    """The earlier recording's frames wait as heads; a frame of the other side pairs with the first head if the identifiers agree within ``near_us``, otherwise the earlier of the two is alone. On equal times side a goes first."""
    def alone(row: dict) -> dict:
        a = row["side"] == "a"
        return {"frame_a": row["frame_id"] if a else None, "frame_b": None if a else row["frame_id"], "status": "LeftOnly" if a else "RightOnly"}

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        wait, out = state.get("wait", []), []
        while wait and row["ts_us"] - wait[0]["ts_us"] >= near_us:
            out.append(alone(wait.pop(0)))
        while wait and wait[0]["side"] != row["side"]:
            head = wait[0]
            if head["can_id"] == row["can_id"]:
                a, b = (head, row) if head["side"] == "a" else (row, head)
                same = list(a["data"]) == list(b["data"])
                return {"wait": wait[1:]}, [*out, {"frame_a": a["frame_id"], "frame_b": b["frame_id"], "status": "Identical" if same else "Different"}]
            if row["side"] == "a" and head["ts_us"] == row["ts_us"]:
                return {"wait": wait}, [*out, alone(row)]
            out.append(alone(wait.pop(0)))
        return {"wait": [*wait, row]}, out

    return step


def merge_heads(df: DataFrame, near_us: int = 100_000) -> DataFrame:
    """Two recordings (column side: 'a' or 'b') compared head to head as head_pairs() does.

    Frames further apart than ``near_us`` never pair, so the merge may be cut at any such pause: each day's first pause starts a stretch that
    runs to the next one's, and stretches are compared in parallel.
    """
    from pyspark.sql import Window

    from framequarry.schema import seq_order

    rows = df.withColumn("day", F.expr("ts_us div 86400000000"))
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("day").orderBy(*seq_order(), "side"))
    starts = rows.withColumn("gap", gap).groupBy("day").agg(F.min(F.when(F.col("gap") >= near_us, F.col("ts_us"))).alias("pause"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("earlier", F.last(F.when(F.col("pause").isNotNull(), F.col("day")), ignorenulls=True).over(before))
    rows = rows.join(starts, "day").withColumn("stretch", F.when(F.col("ts_us") >= F.col("pause"), F.col("day")).otherwise(F.coalesce("earlier", F.lit(-1))))
    finish = lambda state: [{"frame_a": r["frame_id"] if r["side"] == "a" else None, "frame_b": None if r["side"] == "a" else r["frame_id"], "status": "LeftOnly" if r["side"] == "a" else "RightOnly"} for r in state.get("wait", [])]
    narrow = rows.select("stretch", "ts_us", "frame_id", "side", "can_id", "data")
    return run_fold(narrow, ["stretch"], ["ts_us", "frame_id"], head_pairs(near_us), "frame_a long, frame_b long, status string", finish)
