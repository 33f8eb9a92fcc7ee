"""Readings of option flow before an event, each against the one of the label before it, kept for 72 hours.

Tickers are dealt out to parts by hash, and a part's state holds the latest reading of
each label of its tickers. A batch reads and writes a part's state once and compares all
readings of the part as arrays: calls and requests to the state grow with parts, not with
tickers. Time is event time: a reading compares
with the former label's latest reading if that is at most 72 hours older, and a
reading is forgotten when the watermark has passed its 72 hours: by the next batch with
rows of its part, else by a timer. Readings of a
ticker in one batch are taken in the order of their time and id.

``FlowReadings`` is the form with a state, a map by label, for each ticker: a batch holds one
ticker's rows at a time, but a call of Python and its requests take about 10 ms each.

A reading without any measure compares with none; a measure of zero before gives
no trend. Null labels and labels without a former one have no reading before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The label before each, hours that a reading is kept, and bounds of a trend.
BEFORE = {"T-7": "T-14", "T-2": "T-7"}
KEPT_MS = 72 * 3600 * 1000
RISE, FALL = 1.1, 0.9
#: Parts that tickers are dealt out to; a stream that goes on from a checkpoint must have the same.
PARTS = 2048
#: What is kept of a reading: name, type and numpy's type.
KEPT = (("ticker", "string", object), ("label", "string", object), ("at", "long", "int64"), ("reading_id", "long", "int64"), ("measure", "double", "float64"))
OUT = "ticker string, reading_id long, label string, ts timestamp, measure double, before_id long, before double, trend string"


class FlowReadings(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "label string", "at long, reading_id long, measure double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the state of the key is read and written once, not at each reading: it has a label or a few
        kept = {label: value for (label,), value in self.kept.iterator()}
        new, out = set(), []
        for r in pd.concat(list(rows)).sort_values(["ts", "reading_id"]).itertuples():
            at = int(r.ts.value // 1_000_000) if r.ts.unit == "ns" else int(r.ts.timestamp() * 1000)
            measure = next((float(x) for x in (r.put_volume_ratio, r.put_call_ratio) if not pd.isna(x)), None)
            label = None if pd.isna(r.label) else r.label
            former = kept.get(BEFORE.get(label))
            before_id = before = None
            if former is not None and at - former[0] <= KEPT_MS:
                _, before_id, before = former
            change = measure / before if measure is not None and before is not None and before > 0 else 1.0
            out.append((key[0], r.reading_id, label, r.ts, measure, before_id, before, "INCREASING" if change > RISE else "DECREASING" if change < FALL else "STABLE"))
            if label is not None:
                kept[label] = (at, int(r.reading_id), measure)
                new.add(label)
        for label in new:
            self.kept.updateValue((label,), kept[label])
            self.handle.registerTimer(kept[label][0] + KEPT_MS + 1)
        made = pd.DataFrame(out, columns=["ticker", "reading_id", "label", "ts", "measure", "before_id", "before", "trend"])
        yield made.astype({"before_id": "Int64", "measure": "float64", "before": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for label, (at, _, _) in list(self.kept.iterator()):
            if at + KEPT_MS < now:
                self.kept.removeKey(label)
        return iter(())

    def close(self) -> None:
        pass


def compared(kept: list[np.ndarray], rows: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The rows, each with the one of the label before it, and what to keep: the latest reading of each label of a ticker.

    ``kept`` has the columns of ``KEPT``; what is kept is older than all rows.
    """
    ts = rows["ts"].to_numpy("datetime64[us]")
    put, call = (rows[c].to_numpy("float64") for c in ("put_volume_ratio", "put_call_ratio"))
    # a reading without a time neither compares nor is compared with
    label = np.where(np.isnat(ts), None, rows["label"].to_numpy(object))
    new = [rows["ticker"].to_numpy(object), label, ts.astype("int64") // 1000, rows["reading_id"].to_numpy("int64"), np.where(np.isnan(put), call, put)]
    ticker, label, at, reading_id, measure = both = [np.concatenate(c) for c in zip(kept, new, strict=True)]
    old = len(both[0]) - len(rows)
    ticker, (label, names) = pd.factorize(ticker)[0], pd.factorize(label)
    order = np.lexsort((reading_id, np.concatenate([kept[2] * 1000, ts.astype("int64")]), np.arange(len(at)) >= old, ticker))
    ticker, label, at, reading_id, measure = (c[order] for c in (ticker, label, at, reading_id, measure))
    place, code = np.arange(len(order)), {name: i for i, name in enumerate(names)}
    first = np.maximum.accumulate(np.where(np.diff(ticker, prepend=-2) != 0, place, 0))
    former = np.full(len(order), -1)
    for name, earlier in BEFORE.items():
        if name in code and earlier in code:
            former = np.where(label == code[name], np.maximum.accumulate(np.where(label == code[earlier], place, -1)), former)
    found = (former >= first) & (at - at[former] <= KEPT_MS)
    before = np.where(found, measure[former], np.nan)
    change = measure / np.where(before > 0, before, np.nan)
    trend = np.where(change > RISE, "INCREASING", np.where(change < FALL, "DECREASING", "STABLE")).astype(object)
    own = order >= old
    out = rows[["ticker", "reading_id", "label", "ts"]].iloc[order[own] - old].reset_index(drop=True)
    out = out.assign(measure=measure[own], before_id=pd.arrays.IntegerArray(reading_id[former][own], ~found[own]), before=before[own], trend=trend[own])
    named = place[label >= 0][::-1]
    latest = order[named[np.unique((ticker * (len(names) + 1) + label)[named], return_index=True)[1]]]
    return out, [c[latest] for c in both]


class PartReadings(StatefulProcessor):
    """The readings of a part's tickers, with one state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", ", ".join(f"{c} array<{t}>" for c, t, _ in KEPT))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get() or [[]] * len(KEPT)
        out, kept = compared([np.array(v, t) for v, (_, _, t) in zip(kept, KEPT, strict=True)], pd.concat(list(rows), ignore_index=True))
        at = kept[2]
        live = at + KEPT_MS >= timerValues.getCurrentWatermarkInMs()
        if live.any():
            self.kept.update(tuple(c[live].tolist() for c in kept))
            self.handle.registerTimer(int(at.max()) + KEPT_MS + 1)
        else:
            self.kept.clear()
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.kept.get()
        if kept is not None and max(kept[2]) + KEPT_MS < expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def flow_readings(readings: DataFrame, lateness: str = "3 days", parts: int | None = PARTS) -> DataFrame:
    """Each reading of the stream (ticker, reading_id, label, ts, put_volume_ratio, put_call_ratio) with the one before it and the trend.

    Without ``parts`` each ticker has a state of its own.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kept = readings.withWatermark("ts", lateness)
    if parts is None:
        return kept.groupBy("ticker").transformWithStateInPandas(FlowReadings(), OUT, "append", "eventTime")
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("ticker"), F.lit(parts)).cast("int")).groupBy("part")
    return dealt.transformWithStateInPandas(PartReadings(), OUT, "append", "eventTime")
