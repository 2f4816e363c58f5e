"""Alerts over two streams: a retail price jumps while the wholesale price stays flat.

Each form has the same meaning. At a retail price, the retail price before it is looked at if it is no older than `expiry`, beside the
wholesale price that was last known at either time. A rise of `jump` or more, with wholesale known both times and moved by `flat` at
most, is an alert. Prices of one instant go wholesale first, then by price.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: The state store that transformWithState needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ALERT = "at timestamp, prev_retail double, retail double, prev_wholesale double, wholesale double"


def both(retail: DataFrame, wholesale: DataFrame, key: str, at: str, price: str) -> DataFrame:
    """One table or stream of key, at, side (0 wholesale, 1 retail), price, without nulls."""
    side = lambda df, k: df.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.lit(k).alias("side"), F.col(price).cast("double").alias("price"))
    return side(retail, 1).unionByName(side(wholesale, 0)).filter("key is not null and at is not null and price is not null")


def jumps_batch(retail: DataFrame, wholesale: DataFrame, key: str, at: str, price: str, jump: float = 0.5, flat: float = 0.05, expiry_s: int = 48 * 3600) -> DataFrame:
    """key and the columns of ALERT over tables: one shuffle on the key."""
    w = Window.partitionBy("key").orderBy("at", "side", "price")
    rows = both(retail, wholesale, key, at, price)
    known = F.last(F.when(F.col("side") == 0, F.col("price")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("wholesale", known).filter("side = 1")
    r = r.select("key", "at", F.lag("price").over(w).alias("prev_retail"), F.col("price").alias("retail"), F.lag("wholesale").over(w).alias("prev_wholesale"), "wholesale", F.lag("at").over(w).alias("_before"))
    young = F.unix_micros("at") - F.unix_micros("_before") <= expiry_s * 1_000_000
    rise = (F.col("prev_retail") > 0) & (F.col("retail") >= F.col("prev_retail") * (1 + jump))
    still = (F.col("prev_wholesale") > 0) & (F.abs(F.col("wholesale") - F.col("prev_wholesale")) <= F.col("prev_wholesale") * flat)
    return r.filter(young & rise & still).drop("_before").withColumnRenamed("key", key)


class JumpWhileFlat(StatefulProcessor):
    """Two values a key (the retail price with its time and the wholesale price then; the wholesale price now), the rows that the watermark
    has not passed, and timers: one at each such row's time, one where the retail price is too old to be compared with."""

    def __init__(self, jump: float, flat: float, expiry_s: int):
        self.jump, self.flat, self.expiry = jump, flat, expiry_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.retail = handle.getValueState("retail", "price double, micros bigint, wholesale double")
        self.wholesale = handle.getValueState("wholesale", "price double, micros bigint")
        self.waiting = handle.getListState("waiting", "micros bigint, side int, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        mark, new = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            for micros, side, price in zip(batch["micros"].tolist(), batch["side"].tolist(), batch["price"].tolist(), strict=True):
                if micros // 1000 >= mark:  # what the watermark has passed is late
                    new.append((micros, side, price))
        if new:
            self.waiting.appendList(new)
            for ms in {m // 1000 + 1 for m, _, _ in new}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] // 1000 < mark], [r for r in rows if r[0] // 1000 >= mark]
        hits = []
        if ready:
            before = tuple(self.retail.get()) if self.retail.exists() else None
            known = tuple(self.wholesale.get()) if self.wholesale.exists() else None
            for micros, side, price in ready:
                if side == 0:
                    known = (price, micros)
                    continue
                now = known[0] if known else None
                if before and micros - before[1] <= self.expiry and before[0] > 0 and price >= before[0] * (1 + self.jump):
                    then = before[2]
                    if now is not None and then is not None and then > 0 and abs(now - then) <= then * self.flat:
                        hits.append((key[0], pd.Timestamp(micros, unit="us", tz="UTC"), before[0], price, then, now))
                before = (price, micros, now)
                self.handle.registerTimer((micros + self.expiry) // 1000 + 1)
            if before:
                self.retail.update(before)
            if known:
                self.wholesale.update(known)
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
        elif self.retail.exists() and (self.retail.get()[1] + self.expiry) // 1000 < mark:
            self.retail.clear()  # no price that is still to come can be compared with it
        return iter([pd.DataFrame(hits, columns=["key", "at", "prev_retail", "retail", "prev_wholesale", "wholesale"])] if hits else ())

    def close(self) -> None:
        pass


def jumps_stream(retail: DataFrame, wholesale: DataFrame, key: str, at: str, price: str, delay: str = "48 hours", jump: float = 0.5, flat: float = 0.05, expiry_s: int = 48 * 3600) -> DataFrame:
    """key and the columns of ALERT over streams, each price as the watermark passes it; needs the session to use STATE_STORE."""
    rows = both(retail.withWatermark(at, delay), wholesale.withWatermark(at, delay), key, at, price)
    out = T.StructType([T.StructField("key", retail.schema[key].dataType), *T.StructType.fromDDL(ALERT).fields])
    rows = rows.withColumn("micros", F.unix_micros("at"))
    return rows.groupBy("key").transformWithStateInPandas(JumpWhileFlat(jump, flat, expiry_s), out, "Append", "EventTime").withColumnRenamed("key", key)
