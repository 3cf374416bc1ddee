"""Micro-batches in event-time order with carried state.

Every micro-batch runs a batch operator on the rows the watermark has passed, with
the state the previous batch left. Rows the watermark has not passed wait on
storage, so the order in which files arrive within the allowed delay does not
matter; rows behind the watermark go to a folder of their own. As the operators are
the batch ones, a key that floods the stream is spread over the cluster like in a
batch job, which one stateful task per key could not do.

All files of a batch lie in folders of their own and the batch's note is written
last. A batch that is repeated after a failure starts again from its predecessor's
files and overwrites its own, so nothing is lost or counted twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ready rows, carried state (None at first), watermark (None when flushing)
#: -> rows, with ``_open`` true for those to carry on.
Step = Callable[[DataFrame, DataFrame | None, int | None], DataFrame]

NOTE = T.StructType([
    T.StructField("batch", T.LongType()),
    T.StructField("previous", T.LongType()),
    T.StructField("watermark_us", T.LongType()),
    T.StructField("input_rows", T.LongType()),
    T.StructField("late_rows", T.LongType()),
    T.StructField("result_schema", T.StringType()),
    T.StructField("flushed", T.BooleanType()),
])


@dataclass
class CarryStream:
    spark: SparkSession
    path: str
    time: str
    delay_us: int
    step: Step
    after: Callable[[DataFrame, int], None] | None = None
    _note: Row | None = None

    def _place(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def notes(self) -> DataFrame:
        """One row per finished batch: rows in, rows too late, watermark."""
        return self.spark.read.schema(NOTE).json(f"{self.path}/notes/batch=*")

    def _last(self):
        """The note of the newest finished batch, kept after it was first read."""
        if self._note is None:
            jvm = self.spark.sparkContext._jvm
            root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/notes")
            if root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
                self._note = self.notes().orderBy(F.desc("batch")).first()
        return self._note

    def _read(self, kind: str, batch: int, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._place(kind, batch))

    def _run(self, batch: int, rows: DataFrame | None, schema: T.StructType, flush: bool) -> None:
        last = self._last()
        mark = last["watermark_us"] if last else None
        moment = F.col(self.time)
        total, newest, late = 0, None, 0
        if rows is not None:
            behind = (moment < mark) if mark is not None else F.lit(False)
            total, newest, late = rows.agg(
                F.count(F.lit(1)), F.max(moment), F.count_if(behind)
            ).first()
            if late:
                rows.where(behind).write.mode("overwrite").parquet(self._place("late", batch))
            rows = rows.where(~behind)
        new_mark = mark
        if newest is not None and (mark is None or newest - self.delay_us > mark):
            new_mark = newest - self.delay_us
        if last:
            held = self._read("held", last["batch"], schema)
            rows = held if rows is None else rows.unionByName(held)
        if rows is None:
            return
        passed = F.lit(True) if flush else (
            (moment < new_mark) if new_mark is not None else F.lit(False))
        state = None
        if last:
            carried = T.StructType.fromJson(json.loads(last["result_schema"]))
            state = self._read("result", last["batch"], carried).where("_open").drop("_open")
        result = self.step(rows.where(passed), state, None if flush else new_mark)
        shape = result.schema
        result.write.mode("overwrite").partitionBy("_open").parquet(self._place("result", batch))
        rows.where(~passed).write.mode("overwrite").parquet(self._place("held", batch))
        if self.after:
            self.after(self._read("result", batch, shape).where(~F.col("_open")).drop("_open"), batch)
        note = (batch, last["batch"] if last else None, new_mark, total, late, shape.json(), flush)
        written = self.spark.range(1).select(
            *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(note, NOTE)])
        written.coalesce(1).write.mode("overwrite").json(self._place("notes", batch))
        self._note = Row(*NOTE.names)(*note)

    def output(self) -> DataFrame:
        """Finished rows of all batches."""
        last = self._last()
        shape = T.StructType.fromJson(json.loads(last["result_schema"]))
        found = self.spark.read.schema(shape.add("batch", "long")).parquet(f"{self.path}/result")
        # A batch without a note is not finished and will be written again.
        return found.where(~F.col("_open") & (F.col("batch") <= last["batch"])).drop("_open", "batch")

    def still_open(self) -> DataFrame:
        """The rows that the newest finished batch carries on."""
        last = self._last()
        shape = T.StructType.fromJson(json.loads(last["result_schema"]))
        return self._read("result", last["batch"], shape).where("_open").drop("_open")

    def late(self, schema: T.StructType) -> DataFrame:
        """The rows of finished batches that came behind the watermark."""
        with_late = [r["batch"] for r in self.notes().where("late_rows > 0").select("batch").collect()]
        if not with_late:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._place("late", b) for b in with_late])

    def run_available(self, stream: DataFrame, flush: bool = True) -> None:
        """Process what is there, then finish the open rows too if ``flush``.

        A flush is the end of a job: what was still open is done, so nothing that
        comes later could be joined to it.
        """
        schema = stream.schema
        if self._last() is not None and self._last()["flushed"]:
            raise RuntimeError(f"the job in {self.path} was flushed and takes no more rows")

        def on_batch(rows: DataFrame, batch: int) -> None:
            done = self._last()
            if done is None or done["batch"] < batch:
                self._run(batch, rows, schema, flush=False)

        query = (
            stream.writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", f"{self.path}/offsets")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if flush:
            last = self._last()
            self._run(last["batch"] + 1 if last else 0, None, schema, flush=True)


def replay_files(df: DataFrame, time: str, path: str, parts: int = 4, shuffled: bool | Column = False) -> T.StructType:
    """Write a table as ``parts`` files of rising event time, one after the other.

    With ``shuffled`` each file mixes neighbouring time ranges; given as a condition, it
    names the rows that come a file later.
    """
    low, high = df.agg(F.min(time), F.max(time)).first()
    width = (high - low) // parts + 1
    slot = F.floor((F.col(time) - low) / width)
    if shuffled is not False:
        moved = F.pmod(F.xxhash64(time), F.lit(3)) == 0 if shuffled is True else shuffled
        slot = F.when(moved & (slot + 1 < parts), slot + 1).otherwise(slot)
    # The table is worked out once, by all tasks; what one task does per file is a copy.
    df.withColumn("_slot", slot.cast("long")).write.mode("overwrite").partitionBy("_slot").parquet(f"{path}-slots")
    schema = T.StructType([*df.schema.fields, T.StructField("_slot", T.LongType())])
    dealt = df.sparkSession.read.schema(schema).parquet(f"{path}-slots")
    for i in range(parts):
        dealt.where(F.col("_slot") == i).drop("_slot").coalesce(1).write.mode("append").parquet(path)
    return df.schema


def replay(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The files as a stream, one file per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
