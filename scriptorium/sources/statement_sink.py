"""A data source writer that delivers statements to a graph database in batches, each of them once.

    spark.dataSource.register(statement_sink(send))
    delivery(statements).write.format("statements").option("run", run).mode("append").save()

A batch's id follows from the run, the task's partition and the batch's number in it; the rows of a partition and their order
follow from the data. So a task that is run again, or a whole run that is repeated under its name, sends the same batches under
the same ids, and a receiver that keeps the ids it has applied applies none twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Takes a batch's id and its statements, and applies them in one transaction unless it has applied that id before.
Send = Callable[[str, list[str]], None]


@dataclass
class Delivered(WriterCommitMessage):
    partition: int
    batches: int
    statements: int


def delivery(statements: DataFrame, parts: int = 64) -> DataFrame:
    """part, doc_id, block, idx, statement in the order of delivery: a document's statements stay together, and its part depends on its id alone."""
    rows = statements.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "block", "idx", "statement")
    return rows.repartitionByRange(parts, "part").sortWithinPartitions("part", "doc_id", "block", "idx", "statement")


def statement_sink(send: Send, finish: Callable[[str, bool, int], None] | None = None, name: str = "statements") -> type[DataSource]:
    """A data source class that writes with `send`. finish(run, ok, statements) is called once, on the driver, when all tasks are done or one has failed for good.

    Options: run (names the delivery; the same for a repetition), batch (statements, 500), tries (of a batch, 3), wait (seconds before the second try, doubled each time).
    """

    class Writer(DataSourceWriter):
        def __init__(self, options):
            if "run" not in options:
                raise ValueError("the option run names the delivery")
            self.run, self.size = options["run"], int(options.get("batch", 500))
            self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 0.5))

        def deliver(self, part: int, number: int, held: list[str]) -> None:
            for turn in range(self.tries):
                try:
                    return send(f"{self.run}/{part}/{number}", held)
                except Exception:
                    if turn + 1 == self.tries:
                        raise
                    time.sleep(self.wait * 2**turn)

        def write(self, iterator):
            """Batches end with their part, so that ids don't depend on how parts are dealt to tasks."""
            held: list[str] = []
            part, number, batches, total = -1, 0, 0, 0
            for row in iterator:
                if held and (row["part"] != part or len(held) >= self.size):
                    self.deliver(part, number, held)
                    held, number, batches = [], number + 1, batches + 1
                if row["part"] != part:
                    part, number = row["part"], 0
                held.append(row["statement"])
                total += 1
            if held:
                self.deliver(part, number, held)
                batches += 1
            return Delivered(part, batches, total)

        def commit(self, messages):
            if finish:
                finish(self.run, True, sum(m.statements for m in messages if m is not None))

        def abort(self, messages):
            if finish:
                finish(self.run, False, sum(m.statements for m in messages if m is not None))

    class Statements(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "part int, doc_id string, block int, idx int, statement string"

        def writer(self, schema, overwrite):
            return Writer(dict(self.options))

    return Statements
