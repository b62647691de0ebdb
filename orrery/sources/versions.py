"""Tables that change together, in versions: what a step writes is seen as a whole or not at all, and once.

A state is a folder of Parquet tables and small JSON files ``_versions/<n>.json`` that say which folder each table has in
version n.  A step reads one version, writes new tables beside the old ones, and makes the next version by one act that
fails where another step made it first.  A step that is lost on its way leaves files that no version names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.log_table import Changed, Log


class Versions:
    """The tables of one state."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.log = spark, Log(path)

    def current(self) -> tuple[int, dict[str, str]]:
        """The newest version and the folder of each of its tables; 0 and none at first."""
        now = self.log.current()
        return now["version"], {f["name"]: f["folder"] for f in now["files"]}

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        files = {f["name"]: f["folder"] for f in self.log.current(version)["files"]}
        return self.spark.read.parquet(f"{self.log.path}/{files[name]}") if name in files else None

    def commit(self, base: int, tables: dict[str, DataFrame]) -> int:
        """The next version after base, with these tables and the others as they were; Changed if there is one already."""
        files = {f["name"]: f["folder"] for f in self.log.current(base or None)["files"]} if base else {}
        for name, df in tables.items():
            files[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.log.path}/{files[name]}")
        self.log.publish(base + 1, 0, [{"name": n, "folder": f} for n, f in files.items()])
        return base + 1


Step = Callable[[Callable[[str], DataFrame | None]], tuple[dict[str, DataFrame], DataFrame]]


def once(state: Versions, slot: str, step: Step) -> DataFrame:
    """What is sent for a slot: step(read) gives changed tables and the rows to send, which are kept in table ``sent``.

    A slot that was sent gives the rows of that time again and changes nothing, so a run that is repeated sends nothing new
    and one that was lost before its version was made does all again.  Where another run made a version first, the step begins
    anew from that one.
    """
    while True:
        base, _ = state.current()
        sent = state.table("sent", base) if base else None
        if sent is not None and not (mine := sent.where(F.col("slot") == slot)).isEmpty():
            return mine
        tables, rows = step(lambda name, base=base: state.table(name, base) if base else None)
        rows = rows.withColumn("slot", F.lit(slot))
        try:
            state.commit(base, tables | {"sent": rows if sent is None else sent.unionByName(rows)})
        except Changed:
            continue
        return state.table("sent").where(F.col("slot") == slot)
