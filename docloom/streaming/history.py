"""The history of results and the log: what micro-batches leave behind, however often they run.

A history is a folder of snapshots. A batch writes its snapshot beside the others and then names it current by one rename, so that a
reader sees the state before or after a batch and nothing between. A snapshot carries the number of its batch: a batch that
runs again changes nothing. A snapshot that can't be read is an empty history, as is a folder without one.
"""

from __future__ import annotations

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schemas as S
from docloom.operators import validate
from docloom.operators.ordered import in_order

#: An entry: whose it is, its id, when it was saved (microseconds) and the result as JSON.
ENTRY = "scope string, id string, saved_at bigint, result string"
#: A change: add (an entry), remove (an id) or clear, in the order of saved_at and pos within a batch.
CHANGE = ENTRY + ", action string, pos bigint"


class Kept:
    """One scope's entries, the newest first: at most `most`, one for each id."""

    def __init__(self, most: int):
        self.most, self.scope, self.entries = most, None, []

    def rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
        for e in pdf.itertuples(index=False):
            self.scope = e.scope
            if e.action == "clear":
                self.entries = []
                continue
            own = [x for x in self.entries if x[0] == e.id]
            self.entries = [x for x in self.entries if x[0] != e.id]
            if e.action == "add":
                new = (e.id, int(e.saved_at), e.result)
                self.entries.append(max(own + [new], key=lambda x: x[1]))
                self.entries.sort(key=lambda x: -x[1])
                self.entries = self.entries[: self.most]
        return pd.DataFrame(columns=["scope", "id", "saved_at", "result"])

    def close(self) -> pd.DataFrame:
        return pd.DataFrame([(self.scope, *x) for x in self.entries], columns=["scope", "id", "saved_at", "result"])


def changed(entries: DataFrame, changes: DataFrame, most: int = S.HISTORY_SIZE) -> DataFrame:
    """ENTRY of a history after changes (CHANGE). What has fallen out of the newest `most` does not come back when others go.
    An add with an older time than its id already has is no news. Unknown actions, and changes without a scope or time, say nothing."""
    known = F.col("action").isin("add", "remove", "clear") & F.col("scope").isNotNull() & F.col("saved_at").isNotNull() & (F.col("id").isNotNull() | (F.col("action") == "clear"))
    names = [c.split()[0] for c in CHANGE.split(", ")]
    before = entries.select("scope", "id", "saved_at", "result", F.lit("add").alias("action"), F.lit(-1).cast("bigint").alias("pos"))
    # what is there already comes first, whatever its time
    rows = before.withColumn("turn", F.lit(0)).unionByName(changes.where(known).select(*names).withColumn("turn", F.lit(1)))
    return in_order(rows, ["scope"], ["turn", "saved_at", "pos"], lambda: Kept(most), ENTRY)


class Store:
    """A history below a folder. `apply` is for foreachBatch."""

    def __init__(self, spark: SparkSession, path: str, most: int = S.HISTORY_SIZE):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int | None:
        """The number of the current snapshot: the largest one that has been named."""
        fs, top = self._fs("current")
        if not fs.exists(top):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(top)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def read(self) -> DataFrame:
        version = self.version()
        empty = self.spark.createDataFrame([], ENTRY)
        if version is None:
            return empty
        try:
            found = self.spark.read.schema(ENTRY).parquet(f"{self.path}/snapshot-{version}")
            found.write.format("noop").mode("overwrite").save()  # reading is where a broken file shows
            return found
        except (PySparkException, Py4JJavaError) as e:
            # a file that is broken or gone is no history; whatever else has failed must not pass for that
            if not any(code in str(e) for code in ("FAILED_READ_FILE", "CANNOT_READ_FILE", "PATH_NOT_FOUND")):
                raise
            return empty

    def write(self, entries: DataFrame, version: int) -> None:
        entries.coalesce(max(1, min(64, entries.sparkSession.sparkContext.defaultParallelism))).write.mode("overwrite").parquet(f"{self.path}/snapshot-{version}")
        fs, draft = self._fs(f"draft-{version}")
        fs.create(draft, True).close()
        _, named = self._fs(f"current/{version}")
        fs.mkdirs(named.getParent())
        if not fs.rename(draft, named) and not fs.exists(named):
            raise OSError(f"{self.path}: snapshot {version} could not be named")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """The changes of one batch; those of a batch that is in the history already are left out."""
        version = self.version()
        if version is None or version < batch:
            self.write(changed(self.read(), changes, self.most), batch)

    def clean(self, keep: int = 2) -> None:
        """Delete all snapshots but the last ones."""
        fs, top = self._fs("current")
        if fs.exists(top):
            for n in sorted(int(f.getPath().getName()) for f in fs.listStatus(top))[:-keep]:
                for name in (f"current/{n}", f"snapshot-{n}"):
                    fs.delete(self._fs(name)[1], True)


AMOUNT, DATE = S.AMOUNT, S.DATE
#: What of a result is looked at before it is shown again.
STORED = (
    "document struct<fileName:string,pages:int,language:string,type:string,title:string,date:string>, summary string, keyPoints array<string>, "
    f"entities struct<organizations:array<string>,people:array<string>>, amounts array<{AMOUNT}>, dates array<{DATE}>, keywords array<string>"
)


def decoded(stored: DataFrame, raw: Column) -> DataFrame:
    """scope, id, saved_at, result, place of the entries in texts of untrusted JSON (one a scope): what is no list is an empty one, and what
    is no entry, or has a result that breaks a rule, is left out."""
    v = F.try_parse_json(raw)
    lists = stored.select("scope", F.when(F.schema_of_variant(v).startswith("ARRAY"), v).alias("v")).where("v is not null")
    items = lists.lateralJoin(stored.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("place", "key", "item"))
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get("item", f"$.{name}", "variant")) == "STRING", F.try_variant_get("item", f"$.{name}", "string"))
    d = items.select("scope", "place", text("id").alias("id"), text("savedAt").alias("saved"), F.to_json(F.try_variant_get("item", "$.result", "variant")).alias("result"))
    iso = F.col("saved").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$")
    d = d.where(iso & (F.col("id") != "") & F.col("result").isNotNull()).withColumn("saved_at", F.unix_micros(F.try_to_timestamp("saved")))
    checked = d.where("saved_at is not null").withColumn("r", F.from_json("result", STORED)).where("r.document is not null").select("*", "r.*")
    whole = F.col("keyPoints").isNotNull() & F.col("amounts").isNotNull() & F.col("dates").isNotNull() & F.col("keywords").isNotNull()
    good = checked.where(whole).withColumn("issues", validate.result_issues()).where(F.size("issues") == 0)
    return good.select("scope", "id", "saved_at", "result", "place")


#: What the log may say of each event. Nothing else of an event is ever written.
LOG_FIELDS = {
    "request": "requestId method route status ms".split(),
    "ai_call": "requestId model attempt status ms outcome".split(),
    "error": "requestId code detail".split(),
}


def log_lines(events: DataFrame) -> DataFrame:
    """event, line: events (event, ...) as JSON with the fields above; other events and other columns are not logged. Columns that events
    lack are null; nulls are left out of a line but for `detail`."""
    have = {f.name for f in events.schema.fields}
    field = lambda c: (F.col(c) if c in have else F.lit(None).cast(T.StringType())).alias(c)
    line = F.lit(None).cast("string")
    for kind, fields in LOG_FIELDS.items():
        body = F.struct(F.col("event"), *map(field, fields))
        line = F.when(F.col("event") == kind, F.to_json(body, {"ignoreNullFields": str(kind != "error").lower()})).otherwise(line)
    return events.select("event", line.alias("line")).where("line is not null")


def write_log(events: DataFrame, path: str, batch: int) -> None:
    """The lines of one batch, in a folder of its own, which a batch that runs again replaces."""
    log_lines(events).select("line").write.mode("overwrite").text(f"{path.rstrip('/')}/batch={batch}")
