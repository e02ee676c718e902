"""A history table kept in parts, of which a daily run writes those that change."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions.casts import widen
from sediment.functions.columns import EFFECTIVE_FROM, IS_CURRENT
from sediment.operators.apply import live_rows
from sediment.operators.diff import Comparison, compare
from sediment.plans.materialize import Kept, children, exists

_RUN, _PART = "run_date", "opened_on"
_NEVER = "none"


class HistoryStore:
    """History of one table under ``path``, written run by run.

    ``closed/run_date=…`` has the rows that a run closed, appended under its date and never
    touched again. ``open/opened_on=…/run_date=…`` has the open rows by the day they were
    opened, as the given run left them: a run writes only the days that lost or got a row.
    ``commits/run_date=…`` says which run's files are valid for each day; it is written
    last. Files of a run without a commit are not read, and no file that an earlier commit
    names is changed, so a run that failed is simply repeated, and the last date can be
    repeated as often as wanted: it starts from the commit before it.

    Rows of one day are rewritten together, so what a run writes follows the days on which
    its changed rows were opened, and not the length of the history.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)

    # ---- Commits

    def dates(self) -> list[datetime.date]:
        """Committed run dates, oldest first."""
        folder = self._file("commits")
        names = [n for n in children(self.spark, folder) if n.startswith(f"{_RUN}=")]
        found = (datetime.date.fromisoformat(n.split("=")[1]) for n in names)
        return sorted(d for d in found if exists(self.spark, f"{folder}/{_RUN}={d}/_SUCCESS"))

    def _parts(self, day: datetime.date) -> dict[str, str]:
        """For each opening day the run whose files hold its open rows; a row per day."""
        rows = self.spark.read.schema(f"{_PART} string, {_RUN} string").parquet(
            self._file(f"commits/{_RUN}={day}")
        )
        return {r[_PART]: r[_RUN] for r in rows.collect()}

    def _file(self, name: str) -> str:
        return f"{self.path}/{name}"

    # ---- Reading

    def read(self, as_of: datetime.date | None = None) -> DataFrame:
        """The whole table as the last run left it, or the last one not after ``as_of``."""
        day = max((d for d in self.dates() if as_of is None or d <= as_of), default=None)
        if day is None:
            raise ValueError(f"No run is committed at {self.path}.")
        return self._state(day)

    def _state(self, day: datetime.date) -> DataFrame:
        opened = [self._file(f"open/{_PART}={p}/{_RUN}={r}") for p, r in self._parts(day).items()]
        closed = [self._file(f"closed/{_RUN}={d}") for d in self.dates() if d <= day]
        paths = [p for p in [*opened, *closed] if exists(self.spark, p)]
        sides = {flag: [p for p in paths if (p in opened) is flag] for flag in (True, False)}
        # Types may have been widened since a file was written.
        schema = self.spark.read.parquet(self._file(f"schemas/{_RUN}={day}")).schema
        frames = [
            self._read(group, schema, flag) for flag, files in sides.items() for group in self._alike(files) if group
        ]
        whole = self.spark.createDataFrame([], schema)
        for frame in frames:
            whole = whole.unionByName(frame)
        return whole

    def _alike(self, paths: list[str]) -> Iterable[list[str]]:
        """Paths in groups of one schema: that of the run which wrote them."""
        groups: dict[str, list[str]] = {}
        schemas: dict[str, str] = {}
        for path in paths:
            run = path.rsplit("=", 1)[1]
            if run not in schemas:
                schemas[run] = self.spark.read.parquet(self._file(f"schemas/{_RUN}={run}")).schema.json()
            groups.setdefault(schemas[run], []).append(path)
        return groups.values()

    def _read(self, paths: list[str], schema, current: bool) -> DataFrame:
        df = self.spark.read.parquet(*paths)
        types = {f.name: f.dataType for f in df.schema}

        def value(f) -> Column:
            if f.name == IS_CURRENT:
                return F.lit(current).alias(IS_CURRENT)
            if f.name not in types:
                return F.lit(None).cast(f.dataType).alias(f.name)
            return widen(F.col(f"`{f.name}`"), types[f.name], f.dataType).alias(f.name)

        return df.select(*[value(f) for f in schema])

    # ---- Writing

    def start(self, history: DataFrame, day: datetime.date) -> None:
        """Commit a whole history table as the state after ``day``; rows without a flag are dropped."""
        if self.dates():
            raise ValueError(f"There is a history at {self.path} already.")
        self._commit(day, history.filter(IS_CURRENT), history.filter(~F.col(IS_CURRENT)), history.schema, {})

    def before(self, day: datetime.date) -> DataFrame:
        """The state that a run on ``day`` starts from: that of the last commit before it."""
        dates = self.dates()
        if dates and dates[-1] > day:
            raise ValueError(f"{dates[-1]} is committed already; only the last date can be repeated.")
        earlier = [d for d in dates if d < day]
        if not earlier:
            raise ValueError(f"No run before {day} is committed at {self.path}.")
        return self._state(earlier[-1])

    def write(
        self, comparison: Comparison, day: datetime.date, delete_policy: str = "soft_delete",
        folder: str | None = None,
    ) -> None:
        """Write and commit what a comparison with the state ``before`` that day changes.

        Several jobs read the comparison, so it is best kept (``Comparison.materialized``).
        """
        earlier = max(d for d in self.dates() if d < day)
        with Kept() as kept:
            live = live_rows(comparison, day, delete_policy)
            if not comparison.unique:
                live = kept.materialize(live, folder)
            closing, opening = live.filter(~F.col(IS_CURRENT)), live.filter(IS_CURRENT)
            start = _day_name(F.col(EFFECTIVE_FROM)).alias(_PART)
            # A row per day on which a closed or a new row was opened.
            touched = {r[0] for r in closing.select(start).distinct().collect()} | {str(day)}
            valid = {p: r for p, r in self._parts(earlier).items() if p not in touched}
            changed = opening.filter(_day_name(F.col(EFFECTIVE_FROM)).isin(sorted(touched)))
            self._commit(day, changed, closing, live.schema, valid)

    def run(
        self, snapshot: DataFrame, day: datetime.date, *, delete_policy: str = "soft_delete",
        folder: str | None = None, **options,
    ) -> None:
        """Compare a snapshot with the state before ``day``, write the difference, commit it.

        ``options`` are those of ``compare``. Dates follow each other; the last one can be
        repeated.
        """
        with Kept() as kept:
            comparison = compare(snapshot, self.before(day), self.key, **options)
            self.write(comparison.materialized(folder, kept), day, delete_policy, folder)

    def _commit(self, day, opened: DataFrame, closed: DataFrame, schema, valid: dict[str, str]) -> None:
        run = F.lit(str(day)).alias(_RUN)
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(
            self._file(f"schemas/{_RUN}={day}")
        )
        closed.drop(IS_CURRENT).write.mode("overwrite").parquet(self._file(f"closed/{_RUN}={day}"))
        start = _day_name(F.col(EFFECTIVE_FROM)).alias(_PART)
        (
            opened.drop(IS_CURRENT).select("*", start, run)
            .repartition(_PART, F.pmod(F.xxhash64(*[f"`{k}`" for k in self.key]), F.lit(self._files())))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(_PART, _RUN).parquet(self._file("open"))
        )
        # A row per day that was written.
        written = {r[0] for r in opened.select(start).distinct().collect()}
        parts = [*valid.items(), *((p, str(day)) for p in written)]
        self.spark.createDataFrame(parts, f"{_PART} string, {_RUN} string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(self._file(f"commits/{_RUN}={day}"))

    def _files(self) -> int:
        """Files that a day's open rows may be dealt to: as many as tasks that write."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))


def _day_name(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(_NEVER))
