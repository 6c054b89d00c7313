"""Tables as chains of snapshots: DDL, DML, constraints, commit and revert.

A version is immutable. A table without a path keeps it as a frame. A stored one (``table_log``) keeps files: statements
leave files alone that hold no row for them, and a commit writes only rows of the others. Writers don't wait for each
other: who commits a version second takes the first one's version, repeats its own statements on it and tries again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.operators import table_log as log

Range = Mapping[str, tuple[Any, Any]]


class ConstraintError(ValueError):
    """A staged version breaks a constraint of its table."""


class SchemaError(ValueError):
    """A statement names a column that isn't there, or one that is there already."""


class ConflictError(RuntimeError):
    """Other writers kept committing first."""


@dataclass(frozen=True)
class Constraints:
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    primary_key: str | None = None
    autoincrement: bool = False


@dataclass(frozen=True)
class State:
    """Rows of a version: those of ``files``, and ``loose`` ones that are in no file yet.

    ``stored`` names the columns in files, so that a renamed column needs no new files and one that is added under the
    name of a dropped one doesn't find its values; ``used`` are all names that files may hold.
    """

    loose: DataFrame
    files: tuple[log.FileNote, ...] = ()
    next_id: int = 1
    stored: Mapping[str, str] = field(default_factory=dict)
    used: frozenset[str] = frozenset()

    @property
    def schema(self) -> T.StructType:
        return self.loose.schema


def _new_state(rows: DataFrame, next_id: int = 1) -> State:
    return State(rows, (), next_id, {c: c for c in rows.columns}, frozenset(rows.columns))


@dataclass
class Table:
    """One table; statements stage a new version, ``commit`` publishes it, ``revert`` forgets it."""

    spark: SparkSession
    name: str
    constraints: Constraints
    committed: State
    path: str | None = None
    version: int = 0
    staged: State | None = field(default=None)
    statements: list[Callable[[Table], None]] = field(default_factory=list)

    @classmethod
    def create(cls, spark: SparkSession, name: str, schema: str | T.StructType, constraints: Constraints | None = None, path: str | None = None) -> Table:
        return cls(spark, name, constraints or Constraints(), _new_state(spark.createDataFrame([], schema)), path)

    @classmethod
    def of(cls, name: str, rows: DataFrame, constraints: Constraints | None = None, path: str | None = None) -> Table:
        """A table over existing rows."""
        held = constraints or Constraints()
        next_id = 1
        if held.autoincrement and held.primary_key:
            next_id = (rows.agg(F.max(held.primary_key)).first()[0] or 0) + 1
        return cls(rows.sparkSession, name, held, _new_state(rows, next_id), path)

    @classmethod
    def open(cls, spark: SparkSession, name: str, path: str, constraints: Constraints | None = None, version: int | None = None) -> Table:
        """A committed version at ``path``, the last one if none is named. No rows are read."""
        note, files = log.read_note(spark, path, version)
        empty = spark.createDataFrame([], T.StructType.fromJson(note["schema"]))
        state = State(empty, files, note["next_id"], note["stored"], frozenset(note["used"]))
        return cls(spark, name, constraints or Constraints(), state, path, note["version"])

    @property
    def state(self) -> State:
        return self.staged or self.committed

    @property
    def rows(self) -> DataFrame:
        """The rows as the writer sees them."""
        return self._with_loose(self.state.files)

    def _from_files(self, files: Sequence[log.FileNote]) -> DataFrame:
        """Rows of files under the present names, with the name of their file."""
        state = self.state
        schema = T.StructType([T.StructField(state.stored[f.name], f.dataType) for f in state.schema])
        columns = [F.col(f"`{state.stored[f.name]}`").alias(f.name) for f in state.schema]
        return log.read_files(self.spark, self.path, files, schema).select(*columns, F.col("_metadata.file_name").alias("_file"))

    def _with_loose(self, files: Sequence[log.FileNote]) -> DataFrame:
        return self._from_files(files).drop("_file").unionByName(self.state.loose) if files else self.state.loose

    def _stage(self, rows: DataFrame, **changes) -> None:
        self.staged = replace(self.state, loose=rows, **changes)

    def _do(self, statement: Callable[[Table], None]) -> Table:
        """Carry out a statement and remember it for a repeat on another version."""
        statement(self)
        self.statements.append(statement)
        return self

    def _known(self, *columns: str) -> None:
        missing = [c for c in columns if c not in self.state.schema.names]
        if missing:
            raise SchemaError(f"no column {', '.join(missing)} in {self.name}")

    def _part(self, where: Column | None, within: Range | None) -> tuple[Column | None, list[log.FileNote], list[log.FileNote]]:
        """The whole condition, the files with rows for which it is true, and the others.

        Bounds in the notes rule files out by ``within``; the rest are scanned for the columns of the condition alone.
        """
        for column, (low, high) in (within or {}).items():
            self._known(column)
            value = F.col(f"`{column}`")
            for part in ([] if low is None else [value >= low]) + ([] if high is None else [value <= high]):
                where = part if where is None else where & part
        state = self.state
        near = [f for f in state.files if all(f.may_hold(state.stored[c], *ends) for c, ends in (within or {}).items())]
        if where is not None and near:
            hit = {r["_file"] for r in self._from_files(near).filter(where).select("_file").distinct().collect()}
            near = [f for f in near if f.name.rsplit("/", 1)[1] in hit]
        return where, near, [f for f in state.files if f not in near]

    # ---- schema: no statement of these reads or writes rows

    def add_column(self, column: str, kind: str) -> Table:
        def run(t: Table) -> None:
            if column in t.state.schema.names:
                raise SchemaError(f"{column} is in {t.name} already")
            held, name = t.state, column
            while name in held.used:
                name += "_"
            t._stage(held.loose.withColumn(column, F.lit(None).cast(kind)), stored={**held.stored, column: name}, used=held.used | {name})

        return self._do(run)

    def rename_column(self, old: str, new: str) -> Table:
        def run(t: Table) -> None:
            t._known(old)
            if new in t.state.schema.names:
                raise SchemaError(f"{new} is in {t.name} already")
            stored = {new if c == old else c: n for c, n in t.state.stored.items()}
            t._stage(t.state.loose.withColumnRenamed(old, new), stored=stored)

        self._do(run)
        swap = lambda names: tuple(new if c == old else c for c in names)
        c = self.constraints
        self.constraints = replace(c, not_null=swap(c.not_null), unique=swap(c.unique), primary_key=new if c.primary_key == old else c.primary_key)
        return self

    def drop_column(self, column: str) -> Table:
        def run(t: Table) -> None:
            t._known(column)
            t._stage(t.state.loose.drop(column), stored={c: n for c, n in t.state.stored.items() if c != column})

        if column == self.constraints.primary_key:
            raise ConstraintError(f"{column} is the key of {self.name}")
        return self._do(run)

    def truncate(self) -> Table:
        return self.delete()

    # ---- rows

    def insert(self, values: Sequence[Sequence] | DataFrame, columns: Sequence[str] | None = None) -> Table:
        """Append rows. Columns left out are null, but a key that counts up gets the next numbers in order of input."""
        return self._do(lambda t: t._insert(values, columns))

    def _insert(self, values: Sequence[Sequence] | DataFrame, columns: Sequence[str] | None) -> None:
        held = self.state
        columns = list(columns or held.schema.names)
        self._known(*columns)
        if isinstance(values, DataFrame):
            new = values.toDF(*columns).withColumn("_at", F.monotonically_increasing_id())
        else:
            nullable = T.StructType([T.StructField(c, held.schema[c].dataType, True) for c in columns])
            new = self.spark.createDataFrame([(*v, k) for k, v in enumerate(values)], T.StructType([*nullable.fields, T.StructField("_at", T.LongType())]))
        key, next_id = self.constraints.primary_key, held.next_id
        if self.constraints.autoincrement and key:
            if key not in columns:
                # Blocks of the input get their offsets from counts, so no task numbers all rows.
                new = new.withColumn("_block", F.shiftright("_at", 33))
                before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
                starts = new.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
                within = F.row_number().over(Window.partitionBy("_block").orderBy("_at"))
                new = new.join(starts, "_block").withColumn(key, (F.col("_start") + within + (next_id - 1)).cast(held.schema[key].dataType)).drop("_block", "_start")
            highest = new.agg(F.max(key)).first()[0]
            next_id = max(next_id, (highest or 0) + 1)
        self._stage(held.loose.unionByName(new.drop("_at"), allowMissingColumns=True).select(*(f"`{c}`" for c in held.schema.names)), next_id=next_id)

    def delete(self, where: Column | None = None, within: Range | None = None) -> Table:
        """Rows for which ``where`` is true go; rows where it is null stay. ``within`` bounds columns: {name: (low, high)}."""

        def run(t: Table) -> None:
            whole, touched, others = t._part(where, within)
            if whole is None:
                t._stage(t.state.loose.limit(0), files=())
            else:
                t._stage(t._with_loose(touched).filter(~F.coalesce(whole, F.lit(False))), files=tuple(others))

        return self._do(run)

    def update(self, values: Mapping[str, Column], where: Column | None = None, within: Range | None = None) -> Table:
        """All right sides see the old values; rows where ``where`` is null stay as they are. ``within`` as for delete."""

        def run(t: Table) -> None:
            t._known(*values)
            whole, touched, others = t._part(where, within)
            out = []
            for f in t.state.schema:
                old = F.col(f"`{f.name}`")
                if f.name not in values:
                    out.append(old)
                else:
                    new = values[f.name].cast(f.dataType)
                    out.append((new if whole is None else F.when(whole, new).otherwise(old)).alias(f.name))
            t._stage(t._with_loose(touched).select(*out), files=tuple(others))

        return self._do(run)

    # ---- transactions

    def violations(self) -> list[str]:
        """Constraints that the staged version breaks, found by one aggregation of all constrained columns."""
        c = self.constraints
        key = [c.primary_key] if c.primary_key else []
        required, unique = dict.fromkeys([*c.not_null, *key]), dict.fromkeys([*c.unique, *key])
        names = list({**required, **unique})
        if not names:
            return []
        values = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("string").alias("value")) for n in names))
        counts = self.rows.select(F.explode(values).alias("v")).groupBy("v.name", "v.value").agg(F.count("*").alias("n"))
        null = F.col("value").isNull()
        broken = counts.groupBy("name").agg(F.sum(F.when(null, F.col("n")).otherwise(0)).alias("nulls"), F.max(F.when(~null, F.col("n"))).alias("most"))
        found = {r["name"]: r for r in broken.collect()}
        out = [f"{n} is null in {found[n]['nulls']} rows" for n in required if n in found and found[n]["nulls"]]
        return out + [f"{n} is not unique" for n in unique if n in found and (found[n]["most"] or 0) > 1]

    def commit(self, retries: int = 5) -> Table:
        """Publish the staged version. If others came first, repeat the statements on theirs, ``retries`` times at most."""
        if self.staged is None and not (self.path and self.version == 0):
            return self
        for attempt in range(retries + 1):
            broken = self.violations()
            if broken:
                raise ConstraintError("; ".join(broken))
            held = self.state
            if not self.path:
                self.committed = held
                break
            new = held.loose.select(*(F.col(f"`{c}`").alias(n) for c, n in held.stored.items()))
            files = (*held.files, *log.write_files(new, self.path, held.stored.get(self.constraints.primary_key)))
            note = {"version": self.version + 1, "next_id": held.next_id, "schema": held.schema.jsonValue(), "stored": dict(held.stored), "used": sorted(held.used)}
            if log.publish(self.spark, self.path, note, files):
                self.committed = replace(held, loose=self.spark.createDataFrame([], held.schema), files=files)
                break
            if attempt == retries:
                raise ConflictError(f"version {self.version + 1} of {self.name} is another writer's")
            self._take_last()
        self.staged, self.statements, self.version = None, [], self.version + 1
        return self

    def _take_last(self) -> None:
        """Go on from the last committed version: the statements are repeated on it."""
        last = Table.open(self.spark, self.name, self.path)
        if self.version == 0 and (self.committed.schema.names != last.state.schema.names or self.committed.files == ()) and not self.committed.loose.isEmpty():
            raise ConflictError(f"{self.name} was made by another writer")
        self.committed, self.version, self.staged = last.committed, last.version, None
        for statement in list(self.statements):
            statement(self)

    def revert(self) -> Table:
        self.staged, self.statements = None, []
        return self
