"""The engine's store: tables of fixed schemas under a commit log, state tables, models, run
records, and the commands that change them.

Schemas widen by metadata alone (columns that old files lack read as null). Tables of weekly
rows are partitioned by slot, so a merge of one week rewrites that week.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import sys
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.sources.commits import CommitLog, Transaction
from tallyfield.sources.sinks import canonical_hash, strict_json

SCHEMA_VERSION = 2
# table -> columns of each schema version, oldest first
TABLES: dict[str, list[str]] = {
    "players": ["player_id string, name string, position string, team string"],
    "player_stats": ["player_id string, season int, week int, points double"],
    "formats": ["name string, content string", "name string, content string, offset double"],
    "valuations": ["player_id string, format string, vor double, rank int"],
    "trajectory": ["player_id string, season int, week int, talent double, form double, total double, var double"],
    "overrides": ["player_id string, season int, week int, status string, observed_at timestamp"],
    "benchmarks": ["provider string, player_id string, season int, week int, projected double, observed_at timestamp"],
    "links": ["provider_id string, player_id string, confidence double, state string, decided_at timestamp"],
    "runs": ["run_id string, command string, state string, started_at timestamp, seconds double, detail string"],
    "models": ["family string, version string, role string, config string, created_at timestamp"],
    "configs": ["family string, version string, config string, created_at timestamp"],
    "blocks": ["season int, week int, situation string, i string, j string, v double"],
    "ratings": ["season int, week int, situation string, col string, rating double"],
    "filter_state": ["player_id string, position string, season int, week int, x0 double, x1 double, x2 double, p00 double, p01 double, p02 double, p11 double, p12 double, p22 double, games int"],
    "grades": ["season int, week int, situation string, team string, position string, grade double"],
}
PARTITIONS: dict[str, list[str]] = {
    "player_stats": ["season"], "overrides": ["season"], "benchmarks": ["season"],
    "trajectory": ["season", "week"], "blocks": ["season", "week"], "ratings": ["season", "week"], "filter_state": ["season", "week"], "grades": ["season", "week"],
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    # --- schema and metadata --------------------------------------------------------------

    def init(self) -> int:
        """Make the store or bring it to the current schema; a second call changes nothing."""

        def work(tx: Transaction) -> None:
            for name, versions in TABLES.items():
                want = StructType.fromDDL(versions[-1])
                if name in tx.tables():
                    old = tx.schema(name)
                    want = StructType(old.fields + [f for f in want if f.name not in old.names])
                tx.define(name, want, PARTITIONS.get(name))
            if tx.meta("schema_version") != str(SCHEMA_VERSION):
                tx.set_meta("schema_version", str(SCHEMA_VERSION))

        self.log.transact(work)
        return SCHEMA_VERSION

    def meta(self, key: str) -> str | None:
        return self.log.begin().meta(key)

    def set_meta(self, key: str, value: str) -> None:
        self.log.transact(lambda tx: tx.set_meta(key, value))

    # --- tables ---------------------------------------------------------------------------

    def read(self, name: str, where: str | None = None, parts: list[tuple] | None = None) -> DataFrame:
        """Scan of a table (the SQL table scan of other stores), with an optional predicate and
        of some partitions only."""
        df = self.log.begin().read(name, parts)
        return df.where(where) if where else df

    def write(self, name: str, df: DataFrame) -> None:
        self.log.transact(lambda tx: tx.write(name, df))

    def append(self, name: str, df: DataFrame) -> None:
        self.log.transact(lambda tx: tx.append(name, df))

    def merge(self, name: str, df: DataFrame, keys: list[str], order: str | None = None) -> None:
        self.log.transact(lambda tx: tx.merge(name, df, keys, order))

    # --- state of the filter --------------------------------------------------------------

    def save_state(self, state: DataFrame, season: int, week: int) -> None:
        """Hand-over of any state table after a slot, with the columns it has."""
        self.write(f"state-{season}-{week}", state)

    def load_state(self, season: int, week: int, start: dict[str, float]) -> DataFrame | None:
        """State after a slot, or None; a two-part state of old gets its third part."""
        tx = self.log.begin()
        name = f"state-{season}-{week}"
        return migrate_state(tx.read(name), start) if name in tx.tables() else None

    # --- commands -------------------------------------------------------------------------

    def run(self, command: str, work: Callable[[], object]) -> object:
        """Do ``work`` under a run record: started, then done or failed (and raised)."""
        began, run_id = time.time(), uuid.uuid4().hex[:12]

        def record(state: str, detail: str) -> None:
            row = self.spark.createDataFrame([(run_id, command, state, None, time.time() - began, detail)], TABLES["runs"][-1])
            self.merge("runs", row.withColumn("started_at", F.lit(began).cast("timestamp")), ["run_id"])

        record("running", "")
        try:
            out = work()
        except Exception as e:
            record("failed", str(e)[:200])
            raise
        record("done", "" if out is None else str(out)[:200])
        return out

    def daily_update(self, load: Callable[[int], tuple[DataFrame, DataFrame]], seasons: list[int]) -> dict[int, str]:
        """Players and weekly points of each season, together; a season that fails is noted and
        skipped."""
        log = get_logger("daily_update")

        def season(tx: Transaction, players: DataFrame, stats: DataFrame) -> None:
            tx.merge("players", players, ["player_id"])
            known = stats.join(tx.read("players").select("player_id"), "player_id", "left_semi")
            tx.merge("player_stats", known, ["player_id", "season", "week"])

        def work() -> dict[int, str]:
            out = {}
            for s in seasons:
                try:
                    players, stats = load(s)
                    self.log.transact(lambda tx, p=players, x=stats: season(tx, p, x))
                    out[s] = "ok"
                except Exception as e:  # noqa: BLE001  one season must not stop the others
                    log.warning("season %s: %s", s, e)
                    out[s] = f"failed: {e}"
            return out

        return self.run("daily_update", work)

    def projection_run(self, version: str, projections: Callable[[], DataFrame], broken: Callable[[DataFrame], DataFrame]) -> int:
        """Write projections under a version of their own, if no record breaks a rule."""

        def work() -> int:
            p = projections()
            bad = broken(p).limit(1).collect()
            if bad:
                raise ValueError(f"projection breaks {bad[0].asDict()}")
            name = f"projections-{version}"

            def once(tx: Transaction) -> int:
                if name in tx.tables():
                    raise ValueError(f"version {version} is written")
                tx.write(name, p)
                return tx.read(name).count()

            return self.log.transact(once)

        return self.run("projection_run", work)

    # --- models ---------------------------------------------------------------------------

    def model_rebuild(self, family: str, fit: Callable[[], dict]) -> str:
        """Fit, and enter the model under the hash of its parameters: a new version as candidate;
        one that is there keeps its role."""

        def work() -> str:
            config = strict_json(fit())
            version = hashlib.sha256(config.encode()).hexdigest()[:12]
            self._enter_model(family, version, config)
            return version

        return self.run("model_rebuild", work)

    def _enter_model(self, family: str, version: str, config: str) -> None:
        def work(tx: Transaction) -> None:
            if not tx.read("models").where((F.col("family") == family) & (F.col("version") == version)).isEmpty():
                return
            row = self.spark.createDataFrame([(family, version, "candidate", config, None)], TABLES["models"][-1])
            tx.append("models", row.withColumn("created_at", F.current_timestamp()))

        self.log.transact(work)

    def save_model(self, family: str, model) -> str:
        """Write a fitted pipeline under a hash of what it does (parameters and fitted numbers of
        its stages), and enter it as a candidate if it is new."""
        version = hashlib.sha256(strict_json(_content(model)).encode()).hexdigest()[:12]
        at = self.log.files.uri(f"_models/{family}/{version}")
        if not self.log.files.exists(f"_models/{family}/{version}/metadata"):
            model.write().overwrite().save(at)
        self._enter_model(family, version, strict_json({"path": f"_models/{family}/{version}"}))
        return version

    def load_model(self, family: str, version: str | None = None):
        """A written pipeline: that of a version, or the one in production."""
        from pyspark.ml import PipelineModel

        version = version or self.production(family)
        if version is None or not self.log.files.exists(f"_models/{family}/{version}/metadata"):
            raise ValueError(f"no model of {family} in production" if version is None else f"{family} {version} is not written")
        return PipelineModel.load(self.log.files.uri(f"_models/{family}/{version}"))

    def production(self, family: str) -> str | None:
        got = self.read("models").where((F.col("family") == family) & (F.col("role") == "champion")).select("version").collect()
        return got[0].version if got else None

    def promote(self, family: str, version: str) -> None:
        """Make a candidate the champion; the champion of before becomes the previous one."""
        self._promote(family, version, ["candidate"])

    def _promote(self, family: str, version: str, roles: list[str]) -> None:
        def work(tx: Transaction) -> None:
            m = tx.read("models").where(F.col("family") == family)
            if m.where((F.col("version") == version) & F.col("role").isin(roles)).isEmpty():
                raise ValueError(f"{version} is no {' or '.join(roles)} of {family}")
            role = F.when(F.col("version") == version, "champion").when(F.col("role") == "champion", "previous").when(F.col("role") == "previous", "retired").otherwise(F.col("role"))
            tx.merge("models", m.withColumn("role", role), ["family", "version"])

        self.log.transact(work)

    def rollback(self, family: str) -> str:
        """Bring back the champion of before; refused where there is none."""
        last = self.read("models").where((F.col("family") == family) & (F.col("role") == "previous")).select("version").collect()
        if not last:
            raise ValueError(f"{family} has no previous version")
        self._promote(family, last[0].version, ["previous"])
        return last[0].version

    def set_model_config(self, family: str, config: dict) -> str:
        """Enter a configuration, in a table of its own; the same one again changes nothing."""
        text = strict_json(config)
        version = hashlib.sha256(text.encode()).hexdigest()[:12]

        def work(tx: Transaction) -> None:
            if tx.read("configs").where((F.col("family") == family) & (F.col("version") == version)).isEmpty():
                row = self.spark.createDataFrame([(family, version, text, None)], TABLES["configs"][-1])
                tx.append("configs", row.withColumn("created_at", F.current_timestamp()))

        self.log.transact(work)
        return version

    # --- profiles, imports, links ---------------------------------------------------------

    def set_scoring_profile(self, name: str, weights: list[tuple[str, float]], offset: float = 0.0) -> str:
        """Enter a profile by name; a weight list that isn't affine is refused."""
        from tallyfield.operators.forecast import affine_points

        affine_points(weights, offset)
        content = canonical_hash({"weights": dict(weights), "offset": offset})
        self.merge("formats", self.spark.createDataFrame([(name, content, float(offset))], TABLES["formats"][-1]), ["name"])
        return content

    def import_overrides(self, csv: str) -> int:
        return self._import(csv, "overrides", "player_id string, season int, week int, status string")

    def import_benchmark(self, csv: str) -> int:
        return self._import(csv, "benchmarks", "provider string, player_id string, season int, week int, projected double")

    def _import(self, csv: str, name: str, schema: str) -> int:
        """Rows of a file that the table doesn't have yet, nor twice; returns how many there were."""
        rows = self.spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(csv)
        rows = rows.select(*rows.columns).distinct()

        def work(tx: Transaction) -> int:
            old = tx.read(name)
            new = rows.alias("n").join(old.alias("o"), [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in rows.columns], "left_anti")
            new = new.withColumn("observed_at", F.current_timestamp())
            n = new.count()
            if n:
                tx.append(name, new)
            return n

        return self.log.transact(work)

    def decide_link(self, provider_id: str, player_id: str, approve: bool) -> None:
        """Approve or reject an identity link; one that isn't pending is refused."""

        def work(tx: Transaction) -> None:
            link = tx.read("links").where((F.col("provider_id") == provider_id) & (F.col("player_id") == player_id) & (F.col("state") == "pending"))
            if link.isEmpty():
                raise ValueError(f"no pending link of {provider_id} to {player_id}")
            tx.merge("links", link.withColumn("state", F.lit("approved" if approve else "rejected")).withColumn("decided_at", F.current_timestamp()), ["provider_id", "player_id"])

        self.log.transact(work)

    def evaluation_run(self, verdict: Callable[[], DataFrame]) -> str:
        return self.run("evaluation_run", lambda: verdict().first().verdict)


def _content(model) -> dict:
    """What a fitted pipeline is, without the names that change from fit to fit."""
    out = []
    for s in model.stages:
        told = {p.name: s.getOrDefault(p) for p in s.params if s.isDefined(p)}
        told = {k: v if isinstance(v, int | float | str | bool | list) or v is None else str(v) for k, v in told.items() if s.uid not in str(v)}
        fitted = s.toDebugString.split("\n", 1)[-1] if hasattr(s, "toDebugString") else str(getattr(s, "coefficients", "")) + str(getattr(s, "intercept", ""))
        weights = [float(x) for x in getattr(s, "treeWeights", [])]
        out.append({"stage": type(s).__name__, "params": told, "fitted": fitted, "weights": weights})
    return {"stages": out}


def migrate_state(state: DataFrame, start: dict[str, float]) -> DataFrame:
    """A state without some of its parts gets their start values."""
    return state.select("*", *(F.lit(v).alias(k) for k, v in start.items() if k not in state.columns))


def write_json(path: Path, value: dict) -> None:
    part = Path(f"{path}.new")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_text(strict_json(value))
    os.replace(part, path)


def write_health(path: str, step: str, ok: bool, detail: dict | None = None) -> None:
    """The last outcome of each step of a pipeline, for a probe to read."""
    p = Path(path)
    write_json(p, {**read_health(path), step: {"ok": ok, "at": time.time(), **(detail or {})}})


def read_health(path: str) -> dict:
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {}


def load_registry(path: str) -> dict:
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {}


def save_registry(path: str, registry: dict) -> None:
    write_json(Path(path), registry)


def get_logger(name: str, file: str | None = None) -> logging.Logger:
    """A logger to stderr and, if given, a file; asking again adds no handlers."""
    log = logging.getLogger(f"tallyfield.{name}")
    log.setLevel(logging.INFO)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
    have = {getattr(h, "baseFilename", "stderr") for h in log.handlers}
    if "stderr" not in have:
        log.addHandler(logging.StreamHandler(sys.stderr))
    if file and os.path.abspath(file) not in have:
        log.addHandler(logging.FileHandler(file))
    for h in log.handlers:
        h.setFormatter(form)
    return log


class Namespace:
    """A state folder whose paths may not leave it; live and replayed state stay apart."""

    def __init__(self, root: str, live_root: str):
        self.root, live = os.path.realpath(root), os.path.realpath(live_root)
        if os.path.commonpath([self.root, live]) in (self.root, live):
            raise ValueError(f"{root} and the live folder {live_root} overlap")

    def path(self, *parts: str) -> str:
        at = os.path.realpath(os.path.join(self.root, *parts))
        if os.path.commonpath([at, self.root]) != self.root:
            raise ValueError(f"{parts} leaves the namespace")
        return at


# --- fixtures of raw arrays ----------------------------------------------------------------

KINDS = {"f64": "<f8", "i64": "<i8", "i32": "<i4", "bool": "?"}


def write_fixture(folder: str, arrays: dict[str, tuple[str, object]]) -> None:
    """Arrays as raw little-endian files under a manifest of kinds, sizes and digests."""
    manifest = {}
    for name, (kind, values) in arrays.items():
        if kind == "strings":
            data = json.dumps(list(values)).encode()
        elif kind.startswith("ragged_"):
            lens = np.array([len(x) for x in values], "<i8")
            flat = np.concatenate([np.asarray(x) for x in values]) if len(lens) else np.zeros(0)
            data = np.array([len(lens)], "<i8").tobytes() + lens.tobytes() + flat.astype(KINDS[kind[7:]]).tobytes()
        else:
            data = np.asarray(values).astype(KINDS[kind]).tobytes()
        Path(folder).mkdir(parents=True, exist_ok=True)
        Path(folder, f"{name}.bin").write_bytes(data)
        manifest[name] = {"kind": kind, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    write_json(Path(folder, "manifest.json"), manifest)


def read_fixture(folder: str, name: str):
    """One array of a fixture; size and digest must be those of the manifest."""
    m = json.loads(Path(folder, "manifest.json").read_text())[name]
    data = Path(folder, f"{name}.bin").read_bytes()
    if len(data) != m["bytes"] or hashlib.sha256(data).hexdigest() != m["sha256"]:
        raise ValueError(f"{name} is not what the manifest says")
    if m["kind"] == "strings":
        return json.loads(data)
    if m["kind"].startswith("ragged_"):
        (n,) = np.frombuffer(data, "<i8", 1)
        lens = np.frombuffer(data, "<i8", n, 8)
        flat = np.frombuffer(data, KINDS[m["kind"][7:]], int(lens.sum()), 8 + 8 * int(n))
        return np.split(flat, np.cumsum(lens)[:-1]) if n else []
    return np.frombuffer(data, KINDS[m["kind"]])


# --- sources by name -----------------------------------------------------------------------


def load_years(spark: SparkSession, cache, name: str, years: list[int], fetch: Callable[[str, int], DataFrame], shape: Callable[[DataFrame], DataFrame], ttl_hours: float = 24.0) -> DataFrame:
    """A source over years: from the cache while it is fresh, else fetched, shaped and cached."""
    from tallyfield.sources.tables import union_years

    frames = []
    for y in years:
        key = f"{name}-{y}"
        got = cache.get(key, ttl_hours)
        if got is None:
            cache.put(key, shape(fetch(name, y)))
            got = cache.get(key, ttl_hours)
        frames.append(got)
    return union_years(frames)


def load_raw_pbp(spark, cache, years, fetch):
    return load_years(spark, cache, "raw_pbp", years, fetch, lambda df: df)


def load_pbp(spark, cache, years, fetch):
    """Plays in the engine's shape."""
    from tallyfield.operators.ingest import build_plays

    return build_plays(load_raw_pbp(spark, cache, years, fetch))


def load_rosters(spark, cache, years, fetch):
    from tallyfield.sources.tables import roster_shape

    return load_years(spark, cache, "rosters", years, fetch, roster_shape)


def load_participation(spark, cache, years, fetch):
    from tallyfield.sources.tables import participation_shape

    return load_years(spark, cache, "participation", years, fetch, participation_shape)


def load_state_plays(spark, cache, years, fetch):
    """Plays with the next state, of the offensive side's skill players only."""
    from tallyfield.operators.ingest import with_next_state

    return with_next_state(load_pbp(spark, cache, years, fetch))


def load_synthetic(spark: SparkSession, **config) -> dict[str, DataFrame]:
    """The synthetic bundle under names: plays, players and the feeder league."""
    from tallyfield.sources.tables import synthetic_feeder, synthetic_world

    world = synthetic_world(spark, **config)
    plays, players = world[0], world[1]
    return {"plays": plays, "players": players, "feeder": synthetic_feeder(players)}


def _no_loader(name: str):
    def load(*_args, **_kw):
        raise NotImplementedError(f"{name} has no loader here; give the rows as a DataFrame")

    return load


load_odds, load_college, load_vendor_pbp = map(_no_loader, ("odds", "college statistics", "vendor play-by-play"))
