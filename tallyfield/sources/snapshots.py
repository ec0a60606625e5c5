"""Snapshots by season under declared schemas: written with a manifest, checked before they are
read, and scanned by the seasons asked for.

The fingerprint of a schema is a hash of its names and types. A season whose files don't have
the declared columns is reported, column by column, before anything is read; columns beyond
the declared ones are named in the report and not read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.operators.ingest import season_stats
from tallyfield.sources.commits import Files

MANIFEST = "_manifest.json"
_str, _int, _long = T.StringType(), T.IntegerType(), T.LongType()

# What providers' files hold, without the season, which is their folder.
RAW_PLAYS = T.StructType([T.StructField(n, t) for n, t in (
    ("game_id", _str), ("drive_id", _str), ("play_id", _long), ("week", _int), ("off_team", _str), ("def_team", _str), ("down", _int), ("ydstogo", _int),
    ("yardline_100", _int), ("yards", _int), ("play_type", _str), ("result", _str), ("clock", _int), ("offense_players", _str), ("defense_players", _str))])
ROSTERS = T.StructType([T.StructField(n, _str) for n in ("player_id", "name", "team", "position")])
PARTICIPATION = T.StructType([T.StructField("game_id", _str), T.StructField("play_id", _long), T.StructField("offense_players", _str), T.StructField("defense_players", _str)])
SOURCES: dict[str, T.StructType] = {"plays": RAW_PLAYS, "rosters": ROSTERS, "participation": PARTICIPATION}


def fingerprint(schema: T.StructType) -> str:
    """Hash of names and types, whatever their order; the season isn't part of it."""
    lines = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in schema if f.name != "season")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


class SchemaDrift(ValueError):
    """A season's files don't have the declared columns."""


@dataclass(frozen=True)
class Drift:
    season: int
    absent: tuple[str, ...]
    retyped: tuple[str, ...]  # name: found type, declared type
    extra: tuple[str, ...]

    @property
    def refused(self) -> bool:
        return bool(self.absent or self.retyped)


def seasons_of(spark: SparkSession, path: str) -> list[int]:
    """Seasons that have a folder, from a listing; no file is opened."""
    return sorted(int(n[7:]) for n in Files(spark, path).names("") if n.startswith("season="))


def drifts(spark: SparkSession, path: str, declared: T.StructType, seasons: list[int] | None = None) -> list[Drift]:
    """How each season's files differ from the declared schema; footers are read, no rows."""
    files, out = Files(spark, path), []
    for s in seasons if seasons is not None else seasons_of(spark, path):
        read = spark.read.option("mergeSchema", True)
        try:
            found = {f.name: f.dataType for f in read.parquet(files.uri(f"season={s}")).schema}
        except (PySparkException, Py4JJavaError):  # files of one season that can't be merged
            out.append(Drift(s, (), ("its files disagree in a type",), ()))
            continue
        want = {f.name: f.dataType for f in declared if f.name != "season"}
        retyped = tuple(f"{n}: {found[n].simpleString()}, {t.simpleString()}" for n, t in want.items() if n in found and found[n] != t)
        d = Drift(s, tuple(n for n in want if n not in found), retyped, tuple(sorted(set(found) - set(want))))
        if d.absent or d.retyped or d.extra:
            out.append(d)
    return out


def scan(spark: SparkSession, path: str, declared: T.StructType, seasons: list[int] | None = None) -> DataFrame:
    """Rows with their season; asked for some seasons, only their folders are listed in the plan.

    Raises ``SchemaDrift`` before the read where a season can't be read as declared.
    """
    have = seasons_of(spark, path)
    if missing := sorted(set(seasons or []) - set(have)):
        raise FileNotFoundError(f"{path} has no season {missing}")
    if bad := [d for d in drifts(spark, path, declared, seasons) if d.refused]:
        raise SchemaDrift("; ".join(f"season {d.season}: " + ", ".join([*(f"{n} absent" for n in d.absent), *d.retyped]) for d in bad))
    fields = [f for f in declared if f.name != "season"]
    whole = T.StructType([*fields, T.StructField("season", T.IntegerType())])
    if not have:
        return spark.createDataFrame([], whole)
    df = spark.read.schema(whole).parquet(Files(spark, path).root)
    return df.where(F.col("season").isin(seasons)) if seasons is not None else df


def source(spark: SparkSession, root: str, name: str, seasons: list[int] | None = None) -> DataFrame:
    """One of ``SOURCES`` under its folder of ``root``."""
    return scan(spark, f"{root.rstrip('/')}/{name}", SOURCES[name], seasons)


def write(df: DataFrame, path: str) -> dict:
    """Rows over their own seasons' folders, and the manifest: schema, fingerprint, and of plays
    their counts and coverage per season."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(Files(spark, path).root)
    files = Files(spark, path)
    fields = T.StructType([f for f in df.schema if f.name != "season"])
    back = scan(spark, path, fields)
    stats = season_stats(back) if {"drive_id", "off_players"} <= set(df.columns) else back.groupBy("season").agg(F.count("*").alias("n_rows"))
    manifest = {"fingerprint": fingerprint(fields), "schema": fields.jsonValue(), "seasons": [r.asDict() for r in stats.orderBy("season").collect()]}
    files.delete(MANIFEST)
    files.create(MANIFEST, json.dumps(manifest, sort_keys=True))
    return manifest


def load(spark: SparkSession, path: str, declared: T.StructType | None = None, seasons: list[int] | None = None) -> DataFrame:
    """A written snapshot with its season tag. The manifest's schema counts, and must be the
    declared one, if one is given; its row counts must be those of the files."""
    manifest = json.loads(Files(spark, path).read(MANIFEST))
    schema = T.StructType.fromJson(manifest["schema"])
    if fingerprint(schema) != manifest["fingerprint"]:
        raise SchemaDrift("the manifest's schema isn't what it was when written")
    if declared is not None and fingerprint(declared) != manifest["fingerprint"]:
        want = {(f.name, f.dataType.simpleString()) for f in declared if f.name != "season"}
        have = {(f.name, f.dataType.simpleString()) for f in schema}
        raise SchemaDrift(f"snapshot lacks {sorted(want - have)} and has {sorted(have - want)}")
    df = scan(spark, path, schema, seasons)
    told = {s["season"]: s["n_rows"] for s in manifest["seasons"] if seasons is None or s["season"] in seasons}
    if (found := {r.season: r["count"] for r in df.groupBy("season").count().collect()}) != told:
        raise ValueError(f"rows by season are {found}, the manifest says {told}")
    return df
