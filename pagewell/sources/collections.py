"""Named collections of chunks with vectors, kept as catalog tables.

A collection ``c`` is the table ``c`` (one row per chunk, properties ``dim`` and
``distance``) and small companions: ``c__weights`` (fixed when the index
is built, so that chunks and questions share one vector space), ``c__terms`` and
``c__totals`` (BM25 statistics as increments that are summed when read, so an
append writes only what it adds). ``c__postings`` lists the chunks of each token, for BM25 search, by
slots of tokens; ``c__cells`` has learned search cells and their sizes. ``c__sketches``
the Bloom filters of the stored keys, ``c__applied`` the last change of each document, ``c__rejected`` names the chunks whose vectors did not fit.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell import schemas
from pagewell.operators import postings, sketches
from pagewell.operators.embedding import split_valid
from pagewell.session import COMPRESSION, settings, stored, work_dir

DISTANCE = "cosine"
COMPANIONS = {
    "weights": "slot int, weight int",
    "terms": "token string, n_chunks bigint, max_tf int, min_len int",
    "totals": "n_chunks bigint, n_terms bigint",
    "rejected": "doc_id bigint, chunk_no int, reason string",
    "postings": postings.COLUMNS,
    "cells": "cell int, centre array<double>, n bigint",
    "sketches": sketches.COLUMNS,
    "applied": "doc_id bigint, sequence bigint, withdrawn boolean, part int",
}
# Companions that are stored in parts.
PARTS = {"postings": "slot", "applied": "part"}
POINTER = "__current"
STORED_AS = f"USING parquet OPTIONS ('compression' = '{COMPRESSION}')"


class Collections:
    """All collections of one database.

    The tables of a collection ``c`` carry a version: ``c__v1a2b``, ``c__v1a2b__terms``. Its pointer
    ``c__current`` names the version that is read: a property, which one catalog call switches, and a
    row, by which `attach` finds it in the folder. So a version is built beside the one that is read,
    and is seen whole or not at all. ``c@v1a2b`` as a name is that version whatever the pointer says.
    """

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark, self.database = spark, database
        if not spark.catalog.databaseExists(database):
            place = location or work_dir(spark, "collections")
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{place}'")

    def pointer(self, name: str) -> str:
        return f"{self.database}.`{name}{POINTER}`"

    def version(self, name: str) -> str:
        """The version that is read."""
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.pointer(name)}").collect()
        return {r["key"]: r["value"] for r in rows}["version"]

    def pinned(self, name: str) -> str:
        """A name of the version that is read now, which later builds do not change."""
        return name if "@" in name else f"{name}@{self.version(name)}"

    def table(self, name: str, companion: str | None = None) -> str:
        base = self.pinned(name).replace("@", "__")
        return f"{self.database}.`{base}__{companion}`" if companion else f"{self.database}.`{base}`"

    def names(self) -> DataFrame:
        """One row per collection."""
        tables = self.spark.sql(f"SHOW TABLES IN {self.database}").filter(~F.col("isTemporary"))
        pointers = tables.filter(F.col("tableName").endswith(POINTER))
        return pointers.select(F.expr(f"left(tableName, length(tableName) - {len(POINTER)})").alias("name"))

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.pointer(name))

    def create_if_missing(
        self, name: str, dim: int, buckets: int | None = None, celled: bool = False
    ) -> None:
        """Create an empty collection; an existing one keeps its content.

        ``buckets`` stores chunks by key, so that appends and text lookups need
        not shuffle the collection. ``celled`` stores chunks by search cell, so
        that a search reads only the cells it visits.
        """
        if not self.exists(name):
            return self.switch(name, self.begin(name, dim, buckets, celled))
        present = self.properties(name)["dim"], self.buckets(name), "cell" in self.open(name).columns
        if present != (str(dim), buckets or 0, celled):
            raise ValueError(f"collection {name} exists with (dim, buckets, celled) = {present}")

    def begin(
        self,
        name: str,
        dim: int,
        buckets: int | None = None,
        celled: bool = False,
        parted: bool = False,
        folder: str | None = None,
        version: str | None = None,
    ) -> str:
        """Create the empty tables of a new version and give its name; nobody reads it before `switch`.

        ``parted`` stores chunks and postings by parts of documents, which `overwrite_parts` replaces.
        ``folder`` and ``version`` are for `attach`.
        """
        if parted and (buckets or celled):
            raise ValueError("a collection is stored by parts of documents, by cells or by buckets")
        staged = f"{name}@{version or 'v' + uuid.uuid4().hex[:12]}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.COLLECTION)
        by = "cell" if celled else "part" if parted else None
        layout = f" PARTITIONED BY ({by})" if by else ""
        if buckets:
            layout += f" CLUSTERED BY ({', '.join(schemas.CHUNK_KEYS)}) INTO {buckets} BUCKETS"
        base = staged.replace("@", "__")
        place = lambda table: f" LOCATION '{folder}/{table}'" if folder else ""
        self.spark.sql(
            f"CREATE TABLE {self.table(staged)} "
            f"({columns}{f', {by} int' if by else ''}) {STORED_AS}{layout}{place(base)} "
            f"TBLPROPERTIES ('dim' = '{dim}', 'distance' = '{DISTANCE}')"
        )
        for companion, ddl in COMPANIONS.items():
            parts = f" PARTITIONED BY ({PARTS[companion]})" if companion in PARTS else ""
            if companion == "postings" and parted:
                ddl, parts = f"{ddl}, part int", " PARTITIONED BY (part)"
            self.spark.sql(
                f"CREATE TABLE {self.table(staged, companion)} ({ddl}) "
                f"{STORED_AS}{parts}{place(f'{base}__{companion}')}"
            )
        return staged

    def switch(self, name: str, staged: str) -> None:
        """Let the collection be read from a version that is built; older ones than the last are dropped.

        The last one stays for those who still read it.
        """
        version, last = staged.split("@")[1], self.version(name) if self.exists(name) else ""
        self._point(name, version)
        number = F.coalesce(F.max("number"), F.lit(0)) + 1
        row = self.spark.table(self.pointer(name)).agg(number.cast("bigint").alias("number"))
        row.withColumn("version", F.lit(version)).select("version", "number").write.insertInto(self.pointer(name))
        for old in self._versions(name) - {version, last}:
            self.abandon(f"{name}@{old}")

    def _point(self, name: str, version: str, place: str = "") -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.pointer(name)} (version string, number bigint) USING parquet{place} "
            f"TBLPROPERTIES ('version' = '{version}')"
        )
        self.spark.sql(f"ALTER TABLE {self.pointer(name)} SET TBLPROPERTIES ('version' = '{version}')")

    def _versions(self, name: str) -> set[str]:
        tables = self.spark.sql(f"SHOW TABLES IN {self.database}").select("tableName")
        version = F.regexp_extract("tableName", f"^{re.escape(name.lower())}__(v[0-9a-f]{{12}})$", 1)
        return {r[0] for r in tables.select(version).distinct().collect()} - {""}

    def abandon(self, staged: str) -> None:
        """Drop one version."""
        for companion in [None, *COMPANIONS]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(staged, companion)}")

    def attach(
        self,
        name: str,
        folder: str,
        dim: int,
        buckets: int | None = None,
        celled: bool = False,
        parted: bool = False,
    ) -> None:
        """Register a collection an earlier session left in ``folder``, as it was created.

        For sessions whose catalog does not outlive them. The files belong to the
        folder: dropping an attached collection only forgets it.
        """
        place = f"{folder}/{name}{POINTER}"
        last = self.spark.read.schema("version string, number bigint").parquet(place)
        version = last.agg(F.max_by("version", "number")).first()[0]
        staged = self.begin(name, dim, buckets, celled, parted, folder, version)
        if celled or parted:
            self.spark.catalog.recoverPartitions(self.table(staged))
        for companion in PARTS:
            self.spark.catalog.recoverPartitions(self.table(staged, companion))
        self._point(name, version, f" LOCATION '{place}'")

    def drop(self, name: str) -> None:
        """Remove one named collection with its content."""
        for version in self._versions(name):
            self.abandon(f"{name}@{version}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.pointer(name)}")

    def recreate(
        self, name: str, dim: int, buckets: int | None = None, celled: bool = False
    ) -> None:
        """Create an empty collection; an existing one loses its content, but not before the new one is there."""
        self.switch(name, self.begin(name, dim, buckets, celled))

    def properties(self, name: str) -> dict[str, str]:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.table(name)}").collect()
        return {r["key"]: r["value"] for r in rows}

    def remember(self, name: str, **values) -> None:
        """Keep settings with the collection."""
        pairs = ", ".join(f"'{key}' = '{value}'" for key, value in values.items())
        self.spark.sql(f"ALTER TABLE {self.table(name)} SET TBLPROPERTIES ({pairs})")

    def buckets(self, name: str) -> int:
        described = self.spark.sql(f"DESCRIBE EXTENDED {self.table(name)}")
        row = described.filter(F.col("col_name") == "Num Buckets").first()
        return int(row["data_type"]) if row else 0

    def open(self, name: str) -> DataFrame:
        return self.spark.table(self.table(name))

    def companion(self, name: str, companion: str) -> DataFrame:
        return self.spark.table(self.table(name, companion))

    def totals(self, name: str) -> DataFrame:
        return self.companion(name, "totals").agg(
            F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"),
            F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms"),
        )

    def new_rows(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows whose key the collection lacks, each key once.

        Both steps need the rows by key, so the new rows are shuffled once; of the
        collection only the keys are read, and a bucketed one stays in place.
        """
        keys, buckets = schemas.CHUNK_KEYS, self.buckets(name)
        if buckets:
            rows = rows.repartition(buckets, *keys)
        return rows.dropDuplicates(keys).join(self.open(name).select(*keys), keys, "left_anti")

    def unseen_rows(self, name: str, rows: DataFrame) -> DataFrame:
        """The same as `new_rows`, by the stored Bloom filters: only keys that may be known are looked up.

        Nothing of the collection is read if there are none, and of one stored by parts only the parts of
        such keys. ``rows`` are read several times.
        """
        keys = schemas.CHUNK_KEYS
        own = rows.dropDuplicates(keys)
        maybe = stored(sketches.maybe_known(rows, self.companion(name, "sketches"), keys), "maybe-known", self.spark)
        if maybe.isEmpty():
            return own
        held = self.open(name)
        if "part" in held.columns:
            n = int(self.properties(name)["parts"])
            part = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
            held = held.filter(F.col("part").isin([r[0] for r in maybe.select(part).distinct().collect()]))  # at most n
        known = stored(held.select(*keys).join(maybe, keys, "left_semi"), "known", self.spark)
        return own.join(known, keys, "left_anti")

    def sketch(self, name: str, rows: DataFrame) -> None:
        """Add the keys of rows to the Bloom filters. Done before the rows are stored, so that none is missing."""
        self.append_companion(name, "sketches", sketches.sketch(rows, schemas.CHUNK_KEYS))

    def valid_rows(self, name: str, rows: DataFrame, strict: bool = False) -> DataFrame:
        """Rows that fit the collection's dimension; `split_valid` also shows the others."""
        return split_valid(rows, int(self.properties(name)["dim"]), strict)[0]

    def reject(self, name: str, rows: DataFrame) -> None:
        """Keep the keys of the rows that do not fit, and why."""
        dim = self.properties(name)["dim"]
        reason = F.when(F.col("embedding").isNull(), "no vector").when(
            F.size("embedding") != int(dim), F.concat(F.size("embedding").cast("string"), F.lit(f" elements, not {dim}"))
        )
        bad = split_valid(rows, int(dim))[1]
        bad = bad.select("doc_id", "chunk_no", F.coalesce(reason, F.lit("a NULL element")).alias("reason"))
        self.append_companion(name, "rejected", bad)

    def append(self, name: str, rows: DataFrame, overwrite: bool = False, sketched: bool = False) -> None:
        """Append rows as they are, or put them in place; `new_rows` makes an append repeatable.

        ``sketched`` says that the Bloom filters know the rows' keys.
        """
        if not sketched:
            self.sketch(name, rows)
        target = self.open(name)
        buckets = self.buckets(name)
        out = rows.select(*target.columns)
        if buckets:
            out = out.repartition(buckets, *schemas.CHUNK_KEYS)
        elif "cell" in target.columns:
            out = out.hint("rebalance", "cell")
        out.write.insertInto(self.table(name), overwrite=overwrite)

    def append_companion(
        self, name: str, companion: str, rows: DataFrame, overwrite: bool = False
    ) -> None:
        columns = self.companion(name, companion).columns
        rows.select(*columns).write.insertInto(self.table(name, companion), overwrite=overwrite)

    def overwrite_parts(self, name: str, companion: str | None, rows: DataFrame, parts: list[int]) -> None:
        """Put ``rows`` in place of all rows of these parts; a part without rows becomes empty."""
        table, dynamic = self.table(name, companion), {"spark.sql.sources.partitionOverwriteMode": "dynamic"}
        columns = self.spark.table(table).columns
        with settings(self.spark, dynamic):
            rows.select(*columns).hint("rebalance", "part").write.insertInto(table, overwrite=True)
        left = {r[0] for r in rows.select("part").distinct().collect()}
        for part in set(parts) - left:
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (part = {part})")

    def info(self, name: str) -> DataFrame:
        """(name, points, dim, distance), the dimension as found in the rows."""
        found = self.open(name).select("embedding")
        return collection_info(found, name.split("@")[0], self.properties(name)["distance"])


def collection_info(vectors: DataFrame, name: str, distance: str = DISTANCE) -> DataFrame:
    return vectors.agg(
        F.count(F.lit(1)).alias("points"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
    ).select(
        F.lit(name).alias("name"), "points", "min_dim", "max_dim", F.lit(distance).alias("distance")
    )


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
