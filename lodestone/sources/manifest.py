"""Versions of a stored table as small manifests: optimistic commits, model generations, published shards."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import scratch

MODELS = 8


class Conflict(RuntimeError):
    """Another writer committed first, or what the writer read is no longer so."""


class Manifest:
    """Numbered JSON files in a folder; the newest is the table, and a number is given once.

    A version exists whole or not at all, so a writer that dies leaves the one before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in scratch.listed(self.spark, self.path) if n.endswith(".json")]

    def read(self, version: int | None = None) -> dict:
        """The state of a version, the newest if none is given; {"version": 0} before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(scratch.read_text(self.spark, f"{self.path}/{version:012d}.json")) if version else {"version": 0}

    def commit(self, base: dict, **changes) -> dict:
        """The state after base with changes; Conflict unless base is still the newest version."""
        now = {**base, **changes, "version": base["version"] + 1}
        if max(self.versions(), default=0) != base["version"] or not scratch.create(self.spark, f"{self.path}/{now['version']:012d}.json", json.dumps(now, sort_keys=True)):
            raise Conflict(f"version {now['version']} of {self.path} was written meanwhile")
        return now

    def retry(self, change: Callable[[dict], dict | None], tries: int = 5) -> dict:
        """Commit change(state) on whatever is newest; None changes nothing. For changes that don't depend on data read before."""
        for _ in range(tries):
            base = self.read()
            changes = change(base)
            if changes is None:
                return base
            try:
                return self.commit(base, **changes)
            except Conflict:
                continue
        raise Conflict(f"{self.path} is written too often")

    def forget(self, keep: int) -> None:
        """Remove all but the newest ``keep`` manifests."""
        for v in self.versions()[:-keep]:
            scratch.delete(self.spark, f"{self.path}/{v:012d}.json")


class Generations:
    """Models of a vector table and the shards built for each, published by compare and set.

    A shard is published with the count and the last key that its builder read; it is refused if the table has other
    ones by then. One model is active at most, and readers see only shards of the active model.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.manifest = Manifest(spark, path)

    def begin(self, model: str) -> dict:
        """Register a model beside the others, at most eight in all."""

        def add(state: dict) -> dict | None:
            models = state.get("models", {})
            if model in models:
                return None
            if len(models) >= MODELS:
                raise ValueError(f"there are {MODELS} models already; retire some")
            return {"models": {**models, model: {"active": False, "shards": {}}}}

        return self.manifest.retry(add)

    def activate(self, model: str, stale: int, vectors: int) -> bool:
        """Make a model the only active one; not while it has stale vectors or none."""

        def switch(state: dict) -> dict | None:
            models = state.get("models", {})
            if model not in models:
                raise ValueError(f"no model {model}")
            if stale or not vectors or models[model]["active"]:
                return None
            return {"models": {m: {**held, "active": m == model} for m, held in models.items()}}

        return self.manifest.retry(switch)["models"][model]["active"]

    def retire(self) -> list[str]:
        """Drop all models that are not active; their names."""
        gone: list[str] = []

        def drop(state: dict) -> dict | None:
            models = state.get("models", {})
            gone[:] = sorted(m for m, held in models.items() if not held["active"])
            return {"models": {m: held for m, held in models.items() if held["active"]}} if gone else None

        self.manifest.retry(drop)
        return gone

    @staticmethod
    def currency(vectors: DataFrame) -> dict:
        """Count and last key of vectors(id): what a builder reads before it builds."""
        n, last = vectors.agg(F.count("*"), F.coalesce(F.max("id"), F.lit(0))).first()
        return {"count": n, "last": last}

    def publish(self, model: str, shard: str, folder: str, read: dict, vectors: DataFrame) -> dict:
        """Put a built shard in its place; Conflict if the vectors are not what the builder read, or a commit came between."""
        base = self.manifest.read()
        if model not in base.get("models", {}):
            raise Conflict(f"model {model} was retired")
        if Generations.currency(vectors) != read:
            raise Conflict(f"the vectors of {shard} changed while it was built")
        held = base["models"][model]
        return self.manifest.commit(base, models={**base["models"], model: {**held, "shards": {**held["shards"], shard: {**read, "folder": folder}}}})

    def shards(self) -> dict[str, dict]:
        """Shards of the active model."""
        return next((held["shards"] for held in self.manifest.read().get("models", {}).values() if held["active"]), {})
