"""Embedding pass: pages of pending rows by an id cursor, each committed with its vectors before the next begins.

The model is a function the caller gives. A page is a bounded number of rows, which Spark spreads over its tasks; a
task hands them to the model in batches of the size that its backend likes. A batch that fails is tried again row by
row, so a row that the model can't read costs no other row its vector; such rows are marked and the pass goes on.
A page's vectors are written first and its manifest last: a pass that was killed goes on after the last page, and a
page that was being written is written again under another name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.functions.vectors import MAX_DIMENSIONS
from lodestone.sources.manifest import Conflict, Manifest

Model = Callable[[list[str]], list[list[float]]]

#: Texts that a local and a remote backend take at once, and rows of a page.
NATIVE_BATCH, HTTP_BATCH, PAGE_ROWS = 8, 32, 1 << 17
VECTORS = "id long, revision long, vector array<float>, error string"


def _answer(model: Model, texts: list[str], dimensions: int) -> list[list[float]]:
    """The model's vectors at unit length; an error if any is not one."""
    found = np.array(model(texts), np.float64)
    if found.shape != (len(texts), dimensions):
        raise ValueError(f"the model gave {found.shape}, not {(len(texts), dimensions)}")
    length = np.linalg.norm(found, axis=1)
    if not (np.isfinite(found).all() and (length > 0).all()):
        raise ValueError("the model gave a vector that is not finite or has no length")
    return (found / length[:, None]).tolist()


def embedded(rows: DataFrame, model: Model, dimensions: int, batch: int = NATIVE_BATCH) -> DataFrame:
    """rows(id, revision, text) as VECTORS: a unit vector, or what kept the model from giving one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            texts = ["" if t is None else t for t in given.column("text").to_pylist()]
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    vectors[at : at + len(part)] = _answer(model, part, dimensions)
                except Exception:  # noqa: BLE001  whatever the model raises, its other rows get their turn
                    for i, text in enumerate(part, at):
                        try:
                            vectors[i] = _answer(model, [text], dimensions)[0]
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"[:200]
            yield pa.record_batch([given.column("id"), given.column("revision"), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["id", "revision", "vector", "error"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("revision").cast("long").alias("revision"), "text").mapInArrow(run, VECTORS)


class EmbeddingPass:
    """Vectors of one model over rows(id, revision, text), in a folder with a manifest of committed pages."""

    def __init__(self, spark: SparkSession, path: str, model_key: str, dimensions: int, page_rows: int = PAGE_ROWS, tasks: int | None = None):
        if not 1 <= dimensions <= MAX_DIMENSIONS:
            raise ValueError(f"vectors have 1 to {MAX_DIMENSIONS} dimensions")
        self.spark, self.path, self.key, self.dimensions, self.page_rows = spark, path.rstrip("/"), model_key, dimensions, page_rows
        self.tasks = tasks or spark.sparkContext.defaultParallelism
        self.manifest = Manifest(spark, f"{self.path}/pages")

    def state(self) -> dict:
        """Committed pages: cursor (the last id that is done), folders, counts; done once no row is left."""
        held = {"model": self.key, "cursor": None, "folders": [], "embedded": 0, "failed": 0, "pages": 0, "done": False} | self.manifest.read()
        if held["model"] != self.key:
            raise Conflict(f"the folder holds vectors of {held['model']}")
        return held

    def vectors(self) -> DataFrame:
        """All that committed pages say of a row and revision, marked rows with their error."""
        folders = self.state()["folders"]
        return self.spark.read.schema(VECTORS).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], VECTORS)

    def pending(self, rows: DataFrame) -> DataFrame:
        """Rows of the pass that have no vector of their revision and lie behind the cursor."""
        have = self.vectors().where("error is null").select("id", "revision")
        left = rows.where("id is not null").join(have, ["id", "revision"], "left_anti")
        cursor = self.state()["cursor"]
        return left if cursor is None else left.where(F.col("id") > cursor)

    def step(self, rows: DataFrame, model: Model, batch: int = NATIVE_BATCH) -> bool:
        """Embed and commit the next page; False once nothing is left."""
        state = self.state()
        # only ids of a page meet in a task; its rows, with all of those of its last id, stay spread
        ids = self.pending(rows).select("id").orderBy("id").limit(self.page_rows)
        last = ids.agg(F.max("id")).first()[0]
        if last is not None:
            whole = self.pending(rows).select("id", "revision", "text").where(F.col("id") <= last)
            folder = f"vectors/{scratch.fresh(self.spark, 'page').rsplit('/', 1)[1]}"
            embedded(whole.repartition(self.tasks), model, self.dimensions, batch).write.parquet(f"{self.path}/{folder}")
            n = self.spark.read.schema(VECTORS).parquet(f"{self.path}/{folder}").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("error").alias("bad")).first()
            self.manifest.commit(state, cursor=last, folders=[*state["folders"], folder], embedded=state["embedded"] + n.good, failed=state["failed"] + n.bad, pages=state["pages"] + 1)
        elif not state["done"]:
            self.manifest.commit(state, done=True)
        return last is not None

    def run(self, rows: DataFrame, model: Model, batch: int = NATIVE_BATCH, budget: int | None = None) -> dict:
        """All pages, or ``budget`` of them; the state afterwards."""
        taken = 0
        while (budget is None or taken < budget) and self.step(rows, model, batch):
            taken += 1
        return self.state()

    def again(self) -> None:
        """Begin another pass: rows without a vector, and those with a new revision, get their turn; marks are forgotten."""
        state = self.state()
        good = self.vectors().where("error is null")
        folder = f"vectors/{scratch.fresh(self.spark, 'kept').rsplit('/', 1)[1]}"
        good.write.parquet(f"{self.path}/{folder}")
        self.manifest.commit(state, cursor=None, folders=[folder], failed=0, done=False)
