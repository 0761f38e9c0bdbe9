"""The current transformation at every operator of a page, as a prefix scan over ranges of operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, tasks_for, width

PARTS = ["a", "b", "c", "d", "e", "f"]


def _matrix(v: np.ndarray) -> np.ndarray:
    """[a b c d e f] as the 3 x 3 matrix that a row vector (x, y, 1) is multiplied by."""
    a, b, c, d, e, f = v
    return np.array([[a, b, 0.0], [c, d, 0.0], [e, f, 1.0]])


def _flat(m: np.ndarray) -> list[float]:
    return [m[0, 0], m[0, 1], m[1, 0], m[1, 1], m[2, 0], m[2, 1]]


class Stack:
    """What a run of operators does to any stack it meets: an element of the monoid that the scan is over.

    exposed[0] is multiplied onto the matrix it meets; each further entry follows one Q that takes what it met off the stack. opened are the
    matrices of q's not closed yet, each relative to the one below. If fewer q's are open than are taken off, a Q too many does
    nothing, so what comes after it goes on with the matrix there is.
    """

    def __init__(self, exposed: list[np.ndarray] | None = None, opened: list[np.ndarray] | None = None):
        self.exposed, self.opened = exposed or [np.eye(3)], opened or []

    def apply(self, op: str, matrix: np.ndarray | None) -> None:
        if op == "q":
            self.opened.append(np.eye(3))
        elif op == "Q":
            if self.opened:
                self.opened.pop()
            else:
                self.exposed.append(np.eye(3))
        elif op == "cm" and matrix is not None:
            top = self.opened if self.opened else self.exposed
            top[-1] = matrix @ top[-1]

    def after(self, stack: list[np.ndarray]) -> list[np.ndarray]:
        """The stack (of absolute matrices, the current one last) that this run leaves of `stack`."""
        stack = list(stack)
        stack[-1] = self.exposed[0] @ stack[-1]
        for m in self.exposed[1:]:
            if len(stack) > 1:
                stack.pop()
            stack[-1] = m @ stack[-1]
        for m in self.opened:
            stack.append(m @ stack[-1])
        return stack


def _walk(pdf: pd.DataFrame, stack: Stack) -> Iterator[None]:
    for op, *v in zip(pdf.op, *(pdf[c] for c in PARTS), strict=True):
        stack.apply(op, _matrix(np.array(v, float)) if op == "cm" and not any(x is None or np.isnan(x) for x in v) else None)
        yield


def _runs(keys: list[str]):
    """The first pass: what each page's operators in a range do, one row for a page and range."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stack, head = None, Stack(), None
        told = lambda: head.assign(pops=[np.concatenate([_flat(m) for m in stack.exposed])], pushed=[np.array([x for m in stack.opened for x in _flat(m)], float)])
        for pdf in pdfs:
            for k, own in pdf.groupby("_page_key", sort=False):
                if k != key and key is not None:
                    yield told()
                if k != key:
                    key, stack, head = k, Stack(), own[["_part", "_page_key", *keys]].iloc[:1].reset_index(drop=True)
                for _ in _walk(own, stack):
                    pass
        if key is not None:
            yield told()

    return run


def _entering(pdf: pd.DataFrame) -> pd.DataFrame:
    """The stack that each range of a page begins with, from what the ranges before it do."""
    stack, out = [np.eye(3)], []
    for row in pdf.sort_values("_part").itertuples(index=False):
        out.append([x for m in stack for x in _flat(m)])
        six = lambda v: [_matrix(np.array(x)) for x in np.reshape(np.asarray(v, float), (-1, 6))]
        stack = Stack(six(row.pops), six(row.pushed)).after(stack)
    return pdf.sort_values("_part").drop(columns=["pops", "pushed"]).assign(stack=out)


def _resumed(keys: list[str]):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, below, run = None, [], Stack()
        for pdf in pdfs:
            for k, own in pdf.groupby(["_part", "_page_key"], sort=False):
                if k != key:
                    # The stack that the range meets stands before its operators.
                    key, run = k, Stack()
                    below = [_matrix(np.array(x)) for x in np.reshape(np.asarray(own["stack"].iloc[0], float), (-1, 6))]
                    own = own.iloc[1:]
                out = []
                for _ in _walk(own, run):
                    now = run.after(below)
                    out.append([*_flat(now[-1]), len(now) - 1])
                if not out:
                    continue
                told = own[[*keys, "idx"]].reset_index(drop=True)
                yield pd.concat([told, pd.DataFrame(out, columns=[*PARTS, "depth"])], axis=1)

    return run


def current_matrices(ops: DataFrame, page: list[str]) -> DataFrame:
    """page, idx, a..f, depth: the transformation in force after every operator, and how many q are open.

    ops: page, idx (unique on a page), op and a..f (of cm). q keeps the current matrix, Q takes the last one kept (with none
    kept it does nothing), cm multiplies onto the current one from the left. Pages are cut into ranges of operators: one pass
    sums up what each range does to any stack, these few rows per page are put one after another, and a second pass resumes
    every range with the stack it meets. So a page of any length spreads over tasks, and memory follows the depth of q's.

    Operators other than q, Q and cm change nothing; a cm with a null part neither. Null positions are left out. An empty table
    gives no rows. Columns of other names are not read.
    """
    spark = ops.sparkSession
    keyed = ops.where("idx is not null").select(*page, F.col("idx").cast("long").alias("idx"), "op", *[F.col(c).cast("double").alias(c) for c in PARTS], F.xxhash64(*page).alias("_page_key"))
    tasks = max(2 * width(spark), tasks_for(keyed))
    ranged = cut(keyed.repartitionByRange(tasks, "_page_key", "idx").sortWithinPartitions("_page_key", "idx").withColumn("_part", F.spark_partition_id()))
    kinds = dict(keyed.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in page)
    range_ddl = f"_part int, _page_key long, {named}"
    runs = cut(ranged.mapInPandas(_runs(page), f"{range_ddl}, pops array<double>, pushed array<double>"))
    starts = runs.groupBy("_page_key").applyInPandas(_entering, f"{range_ddl}, stack array<double>")
    ddl = f"{named}, idx long, " + ", ".join(f"{c} double" for c in PARTS) + ", depth long"
    # A row for each page and range holds the stack and comes before the range's rows. It has all keys and a position, so that no whole
    # number becomes a float beside it.
    starts = starts.withColumns({"idx": F.lit(0).cast("long"), "_row": F.lit(False)})
    both = ranged.withColumn("_row", F.lit(True)).unionByName(starts, allowMissingColumns=True).repartition(tasks, "_part", "_page_key")
    met = both.sortWithinPartitions("_part", "_page_key", "_row", "idx")
    return met.mapInPandas(_resumed(page), ddl)
