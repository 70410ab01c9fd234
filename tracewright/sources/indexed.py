"""The seven tables, stored so that the rows of few ids are found without a scan.

A table is stored once for each column that it is looked up by: by its document's id, and by the ids
that the document names (a copy leaves out rows that name nothing). A change of documents reads and
rewrites the buckets of the changed documents and of what they name, or named before.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .buckets import BucketTable
from .documents import Tables
from .schema import TABLES

#: For each table its document's id, and the other ids that it is looked up by.
OWNER = {"dsir": "dsir_id", "dsir_parent": "dsir_id", "dsir_child": "dsir_id", "dsar": "dsar_id", "dsar_dsir": "dsar_id", "job": "job_id", "job_dsar": "job_id"}
NAMES = {"dsir": ["dsar_id"], "dsir_parent": ["parent_id"], "dsir_child": ["child_id"], "dsar_dsir": ["dsir_id"], "job_dsar": ["dsar_id"]}
#: The table with one row for each document, by the id's column.
HEAD = {"dsir_id": "dsir", "dsar_id": "dsar", "job_id": "job"}


def ids(df: DataFrame, column: str) -> DataFrame:
    """One column of ids, whatever it was called."""
    return df.select(F.col(column).alias("id"))


def at_once(work: list[Callable[[], object]], most: int = 3) -> None:
    """Runs writes that do not depend on each other side by side: each alone is too small to fill a
    cluster when a change is. Few at a time, for the driver holds the plans of all that run. The first
    error is raised when all have ended."""
    with ThreadPoolExecutor(most) as pool:
        for done in [pool.submit(w) for w in work]:
            done.result()


class IndexedTables:
    """Tables of documents in a folder. The numbers of jobs are the caller's and stay theirs: a
    change must not number old jobs anew (as ``normalise`` does for each set of documents)."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64) -> None:
        self.copies = {
            (name, column): BucketTable(spark, f"{path.rstrip('/')}/{name}-{column}", TABLES[name], [column], n_buckets)
            for name in TABLES for column in [OWNER[name], *NAMES.get(name, [])]
        }

    def load(self, t: Tables) -> None:
        """Fills empty tables."""
        at_once([partial(table.insert, t[name].where(F.col(column).isNotNull())) for (name, column), table in self.copies.items()])

    def read(self) -> Tables:
        return {name: self.copies[name, OWNER[name]].read() for name in TABLES}

    def look(self, name: str, column: str, wanted: DataFrame) -> DataFrame:
        """The rows of a table whose column is one of the wanted ids (a column ``id``)."""
        return self.copies[name, column].lookup(wanted.select(F.col("id").alias(column)))

    def change(self, new: Tables, changed: dict[str, DataFrame]) -> None:
        """Puts the rows of new in place of all rows of the changed documents, which are ids by the
        id's column; a changed document without rows is gone. The copies by other ids come first: if
        the work is cut short it can be done again, for the old rows are still found by document."""
        def by_names(name: str) -> None:
            owner = OWNER[name]
            before = cut(self.look(name, owner, changed[owner]))
            for column in NAMES[name]:
                self.copies[name, column].replace(before.where(F.col(column).isNotNull()), new[name].where(F.col(column).isNotNull()), [column, owner])

        at_once([partial(by_names, name) for name in NAMES])
        at_once([partial(self.copies[name, owner].replace, changed[owner].select(F.col("id").alias(owner)), new[name]) for name, owner in OWNER.items()])
