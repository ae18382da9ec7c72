"""Matches that depend on order: each base row, in order, takes what earlier ones left.

Rows of one document meet in sorted order and are streamed; a document's rows of one side, as keys of 16 bytes, are held by its task, as
its text is when nodes are made of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Unused:
    """Current rows by each of their keys, in order, without those that were taken."""

    def __init__(self, n_rules: int):
        self.by_key: list[dict[bytes, dict[str, None]]] = [{} for _ in range(n_rules)]
        self.keys: dict[str, tuple] = {}

    def add(self, row: str, keys: tuple) -> None:
        self.keys[row] = keys
        for rule, key in enumerate(keys):
            self.by_key[rule].setdefault(key, {})[row] = None

    def take(self, keys: tuple, unique: list[bool]) -> tuple[str, int] | None:
        """The row that the first rule finds: the only one left with its key, or the first."""
        for rule, key in enumerate(keys):
            left = self.by_key[rule].get(key)
            if left and (len(left) == 1 or not unique[rule]):
                row = next(iter(left))
                for other, own in enumerate(self.keys.pop(row)):
                    del self.by_key[other][own][row]
                return row, rule
        return None


def match_in_order(base: DataFrame, current: DataFrame, rules: list[tuple[str, list[str], bool]], id_col: str = "locator") -> DataFrame:
    """(doc_id, base_id, current_id, how): each base row by ``pos`` takes a current row that none before it took.

    Rules (name, columns, unique) are tried in turn for each base row: a unique one takes the only row left with its columns'
    values, the others the first by ``pos``.
    """
    names, unique = [name for name, _, _ in rules], [u for _, _, u in rules]

    def side(df: DataFrame, number: int) -> DataFrame:
        keys = [F.md5(F.to_json(F.struct(*columns))).alias(f"k{i}") for i, (_, columns, _) in enumerate(rules)]
        return df.select("doc_id", F.lit(number).alias("side"), "pos", F.col(id_col).cast("string").alias("id"), *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, left = None, Unused(len(rules))
        for batch in batches:
            out: list[tuple] = []
            for d, number, _, row, *keys in zip(*(c.to_pylist() for c in batch.columns)):
                if (d,) != doc:
                    doc, left = (d,), Unused(len(rules))
                if number == 0:
                    left.add(row, tuple(keys))
                elif found := left.take(tuple(keys), unique):
                    out.append((d, row, found[0], names[found[1]]))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.string(), pa.string(), pa.string()))], names=["doc_id", "base_id", "current_id", "how"])

    rows = side(current, 0).unionByName(side(base, 1)).repartition("doc_id").sortWithinPartitions("doc_id", "side", "pos", "id")
    kind = base.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, base_id string, current_id string, how string")
