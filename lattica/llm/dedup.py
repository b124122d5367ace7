"""One document of each group of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .shared import fresh, written

SMALL = 500_000


def _comparable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return not isinstance(kind, MapType | VariantType)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` but for documents whose ``group_id`` in ``found`` (``doc_id, group_id``) is a smaller id.

    Of rows that are equal in every column one stays, maps and variants being compared by their JSON; a null id is in
    no group.  Columns, whatever their names, and their order stay.
    """
    gone_id, again_id, n_id = fresh(docs.columns, "gone", "again", "n")
    gone = written(found.where("group_id < doc_id").select(F.col("doc_id").alias(gone_id)).distinct(), "groups_gone")
    n = gone.count()
    # Texts are moved only where the list of documents to drop is too long to be sent to each task.
    gone = F.broadcast(gone) if n <= SMALL else gone.hint("shuffle_hash")
    kept = docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
    again = written(docs.groupBy(id_col).agg(F.count("*").alias(n_id)).where(F.col(n_id) > 1).select(F.col(id_col).alias(again_id)), "groups_again")
    n = again.count()
    if not n:
        return kept
    again = F.broadcast(again) if n <= SMALL else again
    same = F.col(id_col).eqNullSafe(F.col(again_id))
    repeated = kept.join(again, same, "left_semi")
    plain = [f.name for f in docs.schema if _comparable(f.dataType)]
    rest = [c for c in docs.columns if c not in plain]
    json = fresh([*docs.columns, gone_id, again_id, n_id], *[f"json{k}" for k in range(len(rest))])
    entries = lambda c: F.struct(F.sort_array(F.map_entries(c)) if isinstance(docs.schema[c].dataType, MapType) and _comparable(docs.schema[c].dataType.valueType) else F.col(c))
    repeated = repeated.withColumns({j: F.to_json(entries(c)) for j, c in zip(json, rest, strict=True)}).dropDuplicates([*plain, *json])
    return kept.join(again, same, "left_anti").unionAll(repeated.select(*docs.columns))
