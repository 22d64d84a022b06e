"""Slots to rows, JSON answers to rows, and answers to columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.text import not_blank


def unpivot_slots(
    df: DataFrame,
    carry: Sequence[str],
    slots: Sequence[Mapping[str, str]],
    number: str,
    require: str,
) -> DataFrame:
    """One row per numbered slot, in one scan. `slots[i]` maps output names to source columns.

    Slots whose `require` column is blank or NULL are left out; the column itself comes out as it was.
    """
    filled = F.array(*[
        F.struct(
            F.lit(i).alias(number),
            *[col(source).alias(name) for name, source in slot.items()],
        )
        for i, slot in enumerate(slots, start=1)
    ])
    return df.select(*map(col, carry), F.inline(filled)).filter(not_blank(col(require)))


def json_entries(text: Column, fields: Sequence[str], mode: str = "FAILFAST") -> Column:
    """JSON text to an array of structs of text; keys are matched in any case.

    Of keys that are the same, or differ in case only, the last one counts. Text that is not JSON fails the query; pass mode="PERMISSIVE" to get NULL for it.
    """
    parsed = F.from_json(text, "array<map<string,string>>", {"mode": mode})

    def last(entries: Column, field: str) -> Column:
        same = F.filter(entries, lambda e: F.lower(e["key"]) == field.lower())
        return F.try_element_at(same, F.lit(-1))["value"]

    return F.transform(
        parsed, lambda m: F.struct(*[last(F.map_entries(m), f).alias(f) for f in fields])
    )


def explode_json(
    df: DataFrame, text: str, fields: Sequence[str], carry: Sequence[str], mode: str = "FAILFAST"
) -> DataFrame:
    """One row per element of a JSON array; rows with a NULL or empty array vanish."""
    return df.select(*map(col, carry), F.inline(json_entries(col(text), fields, mode)))


def pivot_entries(
    df: DataFrame,
    entries: str,
    id_field: str,
    ids: Sequence[str],
    fields: Sequence[str],
    carry: Sequence[str],
) -> DataFrame:
    """Spread an array of entries over columns `<id>_<field>`, within the row.

    All entries of an output row already sit in one input row, so nothing is exploded, shuffled or
    grouped. The entries are folded into an array with a slot per id, in one pass over them; the columns are then read from
    their slots, so there is one expression over the entries, however many ids there are. A repeated id gives the largest text per
    field; rows without a listed id vanish.
    """
    kinds = {f.name: f.dataType for f in df.schema[entries].dataType.elementType.fields}
    slot = T.StructType([T.StructField(f, kinds[f]) for f in fields])
    empty = F.array_repeat(F.lit(None).cast(slot), len(ids))
    wanted = F.array(*map(F.lit, ids))

    def larger(a: Column, b: Column) -> Column:
        return F.greatest(a, b)  # of what is not NULL

    def put(slots: Column, entry: Column) -> Column:
        at = F.array_position(wanted, entry[id_field])
        held = F.get(slots, (at - 1).cast("int"))
        merged = F.struct(*[larger(held[f], entry[f]).alias(f) for f in fields])
        before, after = F.slice(slots, F.lit(1), (at - 1).cast("int")), F.slice(slots, (at + 1).cast("int"), F.lit(len(ids)))
        return F.concat(before, F.array(merged), after)

    listed = F.filter(col(entries), lambda e: e[id_field].isin(*ids))
    kept = df.select(*map(col, carry), listed.alias("_listed")).filter(F.size("_listed") > 0)
    folded = kept.select(*map(col, carry), F.aggregate("_listed", empty, put).alias("_slots"))
    return folded.select(
        *map(col, carry),
        *[F.col("_slots")[i][f].alias(f"{id}_{f}") for i, id in enumerate(ids) for f in fields],
    )
