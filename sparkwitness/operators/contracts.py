"""Contracts of JSON records: required fields, enums, ranges, nested objects, no unknown fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What a field may hold: one of ``values``, a number within the bounds, an object of ``fields``; anything without these."""

    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    optional: bool = False
    fields: dict[str, Rule] = field(default_factory=dict)

    def fault(self, value: Column) -> Column:
        """Code of the first fault of a value that is there, else null."""
        number = value.try_cast("double")
        fault = F.lit(None).cast("string")
        if self.low is not None or self.high is not None:
            inside = F.lit(True)
            if self.low is not None:
                inside = inside & (number >= self.low)
            if self.high is not None:
                inside = inside & (number <= self.high)
            fault = F.when(number.isNull() | F.isnan(number), "type").when(~inside, "range")
        if self.values:
            fault = F.when(~value.isin(*self.values), "enum").otherwise(fault)
        return fault


def violations(record: Column, contract: dict[str, Rule], at: str = "") -> Column:
    """Array of ``path:code`` of a JSON text: missing, null, type, enum, range, unknown; empty where it holds.

    A record that is null or no JSON object has the one fault ``type``.  Fields
    come in the order of the contract, unknown ones after them in theirs.
    """
    keys = F.json_object_keys(record)
    found = []
    for name, rule in contract.items():
        value = F.get_json_object(record, f"$['{name}']")
        absent = F.when(~F.array_contains(keys, name), F.lit(None if rule.optional else "missing")).when(value.isNull(), F.lit(None if rule.optional else "null"))
        there = F.array_contains(keys, name) & value.isNotNull()
        if rule.fields:
            found.append(F.when(there, violations(value, rule.fields, f"{at}{name}.")).when(absent.isNotNull(), F.array(F.concat(F.lit(f"{at}{name}:"), absent))))
        else:
            code = F.when(there, rule.fault(value)).otherwise(absent)
            found.append(F.when(code.isNotNull(), F.array(F.concat(F.lit(f"{at}{name}:"), code))))
    unknown = F.transform(F.filter(keys, lambda k: ~k.isin(*contract)), lambda k: F.concat(F.lit(at), k, F.lit(":unknown")))
    none = F.array().cast("array<string>")
    parts = F.flatten(F.array(*[F.coalesce(x, none) for x in (*found, unknown)]))
    return F.when(keys.isNull(), F.array(F.lit(f"{at.rstrip('.') or '$'}:type"))).otherwise(parts)


def quarantine(records: DataFrame, json: str, contract: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """The records that hold the contract, and the others with their ``violations``; no record is in neither."""
    judged = records.withColumn("violations", violations(F.col(json), contract))
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)
