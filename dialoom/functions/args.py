"""Canonical JSON for open-typed call arguments, built on VARIANT values."""
from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANT_MAP = "map<string,variant>"


def json_object(text: Column) -> Column:
    """Parse text as a JSON object into MAP<STRING,VARIANT>; NULL for anything else."""
    whole = F.btrim(text, F.lit(" \t\n\r"))
    looks = whole.startswith("{") & whole.endswith("}")
    return F.when(looks, F.try_parse_json(whole).try_cast(VARIANT_MAP))


def json_string(text: Column) -> Column:
    """A string as a quoted JSON string."""
    return F.to_json(text.cast("variant"))


def value_json(value: Column) -> Column:
    """JSON text of one VARIANT; whole numbers print the same whether written 1 or 1.0."""
    kind = F.schema_of_variant(value)
    number = value.try_cast("double")
    whole = number.try_cast("decimal(38,0)")  # JSON numbers of more digits are floating-point in any notation
    return (F.when(kind.isin("DOUBLE", "FLOAT") & (whole.cast("double") == number), whole.cast("string"))
            .otherwise(F.to_json(value)))


def entries_json(entries: Column) -> Column:
    """Sorted JSON object from an array of "key":value texts."""
    return F.concat(F.lit("{"), F.array_join(F.sort_array(entries), ","), F.lit("}"))


def canonical_args(args: Column, drop=()) -> Column:
    """Sorted, number-normalised JSON of MAP<STRING,VARIANT>, optionally without some keys.

    A parsed object already holds its keys in order and its decimals without trailing zeros, so its
    plain JSON is canonical unless a floating-point number in it prints with `.0` or an exponent.
    """
    kept = F.map_filter(args, lambda k, _: ~k.isin(*drop)) if drop else args
    plain = F.to_json(kept)
    slow = entries_json(F.transform(F.map_entries(kept),
                                    lambda e: F.concat(json_string(e["key"]), F.lit(":"), value_json(e["value"]))))
    in_order = F.map_keys(kept) == F.sort_array(F.map_keys(kept))
    return F.when(in_order & ~F.regexp_like(plain, F.lit(r"\d\.0[,}\]]|\dE")), plain).otherwise(slow)
