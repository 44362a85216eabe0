"""String expressions shared by several operators."""
from pyspark.sql import Column
from pyspark.sql import functions as F

def title_case(text: Column) -> Column:
    """Upper-case a letter after anything that is not a letter, lower-case all others."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"([^\p{L}]*\p{L}*)"), F.lit(1))
    def lift(p):
        lead = F.regexp_extract(p, r"^([^\p{L}]*)", 1)
        rest = F.substring(p, F.length(lead) + 1, F.length(p))
        return F.concat(lead, F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, F.length(rest)))
    return F.array_join(F.transform(pieces, lift), "")


def slug(text: Column, drop_quotes=True, dashes=False) -> Column:
    """Lower-case with `_` for spaces; optionally drop apostrophes or map dashes too."""
    out = F.replace(F.lower(text), F.lit(" "), F.lit("_"))
    if drop_quotes:
        out = F.replace(out, F.lit("'"), F.lit(""))
    if dashes:
        out = F.replace(out, F.lit("-"), F.lit("_"))
    return out


def domain_of(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit("."), F.lit(1))


def suffix_of(entity_id: Column) -> Column:
    """Everything after the first dot."""
    return F.substring(entity_id, F.locate(".", entity_id) + 1, F.length(entity_id))


def friendly_name(entity_id: Column) -> Column:
    return title_case(F.replace(suffix_of(entity_id), F.lit("_"), F.lit(" ")))


def placeholders(text: Column, question=False) -> Column:
    """Sorted, comma-joined names of the `<x>` markers in a template.

    Answer templates ignore `device_name` itself; question templates ignore every device_name
    marker and count repeated markers once.
    """
    names = F.regexp_extract_all(text, F.lit("<(.*?)>"), F.lit(1))
    if question:
        names = F.array_distinct(F.filter(names, lambda n: ~n.contains("device_name")))
    else:
        names = F.filter(names, lambda n: n != "device_name")
    return F.array_join(F.sort_array(names), ",")


def fill(text: Column, values: dict) -> Column:
    """Replace `<name>` by a literal value for every (name -> column); NULL values leave the marker."""
    for name, value in values.items():
        mark = F.lit(f"<{name}>")
        text = F.replace(text, mark, F.coalesce(value.cast("string"), mark))
    return text


def strip_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def lookup(key: Column, table: dict) -> Column:
    """Look a string up in a short fixed table of values or lists; NULL when absent."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)
