"""Identifiers, symbols, stages and statuses as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing symbol. Fixed values.
MISSING_SYMBOLS = ["", "-", "NA", "NAN", "NONE", "NULL"]
#: Spellings of a missing identifier. Fixed values.
MISSING_IDS = ["", "nan", "none", "null", "na"]


def normalize_text(v: Column) -> Column:
    return F.nullif(F.trim(v), F.lit(""))


def barcode(v: Column) -> Column:
    return F.upper(F.replace(F.trim(v), F.lit("."), F.lit("-")))


def patient_of(v: Column, project: str = "TCGA-") -> Column:
    """The first 12 characters of a sample code of the project, any other code as it is."""
    b = barcode(v)
    return F.when(b.startswith(project) & (F.length(b) >= 12), F.substring(b, 1, 12)).otherwise(b)


def patient_by_parts(v: Column, parts: int = 3) -> Column:
    return F.array_join(F.slice(F.split(barcode(v), "-"), 1, parts), "-")


def sample_type(v: Column) -> Column:
    """The first two characters of the fourth part, null if there is none."""
    return F.substring(F.get(F.split(barcode(v), "-"), F.lit(3)), 1, 2)


def is_primary(v: Column) -> Column:
    return F.coalesce(sample_type(v) == "01", F.lit(False))


def clean_symbol(v: Column) -> Column:
    s = F.upper(F.trim(v))
    return F.when(s.isin(MISSING_SYMBOLS), None).otherwise(s)


def split_symbols(v: Column) -> Column:
    """Clean symbols of a list with bars, commas or semicolons."""
    return F.filter(F.transform(F.split(v, r"[|,;]"), clean_symbol), lambda s: s.isNotNull())


def normalize_identifier(v: Column) -> Column:
    return F.regexp_replace(F.upper(v), "[^A-Z0-9]", "")


def valid_id(v: Column) -> Column:
    return v.isNotNull() & ~F.lower(F.trim(v)).isin(MISSING_IDS)


def stage_group(v: Column) -> Column:
    """Early or Advanced from a raw stage; III and IV are looked for before II and I."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(v)), "STAGE|PATHOLOGIC|CLINICAL|AJCC", ""), r"[\-_. ]", "")
    return (
        F.when(s.isNull() | s.isin("", "X", "NA", "NAN", "UNKNOWN", "NOTREPORTED", "NOTAVAILABLE"), None)
        .when(s.startswith("III") | s.startswith("IV"), "Advanced")
        .when(s.startswith("II") | s.startswith("I"), "Early")
    )


def stage_binary(v: Column) -> Column:
    """1 for IV and III, 0 for II and I, else by the first number: 3 and 4 give 1, 1 and 2 give 0."""
    s = F.upper(F.trim(v))
    number = F.nullif(F.regexp_extract(s, r"([0-9])", 1), F.lit(""))
    return (
        F.when(s.rlike(r"\b(IV|III)[ABC]?\b"), 1)
        .when(s.rlike(r"\b(II|I)[ABC]?\b"), 0)
        .when(number.isin("1", "2"), 0)
        .when(number.isin("3", "4"), 1)
    )


def _nodal(status: str, n_class: str, amount: str) -> str:
    """A pattern of a nodal finding: its status word, alone or after what it is said of; its class; or an amount of nodes."""
    gap, amount_of = r"[\s_-]*", r"(?:positive\s*)?(?:lymph )?nodes?"
    said_of = rf"(?:lymph{gap})?(?:node|nodal){gap}"
    return rf"\b(?:(?:{said_of})?{status}|n{n_class}|{amount}{amount_of})\b"


NODE_NEGATIVE = _nodal("negative", "0", r"(?:0\s*|no\s+)")
NODE_POSITIVE = _nodal("positive", "[1-9]", r"[1-9]\d*\s*")


def node_status(v: Column) -> Column:
    """0 for negative, else 1 for positive spellings, else by the number if there is exactly one: 0 gives 0, more gives 1."""
    s = F.lower(F.trim(v))
    numbers = F.regexp_extract_all(s, F.lit(r"[0-9]+"), F.lit(0))
    return F.when(s.rlike(NODE_NEGATIVE), 0).when(s.rlike(NODE_POSITIVE), 1).when(F.size(numbers) == 1, F.when(F.get(numbers, F.lit(0)).cast("bigint") > 0, 1).otherwise(0))


def key_value(text: Column, fallback: Column) -> Column:
    """struct(key, value): cut at the first colon, else at the first equals sign, else (fallback, text)."""

    def at(sign: str) -> Column:
        i = F.instr(text, sign)
        return F.struct(F.lower(F.trim(F.substr(text, F.lit(1), i - 1))).alias("key"), F.trim(F.substr(text, i + 1)).alias("value"))

    return F.when(F.instr(text, ":") > 0, at(":")).when(F.instr(text, "=") > 0, at("=")).otherwise(F.struct(fallback.alias("key"), F.trim(text).alias("value")))


def number(v: Column) -> Column:
    """As a double, null where it is none or not finite."""
    d = F.expr("try_cast(x as double)") if isinstance(v, str) else v.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def first_existing(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    """The first candidate among the columns, exactly or else without regard to case."""
    lower = {c.lower(): c for c in reversed(columns)}
    found = next((c for c in candidates if c in columns), None) or next((lower[c.lower()] for c in candidates if c.lower() in lower), None)
    if found is None and required:
        raise KeyError(f"none of {candidates} among {columns}")
    return found


def ordered_join(label: Column, *order: Column, sep: str = "; ") -> Column:
    """An aggregate: labels in order, joined."""
    pairs = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], label.alias("label"))))
    return F.array_join(F.transform(pairs, lambda x: x["label"]), sep)


def coalesce_with_source(**named: Column) -> tuple[Column, Column]:
    """The first known value and the name of where it is from."""
    value = F.coalesce(*named.values())
    source = reduce(lambda c, item: c.when(item[1].isNotNull(), item[0]), list(named.items())[1:], F.when(list(named.values())[0].isNotNull(), next(iter(named))))
    return value, source.otherwise("unresolved")
