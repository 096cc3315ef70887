"""Clinical stages: stated groups, raw codes, and which columns of a table may hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkaudit.functions.text import coalesce_with_source

#: Spellings of stated groups, and of unknown stages. Fixed values.
EARLY = ["early", "early stage", "stage i/ii", "i/ii"]
ADVANCED = ["advanced", "advanced stage", "late", "late stage", "stage iii/iv", "iii/iv"]
UNKNOWN = ["", "NA", "NAN", "NONE", "NULL", "NOT REPORTED", "UNKNOWN"]
#: Stage codes, what is looked for first at the front, and what a lone digit stands for. Fixed values.
CODES = ["IVC", "IVB", "IVA", "IV", "IIIC", "IIIB", "IIIA", "III", "IIC", "IIB", "IIA", "II", "IB", "IA", "IS", "I"]
NUMERALS = {"1": "I", "2": "II", "3": "III", "4": "IV"}
#: Words that may be written on to a code without a blank. Fixed values.
AROUND = ["PATHOLOGIC", "CLINICAL", "TUMOR", "STAGE"]
#: Words of column names that are no stages; endings that say nothing; names of stages, and words of other ones, with their ranks. Fixed values.
NO_STAGE = ["date", "time", "rppa", "protein", "pancan", "plate", "batch", "form_completion", "year", "month", "day"]
ENDINGS = ["_pheno", "_clinical"]
NAMES = [
    "pathologic_stage", "pathological_stage", "ajcc_pathologic_tumor_stage", "ajcc_pathologic_stage", "tumor_stage", "clinical_stage", "ajcc_clinical_stage", "stage",
]
WORDS = {"pathologic": 20, "ajcc": 30, "clinical": 40, "tumor": 50, "stage": 60}


def stated_group(v: Column) -> Column:
    """Early or Advanced from a field that states the group; null for anything else."""
    s = F.lower(F.trim(v))
    return F.when(s.isin(EARLY), "Early").when(s.isin(ADVANCED), "Advanced")


def stage_code(v: Column) -> Column:
    """Of the words of a text the one that comes first among CODES, else the code of its first number from 1 to 4; null for unknown ones.

    Words end at anything but letters and digits; AROUND is taken out wherever it stands.
    """
    s = F.upper(F.trim(v))
    bare = F.regexp_replace(s, "|".join(AROUND), "")
    codes = F.array(*[F.lit(c) for c in CODES])
    places = F.transform(F.split(bare, "[^A-Z0-9]+"), lambda word: F.array_position(codes, word))
    named = F.get(codes, F.array_min(F.filter(places, lambda at: at > 0)).cast("int") - 1)
    single = F.filter(F.regexp_extract_all(bare, F.lit("[0-9]+"), F.lit(0)), lambda n: n.isin(*NUMERALS))
    numbered = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])[F.get(single, F.lit(0))]
    return F.when(~s.isin(UNKNOWN), F.coalesce(named, numbered))


def code_group(code: Column) -> Column:
    s = F.upper(F.trim(code))
    return F.when(s.isin([c for c in CODES if not c.startswith(("III", "IV"))]), "Early").when(s.isin([c for c in CODES if c.startswith(("III", "IV"))]), "Advanced")


def column_priority(name: str) -> int | None:
    """Rank of a column as a source of stages, smaller first; None if it may not be one."""
    low = name.strip().lower()
    bare = next((low.removesuffix(e) for e in ENDINGS if low.endswith(e)), low)
    ranks = {rank for rank, known in enumerate(NAMES) if known == bare}
    if "stage" in bare:
        ranks |= {rank for word, rank in WORDS.items() if word in bare}
    return None if any(w in low for w in NO_STAGE) else min(ranks, default=None)


def stage_columns(df: DataFrame) -> list[str]:
    """Columns that may hold stages, best first."""
    ranked = [(column_priority(c), c) for c in df.columns]
    return [c for _, c in sorted((p, c) for p, c in ranked if p is not None)]


def with_stage(df: DataFrame) -> DataFrame:
    """Adds stage_code, stage_group and stage_source, the first of ``stage_columns`` that gives a code; no such column is an error."""
    columns = stage_columns(df)
    if not columns:
        raise ValueError("no column may hold a stage")
    code, source = coalesce_with_source(**{c: stage_code(F.col(c)) for c in columns})
    return df.withColumns({"stage_code": code, "stage_group": code_group(code), "stage_source": source})


def require_sources(df: DataFrame, source: str = "stage_source") -> DataFrame:
    """The table itself, if all resolved stages come from permitted columns."""
    used = [r[0] for r in df.select(source).distinct().collect()]  # at most one row a column
    wrong = [u for u in used if u not in (None, "unresolved") and column_priority(u) is None]
    if wrong:
        raise ValueError(f"stages from columns that are not permitted: {wrong}")
    return df
