"""Reading the audit's inputs: delimited text of unknown form, set collections, sample metadata, wide matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte order marks and the encodings that they name. Fixed values.
MARKS = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE", b"\xef\xbb\xbf": "UTF-8"}
SEPARATORS = ["\t", ",", ";", "|"]


def head(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    """The first bytes of a file, or of the first file of a folder, read from whatever store Spark reads; no more is read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        files = sorted((f.getPath() for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=str)
        if not files:
            return b""
        at = files[0]
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


#: Bytes that Windows-1252 leaves undefined. Fixed values.
UNDEFINED_1252 = "[\u0081\u008d\u008f\u0090\u009d]"
#: Bytes that are letters or signs in Windows-1252 and controls in Latin 1.
WINDOWS = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def candidates(spark: SparkSession, path: str, start: bytes) -> list[str]:
    """Encodings that the whole of a file decodes in, strictly, in the order in which they are tried.

    A byte order mark, or zeros in every other byte at the beginning, names its encoding. Other files are
    read line by line in tasks: UTF-8 if every line is valid, then Windows-1252 if no line has one of its
    undefined bytes; Latin 1 has a letter for every byte.
    """
    for mark, name in MARKS.items():
        if start.startswith(mark):
            return [name]
    if len(start) > 3 and not any(start[1:64:2]):
        return ["UTF-16LE"]
    if len(start) > 3 and not any(start[0:64:2]):
        return ["UTF-16BE"]
    lines = spark.read.text(path)  # bytes as they are: the text source decodes nothing
    found = ["UTF-8"] if lines.where(~F.is_valid_utf8("value")).isEmpty() else []
    as_latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    if not found and lines.where(as_latin.rlike(UNDEFINED_1252)).isEmpty():
        found = ["windows-1252"]
    return [*found, "ISO-8859-1"]


def header(start: bytes, name: str, comment: str | None) -> tuple[str | None, int]:
    """The separator that cuts a file's first line into most columns, and their number."""
    lines = [x for x in start.decode(name, "ignore").lstrip("\ufeff").splitlines() if x and not (comment and x.startswith(comment))]
    if not lines:
        return None, 0
    sep = max(SEPARATORS, key=lambda s: lines[0].count(s))
    return sep, lines[0].count(sep) + 1


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, comment: str | None = "#") -> DataFrame:
    """A delimited table with a header: the first encoding that all of it decodes in and that gives more than one column."""
    start = head(spark, path, 1 << 20)
    told = {name: header(start, name, comment) for name in candidates(spark, path, start)}
    name = next((n for n, (_, columns) in told.items() if columns > 1), None)
    if name is None:
        raise ValueError(f"{path}: no header of more than one column in {', '.join(told)}")
    sep = told[name][0]
    windows = name == "windows-1252"  # Spark's reader does not know it: read as Latin 1, whose control characters it uses for letters
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1" if windows else name)
    reader = reader.option("comment", comment) if comment else reader
    if name.startswith("UTF-16"):  # line ends of two bytes can't be found by cutting the file; such a file is read whole
        marked = any(start.startswith(m) for m in MARKS)
        reader = reader.option("encoding", "UTF-16" if marked else name).option("multiLine", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if windows:
        controls = "".join(map(chr, WINDOWS))
        letters = bytes(WINDOWS).decode("cp1252")
        df = df.select(*[F.translate(F.col(f"`{c}`"), controls, letters).alias(c.translate(str.maketrans(controls, letters))) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    return df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])


def read_hash_header(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated strings whose header begins with a #."""
    lines = head(spark, path, 1 << 16).decode("utf-8", "ignore").splitlines()
    names = lines[0].lstrip("#").split("\t") if lines else []
    df = spark.read.option("sep", "\t").option("header", False).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return df.where(~F.coalesce(F.col(f"`{names[0]}`").startswith("#"), F.lit(False)))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """term, description, gene of a set collection: one set a line, genes from the third field on, cleaned and distinct."""
    from larkaudit.functions.text import clean_symbol

    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    rows = f.select(F.col("f")[0].alias("term"), F.col("f")[1].alias("description"), F.explode(F.slice("f", 3, F.size("f"))).alias("gene"))
    return rows.withColumn("gene", clean_symbol(F.col("gene"))).where("gene is not null").distinct()


def read_series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """sample (position), key, value from the !Sample_ lines of a series matrix; repeated keys are numbered from 1."""
    whole = spark.read.text(path, wholetext=False).where(F.col("value").startswith("!Sample_"))
    lines = whole.withColumn("at", F.monotonically_increasing_id()).select("at", F.split("value", "\t").alias("f"))
    from pyspark.sql import Window

    key = F.regexp_replace(F.col("f")[0], "^!Sample_", "")
    same = Window.partitionBy("key")
    lines = lines.select("at", key.alias("key"), F.slice("f", 2, F.size("f")).alias("f"))
    lines = lines.withColumn("i", F.row_number().over(same.orderBy("at"))).withColumn("n", F.count("*").over(same))
    name = F.when(F.col("n") > 1, F.concat_ws("_", "key", "i")).otherwise(F.col("key"))
    return lines.select(name.alias("key"), F.posexplode("f").alias("sample", "value")).withColumn("value", F.trim(F.regexp_replace("value", '^"|"$', "")))


def orientation(columns: list[str], first_values: list[str], prefix: str, share: float = 0.2) -> str:
    """genes_by_samples if enough column names are samples, samples_by_genes if enough first values are, else uncertain."""
    hit = lambda names: sum(n.upper().startswith(prefix) for n in names) / max(len(names), 1)
    return "genes_by_samples" if hit(columns[1:]) >= share else "samples_by_genes" if hit(first_values[:2000]) >= share else "uncertain"


def unpivot_matrix(wide: DataFrame, row: str, row_name: str = "gene_id", column_name: str = "sample_id") -> DataFrame:
    """row_name, column_name, value in long form; what is no finite number becomes null."""
    from larkaudit.functions.text import number

    long = wide.select(F.col(row).cast("string").alias(row_name), *[F.col(f"`{c}`").cast("string") for c in wide.columns if c != row]).unpivot([row_name], None, column_name, "value")
    return long.withColumn("value", number(F.col("value")))


def read_json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows from JSON files, one object or list of objects a file."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def read_parts(spark: SparkSession, path: str, expected: int, schema: str | None = None) -> DataFrame:
    """All delimited files that ``path`` names as one table with source_file; another number of files than expected is an error."""
    reader = spark.read.option("header", True).option("sep", "\t")
    df = (reader.schema(schema) if schema else reader).csv(path)
    n = len(df.inputFiles())
    if n != expected:
        raise ValueError(f"{path}: {n} files, {expected} expected")
    return df.withColumn("source_file", F.input_file_name())


def read_wide_features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a wide delimited table, those of them that it has, in the order given."""
    df = read_delimited(spark, path)
    return df.select(*[c for c in columns if c in df.columns])


def audit_files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """name, path, found, bytes of each input, of all files below it for a folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for name, path in files.items():
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        found = fs.exists(at)
        rows.append((name, path, found, fs.getContentSummary(at).getLength() if found else None))
    return spark.createDataFrame(rows, "name string, path string, found boolean, bytes long")


def write_delimited(df: DataFrame, path: str, places: int = 10) -> None:
    """Tab-separated files with a header; doubles with a fixed number of places."""
    columns = [F.format_string(f"%.{places}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", "").csv(path)
