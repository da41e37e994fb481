"""CSV in and out, with types told from the cells."""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNIFF = 2000
DELIMITERS = (",", ";", "\t", "|")
# The words that stand for true and false; they are asked for before numbers.
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")


def detect_delimiter(text: str) -> str:
    """The commonest delimiter outside quotes in the first 2000 characters; a comma if there is none."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for c in text[:SNIFF]:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
    best = max(DELIMITERS, key=counts.__getitem__)
    return best if counts[best] else ","


def typed(cell: Column) -> dict[str, Column]:
    """What a cell is as boolean, number and time, null where it is not; a cell is the first of these that it is."""
    t = F.trim(cell)
    word = F.lower(t)
    flag = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
    hex_ = F.conv(F.substring(t, F.lit(3), F.length(t)), 16, 10).cast("double")
    number = F.when(t.rlike(r"^0[xX][0-9A-Fa-f]+$"), hex_).when(t.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$"), t.try_cast("double"))
    time = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))
    return {"boolean": flag, "double": number, "timestamp": time}


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns as boolean, double or timestamp if all their cells that are not empty are; empty cells are null.
    One aggregation looks at all columns."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    if not columns:
        return df
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    tests = [F.coalesce(F.bool_and(F.when(cell(c).isNotNull(), k.isNotNull())), F.lit(False)).alias(f"{i}_{name}") for i, c in enumerate(columns) for name, k in typed(cell(c)).items()]
    found = df.agg(*tests).first()
    out = {}
    for i, c in enumerate(columns):
        kind = next((k for k in ("boolean", "double", "timestamp") if found[f"{i}_{k}"]), None)
        out[c] = typed(cell(c))[kind] if kind else cell(c)
    return df.withColumns(out)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, infer: bool = True, legacy: bool = False) -> DataFrame:
    """Quotes, doubled quotes and line breaks within quotes are understood; without a header columns are column1, ...
    Short rows are filled with nulls. legacy takes quotes as they are. The delimiter is told from the first lines."""
    if delimiter is None:
        head = "\n".join(r.value for r in spark.read.text(path).limit(50).collect())
        delimiter = detect_delimiter(head)
    df = spark.read.csv(path, sep=delimiter, header=header, quote="" if legacy else '"', escape='"', multiLine=not legacy, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not header:
        df = df.toDF(*[f"column{i + 1}" for i in range(len(df.columns))])
    return infer_types(df) if infer else df


def parse_csv(spark: SparkSession, text: str, **options) -> DataFrame:
    """CSV that is already at hand as a text, such as a message; large data is read with read_csv."""
    if not isinstance(text, str):
        raise TypeError("CSV must be a text")
    delimiter = options.get("delimiter") or detect_delimiter(text)
    rows = [[c.strip().replace("\r", "") for c in r] for r in _csv.reader(io.StringIO(text.strip(), newline=""), delimiter=delimiter) if any(c.strip() for c in r)]
    header = options.get("header", True)
    names = rows.pop(0) if rows and header else [f"column{i + 1}" for i in range(max(map(len, rows), default=0))]
    if not names:
        return spark.createDataFrame([], "value string").drop("value")
    last = {n: i for i, n in enumerate(names)}  # of a repeated header the last counts
    data = [tuple(r[i] if i < len(r) and r[i] else None for i in last.values()) for r in rows]
    df = spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in last))
    return infer_types(df) if options.get("infer", True) else df


def csv_line(df: DataFrame, delimiter: str = ",") -> Column:
    """A row as a line of CSV: null as nothing, quotes only where they are needed."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    needs = lambda v: v.contains('"') | v.contains(delimiter) | v.contains("\n")
    cell = lambda v: F.when(needs(v), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.concat_ws(delimiter, *[cell(text(c)) for c in df.columns])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.csv(path, sep=delimiter, header=header, quote='"', escape='"', nullValue="", emptyValue="")
