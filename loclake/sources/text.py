"""Text sources: files, tolerant decoding, lines, and the leaves of CSV, TXT, JSON, YAML, INI and XML files."""

from __future__ import annotations

import configparser
import csv
import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loclake.functions import predicates as P
from loclake.functions.text import strip

# Line ends that text files may have, and extensions of scripts and data files.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
EXTENSIONS = ("rpy", "rpym", "json", "csv", "txt", "yaml", "xml", "ini")


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(file_path, content) of a project's files; paths are relative to the folder, translations (tl/) are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    root = folder.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + "".join(f"[{c}]" if c in ".^$[]()+*?{}|" else c for c in root.lstrip("/")), "")
    return raw.select(rel.alias("file_path"), "content").where(~F.col("file_path").startswith("tl/") & ~P.engine_file(F.col("file_path")))


@F.pandas_udf(T.StringType())
def _guess(content: pd.Series) -> pd.Series:
    """Charset detection for what isn't UTF-8; what can't be read is replaced."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            from charset_normalizer import from_bytes

            if best := from_bytes(raw).best():
                return str(best)
        except ImportError:
            pass
        return raw.decode("cp1252", "replace")

    return content.map(one)


def decoded(content: Column) -> Column:
    """UTF-8 without its byte-order mark where the bytes are UTF-8, else the most likely charset."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    other = _guess(F.when(~utf8, content))
    return F.when(utf8, F.regexp_replace(content.cast("string"), "\\A\\uFEFF", "")).otherwise(other)


def lines(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(…, line_number, line) with numbers from 1; an end of the last line begins no further one."""
    parts = F.split(text, LINE_END, -1)
    body = F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return df.select(*keep, F.posexplode(body).alias("_n", "line")).select(*keep, (F.col("_n") + 1).alias("line_number"), "line")


def txt_entries(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    out = lines(df, text, keep).withColumn("text", strip(F.col("line"))).where(P.two_letters(F.col("text")))
    return out.select(*keep, "line_number", "text", F.concat(F.lit("txt:line"), F.col("line_number")).alias("context_line"))


# --- leaves of data files; each function maps a whole file to (path, key, text) ---------------------------------------


def json_leaves(content: str) -> Iterator[tuple[str, str | None, str]]:
    def walk(x, path: str, key: str | None):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}.{k}" if path else str(k), str(k))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]", key)
        elif isinstance(x, str):
            yield path, key, x

    try:
        yield from walk(json.loads(content), "", None)
    except ValueError:
        return


def yaml_leaves(content: str) -> Iterator[tuple[str, str | None, str]]:
    try:
        import yaml
    except ImportError:
        return
    try:
        yield from json_leaves(json.dumps(yaml.safe_load(content), default=str))
    except yaml.YAMLError:
        return


def ini_leaves(content: str) -> Iterator[tuple[str, str | None, str]]:
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    try:
        parser.read_string(content)
    except configparser.Error:
        return
    for section in parser.sections():
        for k, v in parser.items(section):
            yield f"ini:[{section}]{k}", k, v


def xml_leaves(content: str) -> Iterator[tuple[str, str | None, str]]:
    if "<!DOCTYPE" in content or "<!ENTITY" in content:  # entity expansion is refused
        return
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return

    def walk(e, path: str):
        if e.text and e.text.strip():
            yield path, e.tag, e.text.strip()
        for child in e:
            yield from walk(child, f"{path}/{child.tag}")
            if child.tail and child.tail.strip():
                yield f"{path}/{child.tag}_tail", e.tag, child.tail.strip()

    yield from walk(root, root.tag)


def csv_cells(content: str) -> Iterator[tuple[str, str | None, str]]:
    try:
        dialect = csv.Sniffer().sniff(content[:1024])
    except csv.Error:
        dialect = csv.excel
    try:
        for r, row in enumerate(csv.reader(io.StringIO(content), dialect)):
            for c, cell in enumerate(row):
                yield f"csv:row{r}_col{c}", None, cell
    except csv.Error:
        return


#: Whether the key lists apply: they do for YAML, INI and XML.
READERS = {"json": (json_leaves, False), "csv": (csv_cells, False), "yaml": (yaml_leaves, True), "yml": (yaml_leaves, True), "ini": (ini_leaves, True), "xml": (xml_leaves, True)}


def data_entries(df: DataFrame, kind: str, key: str = "file_path", content: str = "text") -> DataFrame:
    """(key, context_line, key_name, text) of the texts in data files of one kind; broken files have none."""
    reader, keyed = READERS[kind]
    key_type = dict(df.dtypes)[key]

    def read(batches):
        for pdf in batches:
            rows = [(k, p, n, t) for k, c in zip(pdf[key], pdf[content]) if isinstance(c, str) for p, n, t in reader(c)]
            yield pd.DataFrame(rows, columns=[key, "context_line", "key_name", "text"])

    out = df.select(key, content).mapInPandas(read, f"{key} {key_type}, context_line string, key_name string, text string")
    return out.where(P.meaningful_value(F.col("text"), F.col("key_name")) if keyed else P.two_letters(F.col("text")))


# --- side tables and folders ------------------------------------------------------------------------------------------


def side_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of texts (a glossary, rules); a list gives its items with null values; a missing or
    broken file has no rows."""
    schema = "key string, value string"
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception:  # the file's absence is found when it is analysed
        return spark.createDataFrame([], schema)
    pairs = F.from_json("value", "map<string,string>")
    items = F.transform(F.from_json("value", "array<string>"), lambda v: F.struct(v.alias("key"), F.lit(None).cast("string").alias("value")))
    rows = F.when(F.ltrim("value").startswith("["), items).otherwise(F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return raw.select(F.inline(rows)).where("key is not null")


def diagnostic_samples(spark: SparkSession, path: str, fields: str = "text string, translation_id string, file string") -> DataFrame:
    """The samples of an earlier report, one row each."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.inline(F.from_json("value", f"samples array<struct<{fields.replace(' string', ':string')}>>")["samples"]))


def translation_folder(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    """(file_path, content) of the scripts below tl/<lang>, whatever the case of the folder's name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rpy").load(folder)
    return raw.where(P.in_language_folder(F.col("path"), lang)).select(F.col("path").alias("file_path"), "content")
