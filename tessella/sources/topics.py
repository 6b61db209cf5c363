"""Markdown sources: directory scan, front matter, hook lines, embedding texts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<name:string,description:string,type:string,status:string,authority:string,scopes:array<string>,applies_to:array<string>,triggers:array<string>,last_verified:string,expires_at:string,review_by:string,authority_docs:array<string>,history_docs:array<string>,supersedes:array<string>,retired_by:string,extra:map<string,string>>"
LISTS = ("scopes", "applies_to", "triggers", "authority_docs", "history_docs", "supersedes")
SCALARS = ("name", "description", "type", "status", "authority", "last_verified", "expires_at", "review_by", "retired_by")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files of a folder and its dated archive: path, file, kind (catalog, l2, topic), active, sha256, bytes,
    content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    file = F.element_at(F.split("path", "/"), -1)
    kind = F.when(file == "MEMORY.md", "catalog").when(file.rlike(r"^MEMORY-.*\.md$"), "l2").otherwise("topic")
    return files.select("path", file.alias("file"), kind.alias("kind"), (~F.col("path").rlike(r"/archive/[0-9-]+/[^/]+$")).alias("active"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """One row, source_sha256: a digest of the sorted (path, sha256) list. Paths and digests are short; the list of a
    collection's files is what a manifest holds anyway."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256"))), "\n"), 256).alias("source_sha256"))


def split_front_matter(content: Column) -> Column:
    """struct(header, body, code): code is null, or frontmatter-delimiter where the block is missing or open."""
    text = F.regexp_replace(content, "\r\n", "\n")
    found = text.rlike(r"(?s)\A---\n.*?\n---(\n|\z)")
    return F.struct(F.when(found, F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)).alias("header"), F.when(found, F.regexp_extract(text, r"(?s)\A---\n.*?\n---(?:\n|\z)(.*)\z", 1)).otherwise(text).alias("body"), F.when(~found, F.lit("frontmatter-delimiter")).alias("code"))


def _value(raw: str):
    raw = raw.strip()
    if raw in ("", "null", "~"):
        return None
    if raw[:1] in "\"'":
        if len(raw) < 2 or raw[-1] != raw[0]:
            raise ValueError("open quote")
        return json.loads(raw) if raw[0] == '"' else raw[1:-1].replace("''", "'")
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise ValueError("open list")
        return [_value(x) for x in re.findall(r"""(?:"(?:\\.|[^"])*"|'[^']*'|[^,\[\]])+""", raw[1:-1]) if x.strip()]
    if raw[:1] in "&*!{|>%@`":
        raise ValueError(f"not plain: {raw[:1]}")
    return raw.split(" #")[0].strip()


def parse_yaml(header: str) -> dict:
    """A strict block of YAML: unique keys, scalars, lists, and one level of nesting (metadata:). No aliases or tags."""
    out: dict = {}
    stack, last = [(0, out)], None
    for line in header.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        body = line.strip()
        if "\t" in line[:indent + 1]:
            raise ValueError("tab")
        if body.startswith("- ") or body == "-":
            if last is None or last[0].get(last[1]) not in (None,) and not isinstance(last[0][last[1]], list):
                raise ValueError("stray list item")
            if last[0][last[1]] is None:
                last[0][last[1]] = []
            last[0][last[1]].append(_value(body[1:]))
            continue
        m = re.match(r"([A-Za-z0-9_-]+):(?:\s+(.*)|)$", body)
        if not m:
            raise ValueError(f"not a mapping: {body[:40]}")
        while indent < stack[-1][0]:
            stack.pop()
        if indent > stack[-1][0]:
            if last is None or last[0][last[1]] is not None:
                raise ValueError("indent")
            last[0][last[1]] = {}
            stack.append((indent, last[0][last[1]]))
        here = stack[-1][1]
        if m[1] in here:
            raise ValueError(f"duplicate key {m[1]}")
        here[m[1]] = _value(m[2] or "")
        last = (here, m[1])
    return out


def _record(header: str | None):
    if header is None:
        return None, None
    try:
        raw = parse_yaml(header)
    except (ValueError, IndexError) as e:
        return None, f"yaml-parse: {e}"
    meta = raw.pop("metadata", None) or {}
    if not isinstance(meta, dict):
        return None, "schema: metadata"
    both = meta | raw
    row = {k: None if both.get(k) is None else str(both[k]) for k in SCALARS}
    for k in LISTS:
        v = both.get(k)
        if v is not None and not isinstance(v, list):
            return None, f"schema: {k} is no list"
        row[k] = None if v is None else [str(x) for x in v]
    row["extra"] = {k: json.dumps(v) for k, v in both.items() if k not in SCALARS and k not in LISTS}
    return row, None


def parse_topics(files: DataFrame) -> DataFrame:
    """Topic files with record (see RECORD), body, error (frontmatter-delimiter, yaml-parse: ..., schema: ...)."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf(f"record {RECORD}, error string")
    def parse(headers):
        import pandas as pd

        return pd.DataFrame([_record(h) for h in headers], columns=["record", "error"])

    cut = files.withColumn("_f", split_front_matter(F.col("content"))).withColumn("_p", parse(F.col("_f.header")))
    return cut.select(*[c for c in files.columns if c != "content"], "_p.record", F.col("_f.body").alias("body"), F.coalesce("_f.code", "_p.error").alias("error"))


def hooks(files: DataFrame) -> DataFrame:
    """`- [label](name.md) — summary` lines: file, line (from 1), label, name, summary, text."""
    lines = files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("pos", "text"))
    pattern = r"^\s*-\s+\[([^\]]+)\]\(([^)]+)\.md\)\s*(?:—|--|-)?\s*(.*)$"
    part = lambda i: F.regexp_extract("text", pattern, i)
    return lines.filter(F.col("text").rlike(pattern)).select("file", (F.col("pos") + 1).alias("line"), part(1).alias("label"), F.element_at(F.split(part(2), "/"), -1).alias("name"), part(3).alias("summary"), F.trim("text").alias("text"))


def embedding_text(description: Column, triggers: Column, hook_texts: Column, body: Column) -> Column:
    """Description, triggers, hooks and the first 1,500 characters of the body, one block each; empty blocks are left out."""
    block = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n\n", block(description), block(F.array_join(triggers, "\n")), block(F.array_join(hook_texts, "\n")), block(F.substring(body, 1, 1500)))


def chunks(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Paragraphs with UTF-8 byte ranges: key, pos, start_byte, end_byte, sha256, chunk."""
    lines = docs.select(key, F.posexplode(F.transform(F.array(F.split(body, "\n\n+", -1)), lambda p: F.transform(p, lambda x, i: F.struct(x.alias("chunk"), i.alias("i"))))[0]).alias("pos", "c"), F.col(body).alias("_b"))
    # The byte offset of a paragraph: the length of what precedes it in the text, found by splitting with the gaps kept.
    gaps = F.regexp_extract_all("_b", F.lit("\n\n+"), F.lit(0))
    parts = F.split("_b", "\n\n+", -1)
    before = F.aggregate(F.slice(parts, F.lit(1), F.col("pos")), F.lit(0), lambda s, x: s + F.octet_length(x)) + F.aggregate(F.slice(gaps, F.lit(1), F.col("pos")), F.lit(0), lambda s, x: s + F.octet_length(x))
    out = lines.withColumn("start_byte", before).withColumn("chunk", F.col("c.chunk"))
    return out.filter(F.trim("chunk") != "").select(key, "pos", "start_byte", (F.col("start_byte") + F.octet_length("chunk")).alias("end_byte"), F.sha2("chunk", 256).alias("sha256"), "chunk")
