"""Document and signal files: format detection, text extraction, versioned JSON stage outputs, WAV, manifests, chapter metadata."""

from __future__ import annotations

import io
import json
import re
import wave
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions.text import html_text

#: Known extensions, and the first bytes that the first two must have.
FORMATS = ("pdf", "epub", "docx", "txt")
MAGIC = {"pdf": b"%PDF", "epub": b"PK"}


def format_of_path(path: Column, also: Sequence[str] = ()) -> Column:
    extension = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return F.when(extension.isin(*FORMATS, *also), extension).otherwise("unknown")


def detect_format(path: Column, content: Column) -> Column:
    """Format by extension; `unknown` if the first bytes contradict it."""
    found, out = format_of_path(path), format_of_path(path)
    for name, magic in MAGIC.items():
        fits = F.coalesce(F.substring(content, 1, len(magic)) == F.lit(magic), F.lit(False))
        out = F.when((found == name) & ~fits, "unknown").otherwise(out)
    return out


def epub_text(content: bytes) -> str:
    """HTML items in archive order, joined by blank lines; items that cannot be read are skipped."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if name.lower().endswith((".html", ".xhtml", ".htm")):
                try:
                    text = html_text(z.read(name).decode("utf-8", "replace"))
                except (KeyError, zipfile.BadZipFile):
                    continue
                if text:
                    out.append(text)
    return "\n\n".join(out)


def docx_text(content: bytes) -> str:
    """Paragraphs that are not empty, then table rows with their cells joined by ` | `."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{ns}t")).strip()
    paragraphs = [words(p) for p in body.findall(f"{ns}p")]
    rows = [" | ".join(words(c) for c in r.findall(f"{ns}tc")) for t in body.findall(f"{ns}tbl") for r in t.findall(f"{ns}tr")]
    return "\n".join(x for x in [*paragraphs, *rows] if x.strip(" |"))


def _extract(kind: str, content: bytes) -> tuple[str | None, str | None]:
    try:
        if kind == "txt":
            return content.decode("utf-8"), None
        if kind == "epub":
            return epub_text(content), None
        if kind == "docx":
            return docx_text(content), None
        if kind == "pdf":
            try:
                import pypdf
            except ImportError:
                return None, "no PDF library is installed"
            pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
            text = "\n\n".join(p for p in pages if p.strip())
            return (text, None) if text else (None, "no text")
        return None, "unsupported format"
    except Exception as e:  # a broken file becomes an error row
        return None, f"{type(e).__name__}: {e}"[:200]


@F.pandas_udf(K.StructType([K.StructField("text", K.StringType()), K.StructField("error", K.StringType())]))
def extract_text(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_extract(k, bytes(c or b"")) for k, c in zip(kind, content, strict=True)], columns=["text", "error"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text, error) for each file below path; files that cannot be read have an error and no text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = detect_format(F.col("path"), F.col("content"))
    return raw.select("path", kind.alias("format"), "content").withColumn("x", extract_text("format", "content")).select("path", "format", "x.text", "x.error")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(value, path): whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def first_file(files: DataFrame) -> DataFrame:
    """Of (folder, path, ...) the first path of each folder by name."""
    return files.groupBy("folder").agg(F.min("path").alias("path"))


def write_stage(df: DataFrame, path: str, keys: Sequence[str] = ("collection_id", "stage")) -> None:
    """Write a stage's rows, replacing the partitions that they belong to and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_json_versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files (one object each) below path as rows of `schema` with _key (file name without extension) and _modified."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.select("*", F.regexp_extract("_metadata.file_name", "^(.*)\\.json$", 1).alias("_key"), F.col("_metadata.file_modification_time").alias("_modified"))


def latest_version(versions: DataFrame, key: str = "_key", modified: str = "_modified") -> DataFrame:
    """The newest row of each exact key."""
    rest = [c for c in versions.columns if c != key]
    top = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(modified)).alias("t"))
    return top.select(key, *[F.col(f"t.{c}").alias(c) for c in rest])


def upsert_config(base: Column, change: Column) -> Column:
    """Shallow map update: keys of `change` win."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(change, k))
    return F.coalesce(F.map_concat(kept, change), base, change)


def load_taxonomy(spark: SparkSession, text: str) -> DataFrame:
    """(category, canonical_id, description, tags) from YAML text: category -> id -> {description, tags}."""
    import yaml

    rows = [(c, i, (v or {}).get("description"), list((v or {}).get("tags") or [])) for c, items in (yaml.safe_load(text) or {}).items() for i, v in (items or {}).items()]
    return spark.createDataFrame(rows, "category string, canonical_id string, description string, tags array<string>")


def wav_samples(content: bytes | None) -> tuple[int, list[float], list[float]]:
    """(rate, left, right); mono is doubled; missing or broken content: no samples."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
            x = raw.reshape(-1, w.getnchannels())
            return w.getframerate(), x[:, 0].tolist(), x[:, min(1, x.shape[1] - 1)].tolist()
    except (wave.Error, EOFError):
        return 0, [], []


@F.pandas_udf(K.StructType([K.StructField("rate", K.IntegerType()), *[K.StructField(c, K.ArrayType(K.FloatType())) for c in ("left", "right")]]))
def decode_wav(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([wav_samples(None if c is None else bytes(c)) for c in content], columns=["rate", "left", "right"])


@F.pandas_udf(K.BinaryType())
def encode_wav(left: pd.Series, right: pd.Series, rate: pd.Series) -> pd.Series:
    """16-bit PCM; samples are clamped to [-1, 1]."""

    def one(a, b, r):
        pcm = (np.clip(np.stack([a, b], axis=1), -1, 1) * 32767).astype("<i2")
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes(pcm.tobytes())
        return out.getvalue()

    return pd.Series([one(*x) for x in zip(left, right, rate, strict=True)])


def wav_milliseconds(frames: Column, rate: Column) -> Column:
    return F.coalesce(F.try_divide(frames, rate) * 1000, F.lit(0)).cast("int")


def concat_manifest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, pause_ms: str | None = None) -> DataFrame:
    """keys, line_no, line: `file '...'` lines in order, each followed by a silence line where the pause is positive."""
    quoted = F.concat(F.lit("file '"), F.replace(F.col(path), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    lines = F.array(quoted)
    if pause_ms:
        silence = F.concat(F.lit("file 'silence_"), F.col(pause_ms).cast("int").cast("string"), F.lit("ms.wav'"))
        lines = F.when(F.coalesce(F.col(pause_ms), F.lit(0)) > 0, F.array(quoted, silence)).otherwise(lines)
    flat = rows.select(*keys, *[c for c in order if c not in keys], F.posexplode(lines).alias("k", "line"))
    w = Window.partitionBy(*keys).orderBy(*order, "k")
    return flat.select(*keys, F.row_number().over(w).alias("line_no"), "line")


def chapter_metadata(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, metadata: `[CHAPTER]` blocks in milliseconds from (start_ms, end_ms, title)."""
    block = F.format_string("[CHAPTER]\nTIMEBASE=1/1000\nSTART=%d\nEND=%d\ntitle=%s\n", "start_ms", "end_ms", "title")
    parts = F.array_sort(F.collect_list(F.struct("start_ms", block.alias("block"))))
    return marks.groupBy(*keys).agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform(parts, lambda p: p["block"]), "")).alias("metadata"))


def parse_chapter_metadata(text: Column) -> Column:
    """array<struct<start_ms, end_ms, title>> of a metadata text; times are scaled by each block's timebase."""
    blocks = F.slice(F.split(text, "\\[CHAPTER\\]"), 2, 100_000)

    def row(b: Column) -> Column:
        base = F.coalesce(F.nullif(F.regexp_extract(b, "TIMEBASE=1/(\\d+)", 1), F.lit("")).cast("bigint"), F.lit(1000))
        ms = lambda name: (F.nullif(F.regexp_extract(b, f"{name}=(\\d+)", 1), F.lit("")).cast("bigint") * 1000 / base).cast("bigint")
        return F.struct(ms("START").alias("start_ms"), ms("END").alias("end_ms"), F.regexp_extract(b, "title=([^\\n]*)", 1).alias("title"))

    return F.transform(blocks, row)


def log_lines(*fields: str) -> Column:
    """One JSON log line; fields that are null are left out."""
    return F.to_json(F.struct(*fields))


def parse_json_list(text: str) -> list:
    """Driver-side: a JSON array or object from text that may be fenced."""
    body = re.sub(r"^```\w*\n|```$", "", text.strip())
    got = json.loads(body)
    return got if isinstance(got, list) else [got]
