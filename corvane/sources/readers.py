"""Sources: parsed chunks, archives, files and their identities, manifests, traces."""

from __future__ import annotations

import email
import quopri
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema of parsed chunks in JSON lines; nothing is inferred.
CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("error_codes", T.ArrayType(T.StringType())),
    T.StructField("language", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("publication_number", T.StringType()), T.StructField("revision", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("content_hash", T.StringType()),
])
#: Schema of a manifest's documents, of fields that operators read.
MANIFEST = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("publication_number", T.StringType()), T.StructField("revision", T.StringType()), T.StructField("title", T.StringType()), T.StructField("doc_type", T.StringType()),
    T.StructField("authority", T.StructType([T.StructField("tier", T.StringType())])),
    T.StructField("applicability", T.StructType([T.StructField("models", T.ArrayType(T.StringType())), T.StructField("serial_ranges", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("scope", "model", "start", "end")])))])),
    T.StructField("temporal", T.StructType([T.StructField("publication_date", T.StringType())])), T.StructField("relationships", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("type", "target", "target_revision", "note")]))),
])


def parsed_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all parsed documents under `path` (one folder each), with the file they come from."""
    return spark.read.schema(CHUNKS).option("recursiveFileLookup", "true").option("pathGlobFilter", "chunks*.jsonl").json(path).withColumn("source_file", F.col("_metadata.file_path"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents: JSON, one file each, or YAML where the yaml library is there. Names that start with _ are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/_[^/]*$"))
    plain = files.where("path like '%.json'").select(F.from_json(F.decode("content", "utf-8"), MANIFEST).alias("d")).select("d.*")
    marked = files.where("path like '%.yaml' or path like '%.yml'").select("content")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            if not len(batch):
                continue
            import yaml

            # dates stay text: they may be of any precision
            yield pd.DataFrame({"doc": [json.dumps(yaml.load(bytes(c), yaml.BaseLoader)) for c in batch["content"]]})

    return plain.unionByName(marked.mapInPandas(load, "doc string").select(F.from_json("doc", MANIFEST).alias("d")).select("d.*"))


def edges_of(docs: DataFrame) -> DataFrame:
    """doc_id, ord, type, target, target_revision, note of a manifest's relationships."""
    return docs.select("doc_id", F.posexplode("relationships").alias("ord", "r")).select("doc_id", "ord", "r.*")


def mhtml_to_html(raw: bytes) -> str:
    """The HTML of a saved web page: a MIME archive's HTML part, else what follows <html>, soft breaks undone."""
    text = raw.decode("utf-8", "replace")
    message = email.message_from_bytes(raw)
    for part in message.walk():
        if part.get_content_type() == "text/html":
            body = part.get_payload(decode=True)
            if body:
                return body.decode(part.get_content_charset() or "utf-8", "replace")
    at = re.search(r"(?i)<html", text)
    body = text[at.start() :] if at else text
    if "=3D" in body:
        return quopri.decodestring(body.encode("utf-8", "replace")).decode("utf-8", "replace")
    return re.sub(r"=\r?\n", "", body)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path and html of saved pages (.mhtml, .mht, .html, .htm)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(mhtml|mht|html|htm)$"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "html": [mhtml_to_html(bytes(c)) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(load, "path string, html string")


def file_identities(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes and sha256 of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: PDF and other extractors by name; each takes a DataFrame of (path, content) and returns pages. None is built in: their libraries are optional.
EXTRACTORS: dict = {}


def extractor(name: str):
    """Registers a page extractor: a generator of pandas frames (path, page, text) over frames (path, content)."""

    def put(f):
        EXTRACTORS[name] = f
        return f

    return put


@extractor("pypdf")
def pypdf_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    from pypdf import PdfReader  # optional

    for batch in batches:
        rows = [(p, i + 1, page.extract_text() or "") for p, c in zip(batch["path"], batch["content"]) for i, page in enumerate(PdfReader(io.BytesIO(bytes(c))).pages)]
        yield pd.DataFrame(rows, columns=["path", "page", "text"])


@extractor("text")
def text_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Plain text; a form feed starts a page."""
    for batch in batches:
        rows = [(p, i + 1, t) for p, c in zip(batch["path"], batch["content"]) for i, t in enumerate(bytes(c).decode("utf-8", "replace").split("\f"))]
        yield pd.DataFrame(rows, columns=["path", "page", "text"])


def extracted_pages(spark: SparkSession, path: str, name: str, glob: str = "*.pdf") -> DataFrame:
    """path, page and text of files, by a registered extractor."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(EXTRACTORS[name], "path string, page int, text string")


def trace_records(raw: DataFrame, column: str = "value") -> DataFrame:
    """Records of traces in JSON of several shapes: trace_id, name, ts, question, answer, git_sha."""
    j = lambda *paths: F.coalesce(*[F.get_json_object(column, p) for p in paths])
    return raw.select(
        j("$.id", "$.trace_id", "$.traceId").alias("trace_id"), j("$.name").alias("name"), j("$.timestamp", "$.ts", "$.startTime").alias("ts"),
        j("$.input.question", "$.question", "$.input.text", "$.input").alias("question"), j("$.output.answer", "$.answer", "$.output.text", "$.output").alias("answer"), j("$.metadata.git_sha", "$.metadata.app_git_sha", "$.version").alias("git_sha"),
    )


def is_stamped(record: Column) -> Column:
    return F.coalesce(record, F.lit("")).rlike("^[0-9a-f]{7,40}$")
