"""Document files as rows, redacted files and reports as sinks.

A row is a document: path, kind, content (bytes, for formats that are rewritten in place) and segments. Files are read by Spark's own
readers, so any store that the session knows will do; redacted files are written by the tasks through Arrow's file systems, under a
temporary name that is then moved, so that a task that runs again leaves the same files.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import engine
from inkveil.settings import Settings
from inkveil.sources import blocks, docx

GAP = "\n\n"
SUFFIXES = ("docx", "pdf", "txt", "md")
Extractor = Callable[[bytes], list[str]]


def kind_of(path: str) -> str:
    """The format by suffix, in either case; ValueError for others."""
    kind = posixpath.splitext(path)[1].lower().removeprefix(".")
    if kind not in SUFFIXES:
        raise ValueError(f"unsupported input {path!r}: use one of {', '.join(SUFFIXES)}")
    return kind


def pdf_blocks(data: bytes) -> list[str]:
    """Layout blocks of a PDF in stored order, if the optional library for that is there."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        return [b[4] for page in pdf for b in page.get_text("blocks") if b[6] == 0]


def read(spark: SparkSession, paths: str | list[str], tidy: bool = True, pdf: Extractor = pdf_blocks) -> DataFrame:
    """(path, kind, content, segments) of files. tidy as in blocks.paragraphs; content is null for plain texts."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    by_kind: dict[str, list[str]] = {}
    for p in paths:
        by_kind.setdefault(kind_of(p), []).append(p)
    frames = []
    for kind, some in by_kind.items():
        path = F.col("_metadata.file_path").alias("path")
        if kind in ("txt", "md"):
            d = spark.read.text(some, wholetext=True).select(path, F.lit(kind).alias("kind"), F.lit(None).cast("binary").alias("content"), blocks.paragraphs(F.col("value"), tidy).alias("segments"))
        else:
            raw = spark.read.format("binaryFile").load(some).select(path, F.lit(kind).alias("kind"), "content")
            d = raw.mapInArrow(_extract(docx.texts if kind == "docx" else pdf), "path string, kind string, content binary, segments array<string>")
            if kind == "pdf":
                d = d.withColumn("segments", F.filter(blocks.merge(F.filter(F.transform("segments", blocks.clean), lambda s: s != "")), lambda s: s != ""))
        frames.append(d)
    if not frames:
        raise ValueError("no input")
    return reduce(DataFrame.unionByName, frames)


def _extract(parse: Extractor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                yield pa.record_batch([*row.columns, pa.array([parse(row.column(2)[0].as_py())], pa.list_(pa.string()))], ["path", "kind", "content", "segments"])

    return run


def render(kind: str, content: bytes | None, segments: list[str], entities: list[dict], mapping: list[dict], straddle: str) -> tuple[bytes, int]:
    """The redacted file and the number of spans left out for running across segments ("clip" redacts them in the first one)."""
    new = {(m["type"], m["original"]): m["surrogate"] for m in mapping}
    edits: dict[int, list[docx.Edit]] = {}
    lost, at, number = 0, 0, 0
    for e in entities:  # in order, disjoint
        while number < len(segments) and e["start"] >= at + len(segments[number]) + len(GAP):
            at += len(segments[number]) + len(GAP)
            number += 1
        end = e["end"] - at
        if end > len(segments[number]):
            if straddle != "clip":
                lost += 1
                continue
            end = len(segments[number])
        if e["start"] - at < end:
            edits.setdefault(number, []).append((e["start"] - at, end, new[e["type"], e["text"]]))
    if kind == "docx":
        return docx.rewrite(content, edits), lost
    done = list(segments)
    for number, spans in edits.items():
        for a, b, text in sorted(spans, reverse=True):
            done[number] = done[number][:a] + text + done[number][b:]
    return docx.from_blocks(done) if kind == "pdf" else GAP.join(done).encode(), lost


def redact(files: DataFrame, settings: Settings = Settings(), more: list[engine.Detector] = ()) -> DataFrame:
    """(path, kind, output bytes, entities, mapping, straddle_dropped): a row per file; PDFs come out as .docx."""
    found = engine.detect(files.withColumn("text", F.array_join("segments", GAP, "")), settings.but(emit_mapping=True), more=more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                r = row.to_pylist()[0]
                data, lost = render(r["kind"], r["content"], r["segments"] or [], r["entities"], r["mapping"], settings.straddle)
                yield pa.record_batch([row["path"], row["kind"], pa.array([data], pa.binary()), row["entities"], row["mapping"], pa.array([lost], pa.int64())], ["path", "kind", "output", "entities", "mapping", "straddle_dropped"])

    entity, pair = found.schema["entities"].dataType.simpleString(), found.schema["mapping"].dataType.simpleString()
    out = found.select("path", "kind", "content", "segments", "entities", "mapping").mapInArrow(run, f"path string, kind string, output binary, entities {entity}, mapping {pair}, straddle_dropped long")
    return out if settings.emit_mapping else out.drop("mapping")


def save(redacted: DataFrame, folder: str) -> None:
    """Writes every output under its own file name into a folder that all executors reach (path or URI of an Arrow file system)."""

    def write(rows) -> None:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for r in rows:
            stem, suffix = posixpath.splitext(posixpath.basename(r.path))
            name = f"{root}/{stem}{'.docx' if r.kind == 'pdf' else suffix}"
            part = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(r.output)
            fs.move(part, name)

    names = redacted.select(F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"(?i)\.pdf$", ".docx").alias("name"))
    twice = names.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two inputs would be written to {twice[0].name}")
    redacted.select("path", "kind", "output").foreachPartition(write)


def report(redacted: DataFrame, folder: str, settings: Settings, seconds: float | None = None) -> dict:
    """entities.csv, mapping.json (unless left out by the settings) and summary.json under a folder; returns the summary."""
    rows = redacted.select("path", F.explode("entities").alias("e")).select("path", "e.*")
    rows.write.mode("overwrite").csv(f"{folder}/entities.csv", header=True)
    if settings.emit_mapping:
        engine.mapping(redacted).orderBy("type", "original").write.mode("overwrite").json(f"{folder}/mapping.json")
    s = engine.summary(redacted, settings).first()
    out = {"entities": s.entities or 0, "by_type": s.by_type or {}, "seed_fingerprint": s.seed_fingerprint, "seconds": seconds}
    redacted.sparkSession.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary.json")
    return out
