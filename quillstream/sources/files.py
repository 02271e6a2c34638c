"""Sources and sinks: text, Markdown, JSON, JSONL, CSV, PDF lines, golden sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the fields of the search index and what they can do
CHUNK_FIELDS = ("chunk_id", "act", "chapter_number", "chapter_title", "section_number", "section_title", "subsection", "content_type", "content", "citation_id", "citation_text", "source_file")
SEARCHABLE = {"act", "chapter_title", "section_number", "section_title", "subsection", "content", "citation_text"}
FACETABLE = {"act", "content_type"}


def chunk_schema() -> T.StructType:
    """The index fields, with their capabilities as column metadata."""
    return T.StructType([T.StructField(f, T.StringType(), f not in ("chunk_id",), {"searchable": f in SEARCHABLE, "filterable": f not in ("subsection", "content"), "facetable": f in FACETABLE, "key": f == "chunk_id"}) for f in CHUNK_FIELDS])


def embedding_schema() -> T.StructType:
    return chunk_schema().add("embedding_model", T.StringType()).add("embedding_dimensions", T.IntegerType()).add("embedding", T.ArrayType(T.FloatType()), True, {"retrievable": False})


def text_lines(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, pos, text of every line; CRLF and CR count as LF."""
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).withColumn("path", F.input_file_name())
    return whole.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("pos", "text"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict: blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or an object whose chunks, data or documents hold it."""
    rows = spark.read.option("multiLine", True).json(path)
    found = [c for c in ("chunks", "data", "documents") if c in rows.columns]
    return rows.select(F.explode(F.coalesce(*found)).alias("x")).select("x.*") if found else rows


def preferred(spark: SparkSession, jsonl_path: str, json_path: str, schema: T.StructType) -> DataFrame:
    """JSONL where it exists, else JSON, else an error."""
    if exists(spark, jsonl_path):
        return jsonl(spark, jsonl_path, schema)
    if exists(spark, json_path):
        return json_chunks(spark, json_path)
    raise FileNotFoundError(f"neither {jsonl_path} nor {json_path}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files of a table: another one once they change."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        files.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()[:16]


def first_existing(spark: SparkSession, *paths: str) -> str:
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


GOLD = "array<struct<section_number:string,relevance_grade:int,chunk_ids:array<string>>>"
QUESTION = f"struct<id:string,act:string,query:string,gold:{GOLD}>"


def golden(raw: Column) -> Column:
    """The questions in a golden file's text, whichever of its two layouts it has: acts holding questions, or questions."""
    parsed = F.from_json(raw, f"acts map<string,struct<questions:array<{QUESTION}>>>, questions array<{QUESTION}>")
    by_act = F.flatten(F.transform(F.map_entries(parsed["acts"]), lambda e: F.transform(e["value"]["questions"], lambda q: F.struct(e["key"].alias("act_key"), q.alias("q")))))
    flat = F.transform(parsed["questions"], lambda q: F.struct(q["act"].alias("act_key"), q.alias("q")))
    return F.coalesce(by_act, flat)


def golden_questions(files: DataFrame) -> DataFrame:
    """files (value) -> act_key, id, act, query, gold."""
    return files.select(F.explode(golden(F.col("value"))).alias("x")).select("x.act_key", "x.q.*")


def golden_set(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The golden files below a folder -> file, pos (from 0, in the order of the file), act_key, id, act, query, gold. A file of neither layout, or without questions, is a row without any."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).text(path).select(F.col("_metadata.file_path").alias("file"), golden(F.col("value")).alias("all"))
    rows = files.select("file", F.posexplode_outer("all").alias("pos", "x"))
    return rows.select("file", F.col("pos").cast("long").alias("pos"), "x.act_key", "x.q.*")


def golden_faults(questions: DataFrame) -> DataFrame:
    """file, pos, id, fault of a golden set: no_questions, missing_<field>, duplicate_id (a row for each place of an id that has several, over all files)."""
    none = questions.where("pos is null").select("file", "pos", "id", F.lit("no_questions").alias("fault"))
    there = questions.where("pos is not null")
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in ("id", "act", "query", "gold")]), lambda x: x.isNotNull())
    missing = there.select("file", "pos", "id", F.explode(lacks).alias("fault"))
    repeated = there.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    twice = there.join(repeated, "id", "left_semi").select("file", "pos", "id", F.lit("duplicate_id").alias("fault"))
    return none.unionByName(missing).unionByName(twice)


def golden_keys(questions: DataFrame) -> DataFrame:
    """qid, chunk_id, grade: the largest grade of each chunk of a question."""
    items = questions.select(F.col("id").alias("qid"), F.explode("gold").alias("g"))
    return items.select("qid", F.explode("g.chunk_ids").alias("chunk_id"), F.col("g.relevance_grade").alias("grade")).groupBy("qid", "chunk_id").agg(F.max("grade").cast("long").alias("grade"))


def flat(rows: DataFrame) -> DataFrame:
    """Every column as a string for CSV: arrays and structs as JSON, null as an empty string."""
    show = lambda f: F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name).cast("string")
    return rows.select(*[F.coalesce(show(f), F.lit("")).alias(f.name) for f in rows.schema.fields])


def joined_lists(rows: DataFrame, by: str = ";") -> DataFrame:
    """The fixed CSV of nested answers: arrays joined, scalars as they are."""
    return rows.select(*[F.array_join(f.name, by).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema.fields])


def write_csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def no_nan(rows: DataFrame) -> DataFrame:
    """Fails the job where a floating value isn't finite, as JSON has no such number."""
    bad = [F.isnan(f.name) | (F.abs(f.name) == float("inf")) for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    any_bad = F.lit(False)
    for b in bad:
        any_bad = any_bad | F.coalesce(b, F.lit(False))
    return rows.where(F.when(any_bad, F.raise_error(F.lit("a value is not finite"))).otherwise(F.lit(True)).cast("boolean"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    no_nan(rows).write.mode(mode).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


Extractor = Callable[[bytes], list[dict]]
LINE = "page int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, flags int, page_width double, page_height double"


def pdf_lines(spark: SparkSession, path: str, extractor: Extractor | None = None) -> DataFrame:
    """Positioned lines of PDF files. extractor turns a file's bytes into line rows; by default PyMuPDF, where it is installed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    use = extractor or _pymupdf

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                rows = use(content)
                if rows:
                    yield pd.DataFrame(rows).assign(path=p)[["path", *(c.split()[0] for c in LINE.split(", "))]]

    return files.mapInPandas(read, f"path string, {LINE}")


def _pymupdf(content: bytes) -> list[dict]:
    import fitz

    out = []
    for number, page in enumerate(fitz.open(stream=content, filetype="pdf"), 1):
        for b, block in enumerate(page.get_text("dict")["blocks"]):
            if block["type"]:
                continue
            for n, line in enumerate(block["lines"]):
                spans = line["spans"]
                text = "".join(s["text"] for s in spans).strip()
                if not text:
                    continue
                flags = 0
                for s in spans:
                    flags |= int(s["flags"])
                x0, y0, x1, y1 = line["bbox"]
                out.append({"page": number, "block_no": b, "line_no": n, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text, "font_size": sum(s["size"] for s in spans) / len(spans), "flags": flags, "page_width": page.rect.width, "page_height": page.rect.height})
    return out


def markdown(sections: DataFrame) -> DataFrame:
    """doc_id, markdown: chapters head their sections where they change; sections (doc_id, ord, chapter, section, title, body)."""
    from quillstream.operators.structure import on_change

    rows = on_change(sections, "chapter", "ord")
    head = F.when(F.col("emit") & F.col("chapter").isNotNull(), F.concat(F.lit("# Chapter "), "chapter", F.lit("\n\n"))).otherwise(F.lit(""))
    part = F.concat(head, F.lit("## Section "), "section", F.when(F.col("title").isNotNull(), F.concat(F.lit(" — "), "title")).otherwise(""), F.lit("\n\n"), "body", F.lit("\n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"]), "\n")
    return rows.groupBy("doc_id").agg(F.regexp_replace(whole, r"\n{3,}", "\n\n").alias("markdown"))


def pdf_markdown(spark: SparkSession, path: str, convert: Callable[[bytes], str]) -> DataFrame:
    """path, markdown of PDF files by a converter of bytes to Markdown."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "markdown": [convert(x) for x in batch["content"]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(read, "path string, markdown string")


def embedding_faults(rows: DataFrame, dim: int) -> DataFrame:
    """chunk_id, fault of embedding records: missing_id, missing_vector, wrong_dimension, duplicate_id."""
    no_id = F.coalesce(F.trim("chunk_id"), F.lit("")) == ""
    fault = F.when(no_id, "missing_id").when(F.coalesce(F.size("embedding"), F.lit(-1)) <= 0, "missing_vector").when(F.size("embedding") != dim, "wrong_dimension")
    twice = rows.where(~no_id).groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id", F.lit("duplicate_id").alias("fault"))
    return rows.select("chunk_id", fault.alias("fault")).where("fault is not null").unionByName(twice)


def checked_embeddings(rows: DataFrame, dim: int) -> DataFrame:
    """chunk_id, embedding (float), or an error that names a fault."""
    if (bad := embedding_faults(rows, dim).first()) is not None:
        raise ValueError(f"{bad['chunk_id']}: {bad['fault']}")
    return rows.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))


def search_documents(records: DataFrame, dim: int) -> DataFrame:
    """Chunk records with embeddings as documents of the index: its fields and content_vector; a missing field or a bad vector is an error."""
    missing = [c for c in CHUNK_FIELDS if c not in records.columns]
    if missing:
        raise ValueError(f"missing fields: {missing}")
    bad = F.when((F.coalesce("chunk_id", F.lit("")) == "") | F.coalesce(F.size("embedding") != dim, F.lit(True)), F.raise_error(F.concat(F.coalesce("chunk_id", F.lit("<unknown>")), F.lit(": no id or a vector of the wrong size")))).otherwise(F.lit(True)).cast("boolean")
    return records.where(bad).select(*CHUNK_FIELDS, F.col("embedding").alias("content_vector"))


def write_both(rows: DataFrame, folder: str) -> None:
    """The same rows as JSONL and as Parquet, in folder/jsonl and folder/parquet; each appears as a whole or not at all."""
    write_jsonl(rows, f"{folder}/jsonl")
    rows.write.mode("overwrite").parquet(f"{folder}/parquet")


def write_single(rows: DataFrame, path: str, order: str | None = None) -> None:
    """One string column as one text file: written beside it by one task, renamed over it as a whole. A reader sees the file before or the file after; a task that fails leaves the one before.

    For documents and reports, whose size is bounded; large results are folders (write_text).
    """
    import uuid

    from quillstream.operators.versioned import place

    spark = rows.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    (rows.orderBy(order).select(*[c for c in rows.columns if c != order]) if order else rows).coalesce(1).write.text(folder)
    target, fs = place(spark, path)
    top, _ = place(spark, folder)
    try:
        part = next(f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("part-"))
        kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark._jsc.hadoopConfiguration()).rename(part, fs.makeQualified(target), options)
    finally:
        fs.delete(top, True)


def write_text(rows: DataFrame, path: str) -> None:
    """One string column as text files, committed as a whole."""
    rows.write.mode("overwrite").text(path)


def result_pair(spark: SparkSession, detail_path: str, summary_path: str) -> tuple[DataFrame, DataFrame]:
    """The detailed rows and the summary of an evaluation; an error if one of them is missing or empty."""
    pair = []
    for path in (detail_path, summary_path):
        if not exists(spark, path):
            raise FileNotFoundError(path)
        rows = spark.read.json(path)
        if not rows.columns or rows.isEmpty():
            raise ValueError(f"{path} is empty")
        pair.append(rows)
    return pair[0], pair[1]


def regenerate_csv(spark: SparkSession, detail_path: str, summary_path: str, folder: str) -> None:
    """CSV again from stored results, without a new evaluation."""
    detail, summary = result_pair(spark, detail_path, summary_path)
    write_csv(detail, f"{folder}/detail")
    write_csv(summary, f"{folder}/summary")
