"""Markdown corpus: documents with a metadata block, and their section chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions.runs import with_ordinals
from tracewell.functions.text import clean_text, line_ends, lit_array, rx, slug, strip, typed_metadata
from tracewell.operators.validation import strict_rows

# Fixed values.
REQUIRED_FIELDS = [
    "document_id", "title", "version", "effective_date", "process_area", "source_type", "synthetic",
]
DOCUMENT_COLUMNS = [
    "source_file", "document_id", "title", "version", "effective_date", "process_area",
    "source_type", "synthetic", "body_text", "error",
]


def _has_key(key: str):
    return lambda line: strip(F.substring_index(line, ":", 1)) == key


def parse_documents(files: DataFrame, strict: bool = False) -> DataFrame:
    """Parse (source_file, value) rows into documents; bad files carry an ``error``.

    ``strict`` makes the job fail on the first bad file.
    """
    lines = F.split(line_ends(F.col("value")), "\n")
    base = (
        files.select("source_file", lines.alias("_lines"))
        .withColumn("_trim", F.transform("_lines", strip))
        .withColumn("_close", F.array_position(F.slice("_trim", 2, F.greatest(F.size("_trim") - 1, F.lit(0))), "---"))
    )
    close = F.col("_close")
    meta = F.filter(F.slice("_trim", F.lit(2), F.greatest(close - 1, F.lit(0)).cast("int")), lambda x: x != "")
    body = F.array_join(
        F.slice("_lines", (close + 2).cast("int"), F.greatest(F.size("_lines") - close - 1, F.lit(0)).cast("int")), "\n"
    )
    split = base.withColumns(
        {
            "_opened": F.get("_trim", F.lit(0)) == "---",
            "_meta": F.when(close > 0, meta).otherwise(lit_array([])),
            "body_text": F.when(close > 0, strip(body)),
        }
    ).drop("_lines", "_trim")

    # Value of the last line with each key, keeping later colons; one step per column so that no
    # step repeats the work of the one before.
    last = {
        f"_line_{key}": F.try_element_at(
            F.filter("_meta", _has_key(key)), F.lit(-1)
        )
        for key in REQUIRED_FIELDS
    }
    after_colon = {
        f"_raw_{key}": strip(
            F.substring(f"_line_{key}", F.position(F.lit(":"), F.col(f"_line_{key}")) + 1, F.length(f"_line_{key}"))
        )
        for key in REQUIRED_FIELDS
    }
    typed = (
        split.withColumns(last)
        .withColumns(after_colon)
        .withColumns({f"_{key}": typed_metadata(F.col(f"_raw_{key}")) for key in REQUIRED_FIELDS})
    )
    missing = F.array_compact(
        F.array(*[F.when(F.col(f"_{key}.text").isNull(), F.lit(key)) for key in sorted(REQUIRED_FIELDS)])
    )
    no_colon = F.filter("_meta", lambda m: ~F.contains(m, F.lit(":")))
    empty = F.array_compact(
        F.array(*[F.when(F.col(f"_{key}.text") == "", F.lit(key)) for key in REQUIRED_FIELDS[:5]])
    )
    error = (
        F.when(~F.col("_opened"), "must start with a metadata block")
        .when(F.col("_close") == 0, "metadata block is not closed")
        .when(F.size(no_colon) > 0, F.concat(F.lit("invalid metadata line: "), F.get(no_colon, F.lit(0))))
        .when(F.col("body_text") == "", "empty body text")
        .when(F.size(missing) > 0, F.concat(F.lit("missing metadata fields: "), F.array_join(missing, ", ")))
        .when(F.size(empty) > 0, F.concat(F.lit("empty metadata fields: "), F.array_join(empty, ", ")))
        .when(F.col("_source_type.text") != "sop", "source_type must be sop")
        .when(~F.coalesce(F.col("_synthetic.flag"), F.lit(False)), "synthetic must be true")
    )
    texts = {key: F.col(f"_{key}.text") for key in REQUIRED_FIELDS[:6]}
    documents = (
        typed.withColumn("error", error)
        .withColumns({**texts, "synthetic": F.col("_synthetic.flag")})
        .select(*DOCUMENT_COLUMNS)
    )
    if strict:
        problems = F.array_compact(F.array("error"))
        documents = strict_rows(documents.withColumn("_problems", problems), "_problems", "source_file").drop(
            "_problems"
        )
    return documents


def read_corpus(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Documents of every ``*.md`` file under ``path``; one row per file."""
    files = (
        spark.read.option("pathGlobFilter", "*.md")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("source_file"), "value")
    )
    return parse_documents(files, strict)


def section_chunks(documents: DataFrame) -> DataFrame:
    """Split document bodies at ``## heading`` lines into chunks.

    Text before the first heading is dropped, empty sections vanish without using up a number,
    and a body without headings is one chunk called "Document".  Splitting and numbering happen
    inside the document's row.
    """
    parts = F.split("body_text", r"(?mdU)^##\s+(?=\S)")
    pieces = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            strip(F.substring_index(p, "\n", 1)).alias("heading"),
            strip(
                F.when(
                    F.position(F.lit("\n"), p) > 0,
                    F.substring(p, F.position(F.lit("\n"), p) + 1, F.length(p)),
                ).otherwise(F.lit(""))
            ).alias("body"),
        ),
    )
    whole = F.array(F.struct(F.lit("Document").alias("heading"), F.col("body_text").alias("body")))
    has_heading = rx(F.col("body_text"), r"(?m)^##\s+\S", ignore_case=False)
    # Files with errors get no sections.  Filtering them out here would make the optimizer compute
    # the whole error rule a second time below everything else.
    usable = F.when(F.col("error").isNull(), F.when(F.col("_plain"), whole).otherwise(pieces))
    numbered = with_ordinals(
        documents.withColumn("_plain", ~has_heading)
        .withColumn("_pieces", usable)
        .withColumn("_sections", F.filter("_pieces", lambda s: s["body"] != ""))
        .withColumn("_slugs", F.transform("_sections", lambda s: slug(s["heading"]))),
        "_slugs",
        "_numbers",
    )
    rows = numbered.select(
        "document_id", "source_file", "title", "source_type", "process_area", "version",
        "effective_date", "synthetic", "_plain",
        F.posexplode_outer(F.arrays_zip("_sections", "_slugs", "_numbers")).alias("section_no", "_s"),
    ).filter(F.col("_s").isNotNull())
    s = F.col("_s")
    name = F.when(s["_numbers"] > 1, F.concat(s["_slugs"], F.lit("-"), s["_numbers"].cast("string"))).otherwise(
        s["_slugs"]
    )
    heading, body = s["_sections"]["heading"], s["_sections"]["body"]
    return rows.select(
        F.concat("document_id", F.lit("::"), name).alias("chunk_id"),
        F.col("document_id").alias("source_id"),
        "source_file",
        F.col("title").alias("source_title"),
        "source_type",
        heading.alias("section_heading"),
        "process_area",
        "version",
        "effective_date",
        "synthetic",
        clean_text(F.when(F.col("_plain"), body).otherwise(F.concat(heading, F.lit("\n\n"), body))).alias("text"),
    )
