"""Mail tables: CSV and Parquet, unpacked corpora, partial-header tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.headers import header, header_block, normal_newlines
from ..functions.mime import message_body
from ..functions.strings import strip
from ..operators.dataset import capped_sample, drop_short_bodies

MAIL_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("template_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("body_text", T.StringType()),
    T.StructField("raw_email_source", T.StringType()),
    T.StructField("notes", T.StringType()),
])
MAIL_COLUMNS = [f.name for f in MAIL_SCHEMA.fields]

_CSV = {"header": "true", "quote": '"', "escape": '"', "lineSep": "\n",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_mail_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted multi-line CSV, split like any text file; empty fields are NULL. See
    ``csv_records`` for how a range of bytes finds the records that begin in it."""
    parsed = csv_records(spark, path).where("n > 1").select(F.from_csv(
        "record", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MAIL_SCHEMA.fields),
        {**_CSV, "header": "false", "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, n, record``: the records of quoted CSV files, numbered from 1 in each file,
    header included, without splitting fields.

    Spark reads the files as lines, in ranges of bytes. A line begins a record if an even
    number of quotation marks stands before it in its file (a doubled mark inside a field
    counts twice). So every range is summed up by the parity of its marks; sums over the
    ranges of a file, a row each, give the parity at which each range begins, and with it
    the lines that begin records and the number of records before the range. Tasks then
    read their ranges again, in order, and put records together as they go: no line is
    shuffled. A record that runs over the end of a range gets the lines before the first
    record of the ranges after it. These and the sums, a row a range, are broadcast. No
    task holds more than one batch of lines or one record. Marks stand at the ends of
    quoted fields or doubled inside them, as the format has it; a mark inside an unquoted
    field breaks the count."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))  # bytes: Arrow takes no string that isn't UTF-8
    blocks = lines.mapInArrow(_block_sums(), "path string, block long, marks long, even long, odd long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = blocks.withColumn("parity", F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2)
    begun = F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd"))
    first = parity.select(F.col("path").alias("_path"), F.col("block").alias("_block"), "parity", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("base"))
    # Outer: a range without sums is an error that the task reports, not a loss of lines.
    known = lines.join(F.broadcast(first), (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")), "left").select(
        "path", "block", "parity", "base", "line")
    schema = "path string, block long, n long, record binary"
    rest = known.mapInArrow(_block_records(heads=True), schema).groupBy(F.col("path").alias("_path"), F.col("n").alias("_n")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", F.col("record").cast("string").alias("record"))))["record"], "\n").alias("rest"))
    records = known.mapInArrow(_block_records(heads=False), schema).withColumn("record", F.col("record").cast("string"))
    return records.join(F.broadcast(rest), (F.col("path") == F.col("_path")) & (F.col("n") == F.col("_n")), "left").select(
        "path", "n", F.when(F.col("rest").isNull(), F.col("record")).otherwise(F.concat("record", F.lit("\n"), "rest")).alias("record"))


# The functions sent to the workers are closures without references to this package, so
# executors need no copy of it. A task reads its ranges one after the other, in order.


def _runs():
    """Batch -> ``(path, block, first row, row after the last, marks of each row)`` of
    its runs of rows of one range."""
    def runs(batch):
        import numpy as np
        import pyarrow.compute as pc

        if not batch.num_rows:
            return
        paths = batch.column("path").dictionary_encode()
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        marks = pc.count_substring(batch.column("line"), b'"').to_numpy(zero_copy_only=False).astype(np.int64)
        of = paths.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            yield paths.dictionary[int(of[a])].as_py(), int(blocks[a]), a, b, marks[a:b]

    return runs


def _block_sums():
    """Rows of lines -> a row a range: its marks, and the lines that begin records if the
    marks before it are even in number, or odd."""
    runs = _runs()

    def sums(batches):
        import pyarrow as pa

        def out(at, marks, even, odd):
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.string()), *[pa.array([x], pa.int64()) for x in (at[1], marks, even, odd)]],
                names=["path", "block", "marks", "even", "odd"])

        now, total, even, odd = None, 0, 0, 0
        for batch in batches:
            for path, block, a, b, marks in runs(batch):
                if (path, block) != now:
                    if now is not None:
                        yield out(now, total, even, odd)
                    now, total, even, odd = (path, block), 0, 0, 0
                uneven = int(((total + marks.cumsum() - marks) % 2).sum())
                total, even, odd = total + int(marks.sum()), even + (b - a) - uneven, odd + uneven
        if now is not None:
            yield out(now, total, even, odd)

    return sums


def _block_records(heads: bool):
    """Rows of lines -> the records that begin in each range, as far as it holds them; or,
    of each range that begins inside a record, the lines up to the next one."""
    runs = _runs()

    def records(batches):
        import numpy as np
        import pyarrow as pa

        now, odd, n, held, rows = None, 0, 0, [], []

        def out():
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["path", "block", "n", "record"])

        def close(is_head):
            if held and is_head == heads:
                rows.append((*now, n, b"\n".join(held)))
            held.clear()

        inside = False  # a record that begins in this range is open
        for batch in batches:
            for path, block, a, b, marks in runs(batch):
                if (path, block) != now:
                    if now is not None:
                        close(not inside)
                    parity, base = batch.column("parity")[a].as_py(), batch.column("base")[a].as_py()
                    if parity is None:
                        raise ValueError(f"no sums of the range {block} of {path}: the files were split in another way")
                    now, odd, n, inside = (path, block), parity, base, False
                begins = np.flatnonzero((odd + marks.cumsum() - marks) % 2 == 0).tolist()
                odd = (odd + int(marks.sum())) % 2
                if heads and inside:
                    continue
                upto = begins[0] if begins else b - a
                held.extend(batch.column("line")[a:a + upto].to_pylist())
                if begins:
                    close(not inside)
                    inside = True
                    if heads:
                        continue
                    lines = batch.column("line")[a + upto:b].to_pylist()
                    for start, end in zip(begins, begins[1:], strict=False):
                        n += 1
                        rows.append((*now, n, b"\n".join(lines[start - upto:end - upto])))
                    n += 1
                    held.extend(lines[begins[-1] - upto:])
            yield out()
        if now is not None:
            close(not inside)
        yield out()

    return records


def write_mail_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (df.select(*MAIL_COLUMNS).write.mode(mode)
     .options(**_CSV, quoteAll="true", emptyValue="")
     .csv(path))


def write_mail_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(*MAIL_COLUMNS).write.mode(mode).parquet(path)


def read_message_files(spark: SparkSession, path: str, label: int, source_name: str) -> DataFrame:
    """One raw message per file -> mail rows without ``id``; undecodable bytes
    are replaced, near-empty bodies dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = files.select(F.make_valid_utf8(F.col("content").cast("string")).alias("raw_email_source"))
    subject = header(header_block(F.col("raw_email_source")), "Subject")
    rows = raw.select(
        F.lit(label).alias("label"),
        F.lit(f"real_{source_name}").alias("template_id"),
        F.lit(f"Real: {source_name.replace('_', ' ').title()}").alias("category"),
        F.when(subject == "", F.lit("(no subject)")).otherwise(subject).alias("subject"),
        message_body(F.col("raw_email_source")).alias("body_text"),
        "raw_email_source",
        F.lit("Real mail, genuine headers").alias("notes"),
    )
    return drop_short_bodies(rows)


def _unless_null(c: str, default: str) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def partial_header_source(sender: Column, receiver: Column, date: Column, subject: Column, body: Column) -> Column:
    """Raw message from what little is known; authentication stays ``none``."""
    return F.concat(
        F.lit("From: "), sender,
        F.lit("\nTo: "), strip(F.split(receiver, ",", 2)[0]),
        F.lit("\nSubject: "), subject,
        F.lit("\nDate: "), date,
        F.lit("\nAuthentication-Results: mx.example.com; spf=none; dkim=none; dmarc=none\n\n"),
        body, F.lit("\n"),
    )


def from_partial_headers(df: DataFrame, source_name: str = "partial", id_col: str = "row_id") -> DataFrame:
    """``(sender, receiver, date, subject, body, label)`` with gaps -> mail rows."""
    phish = F.col("label") == 1
    filled = df.select(
        F.col(id_col).alias("id"), "label",
        F.when(phish, F.lit(f"real_{source_name}")).otherwise(F.lit(f"real_{source_name}_control")).alias("template_id"),
        F.when(phish, F.lit(f"Real: {source_name} phishing")).otherwise(
            F.lit(f"Real: {source_name} legitimate control")).alias("category"),
        _unless_null("subject", "(no subject)").alias("subject"),
        _unless_null("body", "").alias("body_text"),
        _unless_null("sender", "unknown@unknown.com").alias("_sender"),
        _unless_null("receiver", "investor@example.com").alias("_receiver"),
        _unless_null("date", "Tue, 01 Jan 2024 00:00:00 +0000").alias("_date"),
    )
    return drop_short_bodies(filled).select(
        "id", "label", "template_id", "category", "subject", "body_text",
        partial_header_source(F.col("_sender"), F.col("_receiver"), F.col("_date"),
                              F.col("subject"), F.col("body_text")).alias("raw_email_source"),
        F.lit("Real mail, partial headers only").alias("notes"),
    )


def from_text_labels(df: DataFrame, max_rows: int | None = None, id_col: str = "id",
                     seed: int = 42) -> DataFrame:
    """``(id, text, label)`` without any header, optionally a capped random
    sample, in the shape of a mail table."""
    picked = df if max_rows is None else capped_sample(df, max_rows, id_col, seed)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = picked.select(
        F.col(id_col).alias("id"), F.col("label").cast("int").alias("label"),
        F.lit("real_generic").alias("template_id"),
        F.lit("Real: generic spam and ham").alias("category"),
        F.lit("(no subject)").alias("subject"),
        body.alias("body_text"),
        F.concat(
            F.lit("From: unknown@unknown.com\nTo: investor@example.com\nSubject: (no subject)\n"
                  "Authentication-Results: mx.example.com; spf=none; dkim=none; dmarc=none\n\n"),
            body, F.lit("\n")).alias("raw_email_source"),
        F.lit("Generic text, no real headers").alias("notes"),
    )
    return drop_short_bodies(rows)


def header_rows(df: DataFrame, raw_col: str = "raw_email_source", id_col: str = "mail_id") -> DataFrame:
    """Ordered ``(id, pos, name, value)`` rows of every header; folded lines
    joined, names lowered. Row-local explode, no shuffle."""
    block = header_block(F.col(raw_col))
    lines = df.select(id_col, F.posexplode(F.split(block, "\n", -1)).alias("pos", "line"))
    kept = lines.filter(F.col("line").rlike("^[!-9;-~]+:"))
    return kept.select(
        id_col, "pos",
        F.lower(F.regexp_extract("line", "^([!-9;-~]+):", 1)).alias("name"),
        F.trim(F.regexp_extract("line", r"(?s)^[!-9;-~]+:[ \t]*(.*)$", 1)).alias("value"),
    )


__all__ = [
    "MAIL_SCHEMA", "from_partial_headers", "from_text_labels", "header_rows", "normal_newlines",
    "read_mail_csv", "read_message_files", "write_mail_csv", "write_mail_parquet",
]
