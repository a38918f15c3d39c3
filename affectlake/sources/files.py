"""Schema-bound readers.  Nothing is inferred; headers never decide types."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from affectlake.functions.labels import STANCE_LABELS, TWEET_LABELS
from affectlake.functions.rounding import round_even
from affectlake.functions.text import HEAD_PATTERN, base_name, evaluation_head, utterance_id
from affectlake.sources.records import read_quoted

VAD_CORPUS = "id string, split string, V double, A double, D double, text string"
METADATA = "id string, document string, category string, subcategory string"
RAW_TEXT = "id string, text string"
ANNOTATIONS = (
    "id string, V double, A double, D double, stdV double, stdA double, stdD double, N int"
)
FORUM = "Text string, Label string, Alpha string"
LEXICON = "word string, v double, a double, d double"

# File name parts of the tweet corpus and of the forum corpora.
TWEET_FILES = {"train": "train", "valid": "dev", "test": "test-gold"}
TWEET_PREFIX = "2018-E-c-En-"
FORUM_FILES = {"train": "train", "valid": "dev", "test": "test"}
STANCE_FILES = {"train": "train-combined-0.0.csv", "test": "test-combined-0.0.csv"}
STANCE_SKIPPED = 1828
SESSIONS = tuple(f"Session{i}" for i in range(1, 6))


def delimited(
    spark: SparkSession, path: str | list[str], schema: str, sep: str = ",",
    header: bool = True, multi_line: bool = True,
) -> DataFrame:
    """Quoted delimited text, read by as many tasks as the files have blocks.

    With ``multi_line`` a field may hold newlines (see :mod:`affectlake.sources.records`);
    files without such fields are read in one pass instead of two when it is off.
    """
    if multi_line:
        return read_quoted(spark, path, schema, sep, header)
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_vad_corpus(spark: SparkSession, path: str, **options) -> DataFrame:
    return delimited(spark, path, VAD_CORPUS, **options)


def read_metadata(spark: SparkSession, path: str, **options) -> DataFrame:
    """Ids and categories, which hold no newline: a large file splits by block."""
    return delimited(spark, path, METADATA, sep="\t", **{"multi_line": False, **options})


def read_raw_text(spark: SparkSession, path: str, **options) -> DataFrame:
    return delimited(spark, path, RAW_TEXT, **options)


def read_annotations(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader or writer perspective of the VAD corpus: ids and numbers, so a file splits by block."""
    return delimited(spark, path, ANNOTATIONS, **{"multi_line": False, **options})


def _splits(spark: SparkSession, files: Mapping[str, str], read) -> DataFrame:
    parts = [read(path).withColumn("split", F.lit(split)) for split, path in files.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_tweets(spark: SparkSession, folder: str, labels: Sequence[str] = TWEET_LABELS, **options) -> DataFrame:
    """Multi-label tweets, one tab-separated file per split."""
    schema = "ID string, Tweet string, " + ", ".join(f"{name} int" for name in labels)
    files = {s: f"{folder}/{TWEET_PREFIX}{part}.txt" for s, part in TWEET_FILES.items()}
    return _splits(spark, files, lambda p: delimited(spark, p, schema, sep="\t", **options))


def read_statements(spark: SparkSession, path: str, form: str = "csv", places: bool = False) -> DataFrame:
    """Text, numeric emotion id and emotion name of the exported statement sheet.

    The columns are found by the names in the header.  ``places`` adds ``file`` and
    ``row_no``, for sheets in CSV form.
    """
    if form == "parquet":
        sheet = spark.read.parquet(path)
    else:
        head = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        schema = T.StructType([T.StructField(name, T.StringType()) for name in head.columns])
        sheet = read_quoted(spark, path, schema.toDDL(), places=places)
    return sheet.select(
        F.col("SIT").cast("string"), F.col("EMOT").cast("double").cast("int").alias("EMOT"),
        F.col("Field1").cast("string"), *(["file", "row_no"] if places else []),
    )


def read_stance_tweets(
    spark: SparkSession, path: str, labels: Sequence[str] = STANCE_LABELS,
    skip_first: int = 0, skip_lines: Sequence[int] = (), multi_line: bool = False,
) -> DataFrame:
    """Headerless label columns and text, named by position.

    ``skip_first`` drops the leading rows of the file, ``skip_lines`` single
    rows by their 1-based number.
    """
    schema = ", ".join(f"{name} string" for name in [*labels, "text"])
    if not skip_first and not skip_lines:
        return delimited(spark, path, schema, sep="\t", header=False, multi_line=multi_line)
    if multi_line:
        numbered = read_quoted(spark, path, schema, "\t", header=False, places=True).drop("file")
    else:
        numbered = with_row_numbers(delimited(spark, path, schema, sep="\t", header=False, multi_line=False))
    dropped = [int(n) for n in skip_lines]
    kept = numbered.filter(F.col("row_no") > skip_first)
    if dropped:
        kept = kept.filter(~F.col("row_no").isin(dropped))
    return kept.drop("row_no")


def with_row_numbers(rows: DataFrame, across: bool = False) -> DataFrame:
    """1-based ``row_no`` within each file, in file order; ``across`` all files, by path, if wanted.

    A window orders the rows of one file block only; block counts, which are
    tiny, say how many rows come before it.
    """
    columns = rows.columns
    block = ["__file", "__block"]
    placed = rows.select(
        *columns,
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
    )
    counts = placed.groupBy(*block).agg(F.count("*").alias("__n"))
    in_order = Window.orderBy("__file", "__block") if across else Window.partitionBy("__file").orderBy("__block")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*block, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("__at"))
    numbered = placed.withColumn("__local", inside).join(starts, block, "inner")
    return numbered.select(*columns, (F.col("__before") + F.col("__local")).alias("row_no"))


def read_forum_posts(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Headerless text, comma list of label ids and id; one file per split."""
    files = {s: f"{folder}/{part}.tsv" for s, part in FORUM_FILES.items()}
    return _splits(
        spark, files, lambda p: delimited(spark, p, FORUM, sep="\t", header=False, **options)
    )


# ------------------------------------------------------------------- dialogues

def read_whole_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """``(file, value)`` of the ``.txt`` files directly inside the folders."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(list(folders), wholetext=True)
    return files.select(base_name(F.col("_metadata.file_name")).alias("file"), "value")


def parse_evaluations(files: DataFrame) -> DataFrame:
    """Evaluation files to ``(file, id, emotion, v, a, d)``.

    A file is cut at empty lines; the first line of a block is its header.
    Blocks without a well-formed header (the file's own heading) give no row.
    """
    blocks = files.select("file", F.explode(F.split("value", "\n\n+")).alias("block"))
    head = F.substring_index(F.ltrim(F.col("block")), "\n", 1)
    well_formed = blocks.select("file", head.alias("head")).filter(F.col("head").rlike(HEAD_PATTERN))
    return well_formed.select("file", evaluation_head("head").alias("e")).select(
        "file", utterance_id("file", "e.utterance").alias("id"), "e.emotion", "e.v", "e.a", "e.d"
    )


def parse_transcripts(files: DataFrame) -> DataFrame:
    """Transcript files to ``(file, id, transcription)``; the last of equal ids wins."""
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return transcript_lines(lines, ["file"])


def transcript_lines(lines: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``<id> [span]: text`` lines; others (no `` [`` or no ``: ``) are left out."""
    parsed = lines.filter(F.col("line").contains(" [") & F.col("line").contains(": ")).select(
        *group,
        F.substring_index("line", " [", 1).alias("id"),
        F.regexp_extract("line", "(?s)^.*?: (.*)$", 1).alias("transcription"),
        "line_no",
    )
    return parsed.groupBy(*group, "id").agg(F.max_by("transcription", "line_no").alias("transcription"))


def dialogue_folders(root: str, kind: str, sessions: Sequence[str] = SESSIONS) -> list[str]:
    sub = {"evaluations": "EmoEvaluation", "transcripts": "transcriptions"}[kind]
    return [f"{root}/{session}/dialog/{sub}" for session in sessions]


# --------------------------------------------------------------------- lexicon

def read_lexicon(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(word, v, a, d)`` rounded to three places; the last of equal words wins, in the order of the paths.

    A line's place is one number, file, block and line in it, so the aggregate hashes.
    """
    raw = delimited(spark, path, LEXICON, sep="\t", multi_line=False)
    names = sorted(re.sub("^([^:]+):/+", r"\1:/", name) for name in raw.inputFiles())  # one way to write a local path
    own = F.regexp_replace("_metadata.file_path", "^([^:]+):/+", "$1:/")
    file = F.array_position(F.lit(names), own) if len(names) > 1 else F.lit(0)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = F.expr("cast(file as decimal(8,0)) * 100000000000000000000 + cast(block as decimal(20,0))") * F.lit(10_000_000_000).cast(
        "decimal(11,0)") + F.col("local").cast("decimal(11,0)")
    scores: list[Column] = [round_even(a, 3).alias(a) for a in "vad"]
    placed = raw.select(
        "word", *scores, file.alias("file"), F.col("_metadata.file_block_start").alias("block"), local.alias("local")
    ).select("word", *"vad", at.cast("decimal(38,0)").alias("at"))
    return placed.groupBy("word").agg(*[F.max_by(a, "at").alias(a) for a in "vad"])
