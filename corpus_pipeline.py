"""From raw documents to packed training sequences, in five stages over the `documents` of a folder.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
`documents`; `n_chars` follows the text. Between stages the rows are written and read again; what a stage wrote for
itself is removed once its result is written.

Quality and decontamination judge each row by its own text, so no row is moved and none is looked up by its id. Near
duplicates are known by id and text.

Defined results: a null or empty text has no sign of bad quality, no line to lose but its empty one, no copies and no
benchmark passage, and is packed as one piece of length 0; a text that is null stays null. Rows without an id, and
different texts under one id, are judged each for itself; rows that repeat id and text are copies of one another, of
which one stays. Columns other than those of `documents` are dropped, whatever their names. Without labels the heuristics
alone judge quality; without items nothing is contaminated. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.llm.common import given
from voltrail.llm.decontaminate import with_matches
from voltrail.llm.line_dedup import dedup_lines
from voltrail.llm.near_dedup import without_near_duplicates
from voltrail.llm.packing import pack_documents
from voltrail.llm.quality import QualityModel
from voltrail.session import work_folders_removed, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer does not reject."""
    own = docs.select(*COLUMNS)
    model = QualityModel(own, given(spark, sf_dir, "labels"))
    judged = own.withColumn("_of", model.verdict(F.coalesce("text", F.lit(""))))
    return judged.where(model.keeps(F.col("_of"))).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in many others."""
    done = dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), F.col("line_result.kept"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles."""
    return without_near_duplicates(docs.select(*COLUMNS))


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    judged = with_matches(docs.select(*COLUMNS), given(spark, sf_dir, "benchmark"), "_matches")
    return judged.where(F.size("_matches") == 0).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of text with its place in a training sequence."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", contamination_stage),
    ("packing", packing_stage),
]

#: Learned scores and latent vectors are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        if number == len(STAGES):
            return stage(spark, docs, sf_dir)
        with work_folders_removed(spark) as kept:
            docs = kept(written(stage(spark, docs, sf_dir), f"stage-{name}"))
