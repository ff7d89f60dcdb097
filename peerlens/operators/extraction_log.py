"""The log of an extraction: how many pages were read, entities found, rejected (by reason) and kept.

Counts of entities come with the rows: they are observed where the rows pass, so counting reads nothing anew.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.entities import Relation

SCHEMA = "job_id string, relation string, stage string, n long, at timestamp"


def reason(kind: Relation):
    """The first required field that a raw entity lacks; null if it has all."""
    lacks = [F.when(F.length(text.strip(text.as_text(F.col(f)))) == 0, F.lit(f)) for f in kind.required]
    return F.coalesce(*lacks, F.lit(None).cast("string"))


def counted(raw: DataFrame, kind: Relation) -> dict[str, int]:
    """Raw entities (found), and those without a required field (no <field>), from one pass over them."""
    seen = Observation(f"extraction-{uuid.uuid4().hex}")
    lacking = [F.count_if(reason(kind) == f).alias(f"no {f}") for f in kind.required]
    raw.observe(seen, F.count(F.lit(1)).alias("found"), *lacking).write.format("noop").mode("overwrite").save()
    return seen.get


def write(spark: SparkSession, path: str, job: str, relation: str, pages: int, seen: dict[str, int], parsed: int, kept: int) -> None:
    """Appends a line for each stage. What the parser rejected beyond missing fields is `unparsed`, what the validator took
    out is `invalid`."""
    whole = seen["found"] - sum(n for k, n in seen.items() if k != "found")
    lines = {"pages": pages, **seen, "unparsed": whole - parsed, "parsed": parsed, "invalid": parsed - kept, "kept": kept}
    at = datetime.now(UTC).isoformat()
    rows = [(json.dumps({"job_id": job, "relation": relation, "stage": stage, "n": n, "at": at}),) for stage, n in lines.items()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)
