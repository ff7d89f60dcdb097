"""Uploaded filings, landed as a stream: every file that appears below a folder is parsed once.

A checkpoint says which files have been seen. A file's name may come again, so what counts is its content: a document is
named by the hash of its bytes, of which a stored table keeps the sections. A batch that is run again after a crash finds
its documents there and adds none twice. An empty file gives nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sections
from . import filings
from .store import StoredTable

FILES = "doc string, name string, bytes long, landed_at timestamp"
SECTIONS = "doc string, pos int, title string, level int, parent int, above array<int>, leaf boolean, pages array<struct<page_number:int,content:string>>, start_page int, end_page int, text_length long, word_count long"
#: Fixed value: kinds of files that are read, Markdown first.
KINDS = {"md": ("md", "txt"), "html": ("html", "htm")}


class Landing:
    """folder: where files appear (its subfolders, too); root: where tables and the checkpoint are kept."""

    def __init__(self, spark: SparkSession, folder: str, root: str, per_trigger: int = 1000, buckets: int = 16):
        self.spark, self.folder, self.root, self.per_trigger = spark, folder, root.rstrip("/"), per_trigger
        self.files = StoredTable(spark, f"{self.root}/files", FILES, ["doc"], buckets)
        #: Sections go to the bucket of their document, so a document's are read and written together.
        self.sections = StoredTable(spark, f"{self.root}/sections", SECTIONS, ["doc"], buckets)

    def _parsed(self, files: DataFrame) -> DataFrame:
        kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
        text = F.decode("content", "UTF-8")
        body = F.when(kind.isin(*KINDS["html"]), filings.markdown_of(text)).otherwise(text)
        return sections.parse(files.select("doc", body.alias("text")))

    def _merge(self, batch: DataFrame, _number: int) -> None:
        hashed = batch.withColumn("doc", F.sha2("content", 256))
        named = hashed.groupBy("doc").agg(F.min("path").alias("path"), F.min("modificationTime").alias("landed_at"), F.max("length").alias("bytes"))
        known = self.files.lookup(named.select("doc")).select("doc")
        new = named.join(known, "doc", "left_anti")
        content = hashed.join(new.select("doc", "path"), ["doc", "path"]).dropDuplicates(["doc"]).select("doc", "path", "content")
        # Sections first: a document that is among the files has all of its sections.
        rows = self._parsed(content)
        self.sections.change(rows, lambda old, fresh: old.join(fresh.select("doc").distinct(), "doc", "left_anti").unionByName(fresh.select(*old.columns)))
        seen = new.select("doc", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "bytes", "landed_at")
        self.files.change(seen, lambda old, fresh: old.unionByName(fresh))

    def run(self, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
        """once: until all files that are there have been read; else a trigger every so often."""
        kinds = ",".join(k for group in KINDS.values() for k in group)
        stream = self.spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{kinds}}}").option("maxFilesPerTrigger", self.per_trigger)
        schema = "path string, modificationTime timestamp, length long, content binary"
        writer = stream.schema(schema).load(self.folder).writeStream.foreachBatch(self._merge).option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
