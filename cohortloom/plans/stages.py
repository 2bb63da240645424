"""Stages that are committed one by one, so that a broken run goes on where it stopped.

A stage writes to a folder of its own attempt. Only when that is whole, a one-row manifest names the folder,
the fingerprint of everything the stage was made from, and what it reports about itself. A later run takes a
committed stage as it is if its fingerprint is still the same. Folders of broken attempts and of replaced
results stay until somebody removes them, as others may still be reading them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortloom.sources.records import first_existing

MANIFEST = "fingerprint string, path string, details string"


@dataclass(frozen=True)
class Committed:
    path: str
    fingerprint: str
    details: dict
    reused: bool


def files_mark(spark: SparkSession, path: str) -> list:
    """Number, length and a sum of digests of the files at ``path`` (names, lengths, times; no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    digest = F.xxhash64("path", "length", "modificationTime").cast("decimal(20, 0)")
    row = files.agg(F.count("*"), F.sum("length"), F.sum(digest).cast("string")).first()
    return list(row)


class Stages:
    """Runs of named stages below ``out_dir``; ``start`` names one from which on all run anew."""

    def __init__(self, spark: SparkSession, out_dir: str, start: str | None = None):
        self.spark, self.out_dir, self.start, self.anew = spark, out_dir, start, False

    def committed(self, name: str) -> Committed | None:
        try:
            path = first_existing(self.spark, [f"{self.out_dir}/committed/{name}"])
        except FileNotFoundError:
            return None
        row = self.spark.read.schema(MANIFEST).json(path).first()
        # a manifest that broke while it was written counts as none
        if row is None or row["details"] is None:
            return None
        return Committed(row["path"], row["fingerprint"], json.loads(row["details"]), True)

    def run(self, name: str, made_from: Mapping, build: Callable[[str], dict | None]) -> Committed:
        """The committed stage, or the one that ``build`` writes to the path it is given.

        ``made_from`` holds parameters and the fingerprints of earlier stages; what ``build`` returns is kept.
        """
        told = json.dumps([name, made_from], sort_keys=True)
        fingerprint = hashlib.sha256(told.encode()).hexdigest()
        self.anew = self.anew or name == self.start
        found = None if self.anew else self.committed(name)
        if found and found.fingerprint == fingerprint:
            return found
        path = f"{self.out_dir}/{name}/{uuid.uuid4().hex}"
        details = build(path) or {}
        row = (fingerprint, path, json.dumps(details))
        manifest = self.spark.createDataFrame([row], MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.out_dir}/committed/{name}")
        return Committed(path, fingerprint, details, False)
