"""The stateless record and text expressions run on a stream as they are."""

import json
import uuid

from test_records import study

from cohortloom.operators.flags import add_disease_flags
from cohortloom.operators.records import parse_records


def test_parse_on_a_stream(spark, scratch):
    folder = f"{scratch}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(study()),), ("broken",)], "value string").write.text(folder)
    lines = spark.readStream.text(folder)
    table, _ = parse_records(lines)
    name = f"parsed_{uuid.uuid4().hex}"
    out = add_disease_flags(table).select("nct_id", "is_nsclc", "label_feasible")
    stream = out.writeStream.format("memory").queryName(name).outputMode("append").start()
    stream.processAllAvailable()
    stream.stop()
    assert [tuple(r) for r in spark.table(name).collect()] == [("N1", 1, 1)]
