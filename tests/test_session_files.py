"""The files that import queries render, one for each session."""

import glob
import os

from pyspark.sql import functions as F

from scrollmill.functions import variants as V
from scrollmill.functions.times import EPOCH
from scrollmill.operators.batch import shared_path
from scrollmill.plans import import_queries
from scrollmill.sources import base, claude_code, codex


def test_session_files_are_those_of_sparks_writer(spark):
    """The same folders and lines as by partitionBy, but written by the tasks: no checksum beside a file, each of which takes Hadoop a process."""
    names = ["session-1", "a/b=c d", "é%ï[x]^", "", None]
    rows = spark.createDataFrame([(s, k, None if k == 3 else f'{{"n": {k}, "t": "ü "}}') for s in names for k in (3, 1, 2)], "session string, at int, value string")
    own, plain = shared_path(spark, "own"), shared_path(spark, "plain")
    import_queries.put_lines(rows, own, per_session=True)
    rows.repartition(2, "session").sortWithinPartitions("session", "at").select("session", "value").write.partitionBy("session").text(plain)

    def held(root):
        lines = spark.read.option("recursiveFileLookup", "true").text(root).select(F.regexp_extract(F.col("_metadata.file_path"), "/(session=[^/]*)/", 1).alias("folder"), "value", F.monotonically_increasing_id().alias("n"))
        out = {}
        for r in lines.orderBy("n").collect():
            out.setdefault(r.folder, []).append(r.value)
        return out

    assert held(own) == held(plain) and len(held(own)) == 4 and all(len(v) in (3, 6) for v in held(own).values())
    files = [f for f in glob.glob(own.removeprefix("file:").replace("//", "/") + "/*/*", include_hidden=True) if os.path.isfile(f)]
    assert len(files) == 5 and not any(f.endswith(".crc") for f in files)


def test_log_lines_are_parsed_once(spark, sf_dir):
    """Sessions, messages and events without text come from one parse of the lines."""
    for batch in (claude_code.read(spark, import_queries.render_claude_code(spark, sf_dir)), codex.read(spark, import_queries.render_codex(spark, sf_dir))):
        assert "parsejson" not in batch.conversations._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")


def test_times_of_records(spark):
    """Each kind of time, also numbers in texts and what is no time."""
    cases = {'{"timestamp": 1779357600000}': "2026-05-21T10:00:00.000Z", '{"createdAt": "2026-05-21T10:00:00.5Z"}': "2026-05-21T10:00:00.500Z", '{"created_at": "2026-05-21"}': "2026-05-21T00:00:00.000Z", '{"timestamp": "2026"}': EPOCH, '{"timestamp": "1779357600000"}': EPOCH, '{"timestamp": "1779357600000.0"}': "2026-05-21T10:00:00.000Z", '{"timestamp": [1]}': EPOCH, '{"timestamp": true}': EPOCH, '{"timestamp": "  "}': EPOCH, "{}": EPOCH}
    rows = spark.createDataFrame([(k,) for k in cases], "j string").withColumn("v", V.parse("j"))
    assert {r.j: r.at for r in rows.select("j", base.record_time().alias("at")).collect()} == cases
