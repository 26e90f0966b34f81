"""Executors of a local cluster of two that are lost between an operator's steps."""

import os
import subprocess
import sys

JOB = """
import sys, time, zlib
from pyspark.sql import SparkSession, functions as F
from planwalk.llm import lang_id, suffix_tree
lost, folder = set(sys.argv[1].split(",")), sys.argv[2]
spark = (SparkSession.builder.master("local-cluster[2,1,1200]").config("spark.executor.memory", "1200m").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate())
suffix_tree.SEGMENT_BYTES = 4000
plain, gone = suffix_tree._exchange, []

def exchange(frame, name, *more, **kind):
    if name in lost:
        held = spark._jsc.sc().getExecutorIds()
        for k in [held.apply(j) for j in range(held.size())]:
            assert spark._jsc.sc().killAndReplaceExecutor(k)
            gone.append(k)
        time.sleep(3)
    return plain(frame, name, *more, **kind)

words = F.expr("transform(sequence(1, 60), j -> concat('w', pmod(xxhash64(id, j), 40)))")
texts = spark.range(0, 300, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
texts.write.parquet(f"{folder}/texts")
texts = spark.read.parquet(f"{folder}/texts")
held = lang_id.held_out("doc_id", 7, 2)
want = sorted((r.doc_id, r.n_tokens, r.score) for r in suffix_tree.score(texts, held).collect())
suffix_tree._exchange = exchange
got = sorted((r.doc_id, r.n_tokens, r.score) for r in suffix_tree.score(texts, held).collect())
assert got == want and len(got) == 300, "other scores"
print("executors lost", len(gone), "tables", len(spark.catalog.listTables()))
spark.stop()
"""


def test_suffix_tree_survives_lost_executors(tmp_path):
    """Both executors are replaced before the exchange of the first contexts and again before the last one."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "job.py").write_text(JOB)
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH", "")])), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED")}
    # into a file: what a cluster starts would hold a pipe open
    with open(tmp_path / "log", "w") as log:
        done = subprocess.run([sys.executable, str(tmp_path / "job.py"), "n1,raised", str(tmp_path)], cwd=tmp_path, env=env, stdin=subprocess.DEVNULL, stdout=log, stderr=log, timeout=240)
    told = (tmp_path / "log").read_text()
    assert done.returncode == 0, told[-3000:]
    assert "executors lost 4 tables 0" in told
