"""What a Python worker keeps between its tasks."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from corpusweave.llm import decontaminate, near_dedup

REPO = Path(__file__).resolve().parents[2]
WORKER = """
import pickle, re, sys
import numpy, pyarrow as pa, pyspark.worker, zstandard
from corpusweave.llm import decontaminate, near_dedup

def mb():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

task = pickle.load(open(sys.argv[1], "rb"))
began = mb()
with open(sys.argv[2], "rb") as source:
    for batch in task(iter(pa.ipc.open_stream(source))):
        pass
del batch
print(mb() - began)
"""


class Table:
    """Takes the place of a table of documents, to get hold of the function for its batches."""

    schema = ()

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):  # noqa: N802
        self.task = task
        return self


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="memory is read from /proc")
@pytest.mark.parametrize("stage", ["near_dedup", "decontaminate"])
def test_a_worker_gives_memory_back_after_its_task(spark, tmp_path, monkeypatch, stage):
    docs = Table()
    if stage == "near_dedup":
        near_dedup.signed(docs, 5, 80)
    else:
        item = pa.table({"item_id": [1], "text": [" ".join(f"b{i}" for i in range(20))]})
        monkeypatch.setattr(decontaminate, "benchmark_blocks", lambda benchmark: ([SimpleNamespace(value=item)], 20))
        decontaminate.find_contamination(docs, None)
    (tmp_path / "task").write_bytes(cloudpickle.dumps(docs.task))
    words = np.array([f"word{i}" for i in range(5000)])
    rng = np.random.default_rng(3)
    batch = pa.record_batch({"doc_id": np.arange(4000), "text": [" ".join(words[rng.integers(0, 5000, 400)]) for _ in range(4000)], "digest": np.arange(4000)})  # 13 MB
    with pa.OSFile(str(tmp_path / "batch"), "wb") as sink, pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    done = subprocess.run([sys.executable, "-c", WORKER, tmp_path / "task", tmp_path / "batch"], cwd=REPO, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert float(done.stdout) < 50
