import os
import subprocess
import sys
from pathlib import Path

import pytest

from plumbline.llm import quality_subword as qs
from plumbline.llm.common import trim_driver

ROOT = Path(__file__).resolve().parents[2]
HELD = """
import random, re, sys
import numpy as np, pandas, pyarrow as pa
from plumbline.llm import quality_subword, token_planes
def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
"""


def _run(code: str) -> float:
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "TOKENIZERS_PARALLELISM": "false"}
    return float(subprocess.run([sys.executable, "-c", HELD + code], env=env, capture_output=True, text=True, check=True).stdout)


def test_a_workers_encoder_stays_small():
    pytest.importorskip("public_tokenizers")
    more = _run("""
import public_tokenizers
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(400_000)]
enc, base = token_planes._encoder(public_tokenizers.path("byte_bpe_50k.json"), 2), held()
for k in range(0, len(words), 20_000):
    enc.encode(pa.array([" ".join(words[k : k + 20_000])]))
print(held() - base)
""")
    assert more < 40  # MB


def test_sample_needs_no_python_workers_of_its_own(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")

    def never(*_, **__):
        raise AssertionError("rows through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", never)
    assert qs.sample(docs, labels) == ([f"text {k}" for k in range(8)], [k % 2 for k in range(8)])


def test_drivers_jvm_can_be_trimmed(spark):
    trim_driver(spark)
    assert spark.range(3).count() == 3
