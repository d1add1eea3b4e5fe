"""The entry module with and without what the corpus operations need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "{missing}" or name == "{missing}":
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print("COUNT", len(e.queries()), len(e.oracle_sql()), sum(k.startswith("op") for k in e.queries()))
"""


@pytest.mark.parametrize("missing", ["corpus_pipeline", "levelfield.llm", "public_tokenizers", "xxhash"])
def test_the_other_queries_stand_alone(missing):
    run = subprocess.run(
        [sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120
    )
    said = [x for x in run.stdout.splitlines() if x.startswith("COUNT")]
    assert said, run.stderr[-800:]
    queries, oracles, corpus = map(int, said[0].split()[1:])
    assert queries >= 155 and oracles == queries and corpus == 0
