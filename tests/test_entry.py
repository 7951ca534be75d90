"""The driver contract: names agree, oracles belong to queries, and llm may be absent."""

import subprocess
import sys


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folder():
    block = "import sys; sys.modules['kinmap.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
    code = block + "import __spark_entry__ as e; q = e.queries(); assert 'align_flagship' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = {r.name: r.value for r in entry.entry(spark).collect()}
    assert set(rows) == {"Hits@1", "Hits@10", "Hits@30", "Hits@50", "MRR"}
