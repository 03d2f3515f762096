import re

import __spark_entry__ as entry
import corpus_pipeline


def test_each_operator_has_one_query_and_the_pipeline_its_stages():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]


def test_nothing_outside_imports_this_folder():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in [*(root / "curbline").rglob("*.py"), *(root / "tools").glob("*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "curbline.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
