import importlib
import sys

import pytest

from strandline import catalogue

from .compare import duck, same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_sql(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.SQL:
        same(df, duck(sf_dir, catalogue.SQL[name]))
    else:
        assert df.count() > 0


def test_routes_are_verified(spark, sf_dir):
    r = catalogue.QUERIES["auto_route"](spark, sf_dir)
    assert r.where("NOT ok OR n_out > n_in").count() == 0


def test_entry_without_training_data_operators(spark, monkeypatch):
    """The entry module works where the operators for training data have been taken away."""
    import importlib.abc

    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("strandline.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n in ("__spark_entry__", "corpus_pipeline") or n.startswith("strandline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    finder = Gone()
    sys.meta_path.insert(0, finder)
    try:
        entry = importlib.import_module("__spark_entry__")
        assert set(entry.queries()) == set(catalogue.QUERIES)
        assert set(entry.oracle_sql()) == set(catalogue.SQL)
        assert entry.entry(spark).count() > 0
    finally:
        sys.meta_path.remove(finder)
        sys.modules.pop("__spark_entry__", None)
