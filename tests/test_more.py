"""What the catalogue's comparison with SQL can't see."""

import importlib.util
import sys

import pytest

from deltaloom import catalog
from deltaloom.operators import more


def test_factors_fit_the_ratings_better_each_step(spark, sf):
    errors = [r["mse"] for r in more.gr_svd_plus_plus(spark, sf).orderBy("step").collect()]
    assert all(b < a for a, b in zip(errors, errors[1:], strict=False))


def test_refusals_name_what_is_wrong(spark, sf):
    found = {r["what"]: r["error"] for r in more.refused(spark, sf, more._WRONG | more._FRAMES, ("region", "nation", "orders")).collect()}
    assert all(found.values()), found


def test_an_error_inside_the_optional_subpackage_is_an_error(tmp_path, monkeypatch):
    """Only the absence of the corpus subpackage is borne."""
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    source = open(entry.__file__).read()
    alone = {"__file__": entry.__file__, "__name__": "alone"}
    exec(compile(source, entry.__file__, "exec"), alone)  # noqa: S102
    assert set(alone["queries"]()) == set(catalog.queries()) and not [n for n in alone["oracle_sql"]() if n.startswith("op")]
    monkeypatch.undo()
    if importlib.util.find_spec("deltaloom.llm") is None:
        return
    monkeypatch.delattr(sys.modules["deltaloom.llm"], "bpe")
    monkeypatch.setitem(sys.modules, "deltaloom.llm.bpe", None)  # as if a module inside were missing
    monkeypatch.delitem(sys.modules, "deltaloom.llm.registry", raising=False)
    with pytest.raises(ImportError):
        exec(compile(source, entry.__file__, "exec"), {"__file__": entry.__file__, "__name__": "broken"})  # noqa: S102
