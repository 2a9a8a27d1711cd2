"""What the library must not contain."""

import re
from pathlib import Path

import pytest

LIBRARY = Path(__file__).resolve().parent.parent / "rosterlake"
SOURCES = sorted(p for p in LIBRARY.rglob("*.py") if LIBRARY / "llm" not in p.parents)


@pytest.mark.parametrize("path", SOURCES, ids=lambda p: p.stem)
def test_no_slow_or_unsafe_calls(path):
    text = path.read_text()
    for pattern in (r"\.rdd\b", r"\budf\(", r"pandas_udf", r"localCheckpoint", r"crossJoin", r"toPandas", r"\.sample\("):
        assert not re.search(pattern, text), pattern


def test_broadcasts_are_only_made_where_the_size_is_checked():
    allowed = {"numbering.py": 1, "skew.py": 3, "intervals.py": 1, "ordering.py": 1}
    found = {p.name: len(re.findall(r"F\.broadcast\(", p.read_text())) for p in SOURCES}
    assert {n: c for n, c in found.items() if c} == allowed


def test_collects_are_only_made_on_bounded_rows():
    found = {p.name for p in SOURCES if re.search(r"\.collect\(\)", p.read_text())}
    assert found == set()


def test_nothing_imports_the_text_operators():
    for path in SOURCES:
        assert "rosterlake.llm" not in path.read_text(), path
