"""Markdown tables, walls that move, and charts without an anchor."""

import numpy as np
import pytest

from gridloom.functions.parse import declared_signs, markdown_tables
from gridloom.operators.control_chart import ChartSpec, _chart
from gridloom.plans.splits import LeakError, Split, SplitScheme


def test_markdown_tables():
    text = "words\n\n| a | `b` |\n|:--|---:|\n| **x** | 1 \\| 2 |\n| y |\n\nmore | words\nfeature | sign\n--- | ---\n`f` | +\n`g` | \u2212\n`h` | ?\n"
    assert markdown_tables(text) == [[{"a": "x", "b": "1 | 2"}, {"a": "y", "b": ""}], [{"feature": "f", "sign": "+"}, {"feature": "g", "sign": "\u2212"}, {"feature": "h", "sign": "?"}]]
    assert declared_signs(text) == {"f": 1, "g": -1} and markdown_tables("") == [] and markdown_tables("| a |") == []


def test_a_wall_only_moves_back():
    s = SplitScheme((Split("train", 0, 100), Split("test", 100, None)), frozenset({"test"}))
    assert s.with_wall(60).wall() == 60 and s.wall() == 100 and s.with_wall(60).sealed == {"test"}
    for wall in (0, 101):
        with pytest.raises(LeakError):
            s.with_wall(wall)


def test_a_chart_without_an_anchor_follows_a_drift():
    rng = np.random.default_rng(1)
    x = (np.linspace(0, 40, 4000) + rng.normal(0, 1, 4000)).tolist()
    home = [True] * len(x)
    held, free = (len(_chart(x, home, 0.0, 1.0, ChartSpec(anchor=a))[0]) for a in (1.4, None))
    assert held > 1000 and free < 5
