"""A task holds the rows of a few workbooks at a time."""

from __future__ import annotations

import pandas as pd
from pagemill.plans.tables import FILE_BYTES
from pagemill.sources import extract
from pagemill.sources.extract import extract_sheets


class _Files:
    """Files of which mapInPandas tells what a task gives."""

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):
        books = [FILE_BYTES["xlsx"]([f"{k}\t{j}\tc" for j in range(9)]) if k % 4 else b"broken" for k in range(40)]
        return list(run(iter([pd.DataFrame({"file_id": [f"b{k}" for k in range(40)], "content": books}), pd.DataFrame({"file_id": [], "content": []})])))


def test_rows_are_given_a_few_workbooks_at_a_time(monkeypatch):
    monkeypatch.setattr(extract, "TOGETHER", 20)
    told = extract_sheets(_Files())
    assert len(told) > 5 and all(len(t) <= 20 + 9 for t in told)
    rows = pd.concat(told)
    assert len(rows) == 30 * 9 + 10 and rows["error"].notna().sum() == 10
    assert list(dict.fromkeys(rows["file_id"])) == [f"b{k}" for k in range(40)]
