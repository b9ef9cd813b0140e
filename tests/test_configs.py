"""Report configs as JSON and as YAML, and what is wrong with broken ones."""

import json

import pytest

from tidemark.sources import index_csv as I

GOOD = {"indices": ["New Orders", "Customers' Inventories", "Prices: paid"], "index_categories": {"Prices: paid": ["Increasing", "Decreasing"], "New Orders": ["Up", "Down"]},
        "canonical_industries": ["Food, Beverage & Tobacco Products", "Machinery"]}
YAML = """---
# a comment
extraction_prompt: |
  Text: with [marks] and - dashes
    deeper: lines
  indices: no
indices:
- New Orders   # the first
- "Customers' Inventories"
- 'Prices: paid'
index_categories:
    "Prices: paid": [Increasing, "Decreasing"]

    New Orders:
      - Up
      - Down
version: 3
canonical_industries:
    - "Food, Beverage & Tobacco Products"
    - Machinery
"""


def rows(frame):
    return {r.report_type: (r.indices, r.index_categories, r.canonical_industries) for r in frame.collect()}


def test_yaml_and_json_give_equal_rows(spark, tmp_path):
    (tmp_path / "one_config.json").write_text(json.dumps(GOOD, indent=1))
    (tmp_path / "two_config.yaml").write_text(YAML)
    (tmp_path / "three_config.yml").write_text(YAML.replace("\n", "\r\n"))
    (tmp_path / "notes.yaml").write_text("not: used")
    got = rows(I.read_report_configs(spark, str(tmp_path)))
    assert set(got) == {"One", "Two", "Three"} and got["One"] == got["Two"] == got["Three"] == (GOOD["indices"], GOOD["index_categories"], GOOD["canonical_industries"])
    assert I.rejected_configs(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text,reason", [
    ("indices:\n  - A\n\t- B", "line 3: tab before text"), ("indices:\n  - A\nwords alone", "line 3: neither key nor item"), ("indices:\n  - [A, B]", "line 2: item is no scalar"),
    ("indices: [A, B", "line 1: value is neither scalar nor list"), ("indices: \"A", "line 1: value is neither scalar nor list"), ("- A\n- B", "line 1: item without a list"),
    ("name: x\n  - A\nindices: [A]", "line 2: item without a list"), ("indices: [A]\nindices: [B]", "repeated key"), ("other: [A]", "no indices"), ("\n", "no indices"), ("{invalid json", "line 1: neither key nor item"),
    ("indices: &anchor\n  - A", "line 1: value is neither scalar nor list"), ("name: x\n  inner: y\nindices: [A]", "line 2: key below a value")])
def test_broken_yaml_is_rejected(spark, tmp_path, text, reason):
    (tmp_path / "odd_config.yaml").write_text(text)
    (tmp_path / "good_config.yaml").write_text("indices: [ A , 'B, C' ]")
    assert [(r.report_type, r.reason) for r in I.rejected_configs(spark, str(tmp_path)).collect()] == [("Odd", reason)]
    assert rows(I.read_report_configs(spark, str(tmp_path))) == {"Good": (["A", "B, C"], None, None)}


def test_broken_json_is_rejected(spark, tmp_path):
    (tmp_path / "odd_config.json").write_text("{invalid json")
    (tmp_path / "empty_config.json").write_text("{}")
    assert sorted((r.report_type, r.reason) for r in I.rejected_configs(spark, str(tmp_path)).collect()) == [("Empty", "no indices"), ("Odd", "no JSON")]
