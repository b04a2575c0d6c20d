"""Settings in YAML and by sections."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from areasignal import config
from areasignal.settings_files import of_sections, parsed

SECTIONS = """
# A run of trees; what follows '#' is no setting.
dataset: out/rows.jsonl     # a path
out_dir: "out/run #1"
caption:
  mode: modality_sep
encoder: {backend: sbert, batch_size: 32}
cv:
  n_splits: 4
train:
  use_poi_vec: true
  use_spatial_lag: true
  use_ego_gap: true
  use_sar_lag: false
  ablate_modalities: [sv, ntl]
  seed: 7
svf:
  parquets:
  - a.parquet
  - b.parquet
  columns: [mean, std]
lgbm:
  n_estimators: 50
  learning_rate: 0.03
  lambda_l2: 1.0
"""


def test_sections():
    run, rest = of_sections(parsed(SECTIONS), "trees")
    assert (run.name, run.folds, run.seed, run.regressor, run.ablate, run.keep) == ("trees", 4, 7, "boosted", ("sv", "ntl"), None)
    assert run.use_poi and run.use_ego_gap and not run.use_target_lag and not run.use_neighbour_mean and not run.use_indicators
    assert dict(run.boosting) == {"rounds": 50, "rate": 0.03, "l2": 1.0} and run.ratio_columns == ("mean", "std")
    assert rest["out_dir"] == "out/run #1" and rest["svf.parquets"] == ["a.parquet", "b.parquet"] and rest["encoder"]["batch_size"] == 32
    plain, _ = of_sections(parsed("train:\n  regressor: ridge_cv\n  use_spatial_lag: true\n"))
    assert plain.regressor == "ridge" and plain.use_neighbour_mean and not plain.use_ego_gap
    with pytest.raises(ValueError, match="use_nothing"):
        of_sections({"train": {"use_nothing": True}})


def test_yaml_by_hand():
    text = "a: 1\nb:\n  - x\n  - y: 2\n    z: [1, 'it''s', {k: v}]\n  -\n    - 3\n  - - 4\n    - -5\nc:\nd: ''\n'e f': \"q\\n\"\nu: http://h:1/p#q\nw: a - b\n"
    want = {"a": 1, "b": ["x", {"y": 2, "z": [1, "it's", {"k": "v"}]}, [3], [4, -5]], "c": None, "d": "", "e f": "q\n", "u": "http://h:1/p#q", "w": "a - b"}
    assert parsed(text) == want and parsed("") is None and parsed("[1, 2.5, yes, ~]") == [1, 2.5, True, None]
    for bad in ("a: 1\na: 2", "a: &x 1", "a: |\n  text", "\ta: 1", "a: [1, 2", "--- \na: 1", "a: 1\n   b: 2", "a: [1,,2]"):
        with pytest.raises(ValueError):
            parsed(bad)


def written(value, indent: int = 0) -> str:
    """Values as YAML by indent, strings quoted."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(k)}:" + (f"\n{written(v, indent + 2)}" if isinstance(v, (dict, list)) and v else f" {json.dumps(v)}  # {k!r}\n") for k, v in value.items())
    return "".join(f"{pad}-" + (f"\n{written(v, indent + 2)}" if isinstance(v, (dict, list)) and v else f" {json.dumps(v)}\n") for v in value)


LEAVES = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(codec="utf-8", exclude_characters="\x85  ", exclude_categories=["Cc", "Cs"]))
KEYS = st.text("abc #:-'\"[]{}", min_size=1)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(KEYS, st.recursive(LEAVES, lambda v: st.lists(v) | st.dictionaries(KEYS, v), max_leaves=12), min_size=1))
def test_round_trip(value):
    assert parsed(written(value)) == value


def test_manifest_in_yaml(tmp_path):
    at = tmp_path / "runs.yaml"
    at.write_text("defaults: {seed: 3}\nruns:\n  - name: a\n  - name: b\n    ablate: [sat]\npaths:\n  oof: out/oof.jsonl\n")
    runs, paths = config.manifest(str(at))
    assert [(r.name, r.seed, r.ablate) for r in runs] == [("a", 3, ()), ("b", 3, ("sat",))] and paths == {"oof": str(tmp_path / "out/oof.jsonl")}
