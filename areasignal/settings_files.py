"""Settings in files: the part of YAML that settings of runs are written in, JSON, and runs given by sections."""

from __future__ import annotations

import json
import re

from areasignal.config import RunConfig

_WORDS = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "~": None, "": None}
_NUMBER = re.compile(r"[-+]?(\d+|(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][-+]?\d+)?)")
_QUOTED = r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\''
#: Parts of a line: texts in quotes, which open where a value may start; a comment, which starts the line or follows a space.
_CODE = re.compile(rf"(?<!\S)#.*|((?<![^\s\[{{,])(?:{_QUOTED})|.)")
_KEY = re.compile(rf"({_QUOTED}|[^\s\[\]{{}}\"'#,&*!|>%@`-][^#\"']*?|-[^\s#\"'][^#\"']*?)\s*:(?:\s+|$)")


def parsed(text: str) -> object:
    """Nested mappings and lists by indent, lists and mappings in brackets, quoted and plain scalars, comments.

    What else YAML has (anchors, tags, texts of several lines, several documents) is an error that names the line, as are
    repeated keys and indents by tabs. An empty text is None.
    """
    lines = []
    for number, line in enumerate(text.splitlines(), 1):
        code = "".join(_CODE.findall(line)).rstrip()
        if code.strip():
            indent = len(code) - len(code.lstrip())
            if "\t" in code[:indent] or code.startswith(("---", "...", "%")):
                raise ValueError(f"line {number}: {line!r} isn't understood")
            lines.append((indent, code.strip(), number))
    if not lines:
        return None
    if len(lines) == 1 and not _KEY.match(lines[0][1]) and not _item(lines[0][1]):
        return _flow(lines[0][1], lines[0][2])
    value, at = _block(lines, 0)
    if at < len(lines):
        raise ValueError(f"line {lines[at][2]}: unexpected indent")
    return value


def _item(code: str) -> bool:
    return code == "-" or code.startswith("- ")


def _block(lines: list[tuple[int, str, int]], at: int) -> tuple[object, int]:
    """The list or mapping that starts at a line, and the first line after it."""
    indent, code, _ = lines[at]
    out: list | dict = [] if _item(code) else {}
    while at < len(lines) and lines[at][0] == indent and _item(lines[at][1]) == isinstance(out, list):
        _, code, number = lines[at]
        if isinstance(out, list):
            rest = code[1:].lstrip()
            if rest and (_item(rest) or _KEY.match(rest)):  # a block that starts on the item's line
                lines[at] = (indent + len(code) - len(rest), rest, number)
                value, at = _block(lines, at)
            else:
                value, at = _value(lines, at, rest, indent, indent + 1)
            out.append(value)
            continue
        found = _KEY.match(code)
        if not found:
            raise ValueError(f"line {number}: {code!r} has no key")
        if (key := _flow(found[1], number)) in out:
            raise ValueError(f"line {number}: {key!r} is repeated")
        rest = code[found.end() :]
        lists_here = at + 1 < len(lines) and _item(lines[at + 1][1])  # a list may stand as far left as its key
        out[key], at = _value(lines, at, rest, indent, indent if lists_here else indent + 1)
    return out, at


def _value(lines: list[tuple[int, str, int]], at: int, rest: str, indent: int, least: int) -> tuple[object, int]:
    if rest:
        return _flow(rest, lines[at][2]), at + 1
    if at + 1 < len(lines) and lines[at + 1][0] >= least:
        return _block(lines, at + 1)
    return None, at + 1


def _flow(code: str, number: int) -> object:
    """A scalar, or a list or mapping in brackets."""
    if code[:1] in "[{":
        close, inner = {"[": "]", "{": "}"}[code[0]], code[1:-1]
        if code[-1] != close:
            raise ValueError(f"line {number}: {code!r} isn't closed")
        parts, depth, part = [], 0, ""
        for p in re.findall(rf"{_QUOTED}|.", inner):
            depth += (p in "[{") - (p in "]}") if len(p) == 1 else 0
            if p == "," and not depth:
                parts.append(part.strip())
                part = ""
            else:
                part += p
        parts += [part.strip()] if part.strip() else []
        if depth or "" in parts:
            raise ValueError(f"line {number}: {code!r} isn't understood")
        if code[0] == "[":
            return [_flow(p, number) for p in parts]
        pairs = [(_KEY.match(p), p) for p in parts]
        if not all(k for k, _ in pairs):
            raise ValueError(f"line {number}: {code!r} has an entry without a key")
        return {_flow(k[1], number): _flow(p[k.end() :], number) for k, p in pairs}
    if re.fullmatch(_QUOTED, code):
        return json.loads(code) if code[0] == '"' else code[1:-1].replace("''", "'")
    if code[:1] in "&*!|>%@`\"'":
        raise ValueError(f"line {number}: {code!r} isn't understood")
    if code.lower() in _WORDS:
        return _WORDS[code.lower()]
    if _NUMBER.fullmatch(code):
        return int(code) if re.fullmatch(r"[-+]?\d+", code) else float(code)
    return code


def read(path: str) -> object:
    """What a file holds: JSON by its name, else YAML."""
    with open(path, encoding="utf-8") as f:
        return json.load(f) if path.endswith(".json") else parsed(f.read())


# Names that files of settings by sections use, and the settings they stand for.
SECTIONS: dict[str, dict[str, str]] = {
    "caption": {"mode": "caption_mode"},
    "cv": {"n_splits": "folds"},
    "train": {
        "regressor": "regressor", "seed": "seed", "use_poi_vec": "use_poi", "use_sar_lag": "use_target_lag", "use_domain_indicators": "use_indicators", "use_latlon": "use_coordinates",
        "ablate_modalities": "ablate", "keep_modalities": "keep",
    },
    "svf": {"columns": "ratio_columns"},
}
BOOSTING = {
    "n_estimators": "rounds", "learning_rate": "rate", "num_leaves": "leaves", "min_data_in_leaf": "least", "lambda_l2": "l2",
    "feature_fraction": "features", "bagging_fraction": "rows", "bagging_freq": "every", "early_stopping_rounds": "patience",
}
REGRESSORS = {"ridge_cv": "ridge", "lasso_cv": "lasso", "elasticnet_cv": "elastic"}
#: What sections say that no setting here is about: where vectors and ratios come from, that units are means of their rows.
OTHER = {"encoder": None, "train": {"use_dz_agg", "use_spatial_lag", "use_ego_gap"}, "lgbm": {"backend", "objective", "sbert_pca_dim"}, "svf": {"parquets"}}


def of_sections(found: dict, name: str = "run") -> tuple[RunConfig, dict[str, object]]:
    """The run of a file with sections, and what of it isn't a run's (paths, encoder, parquets, outputs).

    Blocks that a file doesn't name are off. Neighbours' means come in as they are, or as gaps if those are on too. A section of
    boosting makes the regressor boosted trees. Names that aren't known are an error.
    """
    layer: dict[str, object] = {"name": name, "use_poi": False, "use_target_lag": False, "use_ego_gap": False}
    rest: dict[str, object] = {}
    for section, values in found.items():
        if section in OTHER and OTHER[section] is None or not isinstance(values, dict):
            rest[section] = values
            continue
        names, other = BOOSTING if section == "lgbm" else SECTIONS.get(section, {}), OTHER.get(section, set())
        if unknown := set(values) - set(names) - other:
            raise ValueError(f"unknown settings {sorted(unknown)} of {section}")
        rest |= {f"{section}.{k}": v for k, v in values.items() if k not in names}
        if section != "lgbm":
            layer |= {names[k]: v for k, v in values.items() if k in names and v is not None}
    train = found.get("train") or {}
    if train.get("use_spatial_lag"):
        gap = bool(train.get("use_ego_gap"))
        layer |= {"use_ego_gap": gap, "use_neighbour_mean": not gap}
    layer["regressor"] = REGRESSORS.get(layer.get("regressor", "ridge"), layer.get("regressor", "ridge"))
    if not layer.get("keep"):
        layer.pop("keep", None)
    if (trees := found.get("lgbm")) is not None:
        layer |= {"regressor": "boosted", "boosting": {BOOSTING[k]: v for k, v in trees.items() if k in BOOSTING}, "pca_components": trees.get("sbert_pca_dim") or 0}
    return RunConfig.of(layer), rest
