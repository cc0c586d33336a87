"""Settings of jobs: YAML files, defaults from a template of fields, and what a user sets over them."""

from __future__ import annotations

from collections.abc import Iterable
from copy import deepcopy
from typing import Any

import yaml

#: The fields that settings have, by section: name, kind, default, choices.
TEMPLATE: dict[str, list[dict[str, Any]]] = {
    "input_output": [
        {"name": "input", "type": "files", "label": "Input files"}, {"name": "output", "type": "files", "label": "Output folder", "output_dir_set": True},
        {"name": "overwrite", "type": "checkbox", "label": "Overwrite", "default": True},
    ],
    "preprocessing": [
        {"name": "flatfield_quantiles", "type": "textbox", "label": "Flat-field quantiles", "default": ""}, {"name": "gaussian_sigma", "type": "float", "label": "Blur", "default": 0.0},
        {"name": "normalisation", "type": "dropdown", "label": "Normalisation", "default": "none", "options": [{"label": x, "value": x} for x in ("none", "individual", "global")]},
        {"name": "filter_foreground", "type": "checkbox", "label": "Foreground only", "default": False},
    ],
    "registration": [
        {"name": "method", "type": "dropdown", "label": "Method", "default": "phase", "options": [{"label": x, "value": x} for x in ("phase", "peaks", "features", "cpd", "intensity")]},
        {"name": "transform_type", "type": "dropdown", "label": "Transform", "default": "translation", "options": [{"label": x, "value": x} for x in ("translation", "rigid", "similarity")]},
        {"name": "quality_threshold", "type": "float", "label": "Least quality", "default": 0.0},
    ],
    "fusion": [
        {"name": "fusion", "type": "dropdown", "label": "Fusion", "default": "mean", "options": [{"label": x, "value": x} for x in ("mean", "sum", "max", "exclusive")]},
        {"name": "output_spacing", "type": "dropdown", "label": "Spacing", "default": "mean", "options": [{"label": x, "value": x} for x in ("mean", "min", "max")]},
    ],
}


def read(path: str) -> dict[str, Any]:
    """A YAML file's settings; only plain values are read."""
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def write(path: str, settings: dict[str, Any]) -> None:
    with open(path, "w", encoding="utf-8") as file:
        yaml.safe_dump(settings, file, default_flow_style=False)


def template() -> dict[str, list[dict[str, Any]]]:
    return deepcopy(TEMPLATE)


def sections(fields: dict[str, list[dict[str, Any]]] | list[dict[str, Any]], keys: Iterable[str] | None = None) -> dict[str, list[dict[str, Any]]]:
    """Fields by the section that they name (or stand under), in the order of ``cli_order``."""
    out: dict[str, list[dict[str, Any]]] = {}
    for key in keys if keys is not None else fields if isinstance(fields, dict) else [None]:
        for item in fields.get(key, []) if isinstance(fields, dict) else fields:
            item = {**item, "section_key": key, "type": str(item["type"]).lower(), "cli_order": int(item.get("cli_order") or 0)}
            out.setdefault(item.get("section_id") or key, []).append(item)
    return {name: sorted(items, key=lambda i: i["cli_order"]) for name, items in out.items()}


def defaults(fields: dict[str, list[dict[str, Any]]]) -> dict[str, dict[str, Any]]:
    """The defaults of labelled fields by section; the first of a name counts."""
    out: dict[str, dict[str, Any]] = {}
    for section, items in fields.items():
        out[section] = {}
        for item in items:
            if item.get("label") and item.get("default") is not None:
                out[section].setdefault(item["name"], item["default"])
    return out


def updated(settings: dict[str, dict[str, Any]], new: dict[str, dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """Settings with others set over them, section by section."""
    out = deepcopy(settings)
    for section, values in new.items():
        out.setdefault(section, {}).update(values)
    return out


def choices(options: Any) -> Any:
    """Options of a menu as keys with what is shown for each; others as they are."""
    return {"choices": list(options), "key": options.__getitem__} if isinstance(options, dict) else options


#: Kinds of fields and the entry that a form shows for each.
ENTRIES = {"files": "file", "textbox": "line", "float": "number", "integer": "number", "checkbox": "check", "dropdown": "menu", "radio": "menu"}


def form_field(item: dict[str, Any], section: str, values: dict[str, Any]) -> dict[str, Any]:
    """What a form needs to show a field: its entry, label, value, default and choices."""
    kind = str(item["type"]).lower()
    if kind not in ENTRIES:
        raise ValueError(f"unknown field type {kind}")
    shown = {o["value"]: o["label"] for o in item.get("options") or ()} if ENTRIES[kind] == "menu" else {}
    return {
        "section": section, "name": item["name"], "label": item.get("label") or item["name"], "entry": ENTRIES[kind], "value": values.get(item["name"], item.get("default")), "default": item.get("default"),
        "description": item.get("description"), "choices": shown, "is_output": section == "output" or bool(item.get("output_dir_set")), "is_file": ENTRIES[kind] == "file",
    }


def path_of(value: Any) -> dict[str, Any]:
    """An input or output given as a path, a list of paths, or a mapping with them."""
    return value if isinstance(value, dict) else {"path": value}


def native(value: Any) -> Any:
    """Numbers and arrays of a numerical library as plain ones, in mappings and sequences too."""
    if isinstance(value, dict):
        return {native(k): native(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [native(v) for v in value]
    return value.tolist() if hasattr(value, "tolist") else value
