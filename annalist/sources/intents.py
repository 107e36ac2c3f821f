"""Intents: JSON question documents in a folder, and the text helpers around a model's answers."""

from __future__ import annotations

import json
import re
from pathlib import Path


def fill_template(template: str, values: dict[str, str]) -> str:
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values.get(m[1], m[0]), template)


def strip_fence(text: str) -> str:
    """The text without a Markdown code fence around it."""
    inside = re.search(r"```[a-zA-Z]*\n(.*?)```", text, re.S)
    return (inside[1] if inside else text).strip()


def find_json(text: str) -> dict | None:
    """The first JSON object in the text, or None."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def unwrap(document: dict) -> tuple[str | None, dict]:
    """(sentence, intent) of an intent with or without an envelope."""
    if isinstance(document.get("intent"), dict):
        return document.get("sentence"), document["intent"]
    return None, document


def read_intents(folder: str, max_files: int | None = None) -> list[tuple[str, str | None, dict]]:
    """(file name, sentence, intent) of the folder's *.json files in order of name; files without JSON are skipped."""
    out = []
    for path in sorted(Path(folder).glob("*.json"))[:max_files]:
        try:
            document = json.loads(path.read_text(encoding="utf-8"))
        except ValueError:
            continue
        if isinstance(document, dict):
            out.append((path.name, *unwrap(document)))
    return out
