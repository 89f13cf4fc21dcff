"""Keys and labels made from names."""

from __future__ import annotations

from modlens.functions.core import regex, where


def report_key(name: str) -> str:
    """Output key: lower case, anything but letters, digits, ``.``, ``-`` to one ``_``."""
    return f"btrim(lower(regexp_replace({name}, {regex(r'[^A-Za-z0-9.\-]++')}, '_')), '_')"


def file_stem(path: str) -> str:
    """Last path component without its extension."""
    stem = (
        f"regexp_replace(substring_index({path}, '/', -1), {regex(r'(?<=[\s\S])\.[^.]*+\z')}, '')"
    )
    return f"coalesce(nullif({stem}, ''), 'unknown_procedure')"


def node_id(label: str) -> str:
    """Graph node id: ``N_`` and the label, non-alphanumerics to ``_``, none at the end."""
    return f"rtrim('_', concat('N_', regexp_replace({label}, '[^A-Za-z0-9]', '_')))"


def node_label(label: str) -> str:
    return f"replace({label}, '\"', '\\'')"


def is_external(name: str) -> str:
    """Four or more non-empty dotted parts: an object on another server."""
    parts = where(f"split({name}, r'\\.')", lambda p: f"{p} != ''")
    return f"(size({parts}) >= 4)"
