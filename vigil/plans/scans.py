"""Static scans of a source tree: exceptions that are swallowed, names of secrets and personal data, contracts without a companion."""

from __future__ import annotations

import ast
import re
from pathlib import Path

_BROAD = {"Exception", "BaseException"}
_SECRET = re.compile(r"(?i)(password|passwd|secret|api_?key|access_?token|private_?key)")
_PERSONAL = re.compile(r"(?i)(ssn|social_security|passport_no|birth_?date|date_of_birth|phone|email)")


def swallowed(source: str) -> list[tuple[int, str]]:
    """(line, kind) of handlers that are bare or catch everything without raising again, or that do nothing at all."""
    found = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.ExceptHandler):
            names = {n.id for n in ast.walk(node.type) if isinstance(n, ast.Name)} if node.type else _BROAD
            raises = any(isinstance(n, ast.Raise) for n in ast.walk(node))
            if all(isinstance(n, ast.Pass) for n in node.body):
                found.append((node.lineno, "silent"))
            elif names & _BROAD and not raises:
                found.append((node.lineno, "broad"))
    return sorted(found)


def secrets(source: str) -> list[tuple[int, str]]:
    """(line, name) of assignments of a literal text to a name that sounds like a secret."""
    found = []
    for node in ast.walk(ast.parse(source)):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if targets and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and node.value.value:
            found += [(node.lineno, t.id) for t in targets if isinstance(t, ast.Name) and _SECRET.search(t.id)]
    return sorted(found)


def personal_fields(fields: list[str], masked: frozenset[str] = frozenset()) -> list[str]:
    """Fields that sound like personal data and aren't known to be masked."""
    return sorted(f for f in fields if _PERSONAL.search(f) and f not in masked)


def without_companion(folder: str | Path, kind: str = ".sql", companion: str = ".md") -> list[str]:
    """Files of a kind that no companion of the same name stands beside."""
    return sorted(p.name for p in Path(folder).rglob(f"*{kind}") if not p.with_suffix(companion).exists())


def scan(folder: str | Path) -> dict[str, list[tuple[str, int, str]]]:
    """All findings in a folder's Python files, by rule: (file, line, what)."""
    out: dict[str, list[tuple[str, int, str]]] = {"swallowed": [], "secrets": []}
    for p in sorted(Path(folder).rglob("*.py")):
        source = p.read_text()
        out["swallowed"] += [(str(p.relative_to(folder)), *x) for x in swallowed(source)]
        out["secrets"] += [(str(p.relative_to(folder)), *x) for x in secrets(source)]
    return out
