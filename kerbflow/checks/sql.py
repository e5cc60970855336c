"""Helper that assembles oracle SQL from named common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    if name in CTES:
        raise ValueError(f"duplicate {name}")
    CTES[name] = body.strip()


def build(select: str) -> str:
    """Prefix ``select`` with exactly the expressions it refers to, directly or through others."""
    needed: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in CTES:
            if name != own and name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select.strip()
    order = [n for n in CTES if n in needed]
    recursive = "RECURSIVE " if any("RECURSIVE" in CTES[n] for n in order) else ""
    body = ",\n".join(f"{n} AS ({CTES[n].replace('/*RECURSIVE*/', '')})" for n in order)
    return f"WITH {recursive}{body}\n{select.strip()}"
