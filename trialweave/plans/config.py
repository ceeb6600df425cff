"""Driver-side configuration: recipes that inherit, metric names to providers, suites with held-out splits."""

from __future__ import annotations

from collections.abc import Callable, Mapping


def overlay(base: Mapping, over: Mapping, replaced: tuple[str, ...] = ()) -> dict:
    """Maps merge key by key, lists and scalars replace; a section in ``replaced`` whose ``kind`` changes is replaced whole."""
    out = dict(base)
    for k, v in over.items():
        old = out.get(k)
        if isinstance(old, Mapping) and isinstance(v, Mapping) and not (k in replaced and v.get("kind", old.get("kind")) != old.get("kind")):
            out[k] = overlay(old, v, replaced)
        else:
            out[k] = v
    return out


def inherit(name: str, load: Callable[[str], Mapping], parent: str = "extends", replaced: tuple[str, ...] = ()) -> dict:
    """A recipe over all it extends; a circle is an error."""
    chain: list[Mapping] = []
    seen: list[str] = []
    at: str | None = name
    while at is not None:
        if at in seen:
            raise ValueError(f"recipes extend each other: {' -> '.join([*seen, at])}")
        seen.append(at)
        chain.append(load(at))
        at = chain[-1].get(parent)
    out: dict = {}
    for part in reversed(chain):
        out = overlay(out, {k: v for k, v in part.items() if k != parent}, replaced)
    return out


def providers(wanted: list[str], offers: Mapping[str, tuple[str, ...]]) -> dict[str, str]:
    """Which profile provides each metric (name, or profile.name); unknown, ambiguous and repeated names are errors."""
    out: dict[str, str] = {}
    for w in wanted:
        profile, dot, name = w.rpartition(".")
        found = [p for p, names in offers.items() if (not dot or p == profile) and name in names]
        if len(found) != 1 or w in out:
            raise ValueError(f"{w}: " + ("asked for twice" if w in out else "no profile has it" if not found else f"more than one profile has it: {found}"))
        out[w] = found[0]
    return out


def select_items(items: Mapping[str, str], split: str, chosen: list[str] | None, held_out: frozenset[str] = frozenset(), purpose: str = "eval") -> list[str]:
    """The items of a split, or the chosen ones if all are inside it; held-out splits serve evaluation alone."""
    if split in held_out and purpose != "eval":
        raise ValueError(f"the split {split} is held out")
    inside = sorted(i for i, s in items.items() if s == split)
    if chosen is None:
        return inside
    bad = sorted(set(chosen) - set(inside)) + sorted({c for c in chosen if chosen.count(c) > 1})
    if bad:
        raise ValueError(f"not in the split {split}, or repeated: {bad}")
    return list(chosen)


def render(template: str, values: Mapping[str, str]) -> str:
    """Replace {NAME} in one pass, so that what is filled in is not read again; an unknown name is an error."""
    import re

    return re.sub(r"\{([A-Za-z_]+)\}", lambda m: values[m[1]], template)


def tolerance_problem(metric: str, threshold: float) -> str | None:
    """Why a threshold does not fit its metric, or None."""
    if metric not in ("pcc", "max_abs", "ulp"):
        return f"unknown metric {metric}"
    if isinstance(threshold, bool) or not isinstance(threshold, int | float) or threshold != threshold or abs(threshold) == float("inf"):
        return "the threshold is not a finite number"
    if metric == "pcc" and not -1 <= threshold <= 1:
        return "a correlation lies in [-1, 1]"
    if metric != "pcc" and threshold < 0:
        return "a difference is not negative"
    if metric == "ulp" and threshold != int(threshold):
        return "ulp counts are whole numbers"
    return None
