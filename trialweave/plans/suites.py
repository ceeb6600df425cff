"""Suite manifests: strict YAML to items, languages and files. All problems of a manifest are named, not the first alone."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from math import prod
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from trialweave.plans.config import tolerance_problem

# Splits, name formats, the cap on an input's elements, where tracked files live.
SPLITS = ("train", "eval", "unassigned")
ITEM_NAME, COMMIT, SHA256, OUTPUT = r"[A-Za-z0-9][A-Za-z0-9._+-]*", r"[0-9a-f]{40}", r"[0-9a-f]{64}", r"[A-Za-z0-9_][A-Za-z0-9_.-]{0,246}"
MOST_ELEMENTS, TRACKED, PLACEHOLDER = 1 << 20, "assets/", "PLACEHOLDER"
HELD_OUT = ("inputs", "outputs", "seed")
INPUTS, SUFFIX = "@inputs", ".lassiio"

Problems = Iterator[tuple[str, str]]
Rule = tuple[Callable[[Any], bool], str]


def _matches(pattern: str) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, str) and re.fullmatch(pattern, x) is not None


def is_relative(x: Any) -> bool:
    return isinstance(x, str) and x != "" and not x.startswith("/") and "\\" not in x and not {"", ".", ".."} & set(x.split("/"))


def _filled(kind: type, of: Callable[[Any], bool] = lambda _: True, distinct: bool = False) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, kind) and len(x) > 0 and all(map(of, x)) and (not distinct or len(set(x)) == len(x))


def _keys(at: str, x: Any, need: Mapping[str, Rule], may: Mapping[str, Rule]) -> Problems:
    """What is wrong with a mapping's keys and values."""
    if not isinstance(x, Mapping):
        yield at, "is no mapping"
        return
    yield from ((f"{at}.{k}", "is missing") for k in need if k not in x)
    yield from ((f"{at}.{k}", "is no key here") for k in x if k not in need and k not in may)
    for k, (ok, message) in {**need, **may}.items():
        if k in x and not ok(x[k]):
            yield f"{at}.{k}", message


_TEXTS: Rule = (lambda x: isinstance(x, list) and all(isinstance(a, str) for a in x), "is no list of strings")
_MAP: Rule = (_filled(dict), "is no mapping with entries")
_ANY: Rule = (lambda _: True, "")
_PATH: Rule = (is_relative, "is no relative path")
_HASH: Rule = (_matches(SHA256), "is no sha256")
SUITE = {"suite": _ANY, "repo": (_matches(r"https://.*"), "is no https address"), "commit": (_matches(COMMIT), "is no full commit id"), "items": _MAP}
ITEM = {"split": (lambda x: x in SPLITS, f"is none of {', '.join(SPLITS)}"), "languages": _MAP}
ITEM_MAY = {
    "run_args": _TEXTS, "passfail": (lambda x: isinstance(x, list) and all(isinstance(a, str) for a in x) and len(set(x)) == len(x), "is no list of distinct languages"), "support": (lambda x: isinstance(x, dict) and all(is_relative(v) for kv in x.items() for v in kv), "does not map relative paths"),
    "tolerance": _ANY, "inputs": (_filled(list), "is no list of inputs"), "outputs": (_filled(list, _matches(OUTPUT), True), "is no list of distinct names"),
    "seed": (lambda x: isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 64, "is no unsigned 64-bit number"), "unpack_to_dest": (_matches(r"(?s).*\S.*"), "is an empty note"),
}
LANGUAGE = {"dir": _PATH, "files": (_filled(list, is_relative), "is no list of relative paths")}
LANGUAGE_MAY = {"sha256": _ANY, "tracked": (lambda x: isinstance(x, bool), "is neither true nor false"), "support": _ANY}
INPUT = {"name": (_matches(OUTPUT), "is no name"), "dtype": _ANY, "shape": (_filled(list, lambda n: isinstance(n, int) and n > 0), "is no shape")}
SUPPORT = ({"tracked": (lambda x: is_relative(x) and x.startswith(TRACKED), f"is no path under {TRACKED}")}, {"upstream": _PATH, "sha256": _HASH})


def problems(data: Any, name: str, pin: Mapping[str, str] | None = None) -> Problems:
    """(key, what is wrong) of a suite's manifest; ``pin`` is what the toolchain pin that it names says (COMMIT, URL)."""
    yield from _placeholders("", data)
    yield from _keys("suite", data, SUITE, {"pin": _ANY})
    if not isinstance(data, Mapping):
        return
    if data.get("suite") != name:
        yield "suite.suite", f"is not the file's name, {name}"
    if "pin" in data and pin is not None and (pin.get("COMMIT"), pin.get("URL")) != (data.get("commit"), data.get("repo")):
        yield "suite.pin", "is a pin of another commit or address"
    for item, spec in (data["items"].items() if isinstance(data.get("items"), dict) else ()):
        if not _matches(ITEM_NAME)(item):
            yield f"items.{item}", "is no item name"
        yield from _item(f"items.{item}", spec)


def _placeholders(at: str, x: Any) -> Problems:
    if isinstance(x, str) and x.startswith(PLACEHOLDER):
        yield at or "suite", "is not filled in"
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from _placeholders(f"{at}.{k}".lstrip("."), v)


def _item(at: str, spec: Any) -> Problems:
    yield from _keys(at, spec, ITEM, ITEM_MAY)
    if not isinstance(spec, Mapping) or not isinstance(spec.get("languages"), dict):
        return
    languages = spec["languages"]
    for lang, x in languages.items():
        yield from _language(f"{at}.languages.{lang}", x)
    yield from ((f"{at}.passfail", f"{p} is no language of the item") for p in spec.get("passfail") or [] if p not in languages)
    whole = [x for x in languages.values() if isinstance(x, Mapping)]
    taken = {f for x in whole for part in ("files", "support") if isinstance(x.get(part), (list, dict)) for f in x[part]}
    yield from ((f"{at}.support", f"{f} is a file of a language") for f in sorted(set(spec.get("support") or {}) & taken))
    there = [k for k in HELD_OUT if k in spec]
    if there and len(there) < len(HELD_OUT):
        yield at, f"{' and '.join(HELD_OUT)} go together"
    if there and "run_args" in spec:
        yield f"{at}.run_args", "an item with inputs takes its arguments from them"
    for i, x in enumerate(spec.get("inputs") or []):
        yield from _keys(f"{at}.inputs.{i}", x, INPUT, {k: _ANY for k in x if k not in INPUT} if isinstance(x, Mapping) else {})
        if isinstance(x, Mapping) and INPUT["shape"][0](x.get("shape")) and prod(x["shape"]) > MOST_ELEMENTS:
            yield f"{at}.inputs.{i}.shape", f"holds more than {MOST_ELEMENTS} elements"
    if "tolerance" in spec:
        t = spec["tolerance"]
        bad = list(_keys(f"{at}.tolerance", t, {"metric": _ANY, "threshold": _ANY}, {}))
        why = None if bad else tolerance_problem(t["metric"], t["threshold"])
        yield from bad or ([(f"{at}.tolerance", why)] if why else [])


def _language(at: str, x: Any) -> Problems:
    yield from _keys(at, x, LANGUAGE, LANGUAGE_MAY)
    if not isinstance(x, Mapping):
        return
    files, tracked, hashes = x.get("files"), x.get("tracked") is True, x.get("sha256")
    if tracked and not str(x.get("dir")).startswith(TRACKED):
        yield f"{at}.dir", f"a tracked language lives under {TRACKED}"
    if tracked and hashes is not None:
        yield f"{at}.sha256", "tracked files are held by the repository"
    elif hashes is not None and not (isinstance(hashes, dict) and isinstance(files, list) and set(hashes) == set(files) and all(map(_HASH[0], hashes.values()))):
        yield f"{at}.sha256", "does not give each file its sha256"
    for name, entry in (x.get("support") or {}).items() if isinstance(x.get("support") or {}, dict) else ():
        if not is_relative(name) or (isinstance(files, list) and name in files):
            yield f"{at}.support.{name}", "is no relative path beside the language's own files"
        fits = next((rules for rules in SUPPORT if isinstance(entry, dict) and set(entry) == set(rules)), None)
        yield from _keys(f"{at}.support.{name}", entry, fits, {}) if fits else [(f"{at}.support.{name}", "is neither tracked nor upstream with its sha256")]


@dataclass(frozen=True)
class Suite:
    name: str
    repo: str
    commit: str
    items: Mapping[str, Mapping]

    def splits(self) -> dict[str, str]:
        return {i: x["split"] for i, x in self.items.items()}


def load_suite(path: str | Path, pin: Mapping[str, str] | None = None) -> Suite:
    """The suite of a manifest; an error that names every problem where there are any."""
    path = Path(path)
    data = yaml.safe_load(path.read_text("utf-8"))
    bad = list(problems(data, path.stem, pin))
    if bad:
        raise ValueError(f"{path}: " + "; ".join(f"{k} {why}" for k, why in bad))
    return Suite(data["suite"], data["repo"], data["commit"], data["items"])


def suite_tables(spark: SparkSession, suites: list[Suite]) -> dict[str, DataFrame]:
    """The dimensions of suites: items (suite, item, split, seed, metric, threshold, outputs) and files (suite, item, language, path, sha256, tracked)."""
    items = [(s.name, i, x["split"], str(x["seed"]) if "seed" in x else None, (x.get("tolerance") or {}).get("metric"), float(x["tolerance"]["threshold"]) if "tolerance" in x else None, list(x.get("outputs", []))) for s in suites for i, x in s.items.items()]
    files = [(s.name, i, lang, f"{y['dir']}/{f}", y.get("sha256", {}).get(f), bool(y.get("tracked", False))) for s in suites for i, x in s.items.items() for lang, y in x["languages"].items() for f in y["files"]]
    return {
        "items": spark.createDataFrame(items, "suite string, item string, split string, seed string, metric string, threshold double, outputs array<string>"),
        "files": spark.createDataFrame(files, "suite string, item string, language string, path string, sha256 string, tracked boolean"),
    }


def program_args(item: Mapping) -> list[str]:
    """The arguments of an item's program: its inputs' files, then its outputs', or its own ``run_args``."""
    if not item.get("inputs"):
        return list(item.get("run_args", []))
    return [f"{INPUTS}/{x['name']}{SUFFIX}" for x in item["inputs"]] + [f"{x}{SUFFIX}" for x in item["outputs"]]
