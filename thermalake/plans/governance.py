"""Settings, identities of results, the reviewed-scene gate and the evidence registry."""

from __future__ import annotations

import ast
import hashlib
import json
import pathlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.sources.tables import finite_numbers


def load_settings(path: str | pathlib.Path, _seen: tuple = ()) -> dict:
    """A YAML document over the one that it `extends`; a child's top-level keys replace the base's, cycles raise."""
    import yaml

    path = pathlib.Path(path).resolve()
    if path in _seen:
        raise ValueError(f"settings extend each other: {path.name}")
    own = yaml.safe_load(path.read_text()) or {}
    base = own.pop("extends", None)
    return (load_settings(path.parent / base, (*_seen, path)) | own) if base else own


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def identity(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def code_identity(source: str, names: Iterable[str]) -> str:
    """Hash of the named top-level definitions and of all that they use of the same source, constants too.

    Edits elsewhere leave it as it is; a missing name raises.
    """
    found: dict[str, list[ast.AST]] = {}
    for node in ast.parse(source).body:
        targets = [node] if hasattr(node, "name") else getattr(node, "targets", [getattr(node, "target", None)])
        for target in targets:
            for part in ast.walk(target) if isinstance(target, ast.expr) else [target]:
                name = getattr(part, "name", None) or getattr(part, "id", None)
                if name:
                    found.setdefault(name, []).append(node)
    open_, held = list(names), {}
    if missing := [n for n in open_ if n not in found]:
        raise KeyError(", ".join(sorted(missing)))
    while open_:
        name = open_.pop()
        if name in held or name not in found:
            continue
        held[name] = [ast.dump(n) for n in found[name]]
        open_ += [part.id for n in found[name] for part in ast.walk(n) if isinstance(part, ast.Name)]
    return identity(held)


def table_identity(df: DataFrame) -> dict:
    """Schema, row count and an order-free hash of a table, from one aggregation."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return {"schema": df.schema.simpleString(), "rows": row.n, "hash": str(row.h or 0)}


def status(recorded: dict | None, current: dict) -> tuple[str, list[str]]:
    """'missing', 'stale' with what differs, or 'current'."""
    if recorded is None:
        return "missing", []
    wrong = sorted(k for k in recorded.keys() | current.keys() if recorded.get(k) != current.get(k))
    return ("stale", wrong) if wrong else ("current", [])


def selected_components(taxonomy: dict, diagnostics_hash: str, evaluated: Iterable[int]) -> int:
    """The reviewed number of scenes; raises unless it is set, dated, of these diagnostics, and was evaluated."""
    choice = taxonomy.get("selection") or {}
    k = choice.get("n_components")
    if not isinstance(k, int):
        raise ValueError("no number of scenes is selected")
    for name in ("reviewer", "date", "reason"):
        if not choice.get(name):
            raise ValueError(f"the selection lacks its {name}")
    if choice.get("diagnostics_sha256") != diagnostics_hash:
        raise ValueError("the selection is of other diagnostics")
    if k not in set(evaluated):
        raise ValueError(f"{k} scenes were not evaluated")
    return k


def resolve_components(selected: int, low: int, high: int) -> list[int]:
    """The selected number of scenes and its two neighbours, as far as they were in the range of the sweep."""
    if not low <= selected <= high:
        raise ValueError(f"{selected} is not between {low} and {high}")
    return sorted({selected - 1, selected, selected + 1} & set(range(low, high + 1)))


def check_days(training: Iterable[int], validation: Iterable[int], configured: Iterable[int]) -> None:
    """Raises unless training and validation days divide the configured days, without one in both or repeated."""
    training, validation, configured = list(training), list(validation), list(configured)
    if len({*training}) < len(training) or len({*validation}) < len(validation):
        raise ValueError("a day is repeated")
    if shared := {*training} & {*validation}:
        raise ValueError(f"days {sorted(shared)} are in both parts")
    if wrong := {*training, *validation} ^ {*configured}:
        raise ValueError(f"days {sorted(wrong)} are not in the parts and the configuration alike")


def check_settings(settings: dict, rules: dict[str, tuple[type | tuple[type, ...], float | None, float | None]]) -> None:
    """Raises with all that is wrong: keys of the rules that are missing, of another type, or out of their bounds."""
    wrong = []
    for name, (kind, low, high) in rules.items():
        value = settings.get(name)
        if value is None:
            wrong.append(f"{name} is missing")
        elif not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            wrong.append(f"{name} is not of the right type")
        elif isinstance(value, int | float) and ((low is not None and value < low) or (high is not None and value > high)):
            wrong.append(f"{name} is out of its bounds")
    if wrong:
        raise ValueError("; ".join(wrong))


def profile_differences(recorded: dict, current: dict, ignored: Iterable[str] = ()) -> list[str]:
    """Dotted names of settings that only one profile has or that differ, without those that don't bear on results."""
    out, ignored = [], set(ignored)

    def walk(a, b, name: str) -> None:
        if name in ignored:
            return
        if isinstance(a, dict) and isinstance(b, dict):
            for k in sorted(a.keys() | b.keys()):
                walk(a.get(k), b.get(k), f"{name}.{k}" if name else k)
        elif a != b:
            out.append(name)

    walk(recorded, current, "")
    return out


def stage_identity(stage: str, settings: dict, source: str, names: Iterable[str], inputs: Iterable[str] = ()) -> str:
    """What a stage's output depends on: its own settings and code, and the identities of the stages before it, not those after."""
    return identity({"stage": stage, "settings": settings, "code": code_identity(source, names), "inputs": sorted(inputs)})


def reuse_or_run(recorded: dict | None, current: dict, run: Callable[[], dict]) -> tuple[dict, bool]:
    """The recorded result if it is of the current identity, else a new one, and whether it was reused."""
    if recorded is not None and status(recorded.get("identity"), current)[0] == "current":
        return recorded, True
    return {**run(), "identity": current}, False


#: How fresh evidence is, from worst to best.
FRESHNESS = ("stale", "unverified", "current")


def freshness(parts: Iterable[str]) -> str:
    """The worst of the parts; nothing is unverified."""
    return min(parts, key=FRESHNESS.index, default="unverified")


def registry(spark: SparkSession, terms: list[dict]) -> DataFrame:
    """Evidence terms as a table: name, requirement, bias, sd, rmse and the freshness of their sources."""
    number = lambda x: None if x is None else float(x)
    rows = [(t["name"], t.get("requirement"), *(number(t.get(k)) for k in ("bias", "sd", "rmse")), freshness(t.get("sources", []))) for t in terms]
    return finite_numbers(spark.createDataFrame(rows, "name string, requirement string, bias double, sd double, rmse double, freshness string"))


def term_conflicts(terms: list[dict]) -> list[str]:
    """Names of terms of one requirement and component that state different values; sensitivities are left out, since they are never added."""
    held: dict[tuple, set] = {}
    for t in terms:
        if t.get("kind") != "sensitivity":
            held.setdefault((t.get("requirement"), t["name"]), set()).add((t.get("bias"), t.get("sd"), t.get("rmse")))
    return sorted(name for (_, name), values in held.items() if len(values) > 1)


def requirement(requirements: list[dict], number: str) -> dict:
    """The requirement of an id; raises if it is missing, or stated twice in different ways."""
    held = [r for r in requirements if r.get("id") == number]
    if not held:
        raise KeyError(number)
    if any(r != held[0] for r in held):
        raise ValueError(f"{number} is stated in different ways")
    return held[0]


def gap_report(terms: DataFrame) -> str:
    """Markdown of terms without evidence or with stale evidence, by name."""
    gaps = terms.filter("freshness <> 'current' OR rmse IS NULL").orderBy("name").collect()
    lines = [f"| {g['name']} | {g['requirement'] or '-'} | {'no value' if g['rmse'] is None else format(g['rmse'], '+.3f')} | {g['freshness']} |" for g in gaps]
    return "\n".join(["| term | requirement | rmse | evidence |", "|-|-|-|-|", *lines])
