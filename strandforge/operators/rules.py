"""Cleavage-site rules as column expressions, and the predictor over them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from copy import deepcopy
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandforge.functions.seq import HYDROPATHY, PK_C, PK_C_BY_RESIDUE, PK_N, PK_N_BY_RESIDUE, SIDE_CHARGE, end_charge, running_sums
from strandforge.functions.text import confidence, occurrences

#: Parameters of the default ruleset, as (weight, parameters) by rule.
DEFAULT = {
    "core_start_residue": (0.8, {"scores": {"G": 1.5, "C": 1.3, "A": 1.1, "S": 1.1, "L": 0.6, "Y": 0.6, "W": 0.6, "D": 0.4, "T": 0.4, "F": 0.4, "K": 0.2, "R": 0.2, "E": 0.2}, "penalty_other": -0.1, "hard_forbidden": ["P"], "penalty_forbidden": -2.0}),
    "ring_closure_residue": (4.5, {"allowed_positions": [6, 7, 8, 9, 10], "residues": ["D", "E"], "position_weights": {"6": 0.6, "7": 1.0, "8": 1.1, "9": 1.0, "10": 0.6}, "penalty_if_missing_in_allowed_window": -5.0}),
    "steric_lock_region": (1.0, {"bulky_residues": ["F", "W", "Y", "H", "I", "L", "V", "R", "K"], "relative_to_acceptor": {"start_offset": 4, "end_offset": 12}, "require_at_least": 1}),
    "leader_penultimate_residue": (1.0, {"preferred": {"T": 1.0}, "allowed_rare": {"I": 0.4, "V": 0.4}, "penalty_other": -0.5}),
    "leader_signature_motifs": (1.2, {"patterns": {"Y..P.L": 1.0, "W..P.L": 0.8, "LI.LG.A...T.": 0.8}, "allow_regex": True}),
    "cleavage_motif": (0.8, {"motifs": {"GG": 1.2, "GA": 1.1, "AG": 1.0}}),
    "core_length": (1.0, {"min": 10, "max": 40, "optimal_min": 14, "optimal_max": 26, "score_optimal": 1.0, "score_acceptable": 0.5, "penalty_outside": -1.0}),
    "hydrophobicity_transition": (0.5, {"min_difference": 0.3, "window_size": 10}),
    "charge_transition": (0.4, {"leader_more_charged": True, "min_difference": 0.1}),
}
#: What the presets change.
PRESETS = {
    "default": {},
    "strict": {
        "core_start_residue": (1.5, {"scores": {"G": 1.5}}),
        "ring_closure_residue": (4.5, {"allowed_positions": [7, 8, 9], "position_weights": {"7": 1.0, "8": 1.1, "9": 1.0}}),
        "core_length": (1.2, {"min": 13, "max": 30, "optimal_min": 16, "optimal_max": 23}),
    },
    "permissive": {
        "core_start_residue": (1.2, {"scores": {"G": 1.5, "A": 1.1, "S": 1.1, "C": 1.3}}),
        "ring_closure_residue": (4.0, {}),
        "core_length": (1.0, {"min": 10, "max": 35, "optimal_min": 14, "optimal_max": 25}),
    },
    "discovery": {
        "core_start_residue": (1.0, {"scores": {"G": 1.5, "A": 1.1, "S": 1.1, "C": 1.3}}),
        "ring_closure_residue": (3.0, {"penalty_if_missing_in_allowed_window": -4.0}),
        "cleavage_motif": (0.8, {"motifs": {"GG": 1.2, "GA": 1.1, "AG": 1.0, "TG": 0.8}}),
        "core_length": (0.8, {"min": 8, "max": 40, "optimal_min": 12, "optimal_max": 28}),
    },
}
#: Rules that a ruleset may declare and that score nothing.
UNSCORED = ("alignment_conservation", "position_2_constraint", "ptm_context_hints")
Rule = dict


def ruleset(preset: str = "default") -> dict[str, Rule]:
    """name -> {enabled, weight, parameters}."""
    out = {k: {"enabled": True, "weight": w, "parameters": deepcopy(p)} for k, (w, p) in DEFAULT.items()}
    for k, (w, p) in PRESETS[preset].items():
        out[k]["weight"] = w
        out[k]["parameters"].update(deepcopy(p))
    return out


def update_rule(rules: dict[str, Rule], name: str, enabled: bool | None = None, weight: float | None = None, parameters: dict | None = None) -> dict[str, Rule]:
    """A copy with one rule changed; parameters are merged, an unknown rule is an error."""
    out = deepcopy(rules)
    if name not in out:
        raise KeyError(name)
    if enabled is not None:
        out[name]["enabled"] = enabled
    if weight is not None:
        out[name]["weight"] = weight
    out[name]["parameters"].update(parameters or {})
    return out


def load_rules(path: str | None, fallback: dict[str, Rule] | None = None, spark: SparkSession | None = None) -> dict[str, Rule]:
    """Rules from JSON ({"rules": {name: ...}}); a missing or invalid file gives the fallback, by default the default ruleset.

    With a session the path may be any that Spark reads, a file or a folder with one.
    """
    try:
        text = Path(path).read_text() if spark is None else spark.read.text(path, wholetext=True).first()[0]
        told = json.loads(text)["rules"]
        return {k: {"enabled": bool(v.get("enabled", True)), "weight": float(v["weight"]), "parameters": dict(v["parameters"])} for k, v in told.items()}
    except (OSError, ValueError, KeyError, TypeError, AttributeError, AnalysisException):
        return ruleset() if fallback is None else fallback


def save_rules(rules: dict[str, Rule], path: str, spark: SparkSession | None = None) -> None:
    """Rules as JSON: a local file, or with a session a folder anywhere that Spark writes."""
    text = json.dumps({"version": 1, "rules": rules}, indent=2)
    if spark is None:
        Path(path).write_text(text)
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Few bytes with much work in each row: in as many tasks as the session shuffles to, where small partitions would be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _by_letter(table: dict[str, float], letter: Column) -> Column:
    """The letter's value, else null; a constant map, so the plan's code doesn't grow with the table."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(v)))), letter) if table else F.lit(None).cast("double")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def acceptor(core: Column, params: dict) -> tuple[Column, Column]:
    """(weight, 0-based place) of the best ring-closing residue; of equal weights the first listed place.

    The lambda also keeps the rules' projection out of whole-stage code, where all rules would be one method too long for the JIT.
    """
    tries = F.array(*(F.struct(F.lit(float(params.get("position_weights", {}).get(str(p), 1.0))).alias("w"), F.lit(-i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(params["allowed_positions"])))
    best = F.array_max(F.filter(tries, lambda t: F.substr(core, t["p"], F.lit(1)).isin(*params["residues"])))
    return best["w"], best["p"] - 1


def _counted(rules: dict[str, Rule]) -> dict[str, dict[str, float]]:
    """Letter weights by name, of whose sums the rules need those of stretches of a protein."""
    on = {k: r["parameters"] for k, r in rules.items() if r["enabled"]}
    out: dict[str, dict[str, float]] = {}
    if "hydrophobicity_transition" in on:
        out["hydropathy"] = {k: round(10 * v) for k, v in HYDROPATHY.items()}  # whole tenths: their sums are exact
    if "charge_transition" in on:
        out["charge"] = SIDE_CHARGE
    if "glycine_rich_core" in on:
        out["glycine"] = {"G": 1}
    if "tail_lock_residue" in on:
        out["tail"] = {k: 1 for x in on["tail_lock_residue"]["residues"] for k in x}
    if "steric_lock_region" in on and "ring_closure_residue" in on:
        out["bulky"] = {k: 1 for x in on["steric_lock_region"]["bulky_residues"] for k in x}
    return out


def with_sums(proteins: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Adds _sums: running sums along each protein, made once; what a rule asks of a stretch is then a difference of two of them."""
    return proteins.withColumn("_sums", F.struct(F.lit(None).cast("int").alias("_"), *(running_sums(F.col("sequence"), w).alias(k) for k, w in _counted(rules).items())))


def rule_scores(leader: Column, core: Column, inverted: bool, rules: dict[str, Rule]) -> dict[str, Column]:
    """Each rule's contribution, null where its condition doesn't hold; of a row with sequence, position and ``_sums``."""
    out: dict[str, Column] = {}
    has_core, has_leader = F.length(core) > 0, F.length(leader) > 0
    zero, at, n = F.lit(0), F.col("position"), F.length("sequence")
    (leader_at, leader_end), (core_at, core_end) = ((at, n), (zero, at)) if inverted else ((zero, at), (at, n))
    total = lambda name, a, b: F.get(F.col(f"_sums.{name}"), b) - F.get(F.col(f"_sums.{name}"), a)
    mean = lambda a, b: F.when(b > a, total("hydropathy", a, b) / (10 * (b - a))).otherwise(F.lit(0.0))
    on = {k: (float(r["weight"]), r["parameters"]) for k, r in rules.items() if r["enabled"]}
    if "core_start_residue" in on:
        w, p = on["core_start_residue"]
        first = F.substring(core, 1, 1)
        score = F.when(first.isin(*p.get("hard_forbidden", [])), F.lit(float(p.get("penalty_forbidden", -2.0)))).otherwise(F.coalesce(_by_letter(p["scores"], first), F.lit(float(p.get("penalty_other", -0.5)))))
        out["core_start"] = F.when(has_core, w * score)
    if "ring_closure_residue" in on:
        w, p = on["ring_closure_residue"]
        if p["allowed_positions"] and p["residues"]:
            out["ring_closure"] = w * F.coalesce(acceptor(core, p)[0], F.lit(float(p.get("penalty_if_missing_in_allowed_window", -5.0))))
    if "core_length" in on:
        w, p = on["core_length"]
        n = F.length(core)
        out["core_length"] = w * F.when(n.between(p["optimal_min"], p["optimal_max"]), F.lit(float(p.get("score_optimal", 1.0)))).when(n.between(p["min"], p["max"]), F.lit(float(p.get("score_acceptable", 0.5)))).otherwise(F.lit(float(p.get("penalty_outside", -1.0))))
    if "leader_length" in on:
        w, p = on["leader_length"]
        out["leader_length"] = F.when(F.length(leader).between(p["min"], p["max"]), F.lit(w)).otherwise(F.lit(-w))
    if "cleavage_motif" in on:
        w, p = on["cleavage_motif"]
        pair = F.concat(F.substring(core, -1, 1), F.substring(leader, 1, 1)) if inverted else F.concat(F.substring(leader, -1, 1), F.substring(core, 1, 1))
        out["cleavage_motif"] = F.when(has_core & has_leader, w * _by_letter(p["motifs"], pair) / 2)
    if "leader_motifs" in on and not inverted:
        w, p = on["leader_motifs"]
        end = F.right(leader, F.lit(6))
        out["leader_motif"] = F.when((F.length(leader) >= 3) & _any([F.contains(end, F.lit(m)) for m in p["motifs"]]), F.lit(w))
    if "leader_penultimate_residue" in on and not inverted:
        w, p = on["leader_penultimate_residue"]
        last2 = F.substring(F.right(leader, F.lit(2)), 1, 1)
        score = F.coalesce(_by_letter(p.get("preferred", {}), last2), _by_letter(p.get("allowed_rare", {}), last2), F.lit(float(p.get("penalty_other", -0.5))))
        out["leader_penultimate"] = F.when(F.length(leader) >= 2, w * score)
    if "leader_signature_motifs" in on:
        w, p = on["leader_signature_motifs"]
        hit = (lambda m: leader.rlike(m)) if p.get("allow_regex") else (lambda m: F.contains(leader, F.lit(m)))
        out["leader_signature"] = F.when(has_leader, w * F.array_max(F.array(*(F.when(hit(m), F.lit(float(v))) for m, v in p["patterns"].items()))))
    if "glycine_rich_core" in on:
        w, p = on["glycine_rich_core"]
        out["glycine_rich"] = F.when(has_core & (total("glycine", core_at, core_end) / F.length(core) >= p["min_ratio"]), F.lit(w))
    if "hydrophobicity_transition" in on:
        w, p = on["hydrophobicity_transition"]
        size = F.lit(p["window_size"]) if p.get("window_size") else F.least(F.length(leader), F.length(core))
        first = lambda a, b: mean(a, F.least(b, a + size))
        last = lambda a, b: mean(F.greatest(a, b - size), b)
        inner_l, inner_c = (first, last) if inverted else (last, first)
        diff = F.round(inner_c(core_at, core_end) - inner_l(leader_at, leader_end), 9)  # sums of tenths: a threshold of tenths is met exactly
        out["hydrophobicity"] = F.when(has_core & has_leader & (diff >= p["min_difference"]), w * F.least(diff / 2, F.lit(1.5)))
    if "charge_transition" in on:
        w, p = on["charge_transition"]
        charge = lambda x, a, b: total("charge", a, b) + end_charge(F.substring(x, 1, 1), F.substring(x, -1, 1))
        diff = F.round(charge(leader, leader_at, leader_end) - charge(core, core_at, core_end), 9)
        diff = diff if p["leader_more_charged"] else -diff
        out["charge_transition"] = F.when(has_core & has_leader & (diff >= p.get("min_difference", 0.1)), w * F.least(diff * 2, F.lit(1.0)))
    if "tail_lock_residue" in on:
        w, p = on["tail_lock_residue"]
        out["tail_lock"] = F.when((F.length(core) > p["region_start"]) & (total("tail", core_at + p["region_start"], core_end) >= p.get("require_at_least", 1)), F.lit(w))
    if "steric_lock_region" in on and "ring_closure_residue" in on:
        w, p = on["steric_lock_region"]
        place = acceptor(core, on["ring_closure_residue"][1])[1]
        a, b = p["relative_to_acceptor"].get("start_offset", 0), p["relative_to_acceptor"].get("end_offset", 0)
        s, e = F.greatest(F.lit(0), place + a), F.least(F.length(core) - 1, place + b)
        out["steric_lock"] = F.when(place.isNotNull() & (e >= s) & (total("bulky", core_at + s, core_at + e + 1) >= p.get("require_at_least", 1)), F.lit(w))
    if "forbidden_core_patterns" in on:
        w, p = on["forbidden_core_patterns"]
        out["forbidden_pattern"] = F.when(has_core & _any([F.contains(core, F.lit(m)) for m in p["patterns"]]), F.lit(w * float(p.get("penalty_per_match", -1.0))))
    return out


def _scored(sites: DataFrame, rules: dict[str, Rule], inverted: bool) -> DataFrame:
    """Adds score (rounded to 9 decimals: equal sums of tenths are equal, and meet a cutoff that they equal), _parts and orientation."""
    parts = rule_scores(_leader(inverted), _core(inverted), inverted, rules)
    # both orientations have the same fields: those of the leader first, of which an inverted site lacks some
    every = {**dict.fromkeys(rule_scores(_leader(False), _core(False), False, rules), F.lit(None)), **parts}
    made = sites.withColumn("_parts", F.struct(*(v.cast("double").alias(k) for k, v in (every or {"_": F.lit(None)}).items())))
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"_parts.{k}"), F.lit(0.0)) for k in parts), F.lit(0.0))
    return made.withColumn("score", F.round(total, 9)).withColumn("orientation", F.lit("core_leader" if inverted else "leader_core"))


def _leader(inverted: bool) -> Column:
    return F.substr("sequence", F.col("position") + 1) if inverted else F.left("sequence", F.col("position"))


def _core(inverted: bool) -> Column:
    return F.left("sequence", F.col("position")) if inverted else F.substr("sequence", F.col("position") + 1)


def _told(scored: DataFrame) -> DataFrame:
    """Adds leader, core and score_breakdown by position, orientation and _parts."""
    parts = scored.schema["_parts"].dataType.names
    shown = F.map_filter(F.create_map(*(x for k in parts for x in (F.lit(k), F.col(f"_parts.{k}")))), lambda _, v: v.isNotNull())
    turned = F.col("orientation") == "core_leader"
    sides = {"leader": F.when(turned, _leader(True)).otherwise(_leader(False)), "core": F.when(turned, _core(True)).otherwise(_core(False))}
    return scored.withColumns({**sides, "score_breakdown": shown}).drop("_parts")


def score_sites(sites: DataFrame, rules: dict[str, Rule], inverted: bool = False) -> DataFrame:
    """Adds score and score_breakdown to rows of sequence and position, and leader and core."""
    return _told(_scored(with_sums(sites, rules), rules, inverted).drop("_sums"))


def reasons(breakdown: Column) -> Column:
    """name:+0.00 of the contributions that aren't zero, the largest first; equal ones keep the rules' order."""
    cells = F.filter(F.map_entries(breakdown), lambda e: e["value"] != 0)
    placed = F.transform(cells, lambda e, i: F.struct((-F.abs(e["value"])).alias("k"), i.alias("i"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(placed), lambda e: F.format_string("%s:%+.2f", e["key"], e["value"]))


def _sites(proteins: DataFrame, rules: dict[str, Rule], min_leader: int, min_core: int | None, allow_inverted: bool, key: str | None = None) -> DataFrame:
    """Every allowed position with its score and _parts alone: what stands in the strings is cut out where it is shown.

    With a ``key`` proteins are dealt by it, once, so their sites are ranked in the task that makes them.
    """
    if min_core is None:
        r = rules.get("core_length")
        min_core = int(r["parameters"]["min"]) if r and r["enabled"] else 10
    clean = proteins.withColumn("sequence", F.upper(F.trim("sequence")))
    clean = with_sums(clean if key is None else dealt(clean, key), rules)
    out = None
    for inverted in (False, True) if allow_inverted else (False,):
        a, b = (min_core, min_leader) if inverted else (min_leader, min_core)
        last = F.length("sequence") - b
        places = F.when(last >= a, F.sequence(F.lit(a), last)).otherwise(F.array().cast("array<int>"))
        part = _scored(clean.withColumn("position", F.explode(places)), rules, inverted).drop("_sums")
        out = part if out is None else out.unionByName(part)
    return out


def cleavage_sites(proteins: DataFrame, rules: dict[str, Rule], min_leader: int = 10, min_core: int | None = None, allow_inverted: bool = False) -> DataFrame:
    """Every allowed position of every protein, scored.  ``proteins`` has ``sequence``; its other columns are carried."""
    return _told(_sites(proteins, rules, min_leader, min_core, allow_inverted))


def predict(proteins: DataFrame, key: str, rules: dict[str, Rule] | None = None, top_n: int = 3, min_leader: int = 10, min_core: int | None = None, allow_inverted: bool = False) -> DataFrame:
    """The best cleavage sites by protein: score, then leader first, then the lower position.  Adds rank, confidence, reasons."""
    sites = _sites(proteins, rules or ruleset(), min_leader, min_core, allow_inverted, key)
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("orientation"), "position")
    top = _told(sites.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n))
    return top.withColumn("confidence", confidence(F.col("score"))).withColumn("reasons", reasons(F.col("score_breakdown")))


def predicted_and_known(proteins: DataFrame, rules: dict[str, Rule], allow_inverted: bool = False) -> DataFrame:
    """Each protein's best site and those whose core, with I and L alike, is one of its ``cores``, with their rank among all its sites.

    ``proteins``: distinct sequences with ``cores``; all other sites are ranked and go before anything is told of them.
    """
    order = Window.partitionBy("sequence").orderBy(F.desc("score"), F.desc("orientation"), "position")
    ranked = _sites(proteins, rules, 10, None, allow_inverted, "sequence").withColumn("rank", F.row_number().over(order))
    core = F.when(F.col("orientation") == "core_leader", _core(True)).otherwise(_core(False))
    return _told(ranked.filter((F.col("rank") == 1) | F.array_contains("cores", F.translate(core, "I", "L"))).drop("cores"))


#: Rules that ``_array_scorer`` knows.
_IN_ARRAYS = ("core_start_residue", "ring_closure_residue", "core_length", "cleavage_motif", "leader_penultimate_residue", "leader_signature_motifs", "hydrophobicity_transition", "charge_transition", "steric_lock_region")


def _rounded(x: np.ndarray) -> np.ndarray:
    """To 9 decimals as Spark rounds: halves of the shortest decimal go up."""
    y = x * 1e9
    out = np.rint(y) / 1e9
    for k in np.flatnonzero(np.abs(np.abs(y) % 1 - 0.5) < 1e-4):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _array_scorer(rules: dict[str, Rule]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None:
    """What gives (best score of all sites, number of sites) of each of some sequences, leader first; None where a rule needs more than arrays.

    The scores are those of ``rule_scores``, added in its order.  Most time goes into sites, of which only the best counts here, so all
    sites of many sequences are scored at once and none becomes a row.
    """
    on = {k: (float(r["weight"]), r["parameters"]) for k, r in rules.items() if r["enabled"] and k not in UNSCORED}
    given = {k: p for k, (_, p) in on.items()}
    least = int(given["core_length"]["min"]) if "core_length" in on else 10
    ring, patterns = given.get("ring_closure_residue"), given.get("leader_signature_motifs", {}).get("patterns")
    one = [x for k, name in (("core_start_residue", "scores"), ("core_start_residue", "hard_forbidden"), ("leader_penultimate_residue", "preferred"), ("leader_penultimate_residue", "allowed_rare"), ("ring_closure_residue", "residues"), ("steric_lock_region", "bulky_residues")) for x in given.get(k, {}).get(name, [])]
    sound = not set(on) - set(_IN_ARRAYS) and least >= 1 and all(len(x) == 1 and x < "\x7f" for x in one) and all(len(x) == 2 and x.isascii() for x in given.get("cleavage_motif", {}).get("motifs", []))
    sound = sound and (ring is None or bool(ring["residues"]) and bool(ring["allowed_positions"]) and min(ring["allowed_positions"]) >= 1)
    if not sound or (patterns is not None and not (patterns and all(re.fullmatch("[A-Za-z.]+", x) for x in patterns))):
        return None

    def table(values: dict[str, float], other: float) -> np.ndarray:
        out = np.full(128, float(other))
        for k, v in values.items():
            out[ord(k)] = float(v)
        return out

    ends_n = np.array([1 / (10 ** (ph - PK_N_BY_RESIDUE.get(chr(k), PK_N)) + 1) for ph in (7.0,) for k in range(128)])
    ends_c = np.array([-1 / (10 ** (PK_C_BY_RESIDUE.get(chr(k), PK_C) - 7.0) + 1) for k in range(128)])

    def scores(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in texts], int)
        letters = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), 127).astype(np.int64)
        begin = np.cumsum(size) - size
        count = np.maximum(0, size - least - 9)
        of = np.repeat(np.arange(len(texts)), count)
        position = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + 10
        first, end = begin[of], (begin + size)[of]
        at, n = first + position, size[of] - position
        running = lambda t: np.r_[0, np.cumsum(t[letters])]
        total = np.zeros(len(of))
        if "core_start_residue" in on:
            w, p = on["core_start_residue"]
            t = table(p["scores"], p.get("penalty_other", -0.5))
            t[[ord(x) for x in p.get("hard_forbidden", [])]] = float(p.get("penalty_forbidden", -2.0))
            total = total + w * t[letters[at]]
        best, place = np.full(len(of), -np.inf), np.zeros(len(of), int)
        if ring is not None:
            closes = table(dict.fromkeys(ring["residues"], 1), 0) > 0
            for q in ring["allowed_positions"]:
                v = float(ring.get("position_weights", {}).get(str(q), 1.0))
                better = (q <= n) & closes[letters[np.minimum(at + q - 1, end - 1)]] & (v > best)
                best[better], place[better] = v, q - 1
            w = on["ring_closure_residue"][0]
            total = total + w * np.where(np.isfinite(best), best, float(ring.get("penalty_if_missing_in_allowed_window", -5.0)))
        if "core_length" in on:
            w, p = on["core_length"]
            fits = [(n >= p["optimal_min"]) & (n <= p["optimal_max"]), (n >= p["min"]) & (n <= p["max"])]
            total = total + w * np.select(fits, [float(p.get("score_optimal", 1.0)), float(p.get("score_acceptable", 0.5))], float(p.get("penalty_outside", -1.0)))
        if "cleavage_motif" in on:
            w, p = on["cleavage_motif"]
            pairs = np.zeros((128, 128))
            for k, v in p["motifs"].items():
                pairs[ord(k[0]), ord(k[1])] = w * float(v) / 2
            total = total + pairs[letters[at - 1], letters[at]]
        if "leader_penultimate_residue" in on:
            w, p = on["leader_penultimate_residue"]
            total = total + w * table({**p.get("allowed_rare", {}), **p.get("preferred", {})}, p.get("penalty_other", -0.5))[letters[at - 2]]
        if patterns is not None:
            w, p = on["leader_signature_motifs"]
            most = np.full(len(of), -np.inf)
            for k, v in patterns.items():
                # of one length, so the first match ends first; a leader has it once it reaches that end
                look = re.compile(k.replace(".", "[^\n\r\u0085\u2028\u2029]") if p.get("allow_regex") else re.escape(k))
                ends = np.array([m.end() if (m := look.search(x)) else len(x) + 1 for x in texts], int)
                most = np.where(position >= ends[of], np.maximum(most, float(v)), most)
            total = total + np.where(np.isfinite(most), w * most, 0.0)
        if "hydrophobicity_transition" in on:
            w, p = on["hydrophobicity_transition"]
            tenths = running(table({k: round(10 * v) for k, v in HYDROPATHY.items()}, 0))  # whole numbers: their sums are exact
            window = p["window_size"] if p.get("window_size") else np.minimum(position, n)
            a, b = np.maximum(first, at - window), np.minimum(end, at + window)
            diff = _rounded((tenths[b] - tenths[at]) / (10 * (b - at)) - (tenths[at] - tenths[a]) / (10 * (at - a)))
            total = total + np.where(diff >= p["min_difference"], w * np.minimum(diff / 2, 1.5), 0.0)
        if "charge_transition" in on:
            w, p = on["charge_transition"]
            own, sums = table(SIDE_CHARGE, 0)[letters], np.zeros(len(letters) + len(texts))
            for k, (x, y) in enumerate(zip(begin.tolist(), (begin + size).tolist(), strict=True)):  # each from its own start
                np.cumsum(own[x:y], out=sums[x + k + 1 : y + k + 1])
            leader = sums[at + of] - sums[first + of] + (ends_n[letters[first]] + ends_c[letters[at - 1]])
            core = sums[end + of] - sums[at + of] + (ends_n[letters[at]] + ends_c[letters[end - 1]])
            diff = _rounded(leader - core)
            diff = diff if p["leader_more_charged"] else -diff
            total = total + np.where(diff >= p.get("min_difference", 0.1), w * np.minimum(diff * 2, 1.0), 0.0)
        if "steric_lock_region" in on and ring is not None:
            w, p = on["steric_lock_region"]
            bulky = running(table(dict.fromkeys(p["bulky_residues"], 1), 0))
            a = np.maximum(0, place + p["relative_to_acceptor"].get("start_offset", 0))
            b = np.minimum(n - 1, place + p["relative_to_acceptor"].get("end_offset", 0))
            held = np.isfinite(best) & (b >= a)
            inside = bulky[at + np.where(held, b + 1, 0)] - bulky[at + np.where(held, a, 0)]
            total = total + np.where(held & (inside >= p.get("require_at_least", 1)), w, 0.0)
        out, some = np.zeros(len(texts)), np.flatnonzero(count)
        if len(some):
            out[some] = _rounded(np.maximum.reduceat(total, (np.cumsum(count) - count)[some]))
        return out, count

    return scores


def best_rule_score(proteins: DataFrame, rules: dict[str, Rule] | None = None, allow_inverted: bool = False, **limits) -> DataFrame:
    """(sequence, rule_score_raw, rule_orientation) of the distinct sequences; 0 and null where no site is allowed.

    Each sequence is scored once, its sites as arrays where the rules allow; else by an aggregate with an ordered maximum: no window,
    partial before the shuffle.
    """
    once = dealt(proteins.select(F.upper(F.trim("sequence")).alias("sequence")).distinct())
    scorer = None if allow_inverted or limits else _array_scorer(rules or ruleset())
    if scorer is not None:

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    own = b.column(0).slice(at, 2048)
                    best, count = scorer([x or "" for x in own.to_pylist()])
                    yield pa.RecordBatch.from_arrays([own, pa.array(best), pa.array(["leader_core" if x else None for x in count.tolist()], pa.string())], names=["sequence", "rule_score_raw", "rule_orientation"])

        return once.mapInArrow(scored, "sequence string, rule_score_raw double, rule_orientation string")
    sites = _sites(once, rules or ruleset(), limits.get("min_leader", 10), limits.get("min_core"), allow_inverted)
    best = F.max(F.struct("score", "orientation", (-F.col("position")).alias("p"))).alias("b")
    scored = sites.groupBy("sequence").agg(best).select("sequence", F.col("b.score").alias("rule_score_raw"), F.col("b.orientation").alias("rule_orientation"))
    return once.join(scored, "sequence", "left").withColumn("rule_score_raw", F.coalesce("rule_score_raw", F.lit(0.0)))


def score_given_cores(rows: DataFrame, rules: dict[str, Rule] | None = None, inverted: bool = False, min_leader: int = 10, min_core: int | None = None, top_n: int = 3) -> DataFrame:
    """Proteins with a known core: the best-scoring allowed site where it stands, that site's rank, and the best prediction.

    ``rows``: name, sequence, core.  An inverted core must begin the protein.  core_score and core_rank are null where no
    place of the core is allowed; the prediction of an inverted protein is the best inverted one among the first ``top_n`` of both
    orientations, if there is one.
    """
    rules = rules or ruleset()
    clean = rows.withColumn("sequence", F.upper(F.trim("sequence"))).withColumn("known", F.upper(F.trim("core"))).drop("core")
    if inverted:
        places = F.when((F.col("known") != "") & F.col("sequence").startswith(F.col("known")), F.array(F.length("known"))).otherwise(F.array().cast("array<int>"))
    else:
        places = occurrences(F.col("sequence"), F.col("known"))
    clean = clean.withColumn("places", places)
    sites = _sites(clean, rules, min_leader, min_core, inverted, "name")
    first = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("orientation"), "position")
    own = F.col("orientation") == ("core_leader" if inverted else "leader_core")
    # of all sites of the name, and of those of its orientation
    ranked = sites.withColumn("_all", F.row_number().over(first)).filter(own).withColumn("_rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "position"))).withColumn("_own", F.array_contains("places", F.col("position")))
    best = F.when((F.col("_rank") == 1) & (F.col("_all") <= top_n), F.struct(F.col("position").alias("p"), F.col("score").alias("s"), _core(inverted).alias("core")))
    stats = ranked.groupBy("name").agg(F.min(F.when(F.col("_own"), F.col("_rank"))).alias("core_rank"), F.max(F.when(F.col("_own"), F.col("score"))).alias("core_score"), F.count("*").alias("core_rank_total"), F.max(best).alias("b"))
    out = clean.select("name", "places").join(stats, "name", "left")
    return out.select("name", F.col("places").alias("core_positions"), "core_score", "core_rank", F.coalesce("core_rank_total", F.lit(0)).alias("core_rank_total"), F.col("b.core").alias("best_pred_core"), F.col("b.p").alias("best_pred_pos"), F.col("b.s").alias("best_pred_score"), F.when(F.col("b.s").isNotNull(), confidence(F.col("b.s"))).alias("best_pred_confidence"))
