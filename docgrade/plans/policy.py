"""Policies: rules as data, validated before any document is read, compiled into Columns later."""

from __future__ import annotations

from dataclasses import dataclass, field

RANK = {"O": 1, "S": 2, "C": 3}
FUSED = ("rule", "sensitive", "stamp", "name")


class PolicyError(ValueError):
    """Carries every violation found, not the first alone."""

    def __init__(self, violations: list[str]):
        super().__init__("\n".join(violations))
        self.violations = violations


@dataclass(frozen=True)
class RegexRule:
    id: str
    label: str
    base_grade: str
    bulk_grade: str | None = None
    bulk_threshold: int | None = None
    confidence: float = 0.9
    seed_eligible: bool = True


@dataclass(frozen=True)
class KeywordRule:
    id: str
    terms: tuple[str, ...]
    base_grade: str
    filename: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    term_min_count: dict[str, int] = field(default_factory=dict, hash=False)
    bulk_grade: str | None = None
    bulk_threshold: int | None = None
    confidence: float = 0.8
    seed_eligible: bool = True


@dataclass(frozen=True)
class ComboRule:
    id: str
    grade: str
    all_of: tuple[str, ...] = ()
    of: tuple[str, ...] = ()
    min_types: int = 0
    confidence: float = 0.95
    seed_eligible: bool = True


@dataclass(frozen=True)
class SensitiveRule:
    id: str
    category: str
    terms: tuple[str, ...]
    grade: str
    min_count: int = 3
    exclude: tuple[str, ...] = ()
    confidence: float = 0.7
    seed_eligible: bool = False


@dataclass(frozen=True)
class StampRule:
    id: str
    terms: tuple[str, ...]
    grade: str
    exclude: tuple[str, ...] = ()
    always: bool = False
    confidence: float = 0.85
    seed_eligible: bool = False


@dataclass(frozen=True)
class Policy:
    regex: tuple[RegexRule, ...] = ()
    keywords: tuple[KeywordRule, ...] = ()
    combos: tuple[ComboRule, ...] = ()
    sensitive: tuple[SensitiveRule, ...] = ()
    stamps: tuple[StampRule, ...] = ()
    bulk_threshold: int = 5
    pii_grade_cap: str | None = None
    name_confidence: float = 0.6


KINDS = {"regex_pii": RegexRule, "keywords": KeywordRule, "pii_combos": ComboRule, "sensitive": SensitiveRule, "stamps": StampRule}


def violations(data: dict) -> list[str]:
    """Everything that is wrong with a policy read from a file."""
    out, seen = [], set()
    if not isinstance(data, dict):
        return ["the policy is not a mapping"]
    if "paths" in data:
        out.append("paths: rules by path are no longer part of a policy")
    for section, kind in KINDS.items():
        fields = set(kind.__dataclass_fields__) | {"name", "weight"}
        for i, rule in enumerate(data.get(section) or ()):
            at = f"{section}[{i}]"
            if not isinstance(rule, dict):
                out.append(f"{at}: not a mapping")
                continue
            if not rule.get("id"):
                out.append(f"{at}: no id")
            elif rule["id"] in seen:
                out.append(f"{at}: id {rule['id']} is used twice")
            seen.add(rule.get("id"))
            out += [f"{at}: unknown field {f}" for f in sorted(set(rule) - fields)]
            for f in ("grade", "base_grade", "bulk_grade"):
                if f in rule and rule[f] is not None and rule[f] not in RANK:
                    out.append(f"{at}: {f} {rule[f]!r} is none of {', '.join(RANK)}")
                elif f in fields and f != "bulk_grade" and f not in rule:
                    out.append(f"{at}: no {f}")
            if "terms" in fields and not rule.get("terms") and not rule.get("filename"):
                out.append(f"{at}: no terms")
            if section == "pii_combos" and not rule.get("all_of") and not (rule.get("of") and rule.get("min_types")):
                out.append(f"{at}: a combination without a condition never fires")
    cap = (data.get("defaults") or {}).get("pii_grade_cap")
    if cap is not None and cap not in RANK:
        out.append(f"defaults: pii_grade_cap {cap!r} is none of {', '.join(RANK)}")
    return out


def load(data: dict) -> Policy:
    """A policy from parsed YAML or JSON; all violations at once if there are any."""
    if found := violations(data):
        raise PolicyError(found)
    defaults = data.get("defaults") or {}

    def rules(section: str) -> tuple:
        kind = KINDS[section]
        lowered = {"terms", "exclude", "filename"} if defaults.get("case_insensitive", True) else set()

        def value(k, v):
            if isinstance(v, list):
                return tuple(x.lower() if k in lowered else x for x in v)
            return v

        return tuple(kind(**{k: value(k, v) for k, v in r.items() if k in kind.__dataclass_fields__}) for r in data.get(section) or ())

    return Policy(
        rules("regex_pii"),
        rules("keywords"),
        rules("pii_combos"),
        rules("sensitive"),
        rules("stamps"),
        defaults.get("bulk_threshold", 5),
        defaults.get("pii_grade_cap"),
    )


#: A small English policy whose terms occur in the test tables.
DEMO = Policy(
    regex=(
        RegexRule("R1", "EMAIL", "S", "C", 3, 0.9),
        RegexRule("R2", "IP", "O", "S", 2, 0.6, False),
        RegexRule("R3", "CARD", "C", None, None, 0.95),
    ),
    keywords=(
        KeywordRule("K1", ("license", "licensed"), "O", ("license",), (), {}, "S", 3, 0.7),
        KeywordRule("K2", ("token", "password"), "S", (), ("token ring",), {}, "C", 2, 0.8),
    ),
    combos=(ComboRule("M1", "C", ("EMAIL", "IP")), ComboRule("M2", "S", (), ("EMAIL", "IP", "CARD"), 2)),
    sensitive=(SensitiveRule("E1", "rights", ("rights", "reserved", "license"), "S", 2),),
    stamps=(StampRule("T1", ("all rights reserved",), "S"), StampRule("T2", ("gnu general public",), "O", (), True)),
)
