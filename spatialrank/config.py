"""Run configuration: settings, command lines, batches of runs and the names of outputs."""

from __future__ import annotations

import argparse
import re
import shlex
from dataclasses import dataclass, field

_FLAG, _NUMBER, _COUNT, _FILE = "flag", "number", "count", "file"
#: section -> "key | kind | default" for each setting (fixed values).
SETTINGS = {
    "Settings": """initial removal percent | number | 0
use cost | flag | 0
use mask | flag | 0
use boundary quality penalty | flag | 0
BQP mode | count | 1
BLP | number | 0
z | number | 0.25
edge removal | flag | 1
add to edge borders between removal mask levels | flag | 1
annotate name | flag | 1
resample species | count | 0
drop 0 occurrence layers | flag | 0
removal rule | count | 1
cost file | file |
mask file | file |
BQP profiles file | file |
warp factor | count | 1
logit space | flag | 0
add edge points | count | 0
use SSI | flag | 0
SSI file name | file |
post-processing list file | file |
treat zero-areas as missing data | flag | 0
memory save mode | flag | 0
use groups | flag | 0
groups file | file |
use condition layer | flag | 0
condition file | file |
use retention layer | flag | 0
retention file | file |
use local edge corrections | flag | 0
local edge corrections file | file |
retention layers relative weight | number | 1
mask missing areas | flag | 0
area mask file | file |
use planning unit layer | flag | 0
planning unit layer file | file |
use tree connectivity | flag | 0
tree connectivity file | file |
use interactions | flag | 0
interaction file | file |
random omission percentage after vmat simple impl | number | 0
random omission max feature | count | 0
cell area layer | file |""",
    "Community analysis settings": """load similarity matrix | flag | 0
connectivity similarity matrix file | file |
apply to connectivity | flag | 0
community similarity matrix file | file |
apply to representation | flag | 0
connectivity edge effect fix file | file |""",
    "Administrative units": """use ADMUs | flag | 0
ADMU mode | count | 1
calculate local weights from condition | flag | 0
ADMU layer file | file |
ADMU descriptions file | file |
ADMU weight matrix | file |
Mode 2 global weight | number | 0
row count for per ADMU output curves | count | 0""",
    "Info-gap settings": """Info-gap proportional | flag | 0
use info-gap weights | flag | 0
Info-gap weights file | file |
normalize info-gap weights | flag | 0""",
    "Transformed layers": """output final transformed layers | flag | 0
output info-gap transformed layers | flag | 0
output distribution smoothing transformed layers | flag | 0
output community similarity transformed layers | flag | 0
output condition transformed layers | flag | 0
output retention transformed layers | flag | 0
output matrix connectivity transformed layers | flag | 0
output interactions transformed layers | flag | 0""",
    "Arbitrary kernels": """use arbitrary kernels | flag | 0
arbitrary kernels constant | number | 0
default kernel | count | -1
arbitrary kernels files prefix | file |""",
    "Corridor loss penalty": """use corridors | flag | 0
strength | number | 0
minimum width | count | 7
penalty formula | count | 1
variant | count | 1
info period | count | 10000
output corridor boundaries layer at top percentage | file |
use domain layers | flag | 0
domain layers list file | file |
start at top percentage | number | 100
redundancy radius x | count | 0
redundancy radius y | count | 0""",
    "vmat": """save vmat | file |
load vmat | file |
load vmat directly and risky | flag | 0""",
    "Outputs": """output weighted range size corrected richness | flag | 1
output occurrence richness map | flag | 0
output weighted occurrence richness map | flag | 0
output occurrence level richness map | flag | 0
output weighted occurrence level richness map | flag | 0
output proportional loss ranking | flag | 0
stop before ranking | flag | 0""",
}
RULES = {1: "caz", 2: "abf", 3: "tbf", 4: "gbf", 5: "random"}
_RULE_NAMES = {1: "CAZ", 2: "ABF", 3: "TBF", 4: "GBF", 5: "RND"}


def _convert(kind: str, word: str):
    word = word.strip().strip('"')
    if kind == _FLAG:
        if word.lower() not in ("0", "1", "true", "false"):
            raise ValueError(f"{word!r} is neither 0 nor 1")
        return word.lower() in ("1", "true")
    return int(float(word)) if kind == _COUNT else float(word) if kind == _NUMBER else word


def known() -> dict[tuple[str, str], tuple[str, object]]:
    """(section, key) in lower case -> (kind, default)."""
    out = {}
    for section, text in SETTINGS.items():
        for line in text.splitlines():
            key, kind, default = (p.strip() for p in line.split("|"))
            out[section.lower(), key.lower()] = kind, _convert(kind, default) if default else "" if kind == _FILE else None
    return out


@dataclass
class Settings:
    values: dict[tuple[str, str], object]
    notices: list[str] = field(default_factory=list)

    def get(self, key: str, section: str = "Settings"):
        return self.values[section.lower(), key.lower()]

    @property
    def rule(self) -> str:
        return RULES[self.get("removal rule")]


def settings(text: str) -> Settings:
    """Parse an INI file: sections, keys with or without quotes, comments after ; or #; unknown keys are noted."""
    kinds = known()
    out = Settings({k: default for k, (_, default) in kinds.items()})
    section = "settings"
    for n, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"[;#].*", "", line).strip()
        if not line:
            continue
        if m := re.fullmatch(r"\[(.*)\]", line):
            section = m[1].strip().lower()
        elif m := re.fullmatch(r'("?)(.+?)\1\s*=\s*(.*)', line):
            key = section, m[2].strip().lower()
            if key not in kinds:
                out.notices.append(f"line {n}: unknown key {m[2]!r} in [{section}]")
            else:
                try:
                    out.values[key] = _convert(kinds[key][0], m[3])
                except ValueError as e:
                    raise ValueError(f"line {n}: {m[2]}: {e}") from None
        else:
            raise ValueError(f"line {n}: {line!r}")
    if out.get("removal rule") not in RULES:
        raise ValueError("the removal rule is 1 to 5")
    out.values["settings", "warp factor"] = min(max(out.get("warp factor"), 1), 1_000_000)
    for use in ("use condition layer", "use retention layer"):
        if out.get(use) and not out.get("use groups"):
            out.notices.append(f"{use} needs groups")
            out.values["settings", use] = False
    if out.get("use tree connectivity") and out.get("use boundary quality penalty"):
        out.notices.append("tree connectivity turns the boundary quality penalty off")
        out.values["settings", "use boundary quality penalty"] = False
    return out


@dataclass
class Run:
    """One run: ``mode`` is rank, or load with the ranking to replay."""

    mode: str
    settings: str
    features: str
    output: str
    alpha: float
    smoothing: bool
    kernel_multiplier: float
    autoclose: bool
    ranking: str | None = None
    threads: int = 1
    rule: int | None = None
    warp: int | None = None
    formats: tuple[str, ...] = ()


def command_line(words: list[str] | str) -> Run:
    """Eight words and options: mode, settings, features, output, alpha, smoothing, kernel multiplier, autoclose."""
    words = shlex.split(words) if isinstance(words, str) else list(words)
    parser = argparse.ArgumentParser(prog="spatialrank", exit_on_error=False)
    parser.add_argument("--use-threads", type=int, default=1)
    parser.add_argument("--removal-rule", type=int, choices=sorted(RULES))
    parser.add_argument("--warp-factor", type=int)
    parser.add_argument("--grid-output-formats", nargs="*", default=[])
    mode, rest = words[0], words[1:]
    if not re.fullmatch(r"-r|-l.+", mode) or len(rest) < 7:
        raise ValueError("mode (-r or -l<ranking>) and seven more are needed")
    options, left = parser.parse_known_args(rest[7:])
    if left:
        raise ValueError(f"not understood: {left}")
    config, features, output, alpha, smoothing, multiplier, close = rest[:7]
    return Run("rank" if mode == "-r" else "load", config, features, output, float(alpha), _convert(_FLAG, smoothing), float(multiplier), _convert(_FLAG, close), mode[2:] or None, options.use_threads, options.removal_rule, options.warp_factor, tuple(options.grid_output_formats))


def batch(text: str) -> list[Run]:
    """A run for each line that calls the program; lines of `rem` are comments."""
    runs = []
    for line in text.splitlines():
        words = shlex.split(line, posix=False) if line.strip() else []
        if not words or words[0].lower() in ("rem", "#") or words[0].startswith("#"):
            continue
        words = [w.strip('"') for w in words]
        if words[0].lower() == "call":
            words = words[1:]
        runs.append(command_line(words[1:]))
    return runs


def output_suffix(config: Settings, run: Run) -> str:
    """What an output's name says of the run: the rule, and a letter for each part that was on."""
    parts = [_RULE_NAMES[run.rule or config.get("removal rule")]]
    letters = {"use mask": "M", "use cost": "C", "use SSI": "S", "edge removal": "E", "use retention layer": "R", "use condition layer": "D", "use ADMUs": "A"}
    on = "".join(v for k, v in letters.items() if config.values.get(("settings", k.lower()), config.values.get(("administrative units", k.lower()))))
    parts += [on] if on else []
    if run.alpha:
        parts.append(f"IG{run.alpha:g}")
    if config.get("use boundary quality penalty"):
        parts.append("BQP")
    if config.get("BLP"):
        parts.append(f"BLP{config.get('BLP'):g}")
    return "_".join(parts)


def settings_text(config: Settings) -> str:
    """The settings that aren't the defaults, as an INI file."""
    kinds, out = known(), []
    for section in SETTINGS:
        rows = [(k, v) for (s, k), v in config.values.items() if s == section.lower() and v != kinds[s, k][1]]
        if rows:
            out += [f"[{section}]", *(f"{k} = {int(v) if isinstance(v, bool) else v}" for k, v in rows)]
    return "\n".join(out) + "\n"
