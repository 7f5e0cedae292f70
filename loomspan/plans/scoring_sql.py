"""DuckDB SQL of the rule classifiers.

The patterns are written here once more, from what they mean and not from the
banks of the operators, so that the comparison tests the rules too.  RE2 has no
Unicode word border: a border is written as a character that is no word
character, and two words in one line share it where they stand side by side."""

from __future__ import annotations

from loomspan.plans.common import json_sql

B = r"[^\p{L}\p{N}_]"
INLINE = r"[^\p{L}\p{N}_\n]"


def word(t: str, *alts: str) -> str:
    """Whether t holds one of the alternatives between word borders."""
    return f"regexp_matches({t}, '(?:^|{B})(?:{'|'.join(alts)})(?:{B}|$)')"


def start(t: str, *alts: str) -> str:
    """The same, but a border only in front."""
    return f"regexp_matches({t}, '(?:^|{B})(?:{'|'.join(alts)})')"


def both(t: str, first: str, then: str) -> str:
    """Whether the first word and then, later in the line, the other occur."""
    return f"regexp_matches({t}, '(?:^|{B}){first}(?:{INLINE}|{INLINE}.*{INLINE}){then}(?:{B}|$)')"


def license_case(t: str) -> str:
    rules = [
        (word(t, "mit"), "MIT"),
        (start(t, r"apache\s*(?:license)?\s*(?:2\.0|v2)"), "Apache-2.0"),
        (word(t, r"apache-2\.0"), "Apache-2.0"),
        (start(t, r"gpl\s*(?:v?2|v?3|2\.0|3\.0)"), "GPL"),
        (word(t, r"gpl-3\.0"), "GPL-3.0"),
        (word(t, r"gpl-2\.0"), "GPL-2.0"),
        (word(t, "lgpl"), "LGPL"),
        (start(t, "bsd"), "BSD"),
        (word(t, "isc"), "ISC"),
        (word(t, r"mpl[- ]2\.0", "mozilla public license"), "MPL-2.0"),
        (word(t, "unlicense"), "Unlicense"),
        (start(t, "cc[- ](?:by|0|sa|nc|nd)"), "CC"),
        (word(t, "creative commons"), "CC"),
        (word(t, "agpl"), "AGPL"),
        (word(t, "open software license", "free software license"), "OSL"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in rules) + " ELSE 'unknown' END"


_A = r"(?:a\s+)?"
FLAGS = {
    "browser_automation": [word("t", "browser", "chromium", "headless", "playwright", "puppeteer", "screenshot", "selenium"), both("t", "navigate", "url")],
    "credential_requirements": [word("t", r"api\s*key", "auth", "credential", "jwt", "oauth", "password", "secret", "token")],
    "destructive_potential": [word("t", "delete", "destroy", "remove", "shutdown", "truncate"), both("t", "drop", "table"), both("t", "format", "disk"), both("t", "kill", "process")],
    "filesystem_access": [word("t", "fs", "mkdir", "rm", r"file\s*system", rf"(?:read|write|modify|delete)\s+{_A}file", rf"create\s+{_A}(?:file|directory)"), both("t", "path", "read")],
    "network_access": [word("t", r"api\s*(?:call|request)", "curl", "download", "fetch", "http", "https", "network", "request", "upload", "websocket")],
    "package_installation": [word("t", r"(?:apt|brew|cargo|go|npm|pip)\s+install", r"package\s+manager")],
    "shell_execution": [word("t", "bash", "cli", "exec", "shell", "subprocess", "terminal", r"command\s*(?:line|execution)", rf"run\s+{_A}command")],
}
BOTH = "lower(concat_ws(' ', summary, raw_content))"
_FLAG_LIST = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(c)} THEN '{f}' END" for f, c in FLAGS.items()) + "], lambda x: x IS NOT NULL)"
FLAGGED = f"""d AS (SELECT *, {BOTH} AS t FROM versions), g AS (SELECT *, CASE WHEN length(trim(t)) < 10 THEN [] ELSE {_FLAG_LIST} END AS flags FROM d),
r AS (SELECT *, CASE WHEN length(trim(t)) < 10 THEN 'UNKNOWN' WHEN list_contains(flags, 'destructive_potential') OR len(flags) >= 4 THEN 'HIGH' WHEN len(flags) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM g)"""
RUNTIMES = {"python": ["python", "python3", "pip", "pip3", "venv", "conda", "poetry"], "node": ["node", "npm", "npx", "yarn", "pnpm", "bun"], "rust": ["rust", "cargo", "rustc"], "go": ["go", "golang"], "java": ["java", "jvm", "gradle", "maven", "mvn"], "deno": ["deno"]}
SYSTEMS = {"linux": ["linux", "ubuntu", "debian", "centos", "fedora", "arch"], "macos": ["macos", "darwin", "mac", "osx", "brew", "homebrew"], "windows": ["windows", "powershell", r"cmd\.exe", "wsl"]}
SHELL = ["bash", "sh", "shell", "terminal", "zsh", "command[-_]?line"]
MCP = ["mcp", "model[-_]?context[-_]?protocol", "mcp[-_]?server", "mcp[-_]?tool"]
MENTIONS = {"claude": ["claude", "anthropic", "claude[-_]?code", "claude[-_]?desktop"], "codex": ["codex", "openai[-_]?codex", "codex[-_]?cli"], "cursor": ["cursor", "cursor[-_]?ai"], "gemini": ["gemini", "bard", "google[-_]?ai"], "mcp_client": ["mcp", "model[-_]?context[-_]?protocol"], "opencode": ["opencode"]}
_INSTALL = r"regexp_matches(t, '(?m)(?:^|[\s`$(])(?:pip3?|npm|yarn|apt-get|apt|brew|cargo|go|gem) +(?:install|add|i) +[a-z0-9@]')"
TOOLS = "ansible aws az cargo cmake curl docker eslint ffmpeg gcloud gh git gradle helm jq kubectl make maven node npm pandoc poetry psql pytest redis-cli rsync ruff sqlite3 ssh terraform tmux vim vite webpack wget".split()


def bank(of: dict[str, list[str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {word('t', *p)} THEN '{n}' END" for n, p in of.items()) + "], lambda x: x IS NOT NULL), '|')"


INVOCATION = f"CASE WHEN contains(lower(coalesce(source_path, '')), 'skill.md') THEN 'prompt_only' WHEN {word('t', *MCP)} THEN 'mcp_tool' WHEN {word('t', 'npm', 'pip', 'npx')} THEN 'tool_call' WHEN {word('t', *SHELL)} THEN 'cli_command' ELSE 'prompt_only' END"


def fit() -> str:
    """CTEs up to fit(id, agent, score, level, blocked)."""
    supports = {  # skill file, agents file, mcp, shell, browser
        "claude": "11111", "codex": "11010", "cursor": "11110", "gemini": "00110", "generic_cli": "00010", "mcp_client": "00100", "opencode": "11111",
    }
    rows = ", ".join("(" + ", ".join([f"'{a}'", *("true" if x == "1" else "false" for x in s)]) + ")" for a, s in supports.items())
    says = "[" + ", ".join(f"CASE WHEN {word('t', *p)} THEN '{a}' END" for a, p in MENTIONS.items()) + "]"
    heavy = {r: word("t", *RUNTIMES[r]) for r in ("rust", "go", "java", "deno")}
    rt = " ".join(f"- CASE WHEN {r}_ AND NOT shell_ok THEN 0.2::DOUBLE ELSE 0 END" for r in heavy)
    score = f"""0.5::DOUBLE + CASE WHEN sf THEN CASE WHEN skill THEN 0.35::DOUBLE ELSE -0.1::DOUBLE END ELSE 0 END
 + CASE WHEN af AND agents THEN 0.15::DOUBLE ELSE 0 END
 + CASE WHEN m THEN CASE WHEN mcp_ok THEN 0.3::DOUBLE ELSE -0.3::DOUBLE END ELSE 0 END {rt}
 - CASE WHEN br AND NOT browser_ok THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN sh AND NOT sf AND NOT shell_ok THEN 0.3::DOUBLE ELSE 0 END
 + CASE WHEN list_contains(says, agent) THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN dk AND NOT shell_ok THEN 0.2::DOUBLE ELSE 0 END"""
    blocks = [("m AND NOT mcp_ok", "needs mcp"), *((f"{r}_ AND NOT shell_ok", f"needs {r} (no shell)") for r in heavy), ("br AND NOT browser_ok", "needs a browser"), ("sh AND NOT sf AND NOT shell_ok", "needs a shell"), ("dk AND NOT shell_ok", "needs docker")]
    blockers = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in blocks) + "], lambda x: x IS NOT NULL)"
    return f"""a(agent, skill, agents, mcp_ok, shell_ok, browser_ok) AS (VALUES {rows}),
d AS (SELECT id, {BOTH} AS t, source_path, contains(lower(coalesce(source_path, '')), 'skill.md') AS sf, contains(lower(coalesce(source_path, '')), 'agents.md') AS af FROM versions),
s AS (SELECT *, {word('t', *MCP)} AS m, {word('t', 'browser', 'cdp', 'chrome', 'chromium', 'firefox', 'playwright', 'puppeteer', 'selenium')} AS br, {word('t', *SHELL)} AS sh,
  {word('t', 'container', 'docker', 'dockerfile', 'docker[-_]?compose')} AS dk, {says} AS says, {', '.join(f'{c} AS {r}_' for r, c in heavy.items())}, {INVOCATION} AS invocation FROM d),
x AS (SELECT id, agent, {blockers} AS blockers, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {score})), 3) AS score FROM s, a),
fit AS (SELECT id, agent, score, blockers, CASE WHEN score >= 0.8 THEN 'SUPPORTED' WHEN score >= 0.6 THEN 'LIKELY_SUPPORTED' WHEN score >= 0.35 THEN 'REQUIRES_ADAPTER' WHEN len(blockers) > 0 THEN 'NOT_SUPPORTED' ELSE 'UNKNOWN' END AS level FROM x)"""


_KNOWN = "('MIT', 'Apache-2.0', 'GPL', 'GPL-2.0', 'GPL-3.0', 'LGPL', 'BSD', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC', 'MPL-2.0', 'Unlicense', 'CC', 'AGPL', 'AGPL-3.0', 'OSL')"
_LJ = json_sql("license")
LICENSED = f"""rl AS (SELECT id AS repo, min(trim(coalesce(json_extract_string({_LJ}, '$.type'), CASE WHEN json_valid(license) THEN CASE WHEN json_type(license::JSON) = 'VARCHAR' THEN json_extract_string(license, '$') END ELSE license END))) AS repo_license FROM repositories GROUP BY 1),
l0 AS (SELECT v.id, lower(coalesce(v.summary, '')) AS t, rl.repo_license AS rt, trim(CASE WHEN json_valid(license) THEN CASE WHEN json_type(license::JSON) = 'VARCHAR' THEN json_extract_string(license, '$') END ELSE license END) AS bare, json_extract_string({_LJ}, '$.type') AS kind FROM versions v LEFT JOIN rl ON rl.repo = v.source_repo),
l1 AS (SELECT *, {license_case('t')} AS named FROM l0),
lic AS (SELECT id, CASE WHEN rt IN {_KNOWN} THEN rt WHEN bare IN {_KNOWN} THEN bare WHEN coalesce(kind, '') <> '' AND lower(kind) NOT IN ('unknown', 'none') THEN kind ELSE named END AS license_type,
  CASE WHEN rt IN {_KNOWN} THEN 0.95::DOUBLE WHEN bare IN {_KNOWN} OR (coalesce(kind, '') <> '' AND lower(kind) NOT IN ('unknown', 'none')) THEN 0.90::DOUBLE WHEN named <> 'unknown' THEN 0.70::DOUBLE ELSE 0.0::DOUBLE END AS license_confidence FROM l1)"""


def _some(c: str) -> str:
    return f"coalesce({c}, '') NOT IN ('', 'unknown', 'none')"


def _sum(*rules: tuple[str, float]) -> str:
    return " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w in rules)])


_NEEDS = " OR ".join(f"(json_type(rj, '$.{k}') = 'ARRAY' AND json_array_length(rj, '$.{k}') > 0)" for k in ("tools", "apis", "packages", "env_vars", "runtimes"))
#: CTEs up to sc(id, ..., overall); reads d, g and r of FLAGGED.
SCORED = f"""{FLAGGED}, {LICENSED}, nc AS (SELECT version_id_fk AS v, count(*) AS n FROM capabilities GROUP BY 1), nt AS (SELECT version_id_fk AS v, count(*) AS n FROM tags GROUP BY 1),
q0 AS (SELECT r.*, {json_sql('runtime_requirements')} AS rj, length(coalesce(summary, '')) AS ls, length(coalesce(raw_content, '')) AS lr, coalesce(nc.n, 0) AS caps, coalesce(nt.n, 0) AS tags, {_some('input_format')} AS hi, {_some('output_format')} AS ho,
  {_INSTALL} AS ins, {word('t', *[w for p in RUNTIMES.values() for w in p], *TOOLS)} OR {_INSTALL} AS inf FROM r LEFT JOIN nc ON nc.v = r.id LEFT JOIN nt ON nt.v = r.id),
q1 AS (SELECT *, coalesce({_NEEDS}, false) AS dp FROM q0),
q2 AS (SELECT *, least(1.0::DOUBLE, CASE WHEN ls > 200 THEN 0.3::DOUBLE WHEN ls > 100 THEN 0.2::DOUBLE WHEN ls > 30 THEN 0.1::DOUBLE WHEN ls > 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + ({_sum(('lr > 100', 0.3), ('caps > 0', 0.2), ('hi', 0.1), ('ho', 0.1))})) AS doc,
  least(1.0::DOUBLE, {_sum((_some('name'), 0.1), (_some('summary'), 0.1), (_some('domain_primary'), 0.1), ('hi', 0.1), ('ho', 0.1), ('caps > 0', 0.15), ('tags > 0', 0.1), ('ins', 0.1), ('dp', 0.075), ('inf', 0.075))}) AS meta,
  CASE WHEN imported_at IS NULL THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS fresh, CASE WHEN dp AND inf THEN 0.9::DOUBLE WHEN dp THEN 0.7::DOUBLE WHEN inf THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS dep,
  CASE risk WHEN 'LOW' THEN 0.9::DOUBLE WHEN 'MEDIUM' THEN 0.6::DOUBLE WHEN 'HIGH' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS post FROM q1),
sc AS (SELECT q2.id, license_type, license_confidence, flags, risk, round(doc, 3) AS documentation, round(meta, 3) AS metadata, fresh AS freshness, 0.2::DOUBLE AS adoption, dep AS dependency, post AS posture,
  round(doc * 0.25::DOUBLE + meta * 0.20::DOUBLE + fresh * 0.10::DOUBLE + 0.2::DOUBLE * 0.10::DOUBLE + dep * 0.15::DOUBLE + post * 0.20::DOUBLE, 3) AS overall FROM q2 JOIN lic ON lic.id = q2.id)"""
