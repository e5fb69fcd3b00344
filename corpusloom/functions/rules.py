"""The rules of the line scan: what they look for, and in which languages."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from corpusloom.functions.gaps import in_run, in_two_gaps, linear
from corpusloom.functions.text import INSTEAD

# Severities from the gravest on, with their weights in a risk score.
SEVERITIES = {"critical": 10, "high": 5, "medium": 2, "low": 1}
# A score of at least so much has this level.
RISK_LEVELS = [(0, "low"), (15, "medium"), (40, "high"), (80, "severe")]

# Languages of most rules.
EIGHT = ["python", "javascript", "typescript", "go", "java", "ruby", "php", "rust"]

# Of each rule its id, severity, category, languages and patterns.
# Patterns ignore case and are searched anywhere in a line.
POI_001 = [
    r'\brequests\s*\.\s*(?:get|post|put|delete|patch|head|request)\s*\(',
    r'\bhttpx\s*\.\s*(?:get|post|put|delete)\s*\(',
    r'\burllib\.(?:request|opener)',
    r'\bsocket\.(?:socket|connect|create_connection)\s*\(',
    r'\bhttp\.client\b',
    r'\baiohttp\b',
    r'\basyncio\.open_connection\b',
    r'\bfetch\s*\(',
    r'\baxios\s*\.\s*(?:get|post|put|delete|request)\s*\(',
    r'\bXMLHttpRequest\b',
    r'\bhttp\s*\.\s*(?:request|get)\s*\(',
    r'\bsuperagent\b',
    r'\bhttp\.(?:Get|Post|NewRequest)\s*\(',
    r'\bHttpClient\b',
    r'\bOkHttpClient\b',
    r'\bRestTemplate\b',
    r'\b(curl|wget)\s+',
    r'\bfile_get_contents\s*\(\s*[\'"]https?://',
    r'\bcurl_init\s*\(',
]
POI_002 = [
    r'\bos\.system\s*\(',
    r'\bsubprocess\.(?:call|run|Popen|check_output|check_call)\s*\(',
    r'\beval\s*\(',
    r'\bexec\s*\(',
    r'\b__import__\s*\(\s*[\'"]os[\'"]\s*\)',
    r'\bchild_process\s*\.\s*(?:exec|spawn|fork|execSync|spawnSync)\s*\(',
    r'\bprocess\.(?:spawn|exec)\b',
    r'\beval\s*\(',
    r'\bFunction\s*\(\s*[\'"][^)]*[\'"]\s*\)\s*\(',
    r'\bexec\.(?:Command|CommandContext)\s*\(',
    r'\bos\.Exec\b',
    r'\bRuntime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(',
    r'\bProcessBuilder\b',
    r'\bsystem\s*\(',
    r'\bexec\s*\(',
    r'`[^`]+`',
    r'\b(?:exec|system|passthru|shell_exec|proc_open|popen)\s*\(',
]
POI_003 = [
    r'\bopen\s*\(\s*[\'"]/etc/',
    r'\bopen\s*\(\s*[\'"][~.]',
    r'\bopen\s*\(\s*[\'"]C:\\Users\\',
    r'\.(?:read|read_text|read_bytes|readFile|readFileSync)\s*\(',
    r'\bcat\s+/etc/',
    r'\bos\.path\.expanduser\s*\(',
    r'\bos\.environ\b',
    r'\bprocess\.env\b',
    r'\bgetenv\s*\(',
    r'\bSystem\.getenv\b',
]
POI_004 = [
    r'\b(?:b(?:ase)?64|atob|btoa)\b',
    r'\b(?:fromhex|hexlify|unhexlify)\b',
    r'\bcodecs\.decode\b',
    r'\bx03\b.*\bx[0-9a-f]{2}',
    r'[\w+/=]{50,}',
    r'\\\\x[0-9a-fA-F]{2}',
]
POI_005 = [
    r'\b(?:curl|wget)\s+.*\|\s*(?:bash|sh|python|ruby|perl)',
    r'\bpip\s+install.*(?:http://|https://)(?!.*pypi\.org)',
    r'\bnpm\s+install.*(?:http://|https://)(?!.*(?:npmjs\.com|registry\.npmjs))',
    r'\b(?:easy_install|setup\.py)\b',
    r'\bgo\s+get\s+(?:http://|https://)(?!.*(?:golang\.org|pkg\.go\.dev|github\.com))',
    r'\bdocker\s+run.*\|\s*(?:bash|sh)',
]
POI_006 = [
    r'\bcrontab\b',
    r'/etc/cron\.(?:d|daily|hourly|monthly|weekly)',
    r'/etc/systemd/system',
    r'\bsystemctl\s+(?:enable|daemon-reload)',
    r'\.bashrc',
    r'\.zshrc',
    r'\.profile',
    r'~/.config/autostart',
    r'Startup\\\\',
    r'HKEY_(?:CURRENT_USER|LOCAL_MACHINE)',
    r'reg\s+(?:add|import)',
    r'Set-ItemProperty.*Registry',
    r'\bsudo\b',
    r'\bchown\s+\w+\s*:',
    r'\bchmod\s+.*\+s\b',
    r'\bsetuid\b',
    r'\bSet-ExecutionPolicy\b',
    r'\buseradd\b',
    r'\badduser\b',
    r'\bnet\s+user\s+/add',
]
SEC_001 = [
    r'(?:api[_-]?key|apikey|api[_-]?secret)\s*[:=]\s*[\'"][\w\-\.~+/=]{16,}[\'"]',
    r'(?:AKIA|ASIA)[A-Z0-9]{16}',
    r'(?:gh[ps]_[A-Za-z0-9]{36}|github[_-]?token\s*[:=]\s*[\'"]\w{30,}[\'"])',
    r'(?:token|secret|auth_token|access_token)\s*[:=]\s*[\'"][\w\-\.~+/=]{16,}[\'"]',
    r'-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----',
    r'eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+',
    r'(?:sk-[A-Za-z0-9]{32,})',
    r'(?:xox[bps]-[A-Za-z0-9\-]+)',
    r'(?:sk|pk)_(?:test|live)_[A-Za-z0-9]{24,}',
    r'(?:password|passwd|pwd)\s*[:=]\s*[\'"][^\'"]{4,}[\'"]',
]
SEC_002 = [
    r'(?:execute|cursor\.execute|rawQuery|query)\s*\(\s*(?:f"|f\'|\w+\s*\+)',
    r'\w+\s*=\s*(?:f"|f\')[\w\s,.*\'\"=]*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b',
    r'\w+\s*=\s*[\"\'][\w\s,.*]+[\"\']\s*\+.*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b',
    r'\.format\s*\(.*\).*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b',
    r'[\"\']\s*%\s*\w+.*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b',
    r'[\"\']\s*%\s*\(.*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b',
]
SEC_003 = [
    r'shell\s*=\s*True',
    r'\bchild_process\s*\.\s*exec\s*\(\s*\w+\s*\+',
    r'\bchild_process\s*\.\s*exec\s*\(\s*`[^`]*\$\{',
    r'\beval\s*\(\s*\w+\s*\+',
    r'\bexec\s*\(\s*[\'"]\s*\+',
]
SEC_004 = [
    r'\bhashlib\.md5\b',
    r'\bhashlib\.sha1\b',
    r'\bCrypto\.Cipher\.DES\b',
    r'\bCrypto\.Cipher\.ARC4\b',
    r'\bMessageDigest\.getInstance\s*\(\s*"MD5',
    r'\bMessageDigest\.getInstance\s*\(\s*"SHA-?1',
    r'\bcrypto\.createHash\s*\(\s*[\'"]md5[\'"]',
    r'\bcrypto\.createHash\s*\(\s*[\'"]sha1[\'"]',
    r'\b(?:md5|sha1)\s*\(',
    r'ECB\b',
]
SEC_005 = [
    r'\bopen\s*\(\s*\w+\s*\+',
    r'\bopen\s*\(\s*f[\'"]',
    r'\bopen\s*\(\s*[\'"][^\'"]*[\'"]\s*\+',
    r'\breadFile(?:Sync)?\s*\(\s*\w+\s*\+',
    r'\breadFile(?:Sync)?\s*\(\s*`[^`]*\$\{',
    r'\bfs\.(?:readFile|writeFile)\s*\(',
    r'\b(?:read|write)\s*\(\s*\w+\s*\+',
]
SEC_006 = [
    r'\bpickle\.(?:loads|load)\s*\(',
    r'\byaml\.load\s*\(',
    r'\bmarshal\.loads?\s*\(',
    r'\bdill\.loads?\s*\(',
    r'\bnew\s+Function\s*\(',
    r'\bObjectInputStream\b',
    r'\bunserialize\s*\(',
]
SEC_007 = [
    r'\.innerHTML\s*=',
    r'\.outerHTML\s*=',
    r'\.insertAdjacentHTML\s*\(',
    r'\bdocument\.write\s*\(',
    r'\bdangerouslySetInnerHTML\b',
    r'\bv-html\b',
    r'\bng-bind-html\b',
    r'\becho\s+\$_GET',
    r'\becho\s+\$_POST',
    r'\becho\s+\$_REQUEST',
    r'\breturn\s+f[\'"][^\"\']*<[a-zA-Z]+\b[^\"\']*\{',
    r'\brender_template_string\b',
]
SEC_008 = [
    r'\brandom\.(?:randint|random|choice|shuffle)\b',
    r'\bMath\.random\b',
    r'\bnew\s+Random\s*\(',
    r'\bmt_rand\b',
    r'\brand\s*\(',
]

_EVERY = POI_001 + POI_002 + POI_003 + POI_004 + POI_005 + POI_006 + SEC_001 + SEC_002 + SEC_003 + SEC_004 + SEC_005 + SEC_006 + SEC_007 + SEC_008
_IN_RUN = [p for p in SEC_001 if p.startswith("eyJ")] + [p for p in SEC_002 if r"[\w\s,.*\'\"=]*" in p]
_IN_TWO_GAPS = [p for p in SEC_007 if p.count("[^\\\"\\']*") == 2]
INSTEAD.update({p: linear(p) for p in _EVERY if linear(p) != p})
INSTEAD.update({p: in_run(p) for p in _IN_RUN} | {p: in_two_gaps(p) for p in _IN_TWO_GAPS})

#: Given a line and a path: a note if the finding stands, else null.
Context = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    category: str
    languages: list[str]
    patterns: list[str]
    context: Context | None = None
    extensions: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    description: str = ""
    recommendation: str = ""

    def __post_init__(self):
        """Patterns that aren't regular expressions are dropped, with a warning."""
        good = []
        for p in self.patterns:
            try:
                re.compile(p)
                good.append(p)
            except re.error as e:
                warnings.warn(f"{self.id}: {p!r} is no regular expression ({e})", stacklevel=3)
        object.__setattr__(self, "patterns", good)


def built_in() -> list[Rule]:
    """The rules in their order; all of poisoning come first."""
    from corpusloom.functions import context as c

    def poi(n: int, name: str, severity: str, languages: list[str], patterns: list[str], check: Context, description: str, advice: str) -> Rule:
        return Rule(f"POI-{n:03}", name, severity, "poisoning", languages, patterns, check, description=description, recommendation=advice)

    def sec(n: int, name: str, severity: str, languages: list[str], patterns: list[str], check: Context, description: str, advice: str) -> Rule:
        return Rule(f"SEC-{n:03}", name, severity, "security", languages, patterns, check, description=description, recommendation=advice)

    return [
        poi(1, "unexpected network traffic", "critical", EIGHT, POI_001, c.network, "The code talks to another host.", "Check that the project needs this address."),
        poi(2, "system command", "critical", EIGHT, POI_002, c.command, "The code runs a command of the system.", "Check that it is needed and holds no foreign text."),
        poi(3, "sensitive file", "high", EIGHT, POI_003, c.sensitive_file, "The code reads credentials or system files.", "Check that this has a purpose."),
        poi(4, "obfuscation", "critical", [x for x in EIGHT if x != "rust"], POI_004, c.obfuscation, "Encoded text meets dynamic execution.", "Decode it and review it by hand."),
        poi(5, "poisoned dependency", "high", ["all"], POI_005, c.dependency, "A package or script comes from an unofficial place.", "Install from the official index only."),
        poi(6, "persistence or privilege", "high", [x for x in EIGHT if x != "rust"] + ["shell"], POI_006, c.persistence, "The code installs itself or raises its rights.", "Remove it unless the project administers systems."),
        sec(1, "hard-coded secret", "critical", ["all"], SEC_001, c.secret, "A credential is part of the code.", "Keep credentials in the environment or a vault."),
        sec(2, "SQL injection", "critical", ["python", "javascript", "typescript", "java", "go", "php", "ruby"], SEC_002, c.sql_injection, "A query is put together from strings.", "Bind parameters."),
        sec(3, "command injection", "critical", ["python", "javascript", "typescript", "ruby", "php"], SEC_003, c.command_injection, "A shell runs text that varies.", "Pass arguments as a list."),
        sec(4, "weak cryptography", "high", ["python", "javascript", "typescript", "java", "go", "php"], SEC_004, c.weak_crypto, "The algorithm is known to be weak.", "Use current hashes and ciphers."),
        sec(5, "path traversal", "high", ["python", "javascript", "typescript", "java", "go", "php"], SEC_005, c.path_traversal, "A path is put together from input.", "Resolve the path and check where it lies."),
        sec(6, "unsafe deserialisation", "critical", ["python", "javascript", "typescript", "java", "ruby", "php"], SEC_006, c.deserialisation, "Loading such data can run code.", "Use a format that holds data only."),
        sec(7, "cross-site scripting", "high", ["javascript", "typescript", "php", "ruby", "python"], SEC_007, c.xss, "Input reaches HTML unescaped.", "Escape it or set text instead of HTML."),
        sec(8, "insecure random numbers", "medium", ["python", "javascript", "typescript", "java"], SEC_008, c.insecure_random, "The generator can be predicted.", "Use a cryptographic generator."),
    ]
