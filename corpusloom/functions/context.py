"""Whether a line that fits a rule is a finding: each check gives a note, or null for none.

The first condition that holds decides. Notes are short codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.gaps import in_two_gaps, linear
from corpusloom.functions.text import INSTEAD, any_of, contains_any, entropy, search, stripped

# Words and patterns of the checks.
SAFE_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "api.", "pypi.org", "npmjs.com", "github.com", "googleapis.com", "cdn.", "static."]
API_PATH = r"https?://[^/\s]+/api/"
DYNAMIC = ["+", 'f"', "f'", "format(", "${"]
EVALUATES = r"\beval\s*\(|\bexec\s*\("
SENSITIVE_PATHS = [
    r"/etc/(passwd|shadow|hosts|sudoers)",
    r"\.ssh/",
    r"\.aws/credentials",
    r"\.config/gcloud",
    r"\.kube/config",
    r"\.env($|[^a-zA-Z])",
    r"id_rsa",
    r"\.pem\b",
    r"\\Windows\\System32\\drivers\\etc",
]
ENVIRONMENT, ENVIRONMENT_ITEM = r"os\.environ\b", r"os\.environ\["
BASE64, EXECUTES = r"(?:b(?:ase)?64|atob|btoa)", r"\b(?:eval|exec|execCommand)\s*\("
LONG_RUN, LONG_RUN_ENTROPY = r"[\w+/=]{60,}", 4.5
HEX = r"(?:0x[0-9a-fA-F]{20,}|\\\\x[0-9a-fA-F]{2})"
PIP_URL, NPM_URL = r"pip\s+install.*(?:http://|https://)", r"npm\s+install.*(?:http://|https://)"
PIPED = r"(?:curl|wget)\s+.*\|\s*(?:bash|sh|python)"
CRON = r"crontab\s+-|/etc/cron"
REGISTRY = r"(?:reg\s+add|HKEY_|Set-ItemProperty.*Registry)"
SYSTEMD = r"(?:systemctl\s+enable|/etc/systemd/system)"
AUTOSTART = r"(?:\.bashrc|\.zshrc|\.profile|Startup|启动)"
SUDO, RAISES = r"\bsudo\b", r"(?:chmod.*\+s|chown\s+root)"
EXAMPLE_FILES = [".env.example", ".env.template", ".env.sample", "README.md"]
PLACEHOLDERS = ["your-api-key", "your_token", "your_", "todo", "<your", "<token", "placeholder", "example", "xxxx", "****", "...", "<key>"]
SQL_VERB = r"(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s"
SQL_JOINED = ["+", 'f"', "f'", ".format(", "%", "${"]
SHELL_TRUE = r"shell\s*=\s*True"
SHELL_JOINED = ["+", 'f"', "f'", ".format("]
MD5, SHA1, PASSWORD = r"hashlib\.md5\b", r"hashlib\.sha1\b", r"password|passwd|pwd|secret"
FILE_CALL = r"\b(?:open|read|write|readFile|writeFile|readFileSync|writeFileSync)\s*\("
PATH_INPUT = r"(?:request\.|params\[|query\[|body\[|req\.|input\()|\$\{|%s|\.format\("
PICKLE, MARSHAL, JSON_PARSE, FOREIGN = r"pickle\.(?:loads|load)\b", r"marshal\.loads?\b", r"JSON\.parse\b", r"untrusted|user|request"
YAML = r"yaml\.load\b(?!.*Loader=yaml\.(?:Safe|CSafe)Loader)"
DOM = r"(?:innerHTML|outerHTML|insertAdjacentHTML|document\.write|dangerouslySetInnerHTML|v-html|ng-bind-html|render_template_string)"
DOM_INPUT = r"(?:request\.|params\[|query\[|body\[|req\.|input\()|\.value\b|\$\{|props\.|state\.|this\.state"
RETURNED_HTML = r"""(?:return|response|send)\s+f['"][^"']*<[a-zA-Z]+\b[^"']*\{"""
REQUEST = r"(?:request\.|params\[|query\[|body\[|req\.)"
PYTHON_RANDOM, PYTHON_RANDOM_WORDS = r"\brandom\.(?:randint|random|choice|shuffle)\b", ["token", "password", "secret", "key", "auth", "session"]
JS_RANDOM, JS_RANDOM_WORDS = r"\bMath\.random\b", ["token", "password", "secret", "key", "auth"]

INSTEAD.update({p: linear(p) for p in (PIP_URL, NPM_URL, PIPED, REGISTRY, RAISES, YAML)} | {RETURNED_HTML: in_two_gaps(RETURNED_HTML)})


def _starts(text: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(text, F.lit(h))
    return out


def _none() -> Column:
    return F.lit(None).cast("string")


def network(line: Column, path: Column) -> Column:
    low = F.lower(line)
    return F.when(contains_any(low, SAFE_HOSTS) | search(low, API_PATH), _none()).otherwise("external request")


def command(line: Column, path: Column) -> Column:
    return F.when(_starts(stripped(line), "#", "//"), _none()).when(contains_any(line, DYNAMIC), "dynamic command").when(search(line, EVALUATES), "dynamic code").otherwise("command")


def sensitive_file(line: Column, path: Column) -> Column:
    return F.when(search(line, any_of(SENSITIVE_PATHS), True), "sensitive path").when(search(line, ENVIRONMENT) & ~search(line, ENVIRONMENT_ITEM), "whole environment")


def obfuscation(line: Column, path: Column) -> Column:
    executes = search(line, EXECUTES)
    run = F.regexp_extract(line, f"(?Ud){LONG_RUN}", 0)
    return (
        F.when(search(line, BASE64, True) & executes, "base64 executed")
        .when((run != "") & (entropy(run) >= LONG_RUN_ENTROPY), "long high-entropy text")
        .when(search(line, HEX) & executes, "hex executed")
    )


def dependency(line: Column, path: Column) -> Column:
    return F.when(search(line, PIP_URL), "package from a URL (pip)").when(search(line, NPM_URL), "package from a URL (npm)").when(search(line, PIPED), "download piped to an interpreter")


def persistence(line: Column, path: Column) -> Column:
    return (
        F.when(search(line, CRON), "cron")
        .when(search(line, REGISTRY, True), "registry")
        .when(search(line, SYSTEMD), "service")
        .when(search(line, AUTOSTART), "autostart")
        .when(search(line, SUDO) & search(line, RAISES), "privilege")
    )


def secret(line: Column, path: Column) -> Column:
    s = stripped(line)
    example = F.lit(False)
    for end in EXAMPLE_FILES:
        example = example | F.endswith(path, F.lit(end))
    return F.when(_starts(s, "#", "//", '"""', "'''") | example | contains_any(F.lower(s), PLACEHOLDERS), _none()).otherwise("hard-coded credential")


def sql_injection(line: Column, path: Column) -> Column:
    return F.when(search(line, SQL_VERB, True) & contains_any(line, SQL_JOINED), "query from strings")


def command_injection(line: Column, path: Column) -> Column:
    return F.when(~search(line, SHELL_TRUE), _none()).when(contains_any(line, SHELL_JOINED), "dynamic shell").otherwise("shell")


def weak_crypto(line: Column, path: Column) -> Column:
    word = search(line, PASSWORD, True)
    return F.when(search(line, MD5) & word, "md5 of a password").when(search(line, SHA1) & word, "sha1 of a password").otherwise("weak algorithm")


def path_traversal(line: Column, path: Column) -> Column:
    return F.when(search(line, FILE_CALL) & (search(line, PATH_INPUT) | F.contains(line, F.lit("+"))), "path from input")


def deserialisation(line: Column, path: Column) -> Column:
    return (
        F.when(search(line, PICKLE), "pickle")
        .when(search(line, YAML), "yaml")
        .when(search(line, MARSHAL), "marshal")
        .when(search(line, JSON_PARSE) & search(line, FOREIGN, True), "json of a user")
        .otherwise("unsafe loader")
    )


def xss(line: Column, path: Column) -> Column:
    """A returned f-string counts if the line has no return, or after its last one a brace, or names a request."""
    tail = F.element_at(F.split(line, "return"), -1)
    returned = search(line, RETURNED_HTML) & (~F.contains(line, F.lit("return")) | search(line, REQUEST) | F.contains(tail, F.lit("{")))
    return F.when(search(line, DOM), F.when(search(line, DOM_INPUT), "user data in HTML").otherwise("unsafe HTML")).when(returned, "embedded in HTML")


def insecure_random(line: Column, path: Column) -> Column:
    low = F.lower(line)
    return (
        F.when(search(line, PYTHON_RANDOM) & contains_any(low, PYTHON_RANDOM_WORDS), "security from random")
        .when(search(line, JS_RANDOM) & contains_any(low, JS_RANDOM_WORDS), "security from Math.random")
        .otherwise("not cryptographic")
    )
