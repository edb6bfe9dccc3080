"""Credentials embedded in source code, configuration and notes.

Token formats, key armor and connection strings are combined into one deterministic
automaton. It runs over overlapping chunks of all texts at once and gives the absolute spans of what it recognises, each
once; judges refuse placeholders. A second automaton points to lines where a name announces a value that has no
format of its own; those are parsed into the spans of secret values. Redaction splices a
placeholder into each span and leaves every other character as it was.
"""

from __future__ import annotations

import base64
import binascii
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .automaton import Automaton, compile_search

PLACEHOLDER = "[REDACTED]"
#: Bytes of a chunk that a lane of the automaton scans, and of the overlap with the next.
CHUNK, OVERLAP = 1024, 256

TOKEN, ARMOR, URL = range(3)
_LEFT = "[^A-Za-z0-9_/+]"
#: Before formats that hold dots and dashes: of these only the mark of a changed line.
_LEFT_OF_DASHED = "([^A-Za-z0-9_/+.\\-]|\n[+\\-])"
#: (grammar, ignore case, kind): whole formats, each with the character before it where one is asked for.
FORMATS = [
    (_LEFT + "A(K|S)IA[0-9A-Z]{16}", False, TOKEN),
    (_LEFT + "gh[pousr]_[A-Za-z0-9]{30,}", False, TOKEN),
    (_LEFT_OF_DASHED + "xox[abeprs]-[A-Za-z0-9\\-]{12,}", False, TOKEN),
    (_LEFT + "[srp]k_(live|test)_[A-Za-z0-9]{16,}", False, TOKEN),
    (_LEFT_OF_DASHED + "eyJ[A-Za-z0-9_\\-]{8,}\\.[A-Za-z0-9_\\-]{4,}(\\.[A-Za-z0-9_\\-]*)?", False, TOKEN),
    (_LEFT + "[a-z][a-z0-9]*_(tok|key|pat|sec|token|secret)_[A-Za-z0-9]{20,}", False, TOKEN),
    (_LEFT_OF_DASHED + "(glpat-[A-Za-z0-9_\\-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|AIza[A-Za-z0-9_\\-]{30,}|SG\\.[A-Za-z0-9_\\-]{16,}\\.[A-Za-z0-9_\\-]{16,})", False, TOKEN),
    ("-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----", False, ARMOR),
    ("://[^ \t\r\n:/@\"'`]+:[^ \t\r\n@\"'`/]+@", False, URL),
]
_WORD = "(passw|pwd|pass|secret|token|credential|key|auth|identified by)"
#: (grammar, ignore case): what announces a value, or a literal put together of parts.
NAMES = [
    (_WORD + "[a-z0-9_.\\-]*(>|[\"'`\\])]*[ \t]*(:|=|,|\\|\\||\\())", True),
    (_WORD + "[a-z]*[ \t]+[\"'`]?[^ \t\r\n]", True),
    ("value[\"']?[ \t]*[:=]", True),
    ("[^A-Za-z0-9](pin|pw)([ \t]+is)?[\"'`\\])]*[ \t]*[:=]", True),
    ("[^A-Za-z0-9_](-u|--user)[ =]", False),
    ("(bearer|basic) +[a-z0-9]", True),
    ("(AKIA|ASIA|gh[pousr]_|xox[abeprs]-|glpat-|npm_|hf_|AIza|SG\\.|[srp]k_live_|[srp]k_test_|eyJ|_(tok|key|pat|sec|token|secret)_|://)[^ \t\r\n\"'`]*[\"'`][ \t]*(\\+|\\.\\.|\\|\\||&|\\.)?[ \t]*[\"'`]", False),
]


@functools.lru_cache(maxsize=1)
def formats() -> Automaton:
    return compile_search(FORMATS)


@functools.lru_cache(maxsize=1)
def names() -> Automaton:
    return compile_search(NAMES)


_JOINT = re.compile(r"""(["'`])\s*(?:\+|\.\.|\|\||&|\.)?\s*\1(?=[A-Za-z0-9+/=_\-.])""")
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9_/+])(?:"
    r"A(?:KI|SI)A[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|xox[abeprs]-[A-Za-z0-9-]{12,}"
    r"|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?"
    r"|[a-z][a-z0-9]*_(?:tok|key|pat|sec|token|secret)_[A-Za-z0-9]{20,}"
    r"|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|AIza[A-Za-z0-9_-]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r")"
)
_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINE = re.compile(r"""[+\- ]?[ \t>#*/"'`]*(?P<body>[A-Za-z0-9+/=]+)(?:\\[nr])*["'`,;+ \t\\]*\r?""")
_KEY_HEAD = re.compile(r"""[+\- ]?[ \t>#*/"'`]*(?:(?:Proc-Type|DEK-Info|Version|Comment):.*|\r?)""")
_ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{24,}|[+\- ]?\s*[A-Za-z0-9+/=]+\r?$|[+\- ]?\s*\.\.\. \((?:diff )?truncated|(?:Proc-Type|DEK-Info|Version|Comment):")
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*://([^\s:/@"'`]*):([^\s@"'`/]+)@""")
_USER = re.compile(r"""(?:^[+\-]?|\s)(?:-u|--user)[ =]["']?([^\s:"']+):([^\s"']+)""")
_SCHEME = re.compile(r"""(?i)\b(bearer|basic)\s+([A-Za-z0-9+/=._~\-]{8,})""")
_XML = re.compile(r"""<([A-Za-z][\w.\-]*)>([^<>]+)</\1>""")
# A name and a quoted value: assignments, defaults, arguments, JSON, calls and declarations.
_QUOTED = re.compile(r"""(?P<name>[A-Za-z_][\w.\-]*(?: [A-Za-z_][\w\-]*){0,6}?)["'`\])]*(?:\s*:\s*[A-Za-z_][\w.\[\]]*(?=\s*=))?\s*(?::=|=>|\|\||=|:|,|\(|(?<=\s))\s*(?:[bru]|std::string\()?(?=(?P<q>["'`])(?P<v>(?:(?!(?P=q)).)*)(?P=q))""")
_BARE = re.compile(r"""^[+\- ]?\s*(?:(?:export|set|ENV|ARG)\s+|-\s+|--\s+|#\s*|//\s*)?(?P<name>[A-Za-z_][\w.\-]*(?: [A-Za-z_][\w\-]*){0,4})\s*[:=]\s*(?P<v>[^\s"'`]+)\s*$""")
_SAID = re.compile(r"""(?i)(?P<name>\b(?:[\w\-]+ )?(?:password|passwd|passphrase|pwd|pw|api key|access key|secret key|secret|token|pin)\b)(?:\s+is)?\s*:\s*(?P<v>[^\s"'`]+)""")
#: What a `pin` holds that is none to enter: a contact of a board or a version.
_PLACE = re.compile(r"[A-Za-z]{1,5}[-_]?\d{1,3}|[<>=~^!v]*\d+(?:\.[\dx*]+)+.*|[\w.\-]+[<>=~!]=.*")
_WITH = re.compile(r"""(?i)\bwith the (?P<name>(?:[\w\-]+ ){0,5}(?:password|passwd|passphrase|pwd|\w*key|secret|token|credential|pass))\s+["'`]?(?P<v>[^\s"'`]+)""")
_NETRC = re.compile(r"""(?i)\b(?:login\s+\S+\s+password|identified\s+by|password)\s+(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)""")
_FLAG = re.compile(r"""(?:^|\s)--?(?P<name>[a-z][a-z0-9\-]*)[= ](?P<v>[^\s"'`\-][^\s"'`]*)""")
_NAME_LINE = re.compile(r"""^[+\- ]?\s*-?\s*["']?(?:name|key)["']?\s*[:=]\s*["']?([\w.\-]+)["']?,?\s*$""", re.I)
_VALUE_LINE = re.compile(r"""^[+\- ]?\s*["']?value["']?\s*[:=]\s*(?P<q>["']?)(?P<v>[^\s"']+)(?P=q),?\s*$""", re.I)

# Words of a name that make its value a secret, and last words that make it something about one.
_SECRET_WORDS = {"pw", "password", "passwd", "pwd", "passphrase", "pass", "secret", "secrets", "token", "apikey", "credential", "credentials", "passcode"}
_ABOUT = set("ref refs reference header headers field fields name names type types kind count counts path paths file files dir length len size min max limit budget url uri endpoint host id ids uuid hash digest checksum sha256 prefix suffix format pattern regex policy provider manager store expiry expires ttl age version label hint column env var variable enabled required rotation interval days hours seconds status index scope scopes param parameter parser izer tokenizer tokens alg algorithm usage".split())
#: Last words of names whose value is one to enter, so that words and blanks may be in it.
_ENTERED = {"pw", "password", "passwd", "pwd", "passphrase", "passcode"}
_PLAIN_KEYS = {"public", "primary", "foreign", "idempotency"}
_NOT = re.compile(
    r"(?i)^(?:|change[-_ ]?(?:me|it|this).*|dummy.*|redacted.*|replace[-_ ]?(?:me|this|with).*|todo\b.*|tbd|fixme.*|your[-_ ].*|my[-_ ](?:password|secret|token|key).*|<.*>?|x{3,}[-_x]*|\*+|\.{2,}|-+|_+|#+|none|null|nil|undefined|true|false|yes|no|empty|example[-_ ]?(?:password|passwd|secret|token|key|value)?|placeholder.*|pass|pwd|user(?:name)?|insert[-_ ](?:your|the|my|a|key|token|password|secret|here)\b.*|fill[-_ ](?:me|this|in)\b.*|sample|test|foo|bar|n/?a|\[.*\]?|\{.*\}?|%[sdv]|%[({].*|\$.*|@.*|env[:.(].*|os\.(?:environ|getenv).*|process\.env.*|(?:vault|ssm|arn|file|secret|secrets|secretref|keyring|kms|op|gcp|aws|azure|sops|ref|config)[:+].*|x-[a-z][a-z-]*|bearer|basic|digest|password|secret|token|api[-_ ]?key|hidden|masked|removed|unset|not[-_ ]set|default)$"
)
_PATH = re.compile(r"^(?:[\w.\-]*/)+[\w.\-]*$")
_WORDS = re.compile(r"^[A-Za-z]+(?:[-_ .][A-Za-z]+)*$")
#: Words that a password's field says about it and that are none.
_SAID_OF = set("string varchar required optional integer number boolean object prompt stdin interactive encrypted hashed plain plaintext invalid wrong incorrect missing expired changed reset forgotten forgot confirm repeat login secure strong weak field input label value default unknown disabled enabled nullable".split())
#: A pass phrase: three words or more in lower case, without those that sentences are made of.
_PHRASE = re.compile(r"(?!.*\b(?:the|a|an|is|are|of|to|for|in|on|and|or|your|my|must|should|be|with|this|that|not|no|from)\b)[a-z]{3,}(?: [a-z]{3,}){2,7}")
_SNAKE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_words(name: str) -> list[str]:
    """`aws.SecretAccessKey` as [secret, access, key]."""
    return [w.lower() for w in _SNAKE.findall(name.rsplit(".", 1)[-1])]


def name_power(name: str) -> int:
    """2: the name says secret, 1: some key, 0: neither, or something about one."""
    words = name_words(name)
    while words and words[-1].isdigit():
        words.pop()
    if words[:1] == ["set"] and len(words) > 1:
        words = words[1:]
    if not words or words[-1] in _ABOUT:
        return 0
    if words[-2:] in (["api", "key"], ["access", "key"], ["secret", "key"], ["private", "key"], ["signing", "key"], ["encryption", "key"], ["auth", "key"], ["account", "key"]) or words[-1] in _SECRET_WORDS:
        return 2
    if words[-1] == "key":
        return 0 if len(words) > 1 and words[-2] in _PLAIN_KEYS or len(words) == 1 else 1
    return 2 if _SECRET_WORDS & set(words) - {"pass", "token"} else 0


def _odd_case(v: str) -> bool:
    """Capitals where no word, acronym or compound has them."""
    return len(v) >= 8 and any(not re.fullmatch(r"[a-z]*|[A-Z]*|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*", x) for x in re.split(r"[-_ .+/=]", v))


def _random(v: str) -> bool:
    """No word or number: letters and digits mixed, over a length."""
    if len(v) < 16 or len(set(v)) < 8:
        return False
    if len(v) >= 24 and " " not in v and _odd_case(v) and not re.search(r"\d", v):
        return True
    return bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and not re.fullmatch(r"[a-z]+(?:[-_/.][a-z]+)*(?:[-_/.]?\d+)?", v) and " " not in v)


def entered(name: str) -> bool:
    """Whether a name says that its value is a password, and nothing about one."""
    words = name_words(name.replace(" ", "_"))
    while words and words[-1].isdigit():
        words.pop()
    return bool(words) and words[-1] in _ENTERED


def is_secret(v: str, power: int, bare: bool = False, entered: bool = False) -> bool:
    """Whether a value that stands under a name of this power is a literal secret; words are one under a name of passwords."""
    v = v.strip()
    if power == 0 or len(v) < 4 or _NOT.match(v) or " " in v and not (entered and not bare and _PHRASE.fullmatch(v)):
        return False
    if re.search(r"\$\{|\{\{|\$\(|<[a-z]|%\(|\bgetenv\b|environ\b", v) or bare and re.search(r"[()\[\]{}]|^\d+$|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$|^https?://", v):
        return False
    if re.match(r"[a-z][a-z0-9+.\-]*://", v) or len(set(v)) <= 2:
        return False
    if power == 1:
        return _random(v) and not _PATH.match(v) or bool(re.search(r"/", v) and len(v) >= 30 and _random(v))
    if _WORDS.match(v) and not _odd_case(v) and not re.search(r"[a-z][A-Z]+[a-z]", v):
        return entered and bool(_PHRASE.fullmatch(v) if " " in v else re.fullmatch(r"[a-z]{5,}|[A-Z][a-z]{4,}", v) and v.lower() not in _SAID_OF)
    if re.fullmatch(r"[a-z_]+(?:/[a-z_]+)+", v) or re.fullmatch(r"\d{1,5}|\d+\.\d+|\d+[smhd]", v):
        return False
    return True


def _basic(v: str) -> bool:
    try:
        text = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return len(v) >= 12 and _random(v)
    user, sep, word = text.partition(":")
    return bool(sep) and bool(word) and not _NOT.match(word)


def _bearer(v: str) -> bool:
    return not _NOT.match(v) and bool(re.search(r"\d", v)) and len(v) >= 12


def _token(v: str) -> bool:
    return "EXAMPLE" not in v and len(set(v[-16:])) > 5


def _in_url(v: str) -> bool:
    return not _NOT.match(v) and "${" not in v and "{{" not in v


def _armor(rest: str, after: str | None) -> tuple[int, int] | bool:
    """Of what follows key armor on its line: the key's span there, or whether a key follows below."""
    if re.match(r"(?:\\r)?\\n|\s*[A-Za-z0-9+/]{24}", rest):
        stop = _ARMOR_END.search(rest)
        end = stop.start() if stop else len(re.match(r"(?:\\[rn]|[A-Za-z0-9+/=\s])*", rest).group())
        return (0, end) if end else True
    return not rest.strip(" \t\r\"'`,;\\+)") and bool(after is None or _KEY_BODY.match(after) or re.search(r"[A-Za-z0-9+/=]{24}", after))


def line_spans(line: str, before: str = "", after: str | None = None, known: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int]]:
    """Spans of the secret values of a line, in order and apart.

    `before` and `after` are the lines around it: a value may be named on the line above,
    and armor needs a key under it (None: the text ends there). `known` are the (start, end, kind) that the automaton of formats
    has found on the line; without it, and where literals are put together of parts, they are looked for here.
    """
    # Literals put together of parts are read as one; `at` leads back.
    joined, at, last = [], [], 0
    for m in _JOINT.finditer(line):
        joined.append(line[last : m.start()])
        at += range(last, m.start())
        last = m.end()
    joined.append(line[last:])
    at += range(last, len(line) + 1)
    text = "".join(joined)
    spans: list[tuple[int, int]] = []

    def take(a: int, z: int):
        if z > a:
            spans.append((at[a], at[z - 1] + 1))

    if known is None or last:
        known = [(*m.span(), TOKEN) for m in _TOKEN.finditer(text)] + [(*m.span(), ARMOR) for m in _ARMOR.finditer(text)] + [(m.start(1) - 3, m.end(), URL) for m in _URL.finditer(text)]
    for a, z, kind in known:
        if kind == TOKEN:
            if _token(text[a:z]):
                take(a, z)
        elif kind == ARMOR:
            key = _armor(text[z:], after)
            if isinstance(key, tuple):
                take(z + key[0], z + key[1])
            elif key:
                take(a, z)
        else:
            colon = text.index(":", a + 3)
            if a and text[a - 1].isalnum() and _in_url(text[colon + 1 : z - 1]):
                take(colon + 1, z - 1)
    if not _ANNOUNCED.search(text):
        return _apart(spans)
    for m in _USER.finditer(text):
        if not _NOT.match(m[2]) and not m[2].startswith("/"):
            take(*m.span(2))
    for m in _SCHEME.finditer(text):
        if _basic(m[2]) if m[1].lower() == "basic" else _bearer(m[2]):
            take(*m.span(2))
    for m in _XML.finditer(text):
        if is_secret(m[2], name_power(m[1])):
            take(*m.span(2))
    for m in _QUOTED.finditer(text):
        name = m["name"]
        own = name.rsplit(" ", 1)[-1]
        if is_secret(m["v"], name_power(own) or _phrase_power(name), False, entered(own)) or name_words(own)[-1:] == ["pin"] and re.fullmatch(r"\d{4,12}", m["v"]):
            take(*m.span("v"))
    for m in _WITH.finditer(text):
        if is_secret(m["v"], 2):
            take(*m.span("v"))
    for m in _NETRC.finditer(text):
        if _said(m["v"]) and (m["q"] or "login" in m.group().lower()):
            take(*m.span("v"))
    m = _BARE.match(text)
    if m and is_secret(m["v"], name_power(m["name"].replace(" ", "_")), True, entered(m["name"]) and " " not in m["name"]):
        take(*m.span("v"))
    for m in _SAID.finditer(text):
        if _said(m["v"]) and is_secret(m["v"].rstrip(".,;"), 2, True) and (name_power(m["name"].replace(" ", "_")) or _pin(m["name"], m["v"])):
            take(m.start("v"), m.start("v") + len(m["v"].rstrip(".,;")))
    for m in _FLAG.finditer(text):
        if is_secret(m["v"], name_power(m["name"]), True):
            take(*m.span("v"))
    m = _VALUE_LINE.match(text)
    if m and (above := _NAME_LINE.match(before)) and is_secret(m["v"], name_power(above[1]), True):
        take(*m.span("v"))
    return _apart(spans)


#: What any of the parsers below the formats needs in a line.
_ANNOUNCED = re.compile(r"(?i)pass|pwd|pw\b|secret|token|credential|key|auth|identified|value|pin\b|-u\b|--user|bearer|basic")


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _phrase_power(name: str) -> int:
    return name_power(name.replace(" ", "_")) if " " in name else 0


def _pin(name: str, v: str) -> bool:
    return bool(re.fullmatch(r"(?i)(?:(?:the|a|my|your|our|new|old|card|sim|account|user|admin|login|access|security) )?pin", name)) and not _PLACE.fullmatch(v)


def _said(v: str) -> bool:
    turns = len(re.findall(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])", v))
    return bool(re.search(r"\d|[^\w\s]", v) or _odd_case(v) and turns >= 4) and not _NOT.match(v)


def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(line from 1, start, end) of each secret value of each text, offsets in characters."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    flat = b"\n".join(raw) + b"\n"
    data = np.frombuffer(flat, np.uint8)
    found = formats().spans(data, CHUNK, OVERLAP, 10)
    ends = names().ends(data, CHUNK, OVERLAP, 10)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], breaks + 1])
    on = np.searchsorted(breaks, [e - 1 for _, e, _ in found])
    lines = np.unique(np.concatenate([np.searchsorted(breaks, ends), on]).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    first = np.searchsorted(starts, offsets[:-1])  # the first line of each text
    owner = np.searchsorted(offsets, starts[lines], "right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    by_line: dict[int, list[tuple[int, int, int]]] = {}
    for (a, z, kind), i in zip(found, on.tolist()):
        a = max(a, int(starts[i]))  # what stands before a format may be the break
        by_line.setdefault(i, []).append((a - int(starts[i]), z - int(starts[i]), kind))

    def line(i: int) -> str:
        return flat[starts[i] : breaks[i]].decode("utf-8", "surrogatepass")

    def known(i: int) -> list[tuple[int, int, int]]:
        """The line's formats in characters, tokens without what stands before them."""
        spans, bytes_ = [], flat[starts[i] : breaks[i]]
        for a, z, kind in by_line.get(i, ()):
            text = bytes_[a:z].decode("utf-8", "ignore")
            if kind == TOKEN:
                m = _TOKEN_START.search(text)
                z_text = len(bytes_[:z].decode("utf-8", "surrogatepass"))
                spans.append((z_text - len(text) + m.start(), z_text, kind))
            else:
                z_text = len(bytes_[:z].decode("utf-8", "surrogatepass"))
                spans.append((z_text - len(text), z_text, kind))
        return spans

    base = -1
    for i, t in zip(lines.tolist(), owner.tolist()):
        lo, hi = int(first[t]), int(first[t + 1]) if t + 1 < len(texts) else len(breaks)
        got = line_spans(line(i), line(i - 1) if i > lo else "", line(i + 1) if i + 1 < hi else None, known(i))
        if got:
            if base != t:  # characters before each line of this text
                chars, seen, base = 0, lo, t
            chars += sum(len(line(j)) + 1 for j in range(seen, i))
            seen = i
            out[t] += [(i - lo + 1, chars + a, chars + z) for a, z in got]
    return out


_TOKEN_START = re.compile(r"[A-Za-z]")


def key_body(text: str, start: int) -> int:
    """Where the body of a private key ends whose armor ends at `start`: before its end armor, else behind the last line that can be a part of it.

    Lines of the body are base64 alone, 24 characters or more, with quotes and marks of code or a diff around; headers, blank lines,
    and, behind a long line, a last short one belong to it. Anything else, such as a note that the text was cut, ends it.
    """
    at = end = start
    nl = text.find("\n", start)
    long = False
    while nl >= 0:
        at = nl + 1
        nl = text.find("\n", at)
        line = text[at : nl if nl >= 0 else len(text)]
        if stop := _ARMOR_END.search(line):
            return at + stop.start()
        m = _KEY_LINE.fullmatch(line)
        if m and len(m["body"]) >= 24:
            long = True
        elif m and long and (m["body"].endswith("=") or nl >= 0 and _ARMOR_END.search(text, nl + 1, nl + 80)):
            long = False
        elif _KEY_HEAD.fullmatch(line):
            continue
        else:
            break
        end = at + len(line)
    return end


def redact(text: str, found: list[tuple[int, int, int]], placeholder: str = PLACEHOLDER) -> str:
    """The text with each span replaced; the base64 of a key's lines under its armor too, and no other code."""
    out, last = [], 0
    for _, a, z in found:
        if a < last:
            continue
        if _ARMOR.fullmatch(text[a:z]):  # the armor stays, the body goes
            end = key_body(text, z)
            body = text[z:end]
            out += [text[last:z], _BASE64.sub(placeholder, body)]
            last = end
        else:
            out += [text[last:a], placeholder]
            last = z
    return "".join(out) + text[last:]


#: Runs of base64 in a key's body; its headers have none.
_BASE64 = re.compile(r"(?m)(?<![A-Za-z0-9+/=:\-])(?:[A-Za-z0-9+/=]{16,}|(?<=^)[A-Za-z0-9+/=]+(?=\r?$)|(?<=^ )[A-Za-z0-9+/=]+(?=\r?$))")


def find(df: DataFrame, key: str, text: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """(key, line_no, start, end): the secret values of every text; lines are separated by \\n, offsets count characters.

    Null and empty texts and null keys give no rows; repeated rows give repeated rows. One narrow stage.
    """
    ship(df.sparkSession)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, line_no long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for part, at in _parts(texts, batch_bytes):
                rows = [(at + i, *f) for i, found in enumerate(scan(part)) for f in found]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]], [key, "line_no", "start", "end"])

    return df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, text).mapInArrow(run, schema)


def redacted(df: DataFrame, key: str, text: str, placeholder: str = PLACEHOLDER, batch_bytes: int = 4 << 20) -> DataFrame:
    """(key, text, n_secrets): every row with its secret values replaced; nulls stay null."""
    ship(df.sparkSession)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{text}` string, n_secrets int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            new, n = [], []
            for part, _ in _parts([t or "" for t in texts], batch_bytes):
                for t, found in zip(part, scan(part)):
                    new.append(redact(t, found, placeholder))
                    n.append(len(found))
            new = [None if t is None else x for t, x in zip(texts, new)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array(n, pa.int32())], [key, text, "n_secrets"])

    return df.select(key, text).mapInArrow(run, schema)


def _parts(texts: list[str], limit: int) -> Iterator[tuple[list[str], int]]:
    """Runs of texts of about `limit` characters, with the position of each run's first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield texts[at : i + 1], at
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:], at
