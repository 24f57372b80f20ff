"""Secret scan by assignment-aware lexing.

Three fixed patterns give the base spans. Beside them, texts are lexed as source or configuration: quoted literals, names, references
and operators become (name, expression) pairs, from assignments, mappings, index targets, calls, command-line flags, headers,
tags, name/value attributes and user data in addresses. Names are constants: an expression that refers to one takes the literals
it was last given (or is given later, if not before), through any number of steps and joins. A pair whose name tells of a secret
scores its literals by that name and by how random they look; what reaches ``THRESHOLD`` is a found literal.

Lexing is linear in the text: a quote that does not close on its line opens no further literal of its kind there, and what
a value is made of is summed up once and reported once. Texts without any of ``_STEMS`` have no name that can
score and are not lexed. Documents are independent: nothing shuffles, and hot sources or repeated texts do not meet.

Defined results: null text counts as empty and has no spans; a null doc_id stays null; repeated rows get equal rows; invalid UTF-8
counts as the replacement character; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feescope.llm.common import strings

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

THRESHOLD = 0.45

# --- names and literals ------------------------------------------------------------

#: What a word of a name says about the value; fixed values of this library.
_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "apikey": 1.0,
    "secret": 0.9, "token": 0.9, "credential": 0.9, "credentials": 0.9, "authorization": 0.9,
    "pass": 0.7, "pw": 0.7, "auth": 0.6, "bearer": 0.7,
}
_ENDINGS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey", "pwd")
#: "key" counts beside one of these only.
_KEY_OF = frozenset("api access private secret encryption encrypt signing sign auth master account shared storage client ssh aes hmac jwt session deploy".split())
#: Last words of names that hold something about a secret, not the secret.
_ABOUT = frozenset(
    "count length len size max min limit type name id ids url uri path file filename field label hint expiry expires expiration ttl "
    "timeout regex pattern policy index column prompt format header env var enabled required status message text title error".split()
)
_PLACEHOLDERS = frozenset(
    "changeme change_me example password passwd secret token none null nil true false undefined todo tbd test default string empty optional "
    "required redacted hidden placeholder".split()
)
_PREFIXES = ("akia", "asia", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "eyj", "aiza", "-----begin")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STEMS = re.compile(r"pass|pwd|pw\b|secret|token|key|credential|auth|bearer|://", re.IGNORECASE | re.ASCII)


def name_score(name: str) -> float:
    """How surely a value of that name is secret, from 0 to 1."""
    words = [w.lower() for w in _NAME_WORDS.findall(name)][-8:]
    if not words or words[-1] in _ABOUT or "public" in words:
        return 0.0
    best = 0.0
    for i, word in enumerate(words):
        best = max(best, _WEIGHTS.get(word, 0.0))
        if word.endswith(_ENDINGS):
            best = max(best, 0.9)
        if word in ("key", "keys") and not _KEY_OF.isdisjoint(words[max(0, i - 2) : i]):
            best = max(best, 0.9)
    return best


@dataclass(frozen=True)
class Shape:
    """What scoring a literal needs; joining two literals joins their shapes."""

    length: float
    counts: dict[str, float]
    head: str  # the whole literal, if it is no longer than ``_HEAD``
    quoted: bool

    @staticmethod
    def of(value: str, quoted: bool) -> Shape:
        return Shape(len(value), Counter(value), value[:_HEAD], quoted)

    def __add__(self, other: Shape) -> Shape:
        counts = dict(self.counts)
        for char, k in other.counts.items():
            counts[char] = min(counts.get(char, 0) + k, _MOST)
        head = (self.head + other.head)[:_HEAD] if self.length < _HEAD else self.head
        return Shape(min(self.length + other.length, _MOST), counts, head, self.quoted or other.quoted)


_HEAD = 32
_MOST = 1e12  # joins can double a literal at every step


def literal_score(shape: Shape) -> float:
    """How much a literal looks like a secret rather than a word, a place or a stand-in, from 0 to 1."""
    lower, n, chars = shape.head.lower(), shape.length, shape.counts
    if n < 6 or (n <= _HEAD and lower in _PLACEHOLDERS) or len({c.lower() for c in chars}) < 4:
        return 0.0
    if lower.startswith(_PREFIXES):
        return 1.0
    if lower.startswith(("your", "<", "${", "{{", "my_", "enter", "insert", "http://", "https://", "/", "./", "../")):
        return 0.1
    if any(c.isspace() for c in chars):
        return 0.2
    total = sum(chars.values())
    bits = -sum(k / total * math.log2(k / total) for k in chars.values())
    upper = sum(k for c, k in chars.items() if c.isupper())
    kinds = sum((any(c.islower() for c in chars), upper > 0, any(c.isdigit() for c in chars), any(not c.isalnum() for c in chars)))
    found = 0.35 * min(1.0, n / 16) + 0.35 * min(1.0, bits / 3.5) + 0.1 * kinds
    if all(c.isalpha() for c in chars) and (not upper or (upper == 1 and shape.head[0].isupper())):
        found *= 0.6 if shape.quoted else 0.4  # a word, most likely
    return min(1.0, found + (0.1 if shape.quoted else 0.0))


# --- lexer ----------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+)
    |(?P<line>\n)
    |(?P<flag>--[A-Za-z][\w-]*)
    |(?P<name>[^\W\d]\w*(?:(?:\.|->|::|-)[^\W\d]\w*)*)
    |(?P<ref>\$\{[^}\n]{1,200}\}|\$[A-Za-z_]\w*|\{\{[^}\n]{1,200}\}\}|%\([\w.]{1,200}\)s)
    |(?P<assign>:=|=>|\+=|=(?!=)|(?<![:]):(?![:/]))
    |(?P<compare>==+|!=|<=|>=|::|:)
    |(?P<quote>\"\"\"|'''|["'`])
    |(?P<open>[(\[{])|(?P<close>[)\]}])
    |(?P<comma>,)|(?P<end>;)|(?P<less><)|(?P<more>>)
    |(?P<number>\d[\w.]*)
    |(?P<other>.)""",
    re.VERBOSE,
)
_BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+") for q in "\"'`"}
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_BLANKS = re.compile(r"[^\S\n]*")
_WORD = re.compile(r"[^\W\d]\w*(?:(?:\.|->|::|-)[^\W\d]\w*)*\Z")
_REFERENCE = re.compile(r"[^\W\d][\w.]*")
_TYPED = re.compile(r"[^\S\n]{0,9}[\w.\[\]<>|?]{1,60}[^\S\n]{0,9}=(?!=)")
_USER = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"'`]{1,200}:([^\s/@\"'`]{1,500})@")
_SCHEMES = frozenset(("bearer", "basic"))
_ASKS = frozenset("get getenv env environ read load find fetch prompt input ask check verify validate is has require".split())


class Lexer:
    """Pairs of one text. Literals are (start, end, quoted) spans of their content."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.dead: dict[str, int] = {}  # a quote without partner on its line, and where that line ends

    def quoted(self, at: int) -> tuple[int, int, int] | None:
        """(start, end, after) of the literal whose quote stands at ``at``."""
        text, quote = self.text, self.text[at]
        triple = text[at : at + 3]
        if triple in ('"""', "'''"):
            if self.dead.get(triple, 0) <= at:
                end = text.find(triple, at + 3)
                if end >= 0:
                    return at + 3, end, end + 3
                self.dead[triple] = len(text)
            return None
        if self.dead.get(quote, 0) > at:
            return None
        end = _BODY[quote].match(text, at + 1).end()
        if text[end : end + 1] == quote:
            return at + 1, end, end + 1
        line = text.find("\n", at)
        self.dead[quote] = len(text) if line < 0 else line
        return None

    def expression(self, at: int, lines: bool) -> tuple[list, int]:
        """Operands of the value at ``at`` and where it ends.

        An operand is a literal (start, end, quoted), a word (start, end, the word) that may name a constant, or a name.
        """
        text, parts = self.text, []
        at = _BLANKS.match(text, at).end()
        while lines and text[at : at + 1] == "\n":
            at = _BLANKS.match(text, at + 1).end()
        while True:
            char = text[at : at + 1]
            if char and char in "\"'`":
                found = self.quoted(at)
                if not found:
                    break
                parts.append((found[0], found[1], True))
                at = found[2]
            else:
                token = _TOKEN.match(text, at)
                if token and token.lastgroup == "ref":
                    parts.append(_REFERENCE.search(token[0])[0] if _REFERENCE.search(token[0]) else "")
                    at = token.end()
                else:
                    bare = _BARE.match(text, at)
                    if not bare or bare[0] in ("+", ".", "|", ">", "-", "&"):
                        break
                    after = bare.end()
                    if bare[0].lower() in _SCHEMES:
                        at = _BLANKS.match(text, after).end()
                        continue
                    if text[after : after + 1] in ("(", "[") or (bare[0] in ("r", "b", "f", "u", "L") and text[after : after + 1] in ("'", '"')):
                        if text[after] in "([":
                            break  # a call or an index: its arguments are read as such
                        at = after
                        continue
                    parts.append((at, after, bare[0] if _WORD.match(bare[0]) else False))
                    at = after
            after = _BLANKS.match(text, at).end()
            if text[after : after + 1] == "+" or (text[after : after + 1] == "." and text[after + 1 : after + 2].isspace()):
                at = _BLANKS.match(text, after + 1).end()
                while text[at : at + 1] == "\n":  # the rest of a sum may stand on the next line
                    at = _BLANKS.match(text, at + 1).end()
                continue
            if parts and text[after : after + 1] in ('"', "'") and isinstance(parts[-1], tuple) and parts[-1][2] is True:
                at = after  # neighbouring literals are one
                continue
            break
        return parts, at

    def pairs(self):
        """Yield (name, operands) in the order of the text."""
        text, n, at = self.text, len(self.text), 0
        target, target_end, depth, tag = "", -1, 0, ""
        calls: list[str] = []
        named = ""  # the literal of the last name= or key= pair, for the value= that follows
        while at < n:
            token = _TOKEN.match(text, at)
            kind, start, at = token.lastgroup, at, token.end()
            if kind == "space":
                continue
            if kind == "name":
                tag = token[0] if tag == "<" else ""
                target, target_end = token[0], at
            elif kind == "quote":
                found = self.quoted(start)
                tag = ""
                if not found:
                    at = start + 1
                    continue
                inner = text[found[0] : found[1]] if found[1] - found[0] < 200 else ""
                after = _BLANKS.match(text, found[2]).end()
                follows = text[after : after + 1]
                if calls and follows == "," and _WORD.match(inner):
                    parts, end = self.expression(after + 1, True)
                    if parts and isinstance(parts[0], tuple) and parts[0][2] is True:
                        yield inner, parts
                        at = end
                        continue
                callee = calls[-1] if calls else ""
                if callee:
                    yield callee, [(found[0], found[1], True)]
                yield "", [(found[0], found[1], True)]
                target, target_end = (inner if _WORD.match(inner) else ""), found[2]
                at = found[2]
                if follows == "]":  # an index: the name it holds is the target
                    target_end = at = after + 1
            elif kind == "flag":
                follows = text[at : at + 1]
                if follows and follows in " =":
                    parts, end = self.expression(at + 1, False)
                    if parts and text[at + 1 : at + 2] != "-":
                        yield token[0], parts
                        at = end
            elif kind == "assign":
                tag = ""
                gap = text[target_end:start] if 0 <= target_end <= start and start - target_end < 80 else None
                if target and gap is not None and not gap.strip(" \t)]?!\"'`"):
                    name = target
                    if token[0] == ":":  # name: type = value
                        typed = _TYPED.match(text, at)
                        at = typed.end() if typed else at
                    parts, end = self.expression(at, depth > 0)
                    last = name.rsplit(".", 1)[-1].lower()
                    if last in ("value", "content", "default") and named:
                        yield named, parts
                        named = ""
                    else:
                        yield name, parts
                        named = ""
                        if last in ("name", "key", "id", "property") and len(parts) == 1 and isinstance(parts[0], tuple):
                            named = text[parts[0][0] : parts[0][1]][:200]
                    at = max(at, end) if parts else at
                target = ""
            elif kind == "open":
                depth += 1
                name = target if token[0] == "(" and target_end == start else ""
                words = [w.lower() for w in _NAME_WORDS.findall(name)]
                calls.append("" if _ASKS.intersection(words) else name)
                target, tag = "", ""
            elif kind == "close":
                depth = max(0, depth - 1)
                if calls:
                    calls.pop()
                if token[0] == "]" and target:
                    target_end = at
                tag = ""
            elif kind == "less":
                tag = "<"
            elif kind == "more":
                if tag and tag != "<":
                    stop = text.find("<", at, at + 2000)
                    inner = text[at:stop] if stop > 0 else ""
                    if inner.strip() and "\n" not in inner.strip() and text.startswith(f"</{tag}", stop):
                        first = at + len(inner) - len(inner.lstrip())
                        yield tag, [(first, first + len(inner.strip()), True)]
                        at = stop
                tag = ""
            elif kind in ("line", "end"):
                target = "" if kind == "end" or not depth else target
                tag = ""
                if kind == "line" and not depth:
                    calls.clear()
            elif kind != "comma":
                tag = ""


def found_literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that a sensitive name receives, by start."""
    if not _STEMS.search(text):
        return []
    names: dict[str, float] = {}
    constants: dict[str, int] = {}  # name -> the value it has now
    values: list[list] = []  # operands: (start, end, quoted), a value's number, or a (name, span or None) not yet known
    sinks: list[tuple[float, str, int]] = []
    for name, parts in Lexer(text).pairs():
        if not parts:
            continue
        operands = []
        for part in parts:
            refers = part if isinstance(part, str) else part[2] if isinstance(part[2], str) else None
            if refers is None:
                operands.append(part)
                continue
            known = constants.get(refers, constants.get(refers.rsplit(".", 1)[-1]))
            span = None if isinstance(part, str) else (part[0], part[1], False)
            operands.append(known if known is not None else (refers, span))
        values.append(operands)
        if name:
            if name not in names:
                names[name] = name_score(name)
            if names[name]:
                sinks.append((names[name], name, len(values) - 1))
            constants[name] = constants[name.rsplit(".", 1)[-1]] = len(values) - 1

    def operands_of(k: int) -> list:
        """Spans and numbers: names unknown before now have the value they were given last, or are bare words."""
        found = []
        for part in values[k]:
            if not isinstance(part, int) and len(part) == 2:
                part = constants.get(part[0], part[1])
            if part is not None:
                found.append(part)
        return found

    shapes: dict[int, Shape | None] = {}

    def shape_of(k: int) -> Shape | None:
        """Of all literals that make up value ``k``, each value once; a value inside itself adds nothing."""
        stack = [k]
        while stack:
            at = stack[-1]
            if at in shapes and shapes[at] is not ...:
                stack.pop()
                continue
            parts = operands_of(at)
            if at not in shapes:
                shapes[at] = ...
                stack += [x for x in parts if isinstance(x, int) and x not in shapes]
                continue
            whole = None
            for x in parts:
                one = shapes.get(x) if isinstance(x, int) else Shape.of(text[x[0] : x[1]], x[2])
                if one is not None and one is not ...:
                    whole = one if whole is None else whole + one
            shapes[at] = whole
            stack.pop()
        return shapes[k]

    found: dict[tuple[int, int], tuple[str, float]] = {}
    reported: set[int] = set()
    for weight, name, k in sinks:
        shape = shape_of(k)
        score = weight * literal_score(shape) if shape else 0.0
        if score < threshold:
            continue
        stack = [k]
        while stack:
            at = stack.pop()
            if at in reported:
                continue
            reported.add(at)
            for x in operands_of(at):
                if isinstance(x, int):
                    stack.append(x)
                elif x[1] > x[0]:
                    found.setdefault((x[0], x[1]), (name, round(score, 3)))
    for match in _USER.finditer(text):
        score = literal_score(Shape.of(match[1], True))
        if score >= threshold:
            found.setdefault(match.span(1), ("url", round(score, 3)))
    return [(a, b, *rest) for (a, b), rest in sorted(found.items())]


# --- base patterns -----------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    spans = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of 32 or more digits is a match of one or more digits that is long enough.
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans])


def _scan(text: str, threshold: float):
    """(base spans, found literals)."""
    return base_spans(text), found_literals(text, threshold)


_SPANS = "array<struct<kind:string,start:long,end:long,name:string,score:double>>"


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id and ``spans``, by start and kind, in code points, ends exclusive.

    Kinds are ``assign``, ``access``, ``hex`` (the fixed patterns) and ``literal`` (with ``name`` and ``score``), the last only
    for literals that do not lie inside a span of the others.
    """

    def run(batches):
        item = pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]
        )
        for batch in batches:
            rows, offsets = [], [0]
            for raw in strings(batch.column(1)):
                base, literals = _scan(raw.decode("utf-8", "replace"), threshold)
                spans = [(a, kind, b, None, None) for a, kind, b in base]
                reach, k = -1, 0
                for a, b, name, score in literals:  # both by start
                    while k < len(base) and base[k][0] <= a:
                        reach = max(reach, base[k][2])
                        k += 1
                    if b > reach:
                        spans.append((a, 3, b, name, score))
                rows += sorted(spans, key=lambda s: s[:2])
                offsets.append(len(rows))
            columns = list(zip(*rows)) if rows else [[]] * 5
            values = [
                pa.array([KINDS[k] for k in columns[1]], pa.string()),
                pa.array(columns[0], pa.int64()),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.string()),
                pa.array(columns[4], pa.float64()),
            ]
            spans = pa.ListArray.from_arrays(np.array(offsets, np.int32), pa.StructArray.from_arrays(values, fields=list(item)))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, f"doc_id long, spans {_SPANS}")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts and a checksum of the base spans of every document, and all its spans as text."""
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count("literal"),
    )
