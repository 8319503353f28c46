"""Query sites in source files: rules matched against masked text, hits folded to spans, spans scored and ranked per file.

A file is one task's work from its text to its best sites: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from re import _parser as re_parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.engines import dialect_of, engine_from_path
from brindle.functions.paths import extension, is_prose, path_kinds, trigger_of
from brindle.functions.rules import RULES, SYNTAX, extensions
from brindle.functions.scoring import MAX_PER_FILE, MIN_CONFIDENCE, cold_paths, confidence, priority_sum, priority_told
from brindle.operators.spans import FRAGMENT_WINDOW, WINDOW
from brindle.session import cut, small_batches

#: Matches of one rule in one file that count: None, all of them.
MATCHES_PER_RULE = None
CONTEXT_LINES = 6
#: Lines that a Ruby block without an indented body may be above; lines in which a decorator may stand; lines from a lone brace up to its header.
BLOCK_LINES, DECORATOR_LINES, HEADER_LINES = 40, 6, 3

# Rules that tell a statement's dialect.
DIALECT_RULES = frozenset("postgres-dialect postgres-placeholder mysql-dialect mssql-dialect oracle-dialect sqlite-dialect clickhouse pgvector cassandra-cql cql-file hive-file cypher cypher-file promql".split())
# How a line opens a loop or names a scope, for languages of indentation and of braces.
INDENTED = frozenset("py pyi pyx rb ex exs coffee".split())
PY_LOOP, PY_NAME = re.compile(r"^\s*(?:for|while)\b"), re.compile(r"^\s*(?:async\s+def|def|class)\s+([A-Za-z_]\w*)")
RB_LOOP, RB_NAME = re.compile(r"^\s*(?:for|while|until)\b|\.\s*(?:each|each_with_index|each_slice|map|collect|find_each|in_batches|times|upto|downto)\b\s*(?:\{|do\b)"), re.compile(r"^\s*(?:def|class|module)\s+([A-Za-z_][\w.:]*)")
EX_LOOP, EX_NAME = re.compile(r"\bEnum\.(?:each|map|reduce|flat_map)\b|\bfor\b\s+\w+\s+<-"), re.compile(r"^\s*(?:defp?|defmodule)\s+([A-Za-z_][\w.]*)")
COMPREHENSION = re.compile(r"\bfor\s+\w+\s+in\b[\s\S]*[\]\})]")
BRACE_LOOP = re.compile(r"^\s*(?:for|while|do)\b|\bfor\s*\(|\bwhile\s*\(|\.\s*(?:forEach|map|flatMap|filter|reduce)\s*\(|\bforeach\s*\(|\brange\s+")
BRACE_NAME = re.compile(
    r"(?:function\s+([A-Za-z_$]\w*)|(?:async\s+)?([A-Za-z_$]\w*)\s*\([^)]*\)\s*(?::\s*[\w<>,\[\]\s|]+)?\s*\{|(?:class|interface|struct|enum)\s+([A-Za-z_$]\w*)|func\s+(?:\([^)]*\)\s*)?([A-Za-z_$]\w*)|(?:public|private|protected|internal|static|final|override|virtual|async|\s)+[\w<>,\[\]\.]+\s+([A-Za-z_$]\w*)\s*\()"
)
BRACES = re.compile(r"[{}]")
DECORATOR = re.compile(
    r"@(?:app|blueprint|bp|router|api)\.(?:route|get|post|put|patch|delete)\b|@(?:Get|Post|Put|Patch|Delete|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping)\s*\(|@rpc_method\b|@api_view\b|@require_(?:GET|POST|http_methods)\b|@HttpGet\b|\[HttpGet\]|\[HttpPost\]"
)


@lru_cache(None)
def _masker(ext: str) -> tuple[re.Pattern, frozenset[int]] | None:
    """One pattern for a language's comments (no group) and strings (a group for the body, by quote), and the groups of triple quotes. Each branch begins with a
    letter of its own, so that a search goes from mark to mark."""
    for exts, line, block, quotes, escapes in SYNTAX:
        if ext in exts.split():
            branches = []
            if block:
                opens, closes = block.split()
                branches.append(rf"{re.escape(opens)}[\s\S]*?(?:{re.escape(closes)}|\Z)")
            if line:
                branches.append(rf"{re.escape(line)}[^\n]*")
            for quote in quotes.split():
                c = re.escape(quote[0])
                body = [rf"[^{c}\\]++", r"\\[\s\S]?"] if escapes else [rf"[^{c}]++"]
                if len(quote) == 3:
                    body.append(rf"{c}(?!{c}{c})")
                branches.append(rf"{re.escape(quote)}((?:{'|'.join(body)})*+)(?:{re.escape(quote)}|\Z)")
            return re.compile("|".join(branches)), frozenset(k for k, q in enumerate(quotes.split(), 1) if len(q) == 3)
    return None


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text) if "\n" in text else " " * len(text)


def masks(path: str, text: str) -> tuple[str, str]:
    """text with comments as spaces, and with string bodies as spaces too; every other character keeps its place. A triple-quoted string that opens its line
    documents and is blanked like a comment. Files of unknown languages stay as they are."""
    masker = _masker(_ext(path))
    if masker is None:
        return text, text
    pattern, triple = masker
    pieces: tuple[list[str], list[str]] = ([], [])
    done = [0, 0]
    for m in pattern.finditer(text):
        of = m.lastindex
        start, end = m.span() if of is None else m.span(of)
        # What a string is blanked in: only the text without strings, or both where it documents.
        both = of is None or of in triple and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        blank = _blank(text[start:end])
        for k in (0, 1) if both else (1,):
            pieces[k].append(text[done[k] : start])
            pieces[k].append(blank)
            done[k] = end
    return tuple("".join(pieces[k]) + text[done[k] :] for k in (0, 1))


def masked(path: str, text: str, strings: bool) -> str:
    """One of masks: that without strings, if asked."""
    return masks(path, text)[bool(strings)]


def _ext(path: str) -> str:
    return path.lower().rsplit(".", 1)[-1]


class Scope:
    """What surrounds a line: the headers of the loops around it (nearest first), the names of the scopes (outermost first) and the line of
    the innermost one, and whether the line itself opens a loop."""

    __slots__ = ("headers", "names", "named_at", "opens")

    def __init__(self, headers: list[str], names: list[str], named_at: int | None, opens: bool):
        self.headers, self.names, self.named_at, self.opens = headers, names, named_at, opens

    @property
    def symbol(self) -> str | None:
        return ".".join(self.names) or None


def scopes(path: str, text: str, wanted: set[int], code: str | None = None) -> dict[int, Scope]:
    """The scopes of the wanted lines (from 0), in one pass with a stack of open blocks: by indentation, or by braces.

    A line that holds nothing but a brace opens the block of the line above it. In Ruby a loop whose body is not indented counts too, and in
    languages of indentation a comprehension that stands on the line itself. code: the text without strings, where it is known.
    """
    ext = _ext(path)
    code = (masked(path, text, True) if code is None else code).split("\n")
    del code[max(wanted, default=-1) + 1 :]
    loop, name = (RB_LOOP, RB_NAME) if ext == "rb" else (EX_LOOP, EX_NAME) if ext in ("ex", "exs") else (PY_LOOP, PY_NAME) if ext in INDENTED else (BRACE_LOOP, BRACE_NAME)
    told: dict[str, tuple[str | None, str | None]] = {}

    def block(header: str) -> tuple[str | None, str | None]:
        """What a header opens: a loop, or a scope of some name."""
        if header not in told:
            m = None if loop.search(header) else name.search(header)
            told[header] = (header.strip(), None) if loop.search(header) else (None, next((g for g in m.groups() if g), None) if m else None)
        return told[header]

    def scope(k: int, opened: list[tuple[str, int]]) -> Scope:
        blocks = [(*block(header), line) for header, line in opened]
        headers = [b[0] for b in reversed(blocks) if b[0] is not None]
        if not headers and ext == "rb":
            headers = _open_block(code, k)
        if not headers and ext in INDENTED and COMPREHENSION.search(code[k]):
            headers = [code[k].strip()]
        named = [b for b in blocks if b[1]]
        return Scope(headers, [b[1] for b in named], named[-1][2] if named else None, bool(loop.search(code[k])))

    return (_by_indent if ext in INDENTED else _by_brace)(code, wanted, block, scope)


def _by_indent(code: list[str], wanted: set[int], block: Callable, scope: Callable) -> dict[int, Scope]:
    stack: list[tuple[int, str, int]] = []  # level, header, line
    out = {}
    seen: dict[str, tuple[int, bool] | tuple[()]] = {}
    for k, line in enumerate(code):
        known = seen.get(line)
        if known is None:
            known = ()
            if line.strip():
                indent = line[: len(line) - len(line.lstrip(" \t"))]
                opens = block(line)
                known = (len(indent) + 3 * indent.count("\t"), opens[0] is not None or bool(opens[1]))
            seen[line] = known
        if known:
            while stack and stack[-1][0] >= known[0]:
                stack.pop()
        if k in wanted:
            out[k] = scope(k, [s[1:] for s in stack])
        if known and known[1]:
            stack.append((known[0], line, k))
    return out


def _by_brace(code: list[str], wanted: set[int], block: Callable, scope: Callable) -> dict[int, Scope]:
    stack: list[tuple[int, str, int]] = []  # depth, header, line; what a header says is only asked while its block is open
    depth, out = 0, {}
    for k, line in enumerate(code):
        if k in wanted:
            out[k] = scope(k, [s[1:] for s in stack if s[1]])
        if "{" not in line and "}" not in line:
            continue
        header = line
        if line.strip() == "{":
            header = next((x for x in code[max(0, k - HEADER_LINES) : k][::-1] if x.strip()), line)
        for c in BRACES.findall(line):
            if c == "{":
                depth += 1
                stack.append((depth, header, k))
                header = ""
            else:
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                depth = max(0, depth - 1)
    return out


def _open_block(code: list[str], k: int) -> list[str]:
    """The Ruby loop that is open at line k without indenting it: the last one of the lines above, up to the method's head, that no later `end` closes."""
    width = lambda x: len(x) - len(x.lstrip())
    first = max(0, k - BLOCK_LINES)
    heads = [i for i in range(first, k) if RB_NAME.search(code[i])]
    opened: list[str] = []
    for line in code[heads[-1] + 1 if heads else first : k]:
        if not line.strip() or width(line) > width(code[k]):
            continue
        if re.match(r"\s*(?:end\b|\})", line):
            del opened[-1:]
        elif RB_LOOP.search(line):
            opened.append(line.strip())
    return opened[-1:]


def matches(path: str, text: str, masks_of: tuple[str, str] | None = None) -> list[tuple[int, int, int]]:
    """(start, rule, end) of every match of every rule that is for the file's extension, in the order of the text and of the rules.

    One pass of an automaton over the lines of the text, each once, tells which rules it can match at all; only those are tried. masks_of: the text's masks, where they are known.
    """
    with_strings, code = masks(path, text) if masks_of is None else masks_of
    found = []
    for k, pattern, anywhere in _tried(_ext(path), _factors_in(with_strings)):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(with_strings if anywhere else code)]
    return sorted(found, key=lambda h: h[:2])


@lru_cache(1)
def _compiled() -> list[tuple[int, re.Pattern, tuple[str, ...], bool]]:
    return [(k, re.compile(r.pattern, re.ASCII if r.cased else re.ASCII | re.IGNORECASE), extensions(r), r.anywhere) for k, r in enumerate(RULES)]


def factors(pattern: str) -> frozenset[str] | None:
    """Texts in lower case of which every match of a pattern holds one, whatever the case; None if the pattern asks for none of two letters or more."""
    return _factors_of(re_parser.parse(pattern))


def _factors_of(parsed: Iterable) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run = ""

    def ended() -> None:
        nonlocal run
        if len(run) > 1:
            found.append(frozenset((run,)))
        run = ""

    for op, argument in parsed:
        name = str(op)
        if name == "LITERAL" and 32 < argument < 127:
            run += chr(argument).lower()
            continue
        if name == "AT":  # takes no character
            continue
        ended()
        inner = None
        if name == "SUBPATTERN":
            inner = _factors_of(argument[3])
        elif name == "ATOMIC_GROUP":
            inner = _factors_of(argument)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and argument[0] > 0:
            inner = _factors_of(argument[2])
        elif name == "BRANCH":
            sides = [_factors_of(side) for side in argument[1]]
            inner = None if any(side is None for side in sides) else frozenset().union(*sides)
        if inner is not None:
            found.append(inner)
    ended()
    # The rarest are likely the longest, and few.
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def needs(pattern: str) -> list[list[frozenset[str]]]:
    """Of each side of a pattern (the branches it consists of, or itself), what every match of it holds in lower case: a text of each of these sets. Texts may be one letter long."""
    sides = [re_parser.parse(pattern)]
    while any(len(s) == 1 and str(s[0][0]) == "BRANCH" for s in sides):
        sides = [x for s in sides for x in (s[0][1][1] if len(s) == 1 and str(s[0][0]) == "BRANCH" else [s])]
    return [_needs_of(s) for s in sides]


def _needs_of(parsed: Iterable) -> list[frozenset[str]]:
    found: list[frozenset[str]] = []
    run = ""
    for op, argument in [*parsed, ("END", None)]:
        name = str(op)
        if name == "LITERAL" and 32 < argument < 127:
            run += chr(argument).lower()
            continue
        if name == "AT":  # takes no character
            continue
        if run:
            found.append(frozenset((run,)))
            run = ""
        if name == "SUBPATTERN":
            found += _needs_of(argument[3])
        elif name == "ATOMIC_GROUP":
            found += _needs_of(argument)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and argument[0] > 0:
            found += _needs_of(argument[2])
        elif name == "BRANCH":
            sides = [max(_needs_of(side), key=lambda f: (min(map(len, f)), -len(f)), default=None) for side in argument[1]]
            if None not in sides:
                found.append(frozenset().union(*sides))
    return found


@lru_cache(1)
def _needed() -> tuple[list[list[list[frozenset[str]]]], ahocorasick.Automaton, tuple[str, ...]]:
    """What each rule needs; an automaton of the texts of two letters or more that rules need; and those of one letter."""
    told = [needs(r.pattern) for r in RULES]
    words = {f for rule in told for side in rule for one in side for f in one}
    automaton = ahocorasick.Automaton()
    for w in words:
        if len(w) > 1:
            automaton.add_word(w, w)
    automaton.make_automaton()
    return told, automaton, tuple(sorted(w for w in words if len(w) == 1))


def _factors_in(text: str) -> frozenset[str]:
    """The texts that rules need of those in a text. None holds a blank: lines that repeat tell nothing new, and the text with strings speaks for the one without."""
    _, automaton, letters = _needed()
    lines = "\n".join(dict.fromkeys(text.lower().split("\n")))
    return frozenset([w for _, w in automaton.iter(lines)] + [c for c in letters if c in lines])


@lru_cache(10_000)
def _tried(ext: str, found: frozenset[str]) -> list[tuple[int, re.Pattern, bool]]:
    """The rules for an extension that a text with these factors can match."""
    told = _needed()[0]
    possible = lambda k: any(all(one & found for one in side) for side in told[k])
    return [(k, pattern, anywhere) for k, pattern, exts, anywhere in _compiled() if (not exts or ext in exts) and possible(k)]


def spans(found: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, rules) of hits that stand close together; closer is wider where the hit, or one before it in the span, is a fragment."""
    out: list[list] = []
    wide = False
    for start, rule, end in found:
        fragment = RULES[rule].name.startswith("sql-fragment")
        if out and start <= out[-1][1] + (FRAGMENT_WINDOW if fragment or wide else WINDOW):
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].append(rule)
            wide |= fragment
        else:
            out.append([start, end, [rule]])
            wide = fragment
    return [tuple(s) for s in out]


def hits(files: DataFrame) -> DataFrame:
    """(path, rule, start, end): every match of every rule in files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, s, e) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, k, e in matches(p, t or "")]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["path", "rule", "start", "end"])

    return files.select("path", "content").filter(~is_prose(F.col("path"))).mapInArrow(run, "path string, rule int, start int, end int")


_SITE = pa.struct(
    [(n, pa.string()) for n in ("detector", "dialect", "style", "symbol", "excerpt")]
    + [(n, pa.int32()) for n in ("start_line", "end_line", "n", "loop_depth")]
    + [("best", pa.float64()), ("opens_loop", pa.bool_()), ("decorated", pa.bool_()), ("named", pa.list_(pa.string()))]
)
_SITE_SQL = "detector string, dialect string, style string, symbol string, excerpt string, start_line int, end_line int, n int, loop_depth int, best double, opens_loop boolean, decorated boolean, named array<string>"


def sites(path: str, text: str) -> list[dict]:
    """A file's spans with what the rules and the surroundings say of each."""
    both = masks(path, text)
    found = spans(matches(path, text, both))
    if not found:
        return []
    lines = text.split("\n")
    firsts, line, at = [], 0, 0
    for start, _, _ in found:  # in the order of the text
        line, at = line + text.count("\n", at, start), start
        firsts.append(line)
    around = scopes(path, text, set(firsts), both[1])
    first_at = _first_lines(lines, {h for scope in around.values() for h in scope.headers})
    out = []
    for a, (start, end, rules) in zip(firsts, found):
        z = a + text.count("\n", start, end)
        scope = around[a]
        detector, style, best, dialect, named = _of_rules(tuple(rules))
        out.append(
            {
                "detector": detector,
                "dialect": dialect,
                "style": style,
                "symbol": scope.symbol,
                "excerpt": _excerpt(lines, a, z, scope, first_at),
                "start_line": a + 1,
                "end_line": z + 1,
                "n": len(rules),
                "loop_depth": len(scope.headers),
                "best": best,
                "opens_loop": scope.opens,
                "decorated": bool(DECORATOR.search("\n".join(_above(lines, a, scope)))),
                "named": named,
            }
        )
    return out


@lru_cache(10_000)
def _told_by(rules: tuple[int, ...]) -> tuple[str, str, float, str | None, list[str]]:
    """Detector, style, confidence, dialect and engines that distinct rules, in the order of their first hits, tell of a span."""
    by_confidence = sorted((RULES[k] for k in rules), key=lambda r: -r.confidence)
    named = [r.engine for r in by_confidence if r.engine != "unknown"]
    dialect = next((r.engine for r in by_confidence if r.name in DIALECT_RULES and r.engine != "unknown"), None)
    return "+".join(dict.fromkeys(RULES[k].name for k in rules)), by_confidence[0].style, by_confidence[0].confidence / 100, dialect, list(dict.fromkeys(named))


def _of_rules(rules: Iterable[int]) -> tuple[str, str, float, str | None, list[str]]:
    return _told_by(tuple(dict.fromkeys(rules)))


def _first_lines(lines: list[str], headers: set[str]) -> dict[str, int]:
    """Of each header, the first line that is it, white space around aside."""
    out: dict[str, int] = {}
    if headers:
        for k, line in enumerate(lines):
            stripped = line.strip()
            if stripped in headers and stripped not in out:
                out[stripped] = k
                if len(out) == len(headers):
                    break
    return out


def _above(lines: list[str], a: int, scope: Scope) -> list[str]:
    """Lines where a decorator of the innermost named scope may stand, or without one, of the line."""
    end = a if scope.named_at is None else scope.named_at + 1
    return lines[max(0, end - DECORATOR_LINES) : end]


def _excerpt(lines: list[str], a: int, z: int, scope: Scope, first_at: dict[str, int]) -> str:
    """Lines around a span; before them the loop headers that stand higher up, outermost first."""
    low = max(0, a - CONTEXT_LINES)
    body = lines[low : z + 1 + CONTEXT_LINES]
    places = [first_at.get(h, -1) for h in reversed(scope.headers)]
    heads = [f"{k + 1:5d}| {lines[k]}" for k in places if 0 <= k < low]
    return "\n".join([*heads, f"      … (lines above {low + 1} omitted)", *body] if heads else body)


def strengths(path: str, text: str) -> list[dict]:
    """Of each of a file's spans, what its confidence is made of: its best rule's, and its hits."""
    return [{"best": _of_rules(rules)[2], "n": len(rules)} for _, _, rules in spans(matches(path, text))]


_STRENGTH, _STRENGTH_SQL = pa.struct([("best", pa.float64()), ("n", pa.int32())]), "best double, n int"


def _spans_read(files: DataFrame, of: Callable[[str, str], list[dict]], kind: pa.StructType, sql: str) -> DataFrame:
    """(path, spans) of every file (path, content) that has spans: what `of` says of each, as structs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, s) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (s := of(p, t or ""))]
            flat = [x for _, s in rows for x in s]
            fields = pa.StructArray.from_arrays([pa.array([x[f.name] for x in flat], f.type) for f in kind], fields=list(kind))
            offsets = pa.array(accumulate((len(s) for _, s in rows), initial=0), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.ListArray.from_arrays(offsets, fields)], ["path", "spans"])

    small_batches(files.sparkSession)
    return files.select("path", "content").filter(~is_prose(F.col("path"))).mapInArrow(run, f"path string, spans array<struct<{sql.replace(' ', ':').replace(',:', ',')}>>")


def _counters(per_file: int) -> list[Column]:
    """What the floor and the limit took of matched spans, and what they left, where found stand at or above the floor."""
    over = F.greatest(F.col("found") - per_file, F.lit(0))
    return [(F.col("matched") - F.col("found")).alias("below_confidence"), over.alias("low_priority"), F.col("found")]


def _sure(x: Column) -> Column:
    return F.round(confidence(x["best"], x["n"]), 4)


def counted(files: DataFrame, per_file: int = MAX_PER_FILE, floor: float = MIN_CONFIDENCE) -> DataFrame:
    """(path, matched, below_confidence, low_priority, found, kept): the counters of scan, kept for the size of its sites. Every rule is matched in every file; what
    stands around a span ranks it among its file's, but changes no counter, and is not read here."""
    read = _spans_read(files, strengths, _STRENGTH, _STRENGTH_SQL)
    told = read.select("path", F.size("spans").alias("matched"), F.size(F.filter("spans", lambda x: _sure(x) >= floor)).alias("found"))
    return told.select("path", "matched", *_counters(per_file), F.least("found", F.lit(per_file)).alias("kept"))


def scan(files: DataFrame, profile: DataFrame | None = None, per_file: int = MAX_PER_FILE, floor: float = MIN_CONFIDENCE) -> DataFrame:
    """(path, matched, below_confidence, low_priority, found, sites) of every file (path, content) with hits.

    sites: the best `per_file` spans of those at or above the confidence floor, by priority, confidence and line. matched: all spans;
    below_confidence and low_priority: what the floor and the limit took; found: spans at or above the floor. An engine is that of a
    dialect's rule, else the path's, else the most confident rule's that the profile declares, else the profile's primary engine (unknown if
    it is ambiguous), else the most confident rule's. profile: the rows of operators.profile.engine_profile.
    """

    read = _spans_read(files, sites, _SITE, _SITE_SQL)
    if profile is None:
        read = read.select("*", F.array().cast("array<string>").alias("_declared"), F.lit(None).cast("string").alias("_primary"), F.lit(False).alias("_ambiguous"))
    else:
        # One row: the engines that a corpus declares.
        one = profile.agg(F.collect_set(dialect_of(F.col("engine"))).alias("_declared"), F.max(F.when(F.col("primary"), F.col("engine"))).alias("_primary"), F.coalesce(F.bool_or("ambiguous"), F.lit(False)).alias("_ambiguous"))
        read = read.join(F.broadcast(one), F.lit(True))

    # What a path says is told once a file, what a site says once a site: each step keeps what the next ones need.
    kinds, cold = path_kinds(F.col("path")), cold_paths(F.col("path"))
    read = read.select("*", *[c.alias(f"_{n}") for n, c in kinds.items()], cold[0].alias("_cold_migration"), cold[1].alias("_cold_test"), engine_from_path(F.col("path")).alias("_by_path"))
    kinds, cold = {n: F.col(f"_{n}") for n in kinds}, (F.col("_cold_migration"), F.col("_cold_test"))
    known = lambda s: F.get(F.filter(s["named"], lambda e: F.array_contains("_declared", dialect_of(e))), F.lit(0))
    declared = lambda s: F.when(F.size("_declared") > 0, F.coalesce(known(s), F.when(F.col("_ambiguous"), F.lit("unknown")).otherwise(F.nullif(F.col("_primary"), F.lit("unknown")))))
    reached = F.transform("spans", lambda s: F.struct(s.alias("s"), trigger_of(kinds, s["symbol"], s["decorated"]).alias("trigger")))
    told = F.transform(reached, lambda x: F.struct(x["s"].alias("s"), x["trigger"].alias("trigger"), priority_told(cold, x["s"]["excerpt"], x["s"]["loop_depth"], x["trigger"], x["s"]["style"]).alias("told")))
    scored = F.transform(told, lambda x: F.struct(x["s"].alias("s"), x["trigger"].alias("trigger"), x["told"].alias("told"), priority_sum(x["told"]).alias("score"), _sure(x["s"]).alias("sure")))

    def site(x: Column) -> Column:
        s = x["s"]
        return F.struct(
            (-x["score"]).alias("_priority"), (-x["sure"]).alias("_confidence"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), s["detector"].alias("detector"),
            F.coalesce(s["dialect"], F.col("_by_path"), declared(s), F.get(s["named"], F.lit(0)), F.lit("unknown")).alias("engine"), s["style"].alias("access_style"), x["sure"].alias("confidence"),
            x["score"].alias("priority"), F.transform(x["told"], lambda t: t["reason"]).alias("reasons"), s["loop_depth"].alias("loop_depth"), s["opens_loop"].alias("opens_loop"), s["symbol"].alias("symbol"), x["trigger"].alias("trigger"), s["excerpt"].alias("excerpt"),
        )

    told = read.select("path", F.size("spans").alias("matched"), F.transform(F.filter(scored, lambda x: x["sure"] >= floor), site).alias("sites"))
    return told.withColumn("found", F.size("sites")).select("path", "matched", *_counters(per_file), F.slice(F.array_sort("sites"), 1, per_file).alias("sites"))


def candidates(files: DataFrame, profile: DataFrame | None = None, per_file: int = MAX_PER_FILE, floor: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per query site of scan: path, start_line, end_line, detector, engine, access_style, confidence, priority, reasons, loop_depth,
    opens_loop, symbol, trigger, excerpt, and the file's matched."""
    return scan(files, profile, per_file, floor).select("path", "matched", F.explode("sites").alias("s")).select("path", "s.*", "matched").drop("_priority", "_confidence")


def scan_totals(scanned: DataFrame) -> DataFrame:
    """One row: sums of the counters over all files of scan or counted, and how many files were truncated."""
    return scanned.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "below_confidence", "low_priority")], F.count(F.when(F.col("low_priority") > 0, 1)).alias("truncated"))


def scope_line(symbol: Column, loop_depth: Column, opens_loop: Column, reached: Column) -> Column:
    """One line on what surrounds a site."""
    loops = F.when(loop_depth > 0, F.concat(F.lit("inside "), loop_depth.cast("string"), F.when(loop_depth > 1, " loops").otherwise(" loop"))).when(opens_loop, "opens a loop, so its body runs per iteration").otherwise("not in a loop")
    return F.concat_ws("  ·  ", F.concat(F.lit("enclosing: "), symbol), loops, F.concat(F.lit("reached by: "), reached))


JVM = "java kt kts scala groovy"
# Signs of data access in files that no rule found; name, extensions (none: any), pattern. None of them names an engine.
SIGNALS = (
    ("jpa-entity", JVM, r"@Entity\b|@Table\s*\(|@MappedSuperclass\b"),
    ("jpa-criteria", JVM, r"CriteriaBuilder|CriteriaQuery|\bRoot<|EntityManager\b|Specification<|JPAQueryFactory"),
    ("spring-data-repository", JVM, r"extends\s+(?:Jpa|Crud|Paging(?:AndSorting)?|Mongo|R2dbc)Repository\b|@Repository\b"),
    ("jpa-fetch-strategy", JVM, r"@(?:One|Many)To(?:One|Many)\b|FetchType\.(?:LAZY|EAGER)|@BatchSize\b|@EntityGraph\b"),
    ("django-model", "py", r"class\s+\w+\s*\(\s*(?:models\.Model|Model)\s*\)|from\s+django\.db\s+import|models\.(?:ForeignKey|ManyToManyField|OneToOneField)\s*\("),
    ("django-manager", "py", r"class\s+\w*(?:Manager|QuerySet)\s*\(|\.get_queryset\s*\(|Q\s*\(|F\s*\("),
    ("sqlalchemy-model", "py", r"declarative_base\s*\(|__tablename__\s*=|relationship\s*\(|Column\s*\("),
    ("activerecord-model", "rb", r"<\s*(?:ApplicationRecord|ActiveRecord::Base)\b|\b(?:has_many|belongs_to|has_one|has_and_belongs_to_many)\b"),
    ("activerecord-scope", "rb", r"\bscope\s+:\w+\s*,\s*->"),
    ("prisma-client", "", r"from\s+['\"]@prisma\/client['\"]|new\s+PrismaClient\b|Prisma\.\w+WhereInput"),
    ("typeorm-entity", "", r"@Entity\s*\(|@Column\s*\(|@ManyToOne\s*\(|getRepository\s*\(|DataSource\b"),
    ("orm-import", "", r"from\s+['\"](?:sequelize|typeorm|drizzle-orm|knex|mongoose|@mikro-orm\/\w+)['\"]|require\(['\"](?:sequelize|knex|mongoose)['\"]\)"),
    ("gorm-model", "go", r"gorm\.Model\b|gorm:\"|\bPreload\s*\("),
    ("ef-core-context", "cs", r":\s*DbContext\b|DbSet<|OnModelCreating\b|\.Include\s*\("),
)
# Paths that are data access whatever stands in the file; lines worth reading in such files.
PATH_HINTS = r"(?i:(^|/)(?:repositor(?:y|ies)|daos?|entities|models?|schemas?|persistence|store|stores)/)|(?:Repository|Dao|DAO|Entity|Mapper)\.(?:java|kt|scala|cs|ts)$"
TELLING = r"@(?:Entity|Table|Query|OneToMany|ManyToOne|ManyToMany|OneToOne|EntityGraph|BatchSize|Column|Index)\b|FetchType\.|CriteriaBuilder|createQuery|\.objects\.|select_related|prefetch_related|relationship\s*\(|has_many|belongs_to|scope\s+:|\.include\s*\(|Preload\s*\(|DbSet<|prisma\.\w+\.|getRepository|createQueryBuilder"
COLD_PATH = r"(?i)(^|/)migrations?/|(^|/)seeds?/|(^|/)fixtures?/|(^|/)tests?/|(^|/)spec/|[._-]test\.|[._-]spec\."
SAMPLE_LINES, LINES_BEFORE, LINES_AFTER, SAMPLE_PRIORITY, COLD_PRIORITY = 120, 2, 4, 0.38, 0.1


def relevant_files(files: DataFrame, covered: DataFrame) -> DataFrame:
    """(path, reasons, engine): files that no site covers but that show signs of data access, all of them in order; only a file without any counts by its path.

    The paths grow with the corpus: both sides are merged."""
    left = files.join(covered.select("path").distinct().hint("merge"), "path", "left_anti")
    for_it = lambda exts: extension(F.col("path")).isin(*exts.split()) if exts else F.lit(True)
    signs = F.filter(F.array(*[F.when(for_it(exts) & F.col("content").rlike(p), F.lit(n)) for n, exts, p in SIGNALS]), lambda x: x.isNotNull())
    reasons = F.when(F.size(signs) > 0, signs).when(F.col("path").rlike(PATH_HINTS), F.array(F.lit("path")))
    return left.select("path", "content", reasons.alias("reasons"), F.lit("unknown").alias("engine")).filter("reasons IS NOT NULL")


def sampled_files(relevant: DataFrame) -> DataFrame:
    """A site for each file of relevant_files that has telling lines: these lines with those around them, runs of lines apart from each other by a note."""
    lines = F.split("content", "\n", -1)
    told = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(TELLING), i)), lambda i: i.isNotNull())
    near = F.flatten(F.transform(told, lambda i: F.sequence(F.greatest(i - LINES_BEFORE, F.lit(0)), F.least(i + LINES_AFTER, F.size("_lines") - 1))))
    rows = relevant.withColumn("_lines", lines).withColumn("_keep", F.slice(F.array_sort(F.array_distinct(near)), 1, SAMPLE_LINES)).filter(F.size("_keep") > 0)
    before = lambda k: F.get("_keep", k - 1)
    gap = lambda i, k: F.when((k > 0) & (i != before(k) + 1), F.concat(F.lit("… (lines "), (before(k) + 2).cast("string"), F.lit("–"), i.cast("string"), F.lit(" omitted)\n")))
    pieces = F.transform("_keep", lambda i, k: F.concat(F.coalesce(gap(i, k), F.lit("")), F.get("_lines", i)))
    cold = F.col("path").rlike(COLD_PATH)
    return rows.select(
        "path",
        (F.get("_keep", F.lit(0)) + 1).alias("start_line"),
        (F.element_at("_keep", -1) + 1).alias("end_line"),
        F.concat(F.lit("relevance("), F.size("reasons").cast("string"), F.lit(")")).alias("detector"),
        "engine",
        F.lit("orm").alias("access_style"),
        F.lit(MIN_CONFIDENCE).alias("confidence"),
        F.when(cold, COLD_PRIORITY).otherwise(SAMPLE_PRIORITY).alias("priority"),
        F.array(F.when(cold, "0.10 whole-file sample in migration/test code").otherwise("0.38 whole-file sample: no single query site to score")).alias("reasons"),
        F.lit(0).alias("loop_depth"),
        F.lit(False).alias("opens_loop"),
        F.lit(None).cast("string").alias("symbol"),
        F.lit("unknown").alias("trigger"),
        F.array_join(pieces, "\n").alias("excerpt"),
        F.lit(1).alias("matched"),
    )


def both_tiers(files: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Sites of candidates, and after them samples of the relevant files that have none; each counts as matched.

    The sites are written once: the files that they cover are read from them, not from a second scan."""
    first = cut(candidates(files, profile), "sites")
    return first.unionByName(sampled_files(relevant_files(files, first)))
