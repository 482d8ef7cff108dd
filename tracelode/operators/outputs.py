"""Order, alignment and cuts of command outputs, claims in free text, and unified diffs: per-text functions behind Arrow UDFs."""

from __future__ import annotations

import re
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of ls -l, of git log, grep -n, git status and wc, banners, date formats.
LONG_ROW = re.compile(r"^[-dlcbpsD][rwxsStT\-]{9}[@+.]?\s+\d+\s+\S+\s+\S+\s+(\d[\d,.]*[KMGTPB]?)\s+")
LOG_DATE = re.compile(r"(?m)^Date:\s+(.+?)\s*$")
DATES = ("%a %b %d %H:%M:%S %Y %z", "%Y-%m-%d %H:%M:%S %z", "%a, %d %b %Y %H:%M:%S %z")
GREP_ROW = re.compile(r"^(?:([^\n:]+?)[:-])?(\d+)[:-]")
STATUS_ROW = re.compile(r"^(\s*)(modified|new file|deleted|renamed|typechange|both modified):\s")
WC_ROW = re.compile(r"^(\s*)(\d+)(?:\s+\d+){0,2}\s+(\S.*)$")
BANNER = re.compile(r"^=+ .+ =+$")
MIDDLE_CUT = re.compile(r"\.\.\. \[(\d+) characters truncated\] \.\.\.")
TAIL_CUT = re.compile(r"\.\.\. \[(\d+) lines truncated\] \.\.\.")

#: Flags of ls that order by something else than the name.
OTHER_ORDER = set("tSrUXcuvfR")


def _ascending(keys: list) -> bool:
    try:
        return all(a <= b for a, b in zip(keys, keys[1:]))
    except TypeError:  # a number against a letter
        return False


def _natural(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|\D+", name.casefold())]


def listed_names(command: str, output: str) -> list[str] | None:
    """Names in the order in which a plain ls shows them; None for other commands, other orders, or fewer than three."""
    first = command.split("|")[0].strip()
    words = re.split(r"\s+", re.split(r"[;&]\s*", first)[-1])
    if not words or words[0] != "ls":
        return None
    flags = {c for w in words[1:] if w.startswith("-") and not w.startswith("--") for c in w[1:]}
    if flags & OTHER_ORDER or not (flags & {"1", "l"} or "|" in command):
        return None
    rows = [x for x in output.splitlines() if x.strip() and not x.startswith("total ") and not x.endswith(":")]
    if "l" in flags:
        parts = [x.split(None, 8) for x in rows if re.match(r"^[-dlcbpsD][rwxsStT\-]{9}", x)]
        names = [p[8].split(" -> ")[0] for p in parts if len(p) == 9]
    else:
        names = [x.strip() for x in rows]
    return names if len(names) >= 3 else None


def ls_out_of_order(command: str, output: str) -> bool | None:
    """Whether no usual collation (bytes, folded, alphanumeric, natural) sorts the names as shown; None if it isn't such an output."""
    names = listed_names(command, output)
    if names is None:
        return None
    folded = [n.casefold() for n in names]
    bare = [re.sub(r"[^0-9a-z]", "", n) for n in folded]
    return not any(_ascending(keys) for keys in (names, folded, bare, [_natural(n) for n in names]))


def _date(text: str) -> datetime | None:
    for form in DATES:
        try:
            return datetime.strptime(text, form)
        except ValueError:
            pass
    return None


def log_out_of_order(command: str, output: str) -> bool | None:
    """Whether a git log shows a later commit behind an earlier one; None for other commands, other orders, or fewer than three dates."""
    if not re.search(r"\bgit\s+(?:-C\s+\S+\s+|--no-pager\s+)*log\b", command) or re.search(r"--(?:reverse|topo-order|graph)", command):
        return None
    dates = [d for d in map(_date, LOG_DATE.findall(output)) if d]
    return None if len(dates) < 3 else any(later > d for d, later in zip(dates, dates[1:]))


def grep_out_of_order(command: str, output: str) -> bool | None:
    """Whether line numbers fall, or stand, within one file of a grep -n output; None for other commands or fewer than three rows."""
    if not re.search(r"(?:^|[|;&]\s*)(?:grep|egrep|rg)\b[^|;&]*\s-[A-Za-z]*n", command):
        return None
    rows = [(m[1], int(m[2])) for m in map(GREP_ROW.match, output.splitlines()) if m]
    if any(a[0] == b[0] and b[1] <= a[1] for a, b in zip(rows, rows[1:])):
        return True
    return False if len(rows) >= 3 else None


def misaligned(command: str, output: str) -> list[str]:
    """Sorted names of the columns that don't line up: sizes of ls -l, numbers of wc, tabs of git status, banners of pytest."""
    rows, found = output.splitlines(), []
    ends = {
        "ls_long": {m.end(1) for m in map(LONG_ROW.match, rows) if m} if re.search(r"(?:^|[|;&]\s*)ls\s+-[A-Za-z]*l", command) else set(),
        "wc": {m.end(2) for m in map(WC_ROW.match, rows) if m} if re.search(r"(?:^|[|;&]\s*)wc\b", command) else set(),
    }
    matched = {"ls_long": sum(bool(LONG_ROW.match(x)) for x in rows), "wc": sum(bool(WC_ROW.match(x)) for x in rows)}
    found += [n for n, e in ends.items() if len(e) > 1 and matched[n] >= 3]
    if re.search(r"\bgit\s+status\b", command) and not re.search(r"--short|-s\b|--porcelain", command):
        if any(STATUS_ROW.match(x) and not x.startswith("\t") for x in rows):
            found.append("git_status")
    banners = [x for x in rows if BANNER.match(x)]
    if len({len(x) for x in banners}) > 1:
        found.append("pytest_banner")
    return sorted(found)


def cut_sizes(output: str) -> tuple[str, int, int, int] | None:
    """(kind, characters before the mark, behind it, stated count) of a cut output; characters as UTF-16 units."""
    units = lambda s: len(s.encode("utf-16-le")) // 2
    for kind, mark in (("middle", MIDDLE_CUT), ("tail", TAIL_CUT)):
        if m := mark.search(output):
            return kind, units(output[: m.start()]), units(output[m.end() :]), int(m[1])
    return None


_TEXT, _YES = T.StringType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.pandas_udf(_struct(ls=_YES, git_log=_YES, grep_n=_YES, misaligned=T.ArrayType(_TEXT)))
def order_checks(command: pd.Series, output: pd.Series) -> pd.DataFrame:
    """The three order checks (null: doesn't apply) and the misaligned columns of each output."""
    rows = [(c or "", o or "") for c, o in zip(command, output)]
    return pd.DataFrame({
        "ls": [ls_out_of_order(*r) for r in rows],
        "git_log": [log_out_of_order(*r) for r in rows],
        "grep_n": [grep_out_of_order(*r) for r in rows],
        "misaligned": [misaligned(*r) for r in rows],
    })


# --- claims in free text ---------------------------------------------------------------------

#: Kinds of claims in the order in which they are taken; what one takes, the later ones don't see.
CLAIMS = (
    ("url", re.compile(r"https?://[^\s<>\"'`)\]]+")),
    ("uuid", re.compile(r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b")),
    ("path", re.compile(r"(?<![\w/])(?:~|\.{1,2})?/?(?:[\w.@+-]+/)+[\w.@+-]*")),
    ("filename", re.compile(r"\b[\w-]+\.(?:py|js|ts|json|md|txt|csv|html|css|sh|yml|yaml|toml|log|sql|rs|go|c|h|cpp|java)\b")),
    ("hex_id", re.compile(r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{7,64}\b")),
    ("date", re.compile(r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\b")),
    ("time", re.compile(r"\b\d{1,2}:\d{2}(?::\d{2})?\b")),
    ("version", re.compile(r"\bv?\d+\.\d+\.\d+\b")),
    ("number", re.compile(r"(?<![\w.,])\d+(?:,\d{3})*(?:\.\d+)?(?!\w)")),
)
#: Programs whose name makes a code span a command.
PROGRAMS = frozenset("awk bash cargo cat cd chmod cp curl docker echo find gh git go grep head kill ls make mkdir mv node npm npx pip ps pytest python python3 rm sed sort tail tar touch wc wget".split())
SPAN, FENCE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)"), re.compile(r"```[^\n]*\n(.*?)```", re.S)
QUOTED = re.compile(r"\"([^\"\n]{8,})\"|“([^”\n]{8,})”")


def extract_claims(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, start) of what a text claims, in order of kinds and places; no two of the plain kinds overlap.

    Numbers have three digits or more and are no years; commands are code spans and lines of fenced code that begin with a program;
    quoted strings have eight characters or more.
    """
    rest, out = list(text), []
    for kind, pattern in CLAIMS:
        for m in pattern.finditer("".join(rest)):
            value = m[0].rstrip(".,;:!?") if kind in ("url", "path") else m[0]
            if kind == "number":
                digits = re.sub(r"\D", "", value)
                if len(digits) < 3 or (len(digits) == 4 and value == digits and "1900" <= digits <= "2099"):
                    continue
                value = value.replace(",", "")
            rest[m.start() : m.end()] = " " * (m.end() - m.start())
            out.append((kind, value, m.start()))
    spans = [(m[1], m.start(1)) for m in SPAN.finditer(text)]
    for m in FENCE.finditer(text):
        at = m.start(1)
        for line in m[1].split("\n"):
            spans.append((line, at))
            at += len(line) + 1
    for code, at in spans:
        words = code.strip().removeprefix("$ ").split()
        if words and words[0] in PROGRAMS:
            out.append(("command", " ".join(words), at))
    out += [("quoted", " ".join((m[1] or m[2]).split()).lower(), m.start()) for m in QUOTED.finditer(text)]
    return out


@F.pandas_udf(T.ArrayType(_struct(kind=_TEXT, value=_TEXT, start=T.IntegerType())))
def claims(text: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "value": v, "start": s} for k, v, s in extract_claims(t or "")] for t in text])


# --- unified diffs ---------------------------------------------------------------------------


def parse_diff(patch: str) -> list[tuple[str, list[str], list[str]]]:
    """(path, added lines, removed lines) of each file section of a unified diff; a deleted file keeps its old path, combined sections are left out."""
    out: list[tuple[str, list[str], list[str]]] = []
    path, hunk = None, 0  # hunk: rows of the hunk still to come, old and new together
    for line in patch.split("\n"):
        if hunk > 0 and line[:1] in ("+", "-", " ", ""):
            hunk -= 1 if line[:1] in ("+", "-") else 2
            if line[:1] in ("+", "-") and out:
                out[-1][1 if line[0] == "+" else 2].append(line[1:])
        elif line.startswith("diff --git "):
            old, _, new = line[11:].partition(" b/")
            path = new or old.removeprefix("a/")
            out.append((path.strip('"'), [], []))
        elif line.startswith(("diff --cc ", "diff --combined ")):
            path = None
        elif path is not None and line.startswith("+++ ") and not line.startswith("+++ /dev/null"):
            out[-1] = (line[4:].split("\t")[0].strip('"').removeprefix("b/"), *out[-1][1:])
        elif path is not None and (m := re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)):
            hunk = int(m[1] or 1) + int(m[2] or 1)
    return out


@F.pandas_udf(T.ArrayType(_struct(path=_TEXT, added=T.ArrayType(_TEXT), removed=T.ArrayType(_TEXT))))
def diffs(patch: pd.Series) -> pd.Series:
    return pd.Series([[{"path": p, "added": a, "removed": r} for p, a, r in parse_diff(t or "")] for t in patch])
