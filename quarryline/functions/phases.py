"""Phased plans in plain text: lines told apart by their first words, columns and marks."""

from __future__ import annotations

import re

#: words that number a delivery, and that stand in brackets (fixed values)
PHASE_WORDS, MARK_WORDS, MILESTONE = ("phase", "release"), ("phase", "sprint", "release"), ("milestone",)
#: headers of the column of phases, of ids and of names (fixed values)
PHASE_HEADS = ("phase", "release", "phase/release", "delivery phase")
ID_HEADS = ("uc#", "uc", "use case", "use case id", "id", "uc id")
NAME_HEADS = ("feature requirement", "feature", "requirement", "description", "name", "change")
#: rows that end in a phase, at least; signs shown of one without an id; signs of a list item
LEAST_ENDINGS, SHOWN, LEAST_ITEM = 3, 60, 3
CONFLICT = "layouts disagree on the number of phases"

_DASHES = "-–—"
Phases = list[tuple[str, list[str]]]


def numbered(text: str, words: tuple[str, ...], dashes: int = 1) -> tuple[int, str] | None:
    """(number, rest) of a text that begins with one of the words and a number, with so many
    dashes between at most; any case."""
    size = next((i for i, c in enumerate(text) if not c.isalpha()), len(text))
    if text[:size].lower() not in words:
        return None
    rest = text[size:].lstrip()
    while dashes and rest[:1] and rest[0] in _DASHES:
        rest, dashes = rest[1:].lstrip(), dashes - 1
    size = next((i for i, c in enumerate(rest) if not c.isdecimal()), len(rest))
    return (int(rest[:size]), rest[size:]) if size else None


def titled(rest: str) -> str | None:
    """The title after a number: what stands behind a dash or colon; empty for nothing at all,
    None for anything else."""
    rest = rest.strip()
    if not rest:
        return ""
    return rest[1:].strip() or None if rest[0] in _DASHES + ":" else None


def unmarked(line: str) -> str:
    """A line without the hashes of a heading."""
    bare = line.lstrip("#")
    return bare.lstrip() if 1 <= len(line) - len(bare) <= 6 and bare[:1].isspace() else line


def ids(text: str) -> list[str]:
    """All UC numbers of a text, as UC#n."""
    out, low, at = [], text.lower(), -1
    while (at := low.find("uc", at + 1)) >= 0:
        rest = text[at + 2 :].removeprefix("#").lstrip()
        size = next((i for i, c in enumerate(rest) if not c.isdecimal()), len(rest))
        out += [f"UC#{rest[:size]}"] if size else []
    return out


def item(line: str) -> str | None:
    """The text of a list item: after a bullet, or a number with a dot or bracket and a space."""
    line = line.strip()
    if line[:1] and line[0] in "-*•":
        return line[1:].strip()
    size = next((i for i, c in enumerate(line) if not c.isdecimal()), len(line))
    return line[size + 1 :].strip() if size and line[size : size + 1] in (".", ")") and line[size + 1 : size + 2].isspace() else None


def use_cases(lines: list[str]) -> list[str]:
    """What lines below a heading name: UC numbers, or else list items."""
    return ids("\n".join(lines)) or [x for x in map(item, lines) if x and len(x) >= LEAST_ITEM]


def headed(lines: list[str], words: tuple[str, ...], needs_title: bool) -> Phases:
    """Headings alone on their lines, each with what stands below it."""
    found: list[tuple[int, str]] = []
    for at, line in enumerate(lines):
        met = numbered(unmarked(line), words, 0 if needs_title else 1)
        title = titled(met[1]) if met else None
        if title is None or (needs_title and not title):
            continue
        found.append((at, f"Milestone {met[0]} - {title}" if needs_title else f"Phase {met[0]}: {title}" if title else f"Phase {met[0]}"))
    ends = [at for at, _ in found[1:]] + [len(lines)] * bool(found)
    return [(name, use_cases(lines[at + 1 : end])) for (at, name), end in zip(found, ends, strict=True)]


def grouped(pairs: list[tuple[int, str]]) -> Phases:
    """Phases by number, each with its entries in order."""
    out: dict[int, list[str]] = {}
    for number, entry in pairs:
        out.setdefault(number, []).extend([entry] if entry else [])
    return [(f"Phase {n}", out[n]) for n in sorted(out)]


def cells(line: str, separator: str | None) -> tuple[str | None, list[str]]:
    """(separator, cells that aren't empty): bars, tabs or at least two spaces between."""
    separator = separator or ("|" if "|" in line else "\t" if "\t" in line else "  " if "  " in line else None)
    parts = re.split(r"\s{2,}", line) if separator == "  " else line.split(separator) if separator else []
    return separator, [p.strip() for p in parts if p.strip()]


def tabled(lines: list[str]) -> Phases:
    """Rows below the first header with a column of phases."""
    separator, place, one, other, pairs = None, -1, -1, -1, []
    for line in map(str.strip, lines):
        if not line or not line.strip(" \t|:-"):
            continue
        if place < 0:
            separator, row = cells(line, None)
            heads = [c.lower() for c in row]
            place = next((i for i, c in enumerate(heads) if c in PHASE_HEADS), -1)
            one = max((i for i, c in enumerate(heads) if c in ID_HEADS), default=-1)
            other = max((i for i, c in enumerate(heads) if c in NAME_HEADS), default=-1)
            continue
        _, row = cells(line, separator)
        met = numbered(row[place], PHASE_WORDS, 2) if place < len(row) else None
        if met and not met[1].strip():
            at = lambda i: row[i] if 0 <= i < len(row) else ""  # noqa: B023, E731
            pairs.append((met[0], at(one) or at(other) or next((c for i, c in enumerate(row) if i != place), "")))
    return grouped(pairs)


def ending(lines: list[str]) -> Phases:
    """Lines that end in a phase and its number, as rows of a table whose columns are lost."""
    pairs = []
    for line in lines:
        words = line.split()
        # the phase is one to four words: its name, dashes, the number
        for size in range(1, 5):
            met = numbered(" ".join(words[-size:]), PHASE_WORDS, 2) if len(words) > size else None
            if met and not met[1]:
                before = line.rstrip()
                for w in reversed(words[-size:]):
                    before = before[: -len(w)].rstrip()
                before = before.strip()
                pairs.append((met[0], next(iter(ids(before)), before[:SHOWN].strip())))
                break
    return grouped(pairs) if len(pairs) >= LEAST_ENDINGS else []


def marked(text: str) -> Phases:
    """Names with a phase, sprint or release in brackets behind; of a range the first counts."""
    pairs, start = [], 0
    while (at := text.find("[", start)) >= 0:
        start = at + 1
        end = text.find("]", at)
        met = numbered(text[at + 1 : end].strip(), MARK_WORDS) if end > 0 else None
        if not met:
            continue
        rest = met[1].strip()
        if rest and not (rest[0] in _DASHES and rest[1:].strip().isdecimal()):
            continue
        before = text[:at].rstrip()
        size = next((i for i, c in enumerate(reversed(before)) if not (c == " " or c == "_" or c.isascii() and c.isalnum())), len(before))
        run = before[len(before) - size :]
        if run.isdecimal() and before[: len(before) - size][-3:].lower() == "uc#":
            name = before[len(before) - size - 3 :]
        else:
            name = run[next((i for i, c in enumerate(run) if c.isalpha()), len(run)) :].strip()
        if name:
            pairs.append((met[0], name))
    return grouped(pairs)


def plan(text: str | None) -> tuple[str | None, Phases, str | None]:
    """(layout, phases, warning) of a document.  Layouts are headings, a table, line ends (where
    neither is there), marks in brackets and milestones; the first one there is counts, if
    all that are there have as many phases: else there is a warning and no phases.  A single
    phase is none."""
    text = text or ""
    lines = text.splitlines()
    found = [("heading", headed(lines, PHASE_WORDS, False)), ("table", tabled(lines))]
    if not any(p for _, p in found):
        found.append(("line end", ending(lines)))
    found += [("mark", marked(text)), ("milestone", headed(lines, MILESTONE, True))]
    found = [x for x in found if x[1]]
    if len({len(p) for _, p in found}) > 1:
        return None, [], CONFLICT
    return (found[0][0], found[0][1], None) if found and len(found[0][1]) > 1 else (None, [], None)
