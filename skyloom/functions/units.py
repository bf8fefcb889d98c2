"""Unit names in free text: aliases found by an Aho-Corasick automaton, the longest at a place kept, the field told by context.

A unit is told by a small grammar: [number or fraction] [prefix] angle [per time]. Prefixes, fractions and powers of ten that
stand before an angle scale it ("0.001 arcsec", "thousandths of an arcsecond", "milli-arcsec"), "of that" takes up the angle
named last. ``speak`` reads one text and gives the unit it states for a motion and for a position error. The automaton is
built once a Python worker; texts go through it in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the angles, of the prefixes and fractions, and of the times.
ANGLES = {
    "mas": ["mas", "marcsec"],
    "uas": ["uas", "µas", "μas", "uarcsec", "µarcsec", "μarcsec"],
    "arcsec": [
        "arcsec", "arcsecs", "arcsecond", "arcseconds", "arc sec", "arc secs", "arc second", "arc seconds", "arc-sec", "arc-second", "arc-seconds",
        "asec", "as", '"', "″", "''", "seconds of arc", "second of arc"
    ],
    "deg": ["deg", "degs", "degree", "degrees", "°"],
    "pix": ["pix", "px", "pixel", "pixels"],
}
PREFIXES = {"milli": 1e-3, "micro": 1e-6}
FRACTIONS = {"thousandth": 1e-3, "thousandths": 1e-3, "millionth": 1e-6, "millionths": 1e-6}
TIMES = {"yr": ["yr", "year", "a", "y", "annum", "annus"], "cy": ["cy", "century", "100yr", "100 yr", "100 years", "hundred years"]}
# Words that tell which quantity a unit belongs to, and words that make motions of angles, per year or per century.
MOTION = ["proper motion", "proper motions", "pm", "motion", "motions", "velocity", "velocities", "speed", "speeds", "vx", "vy", "pmra", "pmdec"]
ERROR = ["error", "errors", "err", "sigma", "uncertainty", "uncertainties", "x0e", "y0e", "ra_error", "std"]
EVERY, THINGS = ["every", "all", "each", "any"], [
    "quantity", "quantities", "value", "values", "column", "columns", "field", "fields", "number", "numbers", "entry", "entries"
]
BOTH = ["both"]
PER_YEAR = ["annual", "yearly"]
PER_CENTURY = ["centennial", "secular"]


def _per(names: list[str]) -> list[str]:
    """The ways to put a time below the line."""
    below = [f"{way}{n}" for n in names for way in ("/", "/ ", "per ", "a ", "each ", "every ", "pro ")]
    return below + [f"{way}{n}{power}" for n in names for way in ("", " ", ".", "·", "*") for power in ("-1", "^-1", "**-1", "⁻¹")]


def _prefixed() -> dict[str, list[str]]:
    """The angles with their prefixed names; what scales beyond the units in use has no name."""
    out = {u: list(n) for u, n in ANGLES.items()}
    for prefix, by in PREFIXES.items():
        if (u := _scaled("arcsec", by)) is not None:
            out[u] += [f"{prefix}{gap}{n}" for n in ANGLES["arcsec"] if n[0] == "a" and n != "as" for gap in ("", "-", " ")]
    return out


#: Milliarcseconds in one unit of an angle; pixels need the plate scale.
MAS = {"mas": 1.0, "uas": 1e-3, "arcsec": 1e3, "deg": 3.6e6, "pix": None}
#: Years in one unit of the time below the line.
YEARS = {"yr": 1.0, "cy": 100.0}


def _scaled(unit: str, by: float) -> str | None:
    """The unit that is so many of ``unit``, if there is one."""
    if MAS[unit] is None:
        return None
    return next((u for u, m in MAS.items() if m is not None and abs(m / (MAS[unit] * by) - 1) < 1e-9), None)


def _word(c: str) -> bool:
    return c.isalnum() or c in "_µμ"


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    add = lambda words, kind, value: [a.add_word(w.lower(), (kind, value, w.lower())) for w in words]
    add(MOTION, "field", "motion")
    add(ERROR, "field", "error")
    add([*EVERY[:2], "units", *(f"{e} {t}" for e in EVERY for t in THINGS)], "field", "any")
    add(BOTH, "share", "both")
    add(PER_YEAR, "time", "yr")
    add(PER_CENTURY, "time", "cy")
    for w, by in FRACTIONS.items():
        add([w], "fraction", str(by))
    for unit, words in _prefixed().items():
        add(words, "angle", unit)
    for unit, words in TIMES.items():
        add(_per(words), "per", unit)
    a.make_automaton()
    return a


def tokens(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the aliases in a text: whole words only, of overlapping ones the longest from the left."""
    low = text.lower()
    if len(low) != len(text):  # some capitals have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = []
    for end, (kind, value, w) in _automaton().iter(low):
        start, stop = end - len(w) + 1, end + 1
        if _word(w[0]) and start and _word(low[start - 1]) and not (w[0].isalpha() and low[start - 1].isdigit() and kind == "per"):
            continue
        if _word(w[-1]) and stop < len(low) and _word(low[stop]):
            continue
        hits.append((start, stop, kind, value))
    hits.sort(key=lambda h: (h[0], -h[1]))
    out: list[tuple[int, int, str, str]] = []
    for h in hits:
        if not out or h[0] >= out[-1][1]:
            out.append(h)
    out = _grown(low, out)
    # "given as mas/yr": the word before a unit is none itself
    return [t for t, n in zip(out, [*out[1:], None]) if not (n and t[2] == n[2] == "angle" and low[t[0] : t[1]] == "as" and not low[t[1] : n[0]].strip())]


#: A power of ten right before a unit, and what joins a fraction to its unit or to the unit named last.
POWER = re.compile(r"(?<![\w.,/])(?:(\d*\.?\d+(?:e[+-]?\d+)?)|10 ?(?:\^|\*\*) ?([+-]?\d+)|1 ?/ ?(\d+))\s*(?:of (?:an?|one) )?$")
OF, OF_THAT = re.compile(r"\s+of\s+(?:(?:an?|one|the|each)\s+)?"), re.compile(r"\s+of\s+(?:that|those|this|it|the same)\b")


def _grown(low: str, toks: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The tokens with angles scaled by the numbers and fractions before them."""
    out: list[tuple[int, int, str, str]] = []
    named = fraction = None
    for t in toks:
        s, e, kind, value = t
        if kind == "fraction":
            fraction = t
            if named and (m := OF_THAT.match(low, e)) and (u := _scaled(named, float(value))):
                out.append((s, m.end(), "angle", u))
                fraction = None
            continue
        if kind == "angle":
            by, at = 1.0, s
            if fraction and OF.fullmatch(low, fraction[1], s):
                by, at = float(fraction[3]), fraction[0]
            elif m := POWER.search(low, max(0, s - 24), s):
                by = float(m[1]) if m[1] else 10.0 ** int(m[2]) if m[2] and abs(int(m[2])) < 30 else 1 / int(m[3]) if m[3] and int(m[3]) else 1.0
                at = m.start()
            if by not in (1.0, 0.0) and (u := _scaled(value, by)):
                t = (at, e, kind, u)
            named = t[3]
        fraction = None
        out.append(t)
    return out


def speak(text: str | None) -> tuple[str | None, str | None]:
    """(unit of the motion, unit of the error) that a text states; None where it says nothing."""
    if not text:
        return None, None
    units: list[dict] = []
    marks: list[tuple[int, str]] = []
    when = None
    toks = tokens(text)
    shared = any(t[2] == "share" for t in toks)
    for s, e, kind, value in toks:
        if kind == "angle":
            units.append({"at": s, "end": e, "angle": value, "per": None})
        elif kind == "per":
            # joins the angle right before it; apart from one it tells the time of motions in general
            if units and units[-1]["per"] is None and not re.search(r"[a-z;,:]", text[units[-1]["end"] : s].lower()):
                units[-1]["per"] = value
                units[-1]["end"] = e
            else:
                when = value
        elif kind == "time":
            when = value
            marks.append((s, "motion"))
        elif kind == "field":
            marks.append((s, value))
    if not units:
        return None, None
    motion = error = general = None
    marks.sort()
    at = [m[0] for m in marks]
    clauses = [m.start() for m in re.finditer(r";|\.(?!\d)", text)]
    semis = [m.start() for m in re.finditer(";", text)]
    timed = any(u["per"] for u in units)
    for u in units:
        # the last field named before the unit in its clause, and the first one after it
        k = bisect_left(at, u["at"])
        c = bisect_left(clauses, u["at"])
        near = k > 0 and at[k - 1] > (clauses[c - 1] if c else -1)
        n = bisect_left(semis, u["end"])
        follows = k < len(at) and at[k] < (semis[n] if n < len(semis) else len(text))
        if u["per"]:
            what = "motion"
        elif follows and re.match(r"\W*(?:for|in)\W", text[u["end"] : u["end"] + 12].lower()):
            what = marks[k][1]
        elif near:
            what = marks[k - 1][1]
        elif follows:
            what = marks[k][1]
        else:
            what = "error" if timed else "any"
        if what == "motion":
            motion = motion or f"{u['angle']}/{u['per'] or when or 'yr'}"
        elif what == "error":
            error = error or u["angle"]
        else:
            general = general or u["angle"]
        if motion and error:
            break
    if shared and (motion or error or general):
        a = next(u["angle"] for u in units)
        motion, error = motion or f"{a}/{when or 'yr'}", error or a
    if general:
        motion, error = motion or f"{general}/{when or 'yr'}", error or general
    return motion, error


def _said(text: str, alone: str) -> tuple[str | None, str | None]:
    return _known(text, alone) if len(text) < 500 else _known.__wrapped__(text, alone)


@lru_cache(maxsize=100_000)
def _known(text: str, alone: str) -> tuple[str | None, str | None]:
    m, e = speak(text)
    if alone == "motion" and m is None and e is not None:
        m = f"{e}/yr"
    if alone == "error" and e is None and m is not None:
        e = m.split("/")[0]
    return m, e


def stated(text: Column, alone: str = "") -> Column:
    """struct(motion, error): what a text column states. ``alone``: the field that the column is about, if it names no other."""

    @F.pandas_udf("motion string, error string")
    def read(s: pd.Series) -> pd.DataFrame:
        got = [_said(x, alone) if isinstance(x, str) and x else (None, None) for x in s]
        return pd.DataFrame({"motion": pd.Series([g[0] for g in got], dtype=object), "error": pd.Series([g[1] for g in got], dtype=object)})

    return read(text)
