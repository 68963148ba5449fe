"""License scans by template markup, compiled to token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows
from .license_texts import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Leading mandatory words of a template that are looked for in a text; the automaton runs from there.
ANCHOR = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


@dataclass(frozen=True)
class Automaton:
    """States 0 to n; arcs[s]: word -> next states; free[s]: next states for any word; `end` accepts. Epsilon moves are folded in."""

    label: str
    anchor: str
    arcs: tuple
    free: tuple
    start: frozenset
    end: int

    def reach(self, words: list[str], at: int) -> int:
        """The farthest state that words from `at` on lead to: `end` if all mandatory wording stands there."""
        now, far = self.start, 0
        for k in range(at, len(words)):
            word = words[k]
            now = frozenset(t for s in now for t in (*self.arcs[s].get(word, ()), *self.free[s]))
            if not now:
                break
            far = max(far, *now)
            if far == self.end:
                break
        return far


def parts_of(label: str, markup: str) -> list[str]:
    """Words and marks of a template, less the regions that may be left out at either end: they don't change which texts hold the wording."""
    parts: list[str] = []
    for part in re.findall(r"<<[^<>]*>>|[^<>\s]+", markup):
        parts += [part] if part.startswith("<<") else words_of(part)
    depth, edges = 0, [0, len(parts)]
    for k, part in enumerate(parts):
        depth += (part == "<<optional>>") - (part == "<</optional>>")
        if depth < 0 or (part.startswith("<<") and not re.fullmatch(r"<</?optional>>|<<any:[0-9]+>>", part)):
            raise ValueError(f"{label}: misplaced or unknown markup {part}")
        if not depth and not part.startswith("<<"):
            edges = [k, k + 1] if edges == [0, len(parts)] else [edges[0], k + 1]
    if depth or edges == [0, len(parts)] and (not parts or parts[0].startswith("<<")):
        raise ValueError(f"{label}: an optional region is open, or no word is mandatory")
    return parts[edges[0] : edges[1]]


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template; a place of it is that of its first mandatory word."""
    steps: list[tuple] = []  # (state, word or None for any word, next)
    skips: list[tuple[int, int]] = []
    n, opened, parts = 0, [], parts_of(label, markup)
    anchor = parts[: next((k for k, x in enumerate(parts) if x.startswith("<<")), len(parts))][:ANCHOR]
    for part in parts:
        if part == "<<optional>>":
            opened.append(n)
        elif part == "<</optional>>":
            skips.append((opened.pop(), n))
        elif part.startswith("<<"):
            last = n + int(part[6:-2])
            for s in range(n, last):
                steps.append((s, None, s + 1))
                skips.append((s, last))
            n = last
        else:
            steps.append((n, part, n + 1))
            n += 1
    reach = [{s} for s in range(n + 1)]
    for a, b in sorted(skips, reverse=True):
        reach[a] |= reach[b]
    for s in range(n, -1, -1):
        for a, b in skips:
            if a == s:
                reach[s] |= reach[b]
    arcs: list[dict] = [{} for _ in range(n + 1)]
    free: list[set] = [set() for _ in range(n + 1)]
    for s, word, t in steps:
        if word is None:
            free[s] |= reach[t]
        else:
            arcs[s].setdefault(word, set()).update(reach[t])
    return Automaton(label, f" {' '.join(anchor)} ", tuple({w: tuple(sorted(t)) for w, t in a.items()} for a in arcs), tuple(tuple(sorted(f)) for f in free), frozenset(reach[0]), n)


@lru_cache(4)
def automata(rules: tuple[tuple[str, str], ...]) -> tuple[Automaton, ...]:
    return tuple(compile_template(label, markup) for markup, label in rules)


def places(automaton: Automaton, words: list[str], line: str) -> tuple[list[int], float]:
    """Words at which the template is accepted, and the greatest share of it that stands anywhere; line: the words with a space around each."""
    found, at, n, counted, far = [], line.find(automaton.anchor), 0, 0, 0
    while at >= 0:
        n += line.count(" ", counted, at)
        counted = at
        reached = automaton.reach(words, n)
        if reached == automaton.end:
            found.append(n)
        far = max(far, reached)
        at = line.find(automaton.anchor, at + 1)
    return found, far / automaton.end


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base_spans array<int>, spans array<struct<label,word>>, base_labels, labels, score) per row.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters of the whole text. base_spans: all places of the phrases.
    spans: places at which a template's automaton accepts. labels joins both kinds, distinct and sorted. score: the greatest share of a
    template's wording that stands in order at a place, 1 where one is accepted; at least 0.5 where a phrase stands, and 0 without either.
    Null and empty texts have no words, empty labels and score 0. Repeated rows are each returned; an empty table gives no rows; other
    columns are ignored, whatever their names. A very long text is scanned whole by one task, in time in proportion to it for each place at
    which a template may start. A map without a shuffle; phrases and templates are compiled once per Python worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base, own = tuple(sorted(phrases.items())), tuple(sorted((m, k) for k, m in templates.items()))

    def scan(text):
        words = words_of(text)
        line = f" {' '.join(words)} "
        hits, more, score = [], [], 0.0
        for a in automata(base):
            hits += [(n, a.label) for n in places(a, words, line)[0]]
        for a in automata(own):
            found, share = places(a, words, line)
            more += [(n, a.label) for n in found]
            score = max(score, share)
        first = sorted({label for _, label in hits})
        return (
            len(words), sorted(n for n, _ in hits), [{"label": label, "word": n} for n, label in sorted(more)],
            ",".join(first), ",".join(sorted({*first, *(label for _, label in more)})), max(score, 0.5) if hits else score,
        )

    def run(keys, texts):
        return [keys, *(map(list, zip(*map(scan, texts), strict=True)) if texts else [[]] * 6)]

    return map_rows(docs.select(id_col, text_col), f"doc_id {kind}, n_words long, base_spans array<int>, spans array<struct<label:string,word:int>>, base_labels string, labels string, score double", run)
