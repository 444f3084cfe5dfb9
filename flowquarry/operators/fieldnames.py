"""Which known field a column name stands for, from the dictionary and from what happens to the columns.

A name is a field's own if it is listed for it, whatever case and signs. Every other name is weighed by three kinds of
evidence against each field: how alike the names are written (words, and shortened words, in any order; counts twice),
how often the name comes just when the field's other names go or goes when they come, and how alike the values are, on
both sides of such a change or else over all files. Two names that stand in one file are never one field.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Mapping, Sequence

#: Evidence (0 to 4) from which a name is taken for a field's, and the lead over the second-best field.
LEAST_EVIDENCE, LEAD = 1.3, 0.15
_COPY = re.compile(r"(.*)\.(\d+)")


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def words(name: str) -> list[str]:
    """Words in lower case; camel case, signs and digits part them."""
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name).lower())


def shortened(a: str, b: str) -> float:
    """1 for equal words, less if the shorter one is made of the longer one's letters in their order, from the first on."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if a[0] == b[0]:
        letters = iter(b)
        if all(x in letters for x in a):
            return 0.9 if b.startswith(a) else 0.8
    return 0.7 if min(len(a), len(b)) > 4 and difflib.SequenceMatcher(None, a, b).ratio() > 0.8 else 0.0


def likeness(a: str, b: str, weight: Mapping[str, float]) -> float:
    """0 to 1: the weight of the words that two names share, each in full or shortened, of all of their words."""
    wa, wb = words(a), words(b)
    if not wa or not wb:
        return 0.0
    of = lambda w: weight.get(w, 1.0)
    pairs = sorted(((shortened(x, y), i, j) for i, x in enumerate(wa) for j, y in enumerate(wb)), key=lambda t: (-t[0], t[1], t[2]))
    left, right, got = set(), set(), 0.0
    for s, i, j in pairs:
        if s and i not in left and j not in right:
            left.add(i)
            right.add(j)
            got += s * (min(of(wa[i]), of(wb[j])) if s < 1 else of(wa[i])) * 2
    total = sum(of(wa[i]) if i not in left else min(of(wa[i]), 1.0) for i in range(len(wa))) + sum(map(of, wb))
    whole = difflib.SequenceMatcher(None, plain(a), plain(b)).ratio()
    return min(1.0, max(got / total, whole if whole > 0.9 else 0.0))


class Fields:
    """Finds the field of a name; fields: name -> aliases; found: name -> field for names that evidence has resolved.

    Copies (``X.1`` that is not listed itself) are fields of their own, beside the field of ``X``.
    """

    def __init__(self, fields: Mapping[str, Sequence[str]], found: Mapping[str, str] | None = None):
        self.fields = {f: [f, *(aliases or ())] for f, aliases in fields.items()}
        self.exact: dict[str, str] = {}
        for f, names in self.fields.items():
            for n in names:
                self.exact.setdefault(plain(n), f)
        self.found = dict(found or {})
        df: dict[str, int] = {}
        for names in self.fields.values():
            for w in {w for n in names for w in words(n)}:
                df[w] = df.get(w, 0) + 1
        self.weight = {w: 1.0 / n for w, n in df.items()}

    def listed(self, name: str) -> str | None:
        if name in self.fields:
            return name
        if _COPY.fullmatch(name):
            return None
        return self.exact.get(plain(name))

    def of(self, name: str) -> tuple[str, float]:
        """(field, certainty): 1 if listed, 0.9 if found by evidence, 0 for a field of its own."""
        f = self.listed(name)
        if f is not None:
            return f, 1.0
        if name in self.found:
            return self.found[name], 0.9
        if m := _COPY.fullmatch(name):
            base, sure = self.of(m[1])
            return f"{base}.{m[2]}", sure
        return plain(name) or name, 0.0

    def likeness(self, name: str, field: str) -> float:
        return max(likeness(name, n, self.weight) for n in self.fields.get(field, [field]))

    def resolve(self, names: Iterable[str], swaps: Mapping[tuple[str, str], tuple[int, float]], changes: Mapping[str, int], together: set[tuple[str, str]], alike: Mapping[tuple[str, str], float]) -> dict[str, str]:
        """Fields of the names that are not listed.

        swaps: (name, other) -> (times one came as the other went, mean likeness of their values then); changes: name ->
        times it came or went while others went or came; together: pairs of names that stand in one file; alike:
        (name, other) -> likeness of their values over all files.
        """
        names = sorted(set(names))
        open_ = [n for n in names if self.listed(n) is None and not _COPY.fullmatch(n)]
        by_field: dict[str, list[str]] = {}
        for n in names:
            if (f := self.listed(n)) is not None:
                by_field.setdefault(f, []).append(n)

        def evidence(u: str, others: Sequence[str], written: float) -> float | None:
            if any((u, x) in together for x in others):
                return None
            seen = [swaps[u, x] for x in others if (u, x) in swaps]
            times = sum(k for k, _ in seen)
            values = sum(k * v for k, v in seen) / times if times else max((alike.get((u, x), 0.0) for x in others), default=0.0)
            return 2 * written + times / (changes.get(u, 0) + 1) + values

        out: dict[str, str] = {}
        own = [f for f in self.fields if not _COPY.fullmatch(f)]
        options = {u: sorted(((e, f) for f in own if (e := evidence(u, by_field.get(f, []), self.likeness(u, f))) is not None), key=lambda t: (-t[0], t[1])) for u in open_}
        # the surest first: a name that is found rules out its field for names that stand beside it
        for u in sorted(open_, key=lambda u: (-options[u][0][0] if options[u] else 0.0, u)):
            best = [(e, f) for e, f in options[u] if not any((u, x) in together for x, g in out.items() if g == f)][:2]
            if best and best[0][0] >= LEAST_EVIDENCE and (len(best) < 2 or best[0][0] - best[1][0] >= LEAD):
                out[u] = best[0][1]
        # names of no known field that replace each other
        rest = [u for u in open_ if u not in out]
        for n, u in enumerate(rest):
            for x in rest[:n]:
                e = evidence(u, [x], likeness(u, x, self.weight))
                if plain(u) == plain(x) or (e is not None and e >= LEAST_EVIDENCE + 0.3):
                    out[u] = out.get(x) or plain(x) or x
                    out.setdefault(x, out[u])
                    break
        return out
