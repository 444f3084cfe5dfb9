"""Statistics of many texts at once, as array arithmetic on their UTF-8 bytes.

The texts of a batch are one array of bytes. Every byte gets the class of its character (space, line break, letter,
digit, sign), tokens are the runs of letters, runs of digits and single signs, and all statistics are sums over tokens,
lines and clauses by document. Words and lines are compared by 64-bit hashes of their folded bytes, which differences
of one running sum give. Case is folded for ASCII and for the letters of Latin-1; letters are what lies outside of the
blocks of signs, which is exact for the languages of Latin script and near enough for others.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, BREAK, LETTER, DIGIT, SIGN = range(5)
# Signs that end a sentence or a line of prose, signs that end a clause, signs that belong to a word.
ENDINGS = ".!?…:;\"»”)"
CLAUSE_ENDINGS = ".!?…:;,|=/\t(){}[]<>–—_#*"
WORD_SIGNS = "'’-"
STATISTICS = [
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "words_per_line", "different_words", "repeated_lines",
    "sentence_share", "clause_words", "capital_words", "mixed_words", "unread_pairs",
]
#: Bytes that are looked at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Least words of a line that can be a sentence, and least words of its longest clause.
LEAST_WORDS, LEAST_CLAUSE = 6, 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


def _classes() -> np.ndarray:
    out = np.full(256, LETTER, np.uint8)
    out[:128] = SIGN
    for a, b, k in ((48, 57, DIGIT), (65, 90, LETTER), (97, 122, LETTER), (0, 32, SPACE), (127, 127, SPACE)):
        out[a : b + 1] = k
    out[10] = BREAK
    out[0xC2] = out[0xE2] = out[0xEF] = SIGN  # Latin-1 signs; U+2000 to U+2FFF; the replacement character and full width signs
    out[0xF0:] = SIGN
    return out


CLASSES = _classes()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for f in (_FACTOR, _INVERSE):
        p = np.full(n, f, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def folded(b: np.ndarray) -> np.ndarray:
    """Bytes with the capitals of ASCII and Latin-1 made small."""
    out = b.copy()
    out[(b >= 65) & (b <= 90)] += 32
    second = np.flatnonzero(b[:-1] == 0xC3) + 1
    second = second[(b[second] >= 0x80) & (b[second] <= 0x9E) & (b[second] != 0x97)]
    out[second] += 32
    return out


def word_hashes(words: Sequence[str]) -> np.ndarray:
    """The hashes that tokens of these spellings get (one token each)."""
    out = []
    for w in words:
        h, f = 0, 1
        for x in folded(np.frombuffer(w.encode(), np.uint8)).tolist():
            h, f = (h + (x + 1) * f) & 0xFFFFFFFFFFFFFFFF, f * int(_FACTOR) & 0xFFFFFFFFFFFFFFFF
        out.append(h)
    return np.array(out, np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Tokens:
    """The tokens of a block of texts, in order, as arrays: doc, kind, length (characters), word (hash), capital, line."""

    def __init__(self, texts: pa.Array):
        ended = pc.binary_join_element_wise(pc.cast(texts, pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        ended = pa.concat_arrays([ended]) if ended.offset else ended
        at = np.frombuffer(ended.buffers()[1], np.int64)[: len(ended) + 1]
        b = np.frombuffer(ended.buffers()[2], np.uint8)[: at[-1]]
        self.docs = len(ended)
        lead = (b & 0xC0) != 0x80
        kind = CLASSES[b]
        kind[:-1][(b[:-1] == 0xC2) & (b[1:] == 0xA0)] = SPACE
        if not lead.all():
            kind = kind[np.maximum.accumulate(np.where(lead, np.arange(len(b)), 0))]
        edge = np.ones(len(b) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | ((kind[1:] >= SIGN) & lead[1:]) | (kind[1:] == BREAK)
        cuts = np.flatnonzero(edge)
        kinds = kind[cuts[:-1]]
        keep = np.flatnonzero(kinds > BREAK)
        self.start, self.end, self.kind = cuts[keep], cuts[keep + 1], kinds[keep]
        chars = np.concatenate([[0], np.cumsum(lead)])
        self.length = chars[self.end] - chars[self.start]
        breaks = np.flatnonzero(b == 10)
        self.line = np.searchsorted(breaks, self.start)
        self.line_doc = np.searchsorted(at[1:], breaks, side="right")
        self.doc = self.line_doc[self.line]
        self.lines = len(breaks)
        small = folded(b)
        powers, self.inverse = _powers(len(b) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((small.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
        self.word = self.hashes(self.start, self.end)
        first, second = b[self.start], b[np.minimum(self.start + 1, len(b) - 1)]
        self.capital = (self.kind == LETTER) & (((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E)))
        self.spaced = np.ones(len(self.start), bool)  # a space or line break stands before
        self.spaced[1:] = self.start[1:] > self.end[:-1]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def pairs(self) -> np.ndarray:
        """For each token the hash of itself and the one before (numbers are one symbol, the beginning of a line is one)."""
        symbol = np.where(self.kind == DIGIT, np.uint64(7), self.word)
        before = np.roll(symbol, 1)
        if len(before):
            before[0] = 3
            before[1:][self.line[1:] != self.line[:-1]] = 3
        with np.errstate(over="ignore"):
            return _spread(before * np.uint64(0x100000001B3) + symbol)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Marks where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _isin(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """among: sorted, without repetition."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def common_table(words: Mapping[str, set[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, sorted hashes of their common words, and for each the languages that have it (bits)."""
    languages = sorted(words)
    bits: dict[int, int] = {}
    for k, lang in enumerate(languages):
        for h in word_hashes(sorted(words[lang])).tolist():
            bits[h] = bits.get(h, 0) | 1 << k
    keys = np.array(sorted(bits), np.uint64)
    return languages, keys, np.array([bits[k] for k in keys.tolist()], np.int64)


def block_statistics(texts: pa.Array, langs: Sequence[str | None], common: tuple[list[str], np.ndarray, np.ndarray], pairs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and statistics (columns in the order of STATISTICS) of texts that are not null.

    An unlisted language is replaced by the one whose common words the text has most, if they are a twentieth of its
    words, else by und. pairs: sorted hashes of the pairs of tokens known from prose.
    """
    languages, known, bits = common
    t = Tokens(texts)
    n = t.docs
    per = lambda mask, w=None: np.bincount(t.doc[mask], weights=None if w is None else w[mask], minlength=n).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    letters, digits, signs = t.kind == LETTER, t.kind == DIGIT, t.kind == SIGN
    words, solid = per(letters), np.bincount(t.doc, weights=t.length, minlength=n)

    at = np.minimum(np.searchsorted(known, t.word), max(len(known) - 1, 0))
    hit = (known[at] == t.word) & letters if len(known) else np.zeros(len(t.word), bool)
    of = np.where(hit, bits[at], 0) if len(known) else np.zeros(len(t.word), np.int64)
    hits = np.array([per((of >> k & 1) > 0) for k in range(len(languages))]).reshape(len(languages), n)
    place = {x: k for k, x in enumerate(languages)}
    chosen = np.array([place.get(x, -1) for x in langs], np.int64)
    if len(languages):
        guess = np.where(hits.max(0) > 0.05 * np.maximum(words, 1), hits.argmax(0), -1)
        chosen = np.where(chosen < 0, guess, chosen)
    out_langs = [languages[k] if k >= 0 else "und" for k in chosen]
    common_hits = hits[np.maximum(chosen, 0), np.arange(n)] * (chosen >= 0) if len(languages) else np.zeros(n)

    # lines with tokens
    line_start = np.flatnonzero(_groups(t.line)) if len(t.line) else np.zeros(0, np.int64)
    line_end = np.append(line_start[1:], len(t.line))
    ids, line_doc = t.line[line_start], t.doc[line_start]
    by_line = lambda w: np.add.reduceat(w, line_start) if len(line_start) else np.zeros(0)
    size, line_words = by_line(t.length.astype(float)), by_line(letters.astype(float))
    last = line_end - 1
    ends = (t.kind[last] == SIGN) & np.isin(t.word[last], word_hashes(list(ENDINGS)))
    filled = np.bincount(line_doc, minlength=n).astype(float)
    text_hash = t.hashes(t.start[line_start], t.end[last]) if len(ids) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        _, which, times = np.unique(_spread(text_hash + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = times[which] > 2 if len(ids) else np.zeros(0, bool)

    # clauses: between line breaks and signs that part
    parts = (signs & np.isin(t.word, word_hashes(list(CLAUSE_ENDINGS)))) | False
    new = _groups(t.line) if len(t.line) else np.zeros(0, bool)
    new[1:] |= parts[:-1]
    clause = np.cumsum(new) - 1
    clauses = int(clause[-1]) + 1 if len(clause) else 0
    clause_words = np.bincount(clause[letters], minlength=clauses).astype(float)
    clause_size = np.bincount(clause, weights=t.length, minlength=clauses)
    first = np.flatnonzero(new)
    clause_doc = t.doc[first]
    longest = np.zeros(t.lines)
    np.maximum.at(longest, t.line[first], clause_words)
    sentence = ends & (line_words >= LEAST_WORDS) & (longest[ids] >= LEAST_CLAUSE) & ~again

    # words: repeated ones, capitals inside of clauses, and signs or digits within words
    with np.errstate(over="ignore"):
        own = _spread(t.word[letters] + t.doc[letters].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        triple = _spread(own[2:] + np.uint64(3) * own[1:-1] + np.uint64(5) * own[:-2]) if len(own) > 2 else own[:0]
    word_doc = t.doc[letters]
    inside = np.flatnonzero(word_doc[2:] == word_doc[:-2])
    different = np.bincount(word_doc[inside[np.unique(triple[inside], return_index=True)[1]]], minlength=n).astype(float)
    sentence_new = _groups(t.line) if len(t.line) else np.zeros(0, bool)
    sentence_new[1:] |= (signs & np.isin(t.word, word_hashes(list(".!?…:;"))))[:-1]
    inner = t.capital & ~sentence_new
    glued = np.zeros(len(t.kind), bool)  # words and numbers that go on after a sign or a change of kind without space
    touch = ~t.spaced
    hard = signs & ~np.isin(t.word, word_hashes(list(WORD_SIGNS)))
    glued[1:] = touch[1:] & ((letters[1:] & digits[:-1]) | (digits[1:] & letters[:-1]))
    glued[2:] |= touch[2:] & letters[2:] & hard[1:-1] & touch[1:-1] & ~signs[:-2]

    unread = ~_isin(t.pairs(), pairs)
    stats = np.column_stack(
        [
            words,
            share(per(letters, t.length.astype(float)), words),
            share(per(signs), solid),
            share(per(digits, t.length.astype(float)), solid),
            share(np.bincount(line_doc[ends], minlength=n).astype(float), filled),
            share(common_hits, words),
            share(words, filled),
            np.where(words > 2, share(different, words - 2), 1.0),
            share(np.bincount(line_doc[again], weights=size[again], minlength=n), solid),
            share(np.bincount(line_doc[sentence], weights=size[sentence], minlength=n), solid),
            share(np.bincount(clause_doc, weights=clause_words * clause_size, minlength=n), solid),
            share(per(inner), words),
            share(per(glued, t.length.astype(float)), solid),
            share(np.bincount(t.doc[unread], weights=t.length[unread], minlength=n), solid),
        ]
    )
    return out_langs, stats


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of the texts that are looked at together."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK_BYTES, side="right")))
        yield a, b
        a = b
