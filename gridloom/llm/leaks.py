"""Evaluation texts leaking into training text: q-gram lemma filter in diagonal bands, then banded alignment."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cyrillic and Greek letters that look like a Latin one.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ɑ": "a", "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p",
}
SPAN = 1 << 22  # letters of an item at most
BANDS = 1 << 26
GONE = 0xFFFFFFFF
DOC = "\x1e"
GROUP_CHARS, GROUP_CELLS = 1 << 20, 1 << 22
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")


@dataclass(frozen=True)
class LeakSpec:
    """words: least passage. per: a passage may hold one altered word in so many
    (the statement's "about one in eight" is read as at most one in seven), one
    of them at its border, where nothing tells it from the text around.
    q: letters of a q-gram. band: step of the diagonal bands, each two steps wide.
    block_chars: evaluation text held by a task at a time; more is worked off in blocks.
    """

    words: int = 20
    per: int = 7
    q: int = 6
    band: int = 48
    block_chars: int = 4_000_000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it becomes (marks and invisible format characters go, look-alikes become Latin), and whether it is part of a word."""
    fold = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x80, 0x110000):
        ch = chr(c)
        if unicodedata.category(ch) in ("Mn", "Me", "Cf") or unicodedata.combining(ch):
            fold[c] = GONE
    for a, b in LOOK_ALIKES.items():
        fold[ord(a)] = ord(b)
    word = np.zeros(0x110000, bool)
    for m in re.finditer(r"[^\W_]+", "".join(map(chr, range(0x110000)))):
        word[m.start() : m.end()] = True
    return fold, word


@dataclass
class Stream:
    """The words of some texts, letter after letter, in a form that case, punctuation, markup, accents, spacing and look-alike letters don't change.

    doc, word: number of each letter's text and word. start: where each text begins.
    """

    codes: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    start: np.ndarray


def stream(texts: list[str]) -> Stream:
    parts = [_TAG.sub(" ", html.unescape(x)) if "<" in x or "&" in x else x for x in texts]
    joined = DOC.join(parts)
    if joined.count(DOC) >= len(parts):
        joined = DOC.join(x.replace(DOC, " ") for x in parts)
    fold, is_word = _tables()
    if joined.isascii():
        joined = joined.lower()
    else:
        joined = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", joined).casefold())
    codes = fold[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = codes[codes != GONE]
    part = is_word[codes]
    solid = part | (codes == 0x5F)
    quote = (codes == 0x27) | (codes == 0x2019) | (codes == 0x2BC)
    inner = np.zeros(len(codes), bool)
    inner[1:-1] = quote[1:-1] & solid[:-2] & solid[2:]
    codes, part = codes[~inner], part[~inner]
    at = np.flatnonzero(part)
    doc = np.cumsum(codes == ord(DOC))[at]
    word = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
    return Stream(codes[at], doc, word, np.searchsorted(doc, np.arange(len(texts) + 1)))


def _among(x: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is one of the sorted ``names``, and which."""
    low = int(names[0])
    if int(names[-1]) - low < 4 * len(x):  # a table no larger than the data
        table = np.full(int(names[-1]) - low + 2, -1, np.int32)
        table[names - low] = np.arange(len(names), dtype=np.int32)
        number = table[np.minimum(np.maximum(x - low, -1), len(table) - 1)]
        return number >= 0, number
    number = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return names[number] == x, number


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit mix of each q-gram; two q-grams that share one by chance only cost an alignment."""
    n = max(0, len(codes) - q + 1)
    out = np.zeros(n, np.uint64)
    for i in range(q if n else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
    return out


@dataclass
class Region:
    """Where a text may hold a passage: letters [first, last) of an item, on the diagonals low..high; places: its shared q-grams."""

    doc: int
    item: int
    low: int
    high: int
    first: int
    last: int
    places: np.ndarray


class LeakIndex:
    """Q-gram index of a block of evaluation texts."""

    def __init__(self, ids: list[int], texts: list[str | None], spec: LeakSpec) -> None:
        self.spec, self.ids = spec, []
        self.codes: list[np.ndarray] = []
        self.word_of: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        least, width = [], []
        grams, owner, place = [], [], []
        for i, text in zip(ids, texts):
            x = stream([text or ""])
            sizes = np.bincount(x.word)
            if len(sizes) < spec.words:
                continue
            k = len(self.ids)
            if len(x.codes) > SPAN:
                raise ValueError(f"item {i} has {len(x.codes)} letters; split items of over {SPAN}")
            self.ids.append(i)
            self.codes.append(x.codes)
            self.word_of.append(x.word)
            windows = np.lib.stride_tricks.sliding_window_view(sizes, spec.words)
            least.append(self._bound(windows))
            self.sizes.append(sizes)
            width.append(int(windows.sum(axis=1).max()))
            g = _grams(x.codes, spec.q)
            grams.append(g)
            owner.append(np.full(len(g), k, np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
        none = [np.zeros(0, np.int64)]
        self.least, self.width = np.array(least, np.int64), np.array(width, np.int64)
        self.letters = np.array([len(c) for c in self.codes], np.int64)
        self.words = np.array([len(z) for z in self.sizes], np.int64)
        self.grams = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.first, self.count = np.unique(self.grams[order], return_index=True, return_counts=True)
        self.owner, self.place = np.concatenate(owner or none)[order], np.concatenate(place or none)[order]
        # A table with room to spare: a q-gram's slot is its first bits, or the next free one.
        self.bits = np.uint64(64 - max(12, (len(self.grams) * 8).bit_length()))
        self.slots = np.full((1 << (64 - int(self.bits))) + len(self.grams) + 1, -1, np.int32)
        for k, slot in enumerate((self.grams >> self.bits).tolist()):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot] = k

    def _bound(self, windows: np.ndarray) -> int:
        """Q-gram lemma: fewest q-grams that a least passage keeps when its longest words are altered."""
        s, edits = self.spec, self.spec.words // self.spec.per + 1
        lost = np.sort(windows, axis=1)[:, ::-1][:, :edits].sum(axis=1) + edits * (s.q - 1)
        return max(s.q, int((windows.sum(axis=1) - s.q + 1 - lost).min()))

    def _lookup(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the q-grams are in the index, and where there: linear probing for all at once."""
        slot = (g >> self.bits).astype(np.int64)
        at = np.flatnonzero(self.slots[slot] >= 0)  # most texts share next to nothing
        slot, want, got = slot[at], g[at], np.full(len(at), -1, np.int64)
        todo = np.arange(len(at))
        while len(todo):
            k = self.slots[slot[todo]]
            todo, k = todo[k >= 0], k[k >= 0]
            same = self.grams[k] == want[todo]
            got[todo[same]] = k[same]
            todo = todo[~same]
            slot[todo] += 1
        return at[got >= 0], got[got >= 0]

    def regions(self, x: Stream) -> list[Region]:
        """Regions of the texts that keep enough q-grams of an item, in order of text, item and diagonal.

        Every passage has a stretch of ``words`` words with no more than its
        share of altered ones, so a region is retained if some stretch of an
        item, within one band of diagonals, meets the lemma's bound.
        """
        spec, items = self.spec, len(self.ids)
        g = _grams(x.codes, spec.q)
        if not len(g) or not items:
            return []
        few = int(self.least.min())
        near, k = self._lookup(g)
        ok = x.doc[near] == x.doc[near + spec.q - 1]
        near, k = near[ok], k[ok]
        ok = (np.bincount(x.doc[near], minlength=len(x.start)) >= few)[x.doc[near]]
        near, k = near[ok], k[ok]
        # The q-grams of a passage lie in a window of the text as wide as the widest passage and a cell of bands.
        width = int(self.width.max()) + 2 * spec.band
        until = np.searchsorted(near, np.minimum(near + width, x.start[x.doc[near] + 1]))
        rich = np.flatnonzero(until - np.arange(len(near)) >= few)
        if not len(rich):
            return []
        step = np.bincount(rich, minlength=len(near) + 1) - np.bincount(until[rich], minlength=len(near) + 1)
        ok = np.cumsum(step[:-1]) > 0
        near, k = near[ok], k[ok]
        lo, counts = self.first[k], self.count[k]
        hit = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        owner, place, at = self.owner[hit], self.place[hit], np.repeat(near, counts)
        pair = x.doc[at] * items + owner
        count = np.bincount(pair - pair.min()) if np.ptp(pair) < 4 * len(pair) else None
        if count is None:  # few texts among many items: counted by sorting
            sort = np.sort(pair)
            first = np.flatnonzero(np.diff(sort, prepend=-1))
            rich, count = sort[first], np.diff(first, append=len(sort))
        else:
            rich = np.flatnonzero(count)
            count, rich = count[rich], rich + pair.min()
        rich = rich[count >= self.least[rich % items]]
        if not len(rich):
            return []
        keep, number = _among(pair, rich)
        number, place, at = number[keep].astype(np.int64), place[keep], at[keep]
        # Cell b of a pair holds the q-grams of its bands b and b + 1. Only cells with enough of them go on.
        band = number * BANDS + np.floor_divide(place - (at - x.start[x.doc[at]]), spec.band) + BANDS // 2
        sort = np.sort(band)
        first = np.flatnonzero(np.diff(sort, prepend=-1))
        held, count = sort[first], np.diff(first, append=len(sort))
        names = np.unique(np.r_[held, held - 1])
        in_band = lambda b: np.where(held[i := np.minimum(np.searchsorted(held, b), len(held) - 1)] == b, count[i], 0)
        names = names[in_band(names) + in_band(names + 1) >= self.least[rich[names // BANDS] % items]]
        if not len(names):
            return []
        some = np.zeros(len(rich), bool)
        some[names // BANDS] = True
        keep = some[number]
        band, place = np.r_[band[keep], band[keep] - 1], np.r_[place[keep], place[keep]]
        cell = np.minimum(np.searchsorted(names, band), len(names) - 1)
        keep = names[cell] == band
        cell, place = cell[keep], place[keep]
        pair = rich[names // BANDS]
        item = pair % items
        key = cell * SPAN + place
        key.sort()
        cell = key // SPAN
        inside = np.searchsorted(key, np.minimum(key + self.width[item][cell], (cell + 1) * SPAN)) - np.arange(len(key))
        rich = np.flatnonzero(inside >= self.least[item][cell])
        if not len(rich):
            return []
        cells, first = np.unique(cell[rich], return_index=True)
        last = np.r_[first[1:], len(rich)] - 1
        a, z = np.searchsorted(cell, cells), np.searchsorted(cell, cells, "right")
        hold = self._may_hold(item[cells], a, z, key % SPAN)
        out: list[Region] = []
        for j in np.flatnonzero(hold).tolist():
            c = int(cells[j])
            k, doc, low = int(item[c]), int(pair[c]) // items, (int(names[c]) % BANDS - BANDS // 2) * spec.band
            high = low + 2 * spec.band - 1
            places = key[a[j] : z[j]] % SPAN
            p, q = int(key[rich[first[j]]] % SPAN), int(key[rich[last[j]]] % SPAN) + int(self.width[k])
            if out and (out[-1].doc, out[-1].item) == (doc, k) and low <= out[-1].high + 1:  # neighbours that overlap are aligned once
                r = out[-1]
                out[-1] = Region(doc, k, r.low, high, min(p, r.first), max(q, r.last), np.concatenate([r.places, places]))
            else:
                out.append(Region(doc, k, low, high, p, q, places))
        for r in out:
            half, word_of = int(self.width[r.item]) // 2, self.word_of[r.item]
            r.first = int(np.searchsorted(word_of, word_of[max(0, r.first - half)]))
            r.last = min(r.last + half, len(word_of))
            r.places = np.unique(r.places)
        return out

    def _may_hold(self, item: np.ndarray, a: np.ndarray, z: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the letters covered by a cell's shared q-grams, places[a:z], leave room for a passage.

        A word with an uncovered letter can be kept only within a block of
        fewer than q kept letters between altered words, since a longer one, or one
        next to a covered word, would share a q-gram. The bound takes the
        fewest alterations that leave only such blocks, and is slack at the
        borders, where a passage can begin within them.
        """
        out = np.zeros(len(item), bool)
        order = np.argsort(self.words[item], kind="stable")
        size = np.maximum(self.letters[item[order]], 8 * self.words[item[order]])
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), GROUP_CELLS, "right")) + lo)
            some = order[lo:hi]
            out[some] = self._hold_some(item[some], a[some], z[some], places)
            lo = hi
        return out

    def _hold_some(self, item: np.ndarray, a: np.ndarray, z: np.ndarray, places: np.ndarray) -> np.ndarray:
        spec, n, m = self.spec, len(item), int(self.words[item].max())
        begin = np.cumsum(self.letters[item]) - self.letters[item]
        mark = np.zeros(int(self.letters[item].sum()) + 1, np.int32)
        counts = z - a
        at = np.repeat(a - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        mark[np.repeat(begin, counts) + places[at]] = 1
        before = np.r_[np.int32(0), np.cumsum(mark[:-1], dtype=np.int32)]
        letter = np.arange(len(mark) - 1)
        bare = before[letter + 1] == before[np.maximum(letter - spec.q + 1, np.repeat(begin, self.letters[item]))]  # no q-gram began within the last q letters
        word = np.concatenate([self.word_of[k] + i * m for i, k in enumerate(item.tolist())])
        sizes = np.zeros((n, m), np.int64)
        for i, k in enumerate(item.tolist()):
            sizes[i, : self.words[k]] = self.sizes[k]
        ok = (np.bincount(word, bare, n * m) == 0).reshape(n, m) & (sizes > 0)
        flags, block = ok.copy(), np.zeros(n, np.int64)
        for k in range(m):
            border = np.zeros(n, bool)
            if k:
                border |= ok[:, k - 1]
            if k + 1 < m:
                border |= ok[:, k + 1]
            free = ~ok[:, k] & ~border & (block + sizes[:, k] < spec.q) & (sizes[:, k] > 0)
            flags[:, k] |= free
            block = np.where(free, block + sizes[:, k], 0)
        least = spec.words - 4
        gain = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(np.where(flags, 1, 1 - spec.per), axis=1)], axis=1)
        lowest = np.minimum.accumulate(np.where(flags, gain[:, :-1], 1 << 40), axis=1)
        ends = flags[:, least - 1 :] & (gain[:, least:] >= lowest[:, : m - least + 1])
        return ends.any(axis=1) & (ok.sum(axis=1) >= spec.words // 2)

    def found(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(number of the text, item_id, words of its longest passage) for each leaked item.

        A region whose best alignment holds no passage is aligned again before
        and after that alignment, as long as a part has the q-grams of a passage.
        """
        x = stream([t or "" for t in texts])
        best: dict[tuple[int, int], int] = {}
        todo = self.regions(x)
        while todo:
            again: list[Region] = []
            for some in _batches(todo):
                for r, (ok, i, j) in zip(some, _kept_words([self._cut(r) for r in some], x, some)):
                    n = _longest(ok, self.spec.per) + 1
                    if n >= self.spec.words:
                        best[r.doc, r.item] = max(n, best.get((r.doc, r.item), 0))
                    elif j > i:
                        word_of = self.word_of[r.item]
                        cut = int(np.searchsorted(word_of, word_of[r.first + i] + (i > 0 and word_of[r.first + i] == word_of[r.first + i - 1])))
                        for first, last in ((r.first, min(cut, r.first + i)), (int(np.searchsorted(word_of, word_of[r.first + j - 1], "right")), r.last)):
                            places = r.places[(r.places >= first) & (r.places < last)]
                            if last > first and len(places) >= self.least[r.item]:
                                again.append(Region(r.doc, r.item, r.low, r.high, first, last, places))
            todo = again
        return [(d, self.ids[k], n) for (d, k), n in best.items()]

    def _cut(self, r: Region) -> tuple[np.ndarray, np.ndarray]:
        word_of = self.word_of[r.item][r.first : r.last]
        return self.codes[r.item][r.first : r.last], word_of - word_of[0]


def _batches(regions: list[Region]) -> Iterator[list[Region]]:
    """Regions of like size, as many at once as ``GROUP_CELLS`` cells hold, one at least."""
    some: list[Region] = []
    wide = long = 0
    for r in sorted(regions, key=lambda r: (r.high - r.low, r.last - r.first)):
        w, n = max(wide, r.high - r.low + 3), max(long, r.last - r.first)
        if some and w * n * (len(some) + 1) > GROUP_CELLS:
            yield some
            some, w, n = [], r.high - r.low + 3, r.last - r.first
        some.append(r)
        wide, long = w, n
    if some:
        yield some


def _kept_words(items: list[tuple[np.ndarray, np.ndarray]], x: Stream, regions: list[Region]) -> list[tuple[np.ndarray, int, int]]:
    """For each region: which words of the item its best local alignment within the band keeps letter for letter, and the item letters it spans.

    Match 1, mismatch and gap -1. Row i is an item letter; column d a diagonal,
    so the text letter is i - (low + d). The rows of all regions are computed at once: a gap in
    the item runs along the row and is a running maximum.
    """
    m, n = len(items), max(len(c) for c, _ in items)
    w = max(r.high - r.low for r in regions) + 3
    kind = np.int16 if n < 30_000 and w < 30_000 else np.int32  # a score is at most n, a ramp at most w
    ramp = np.arange(w, dtype=kind)
    same = np.zeros((n, m, w), bool)  # beyond the text, and beyond a narrower band, nothing matches
    for k, ((c, _), r) in enumerate(zip(items, regions)):
        q, own, first = len(c), r.high - r.low + 3, r.first - r.high - 1
        text = x.codes[x.start[r.doc] : x.start[r.doc + 1]]
        seen = np.full(q + own - 1, GONE - 1, np.uint32)  # the text letters that the band can meet, from number ``first`` on
        lo, hi = max(first, 0), min(first + len(seen), len(text))
        if lo < hi:
            seen[lo - first : hi - first] = text[lo:hi]
        same[:q, k, :own] = np.lib.stride_tricks.sliding_window_view(seen, own)[:, ::-1] == c[:, None]
    step = same.astype(np.int8)
    step *= 2
    step -= 1
    score = np.zeros((n + 1, m, w), kind)
    for i in range(n):
        prev = score[i]
        row = prev + step[i]  # along the diagonal
        np.maximum(row[:, 1:], prev[:, :-1] - kind(1), out=row[:, 1:])  # an item letter without a text letter: the diagonal rises
        np.maximum(row, 0, out=row)
        row -= ramp  # a text letter without an item letter lowers the diagonal: a running maximum from the right
        np.add(np.maximum.accumulate(row[:, ::-1], axis=1)[:, ::-1], ramp, out=score[i + 1])
    hit = np.zeros((m, n), bool)
    joined = np.ones((m, n + 1), bool)  # no text letter was put in before this item letter
    top = score.max(axis=2)
    i = top.argmax(axis=0)
    k = np.arange(m)
    d = score[i, k].argmax(axis=1)
    end = i.copy()
    on = k[(score[i, k, d] > 0)]
    while len(on):
        a, b = i[on], d[on]
        s, r = score[a, on, b], a - 1
        diag = s == score[r, on, b] + step[r, on, b]
        up = ~diag & (b > 0) & (s == score[r, on, np.maximum(b - 1, 0)] - 1)
        right = ~diag & ~up & (b + 1 < w) & (s == score[a, on, np.minimum(b + 1, w - 1)] - 1)
        hit[on[diag], r[diag]] = same[r[diag], on[diag], b[diag]]
        joined[on[right], a[right]] = False
        i[on] = a - (diag | up)
        d[on] = b - up + right
        go = diag | up | right
        on = on[go]
        on = on[(i[on] > 0)]
        on = on[score[i[on], on, d[on]] > 0]
    out = []
    for j, (c, word_of) in enumerate(items):
        q = len(c)
        first = np.r_[True, word_of[1:] != word_of[:-1]]
        bad = ~hit[j, :q] | (~joined[j, :q] & ~first)
        out.append((np.bincount(word_of, bad, int(word_of[-1]) + 1) == 0, int(i[j]), int(end[j])))
    return out


def _longest(ok: np.ndarray, per: int) -> int:
    """Longest run of words, of which at most one in ``per`` is not kept, that begins and ends with a kept word."""
    kept = ok.tolist()
    gain, total = [0], 0
    for k in kept:
        total += 1 if k else 1 - per
        gain.append(total)
    starts: list[int] = []
    for a, k in enumerate(kept):
        if k and (not starts or gain[a] < gain[starts[-1]]):
            starts.append(a)
    best = 0
    for z in range(len(kept) - 1, -1, -1):
        while kept[z] and starts and gain[z + 1] >= gain[starts[-1]]:
            best = max(best, z + 1 - starts.pop())
    return best


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """Pairs (doc_id, item_id, words) of texts that hold a passage of an evaluation text.

    The evaluation texts are the stated query set: they are read to the driver
    in blocks of about ``block_chars`` letters, as many as their size asks for,
    and each block's q-gram index travels with a map over the documents. The
    corpus is never shuffled. One row per pair.

    Defined cases: NULL, empty and wordless texts hold nothing; items of fewer
    than ``words`` words can't leak and give no rows; NULL item ids are left
    out; documents with equal ids give one row per pair each with the longest
    passage. Other columns are ignored.
    """
    ev = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("x")).filter("i is not null and x is not null")
    total = ev.agg(F.sum(F.length("x"))).first()[0] or 0
    blocks = max(1, -(-total // spec.block_chars))
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("x")).filter("x is not null and length(x) > 0")
    kind = dict(rows.dtypes)["d"]
    out = None
    for b in range(blocks):
        part = ev.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i").toArrow()
        index = LeakIndex(part["i"].to_pylist(), part["x"].to_pylist(), spec)
        found = rows.mapInArrow(_mapper(index), f"d {kind}, i bigint, words int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("d", "i").agg(F.max("words").alias("words")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "words")


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``GROUP_CHARS`` letters."""
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _mapper(index: LeakIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, rows = 0, []
            for group in _groups(batch["x"].to_pylist()):
                rows += [(base + r, i, n) for r, i, n in index.found(group)]
                base += len(group)
            at, item, words = ([v[k] for v in rows] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch["d"].take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(words, pa.int32())], ["d", "i", "words"])

    return run
