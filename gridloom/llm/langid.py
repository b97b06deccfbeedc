"""Missing or wrong language labels: rank-order n-gram profiles and out-of-place distances, per sentence."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages with their two- and three-letter codes and English names.
LANGUAGES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français"),
    "es": ("spa", "spanish", "español"),
    "it": ("ita", "italian", "italiano"),
    "pt": ("por", "portuguese", "português"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "ru": ("rus", "russian", "русский"),
    "ja": ("jpn", "japanese", "日本語"),
}
# Labels that name no language.
MISSING = ("", "und", "unknown", "unk", "none", "null", "n/a", "mul", "zxx")

DOC, SENTENCE = "\x1e", "\x1f"  # separators of the joined text; both are white space
_BREAK = re.compile(r"<br\s*/?>|[\r\n]{2,}", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>\x1e\x1f]*>|https?://\S+|&[#\w]+;")
_END = re.compile(r"[.!?…]+[\"'»”)\]]*(?=\s|$)|[。！？]+[」』）]*")
_LONG = re.compile(r"([^\x1e\x1f]{20000}\S*)\s")
LONG = 20_000
GROUP_CHARS, SLICE_LETTERS = 1 << 20, 1 << 18
BITS = 40  # of an n-gram's code
ABSENT = 30_000  # a rank beyond any profile's
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class LangSpec:
    """grams: longest n-gram (at most 8); n-grams of one letter and more, with word borders. profile: ranks kept of a
    language (at most 10,000). text: ranks kept of a sentence.
    sentences: least sentences of a language in a mixed text. words, letters: what a sentence needs, in
    scripts with and without spaces, to be judged on its own. lead: how much nearer (as a share of its distance) than the
    text's own language another one must be for a sentence to count as foreign.
    sample_rows: bound on the labelled rows that the profiles are fitted on.
    """

    grams: int = 4
    profile: int = 3000
    text: int = 400
    sentences: int = 2
    words: int = 3
    letters: int = 6
    lead: float = 0.06
    sample_rows: int = 100_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    for m in re.finditer(r"[^\W\d_]+", "".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def _split(m: re.Match) -> str:
    return " " * (m.end() - m.start() - 1) + SENTENCE


def marked(texts: list[str]) -> str:
    """The texts joined by ``DOC``, with tags blanked and a ``SENTENCE`` at each end of one: no letter changes its place.

    Sentences end at end marks (with white space after them, except CJK ones),
    blank lines and line-break tags; one of over ``LONG`` letters also at the
    next white space, so that what is held at once stays bounded.
    """
    joined = DOC.join(texts)
    if joined.count(DOC) >= len(texts) or SENTENCE in joined:
        joined = DOC.join(x.replace(DOC, " ").replace(SENTENCE, " ") for x in texts)
    joined = _END.sub(_split, _TAG.sub(_blank, _BREAK.sub(_split, joined)))
    ends = _breaks(_codes(joined))[0]
    if np.diff(np.r_[-1, ends, len(joined)]).max(initial=0) > LONG:
        joined = _LONG.sub(r"\1" + SENTENCE, joined)
    return joined


def _breaks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the separators, and which of them part documents."""
    at = np.flatnonzero((codes == 0x1E) | (codes == 0x1F))
    return at, codes[at] == 0x1E


def _plain(joined: str) -> np.ndarray:
    return _codes(unicodedata.normalize("NFKC", joined).lower())


@dataclass
class Pieces:
    """Sentences with letters of a group of texts: document, place in its text, words and letters, and the word stream.

    stream: code points of all words, each with a blank before and after. word: number of the word at each place.
    """

    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    words: np.ndarray
    size: np.ndarray
    wide: np.ndarray
    stream: np.ndarray
    word: np.ndarray
    sentence: np.ndarray  # of each word


def pieces(texts: list[str]) -> Pieces:
    raw = marked(texts)
    ends, part = _breaks(_codes(raw))
    ends, part = np.r_[ends, len(raw)], np.r_[part, True]
    begin = np.r_[0, ends[:-1] + 1]
    doc = np.r_[0, np.cumsum(part)[:-1]]
    origin = begin[np.r_[True, part[:-1]]]  # where each document begins
    codes = _plain(raw)
    at = np.flatnonzero(_letters()[codes])
    cut = _breaks(codes)[0]
    fresh = np.diff(at, prepend=-2) != 1
    first = np.flatnonzero(fresh)
    word = np.cumsum(fresh) - 1
    stream = np.full(len(at) + 2 * len(first), 32, np.uint32)
    place = np.arange(len(at)) + 2 * word + 1
    stream[place] = codes[at]
    sizes = np.diff(np.r_[first, len(at)])
    piece = np.searchsorted(cut, at[first])  # the sentence of each word, among all of them
    kept, sentence = np.unique(piece, return_inverse=True)
    n = len(kept)
    wide = np.bincount(sentence, np.add.reduceat(codes[at] >= 0x3040, first) if len(first) else np.zeros(0), n)
    d = doc[kept]
    return Pieces(d, begin[kept] - origin[d], (ends + ~part)[kept] - origin[d], np.bincount(sentence, minlength=n), np.bincount(sentence, sizes, n), wide, stream, np.repeat(np.arange(len(first)), sizes + 2), sentence)


def _gram_keys(stream: np.ndarray, word: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """A 40-bit code of each n-gram, its length first, and its word. Two n-grams share a code by chance about once in 10^11."""
    keys, words = [], []
    h = np.zeros(len(stream), np.uint64)
    for n in range(1, longest + 1):
        k = len(stream) - n + 1
        if k <= 0:
            break
        h = h[:k] * M1 + stream[n - 1 :].astype(np.uint64) + np.uint64(1)
        ok = word[:k] == word[n - 1 :]
        if n == 1:
            ok = ok & (stream != 32)
        g = h[ok] * M2
        keys.append((g ^ (g >> np.uint64(29))) * M1 >> np.uint64(64 - BITS + 3) | np.uint64((n - 1) << (BITS - 3)))
        words.append(word[:k][ok])
    return (np.concatenate(keys), np.concatenate(words)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Profiles:
    """Rank of each n-gram in each language's profile, in a hash table, and a calibration of margins.

    ``calibration``: rising margins and the share of held-out judgements at such a margin that were right.
    """

    def __init__(self, samples: dict[str, list[str]], spec: LangSpec) -> None:
        self.spec = spec
        self.langs = sorted(samples)
        self.calibration: tuple[np.ndarray, np.ndarray] | None = None
        best: list[np.ndarray] = []
        for k in self.langs:
            found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for group in _groups(samples[k]):
                x = pieces(group)
                g, c = np.unique(_gram_keys(x.stream, x.word, spec.grams)[0], return_counts=True)
                found, at = np.unique(np.r_[found, g], return_inverse=True)
                counts = np.bincount(at, np.r_[counts, c], len(found)).astype(np.int64)
            best.append(found[np.lexsort((found, -counts))][: spec.profile])
        grams = np.unique(np.concatenate(best)) if best else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(grams)), ABSENT, np.int16)
        for i, b in enumerate(best):
            self.ranks[i, np.searchsorted(grams, b)] = np.arange(len(b))
        bits = max(4, int(len(grams) * 8).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.full(1 << bits, -1, np.int32)
        self.grams = np.r_[grams, np.uint64(1 << 63)]  # the last one equals no code
        for row, slot in enumerate((grams & self.mask).tolist()):
            while self.table[slot] >= 0:
                slot = (slot + 1) & int(self.mask)
            self.table[slot] = row

    def _rows(self, g: np.ndarray) -> np.ndarray:
        """Row of each n-gram's ranks, or -1: linear probing for all at once."""
        slot = (g & self.mask).astype(np.int64)
        row = self.table[slot]
        open_ = np.flatnonzero((row >= 0) & (self.grams[row] != g))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            row[open_] = self.table[slot[open_]]
            open_ = open_[(row[open_] >= 0) & (self.grams[row[open_]] != g[open_])]
        return row

    def distances(self, x: Pieces) -> np.ndarray:
        """Mean out-of-place distance of each sentence to each language, as a share of the largest possible one.

        A sentence's n-grams rank by falling count, equal counts by length, then code.
        A sentence has far fewer ranks than a profile, so its ranks are
        stretched over the profile's first quarter before comparison.
        """
        n = len(x.doc)
        out = np.ones((n, len(self.langs)))
        ends = np.cumsum(np.bincount(x.sentence, x_sizes(x), n)) if n else np.zeros(0)
        lo = 0
        while lo < n:  # as many sentences at once as a slice holds, one at least
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + SLICE_LETTERS, "right")))
            out[lo:hi] = self._slice(x, lo, hi, int(done), int(ends[hi - 1]))
            lo = hi
        return out

    def _slice(self, x: Pieces, lo: int, hi: int, a: int, z: int) -> np.ndarray:
        spec, n = self.spec, hi - lo
        g, word = _gram_keys(x.stream[a:z], x.word[a:z], spec.grams)
        key = (x.sentence - lo).astype(np.uint64)[word] << np.uint64(BITS) | g
        key.sort()
        first = np.flatnonzero(_changes(key))
        count = np.minimum(np.diff(first, append=len(key)), 4095)
        key = key[first]
        s = (key >> np.uint64(BITS)).astype(np.int64)
        # Within a sentence by falling count; the low bits say where an n-gram was before.
        order = s << 12
        order |= 4095 - count
        order <<= 28
        order |= np.arange(len(s))
        order.sort()
        order &= (1 << 28) - 1
        distinct = np.bincount(s, minlength=n)
        place = np.arange(len(s)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
        row = self._rows(key & np.uint64((1 << BITS) - 1))[order]
        keep = np.flatnonzero((row >= 0) & (place < spec.text))
        kept = np.maximum(np.minimum(distinct, spec.text), 1)
        row, s, place = row[keep], s[keep], place[keep]
        saved = np.zeros((n, len(self.langs)))
        if len(s):
            stretch = (place * (spec.profile / 4 / kept)[s]).astype(np.int16)
            heads = np.flatnonzero(_changes(s))
            at = s[heads]
            for i, ranks in enumerate(self.ranks):
                near = ranks[row]
                near -= stretch
                np.abs(near, out=near)
                np.subtract(spec.profile, near, out=near)
                np.maximum(near, 0, out=near)  # an n-gram the profile lacks is as far as can be
                saved[at, i] = np.add.reduceat(near, heads, dtype=np.int64)
        return 1 - saved / (kept * spec.profile)[:, None]

    def confidence(self, dist: np.ndarray) -> np.ndarray:
        """How likely the nearest language is right, from how much nearer it is than the second nearest."""
        return np.interp(_margin(dist), *self.calibration) if self.calibration else _margin(dist)

    def judge(self, texts: list[str]) -> Judged:
        return Judged(self, pieces(texts), len(texts))


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first one does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def x_sizes(x: Pieces) -> np.ndarray:
    """Places of the stream that each word takes."""
    return np.bincount(x.word, minlength=len(x.sentence))


def _margin(dist: np.ndarray) -> np.ndarray:
    if dist.shape[1] < 2:
        return np.ones(len(dist))
    two = np.partition(dist, 1, axis=1)
    return 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)


class Judged:
    """Languages of a group of texts: of each sentence with letters, and of each text."""

    def __init__(self, p: Profiles, x: Pieces, texts: int) -> None:
        spec, k = p.spec, len(p.langs)
        self.p, self.x = p, x
        self.d = d = p.distances(x)
        whole = np.zeros((texts, k))
        np.add.at(whole, x.doc, d * x.size[:, None])
        total = np.bincount(x.doc, x.size, texts)
        self.has = total > 0
        self.whole = whole / np.maximum(total, 1)[:, None]
        own = self.whole.argmin(axis=1)
        best, mine = d.argmin(axis=1), own[x.doc]
        at = np.arange(len(d))
        lead = 1 - d[at, best] / np.maximum(d[at, mine], 1e-9)
        enough = (x.words >= spec.words) | (x.wide >= spec.letters)
        lang = np.where((lead > spec.lead) & enough, best, mine)
        counts = np.bincount(x.doc[enough] * k + lang[enough], minlength=texts * k).reshape(texts, k)
        many = counts >= spec.sentences
        self.mixed = many.sum(axis=1) > 1
        # A sentence of a language that isn't one of the text's counts for the text's own, or else the commonest one.
        main = np.where(many[np.arange(texts), own], own, np.where(many, counts, -1).argmax(axis=1))
        self.lang = np.where(self.mixed[x.doc], np.where(many[x.doc, lang], lang, main[x.doc]), mine)
        self.own = own

    def _sums(self, group: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.p.langs)))
        np.add.at(out, group, self.d * self.x.size[:, None])
        return out / np.maximum(np.bincount(group, self.x.size, n), 1e-9)[:, None]

    def languages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, language, confidence, sentences, mixed: a row for each text's language, or for each of a mixed text."""
        k, x = len(self.p.langs), self.x
        group, at, n = np.unique(x.doc * k + self.lang, return_inverse=True, return_counts=True)
        return group // k, group % k, self.p.confidence(self._sums(at, len(group))), n, self.mixed[group // k]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, begin, end, language, confidence, sentences: a row for each run of sentences of one language."""
        x = self.x
        key = x.doc * len(self.p.langs) + self.lang
        head = np.diff(key, prepend=-1) != 0
        at = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        n = np.diff(first, append=len(key))
        return x.doc[first], x.begin[first], x.end[first + n - 1], self.lang[first], self.p.confidence(self._sums(at, len(first))), n


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


def named_language(label: Column) -> Column:
    """The language a label names: NULL if missing, its two-letter code, or '?' for a label that names none of the nine."""
    plain = F.lower(F.trim(label))
    head = F.regexp_extract(plain, r"^([^-_ ]+)", 1)
    out = F.when(label.isNull() | plain.isin(*MISSING), F.lit(None).cast("string"))
    for code, names in LANGUAGES.items():
        out = out.when(head.isin(code, *names), F.lit(code))
    return out.otherwise(F.lit("?"))


def fit_profiles(samples: DataFrame, lang: str, text: str, spec: LangSpec = LangSpec()) -> Profiles:
    """Profiles from labelled rows: at most ``sample_rows`` of them, chosen by a hash, in a defined order.

    Margins are calibrated on the same rows: each third is judged, whole and in
    pieces of three words, by profiles of the other two, and the share of right
    answers is made to rise with the margin.
    """
    rows = samples.select(F.col(f"`{lang}`").alias("k"), F.col(f"`{text}`").alias("x")).filter("k is not null and x is not null")
    rows = rows.orderBy(F.xxhash64("k", "x"), "k", "x").limit(spec.sample_rows).toArrow()
    pairs = list(zip(rows["k"].to_pylist(), rows["x"].to_pylist()))
    if not pairs:
        raise ValueError("no labelled rows to fit language profiles on")
    out = Profiles(_by_language(pairs), spec)
    out.calibration = calibrate(pairs, spec)
    return out


def _by_language(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    got: dict[str, list[str]] = {}
    for k, x in pairs:
        got.setdefault(k, []).append(x)
    return got


def calibrate(pairs: list[tuple[str, str]], spec: LangSpec, folds: int = 3, bins: int = 20) -> tuple[np.ndarray, np.ndarray] | None:
    """Rising margins, and the share of right answers near each (pooled until it rises); NULL where a fold lacks a language."""
    margin, right = [], []
    for f in range(folds):
        train = _by_language([p for i, p in enumerate(pairs) if i % folds != f])
        held = [p for i, p in enumerate(pairs) if i % folds == f]
        if not held or len(train) < 2 or {k for k, _ in held} - set(train):
            return None
        held += [(k, " ".join(w[i : i + 3])) for k, x in held for w in [x.split()] for i in range(0, len(w), 3)]
        p, n = Profiles(train, spec), 0
        for group in _groups([x for _, x in held]):
            j = p.judge(group)
            truth = np.array([p.langs.index(k) for k, _ in held[n : n + len(group)]])
            n += len(group)
            margin.append(_margin(j.whole[j.has]))
            right.append((j.own == truth)[j.has])
    m, ok = np.concatenate(margin), np.concatenate(right)
    parts = [b for b in np.array_split(np.argsort(m, kind="stable"), bins) if len(b)]
    pooled: list[list[float]] = []  # margin, answers, right ones
    for b in parts:
        pooled.append([float(m[b].sum()), len(b), float(ok[b].sum())])
        while len(pooled) > 1 and pooled[-1][2] / pooled[-1][1] <= pooled[-2][2] / pooled[-2][1]:
            last = pooled.pop()
            pooled[-1] = [a + c for a, c in zip(pooled[-1], last)]
    return np.array([s / n for s, n, _ in pooled]), np.array([(c + 1) / (n + 2) for _, n, c in pooled])


def _mapped(docs: DataFrame, doc_id: str, text: str, label: str, profiles: Profiles, schema: str, rows_of) -> DataFrame:
    """A map over the documents: the rows that ``rows_of`` makes of each group of texts, beside their ids and labels."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("x"), named_language(F.col(f"`{label}`")).alias("labelled")).filter("x is not null and length(x) > 0")
    names = np.array(profiles.langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = 0
            for group in _groups(batch["x"].to_pylist()):
                part = batch.slice(base, len(group))
                base += len(group)
                at, cols = rows_of(profiles.judge(group), names)
                take = pa.array(at, pa.int64())
                cols = {"d": part["d"].take(take), **cols, "labelled": part["labelled"].take(take)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return rows.mapInArrow(run, f"d {dict(rows.dtypes)['d']}, {schema}, labelled string").withColumnRenamed("d", doc_id)


def identify(docs: DataFrame, doc_id: str, text: str, label: str, profiles: Profiles) -> DataFrame:
    """Languages of each document with words: doc_id, lang, confidence, sentences, mixed, labelled (what its label names).

    One row, or one for each language of a mixed text. A map over the documents:
    nothing is shuffled, and all texts of a group are worked off together.
    ``confidence``: how often such a margin between the nearest and the second
    nearest profile was right on held-out samples.

    Defined cases: NULL, empty and wordless texts give no row. A sentence of
    few words counts for the text's own language. Texts of one language with
    a foreign sentence, word or phrase aren't mixed. Repeated rows give
    repeated results. Very long texts are judged whole. Other columns are ignored.
    """

    def rows_of(j: Judged, names: np.ndarray):
        at, lang, conf, n, mixed = j.languages()
        return at, {"lang": pa.array(names[lang], pa.string()), "confidence": pa.array(conf, pa.float64()), "sentences": pa.array(n, pa.int32()), "mixed": pa.array(mixed, pa.bool_())}

    return _mapped(docs, doc_id, text, label, profiles, "lang string, confidence double, sentences int, mixed boolean", rows_of)


def segments(docs: DataFrame, doc_id: str, text: str, label: str, profiles: Profiles) -> DataFrame:
    """Segments of each document with words: doc_id, begin, end, lang, confidence, sentences, labelled.

    A segment is a run of sentences of one language, [begin, end) counts the
    letters (code points) of the text as it stands. A text of one language is one segment. Cases as for ``identify``.
    """

    def rows_of(j: Judged, names: np.ndarray):
        at, begin, end, lang, conf, n = j.segments()
        return at, {"begin": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64()), "lang": pa.array(names[lang], pa.string()), "confidence": pa.array(conf, pa.float64()), "sentences": pa.array(n, pa.int32())}

    return _mapped(docs, doc_id, text, label, profiles, "begin bigint, end bigint, lang string, confidence double, sentences int", rows_of)


def relabelled(docs: DataFrame, doc_id: str, text: str, label: str, profiles: Profiles) -> DataFrame:
    """The rows of ``identify`` whose document has no label, one that names another language, or a mixed text."""
    return identify(docs, doc_id, text, label, profiles).filter("mixed or labelled is null or labelled <> lang")
