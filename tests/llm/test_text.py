"""BPE against the public library, leaks against planted passages, languages against held-out samples."""

import os
import random

import numpy as np
import pytest

from gridloom.llm import langid, leaks
from gridloom.llm.bpe import decode_ids, encode_corpus

TOK = os.environ.get("GRIDLOOM_TOKENIZERS", "/opt/tokenizers")
DATA = "/root/testdata/sf0.01"
needs_tok = pytest.mark.skipif(not os.path.exists(f"{TOK}/byte_bpe_50k.json"), reason="no vocabulary files")
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")

TEXTS = [
    "", None, " ", "   a  b\n\n\tc   ", "Hello world", "I'll say it's <|endoftext|> don't", "naïve café — ÄÖÜ ß", "日本語のテキストです。とても良い", "🤷🏽‍♀️👍🇸🇪", "x" * 400, "aaaa bbbb " * 50,
    "1234567890 12.5% $5", "é ​﻿    a", "\x00\x1f\x85", "tail   ", "привет мир", "ab\r\ncd", "'s 'll", "　全角　空白　",
]


@needs_tok
def test_ids_equal_those_of_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOK}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = [(i, x, "clash", 0) for i, x in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, h int")
    for hot in (65_536, 3):  # all words known beforehand, or most of them folded in place
        rows = encode_corpus(df, "doc_id", "text", f"{TOK}/byte_bpe_50k.tiktoken", hot).collect()
        assert len(rows) == 2 * len(TEXTS)  # a row each, repeated rows too
        for r in rows:
            x = TEXTS[r.doc_id]
            assert list(r.ids) == t.encode(x or "", add_special_tokens=False).ids, repr(x)


@needs_tok
def test_ids_decode_to_the_text(spark):
    path = f"{TOK}/byte_bpe_50k.tiktoken"
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    back = decode_ids(encode_corpus(df, "doc_id", "text", path), "ids", path, "back")
    assert {r.doc_id: r.back for r in back.collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert encode_corpus(df.limit(0), "doc_id", "text", path).count() == 0


WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "mu", "ze") for b in ("lo", "ti", "na", "fe") for c in ("r", "n", "st", "")]


def item(rng, n=60):
    return [rng.choice(WORDS) for _ in range(n)]


def alter(rng, words, share):
    out = list(words)
    for i in rng.sample(range(1, len(words) - 1), int(len(words) * share)):
        out[i] = rng.choice([rng.choice(WORDS), out[i][1:] + "x", ""])
    return [w for w in out if w]


def dress(words):
    text = "  ".join(w.upper() if i % 3 else w.replace("e", "é").replace("o", "о") for i, w in enumerate(words))
    return text.replace("a", "a​", 2) + " <br/>"


def test_planted_passages_are_found_and_short_ones_are_not():
    rng = random.Random(9)
    items = {i: item(rng) for i in range(30)}
    index = leaks.LeakIndex(list(items), [" ".join(w) for w in items.values()], leaks.LeakSpec())
    for i, words in items.items():
        fill = lambda: " ".join(item(rng, 40))
        a = rng.randrange(0, 30)
        for n, share, want in ((24, 0.0, True), (28, 0.1, True), (60, 0.1, True), (14, 0.0, False), (10, 0.0, False), (30, 0.5, False)):
            part = words[min(a, 60 - n) : min(a, 60 - n) + n]
            text = f"{fill()} {dress(alter(rng, part, share))} {fill()}"
            assert ([x for _, x, _ in index.found([text])] == [i]) == want, (i, n, share)
    assert index.found([None, "", "...!"]) == [] and index.found([]) == []


def test_texts_found_together_equal_those_found_alone():
    rng = random.Random(5)
    items = {i: item(rng) for i in range(12)}
    index = leaks.LeakIndex(list(items), [" ".join(w) for w in items.values()], leaks.LeakSpec())
    texts = [" ".join(item(rng, 30) + alter(rng, items[i % 12][i % 9 : i % 9 + 30], 0.08) + item(rng, i)) for i in range(40)] + [None, "", " ".join(items[3]) + " x " + " ".join(items[5])]
    alone = sorted((r, i, n) for r, x in enumerate(texts) for _, i, n in index.found([x]))
    assert sorted(index.found(texts)) == alone and {(42, 3), (42, 5)} <= {(r, i) for r, i, _ in alone}


def test_long_tags_and_invisible_letters_do_not_hide_a_passage():
    rng = random.Random(6)
    words = item(rng)
    index = leaks.LeakIndex([1], [" ".join(words)], leaks.LeakSpec())
    part = words[10:34]
    tag = f"<a href='{'x' * 250} y'>"
    split = [w[:2] + chr(0xE0061) + w[2:] if i % 2 else w[:1] + "\ufe0f" + w[1:] for i, w in enumerate(part)]
    for text in (" ".join(part[:12]) + tag + " ".join(part[12:]), " ".join(split)):
        assert [i for _, i, _ in index.found([text])] == [1]
    assert len(leaks.stream(["a < b and c > d"]).codes) == len("abandcd")  # no tag


def test_a_passage_beside_a_longer_altered_stretch_is_found():
    rng = random.Random(8)
    words = item(rng, 120)
    index = leaks.LeakIndex([1], [" ".join(words)], leaks.LeakSpec())
    worse = [w if i % 4 else w[1:] + "x" for i, w in enumerate(words[60:118])]  # longer, but altered too often
    gap = ["".join(rng.choice("qwyz") for _ in w) for w in words[23:60]]
    text = " ".join(words[2:23] + gap + worse)
    assert [i for _, i, _ in index.found([text])] == [1]


def test_banded_alignment_equals_the_full_one():
    rng = random.Random(3)
    cases = []
    for _ in range(40):
        a = item(rng, 25)
        cases.append((a, item(rng, 5) + alter(rng, a[3:22], 0.15) + item(rng, 6)))
    x = leaks.stream([" ".join(b) for _, b in cases])
    items = [(leaks.stream([" ".join(a)]).codes, leaks.stream([" ".join(a)]).word) for a, _ in cases]
    wide, near = [], []
    for k, (a, b) in enumerate(cases):
        n, shift = len(items[k][0]), len("".join(a[:3])) - len("".join(b[:5]))
        wide.append(leaks.Region(k, 0, -int(x.start[k + 1] - x.start[k]), n, 0, n, np.zeros(0, int)))
        near.append(leaks.Region(k, 0, shift - 48, shift + 48, 0, n, np.zeros(0, int)))
    for one, other in zip(leaks._kept_words(items, x, wide), leaks._kept_words(items, x, near)):
        assert leaks._longest(one[0], 7) == leaks._longest(other[0], 7)


@pytest.mark.parametrize("flags, per, want", [("1111", 7, 4), ("0000", 7, 0), ("1101", 7, 2), ("1" * 7 + "0" + "1" * 7, 7, 15), ("1" * 3 + "0" + "1" * 3, 7, 7), ("111011011", 7, 3)])
def test_longest_kept(flags, per, want):
    ok = np.array([c == "1" for c in flags])
    brute = max([b - a for a in range(len(ok)) for b in range(a + 1, len(ok) + 1) if ok[a] and ok[b - 1] and (~ok[a:b]).sum() * per <= b - a] or [0])
    assert leaks._longest(ok, per) == brute and (brute == want or flags in ("111011011", "1101"))


def test_find_leaks_frame(spark):
    rng = random.Random(1)
    items = {i: item(rng) for i in range(4)}
    docs = [(1, "x " + " ".join(items[2][5:40]), 7, "c"), (2, None, 7, "c"), (3, "", 7, "c"), (4, " ".join(items[0]) + " " + " ".join(items[3]), 7, "c")]
    d = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string, item_id int, i string")
    h = spark.createDataFrame([(i, " ".join(w), "z") for i, w in items.items()] + [(9, "too short", "z"), (8, None, "z")], "item_id bigint, text string, doc_id string")
    for spec in (leaks.LeakSpec(), leaks.LeakSpec(block_chars=300)):
        got = sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(d, "doc_id", "text", h, "item_id", "text", spec).collect())
        assert got == [(1, 2), (4, 0), (4, 3)]
    assert leaks.find_leaks(d.limit(0), "doc_id", "text", h, "item_id", "text").count() == 0
    assert leaks.find_leaks(d, "doc_id", "text", h.limit(0), "item_id", "text").count() == 0


@needs_data
def test_languages_of_held_out_samples(spark):
    s = spark.read.parquet(f"{DATA}/lang_samples.parquet").toPandas()
    wrong = 0
    for fold in range(3):
        train, held = s[s.sample_id % 3 != fold], s[s.sample_id % 3 == fold]
        p = langid.Profiles(train.groupby("lang").text.apply(list).to_dict(), langid.LangSpec())
        j = p.judge(held.text.tolist())
        wrong += sum(p.langs[k] != want for k, want in zip(j.own, held.lang))
    assert wrong <= 0.01 * len(s)


@needs_data
def test_confidence_is_the_share_of_right_answers(spark):
    """Fitted on one half of the labelled sentences, checked on pieces of the other."""
    s = spark.read.parquet(f"{DATA}/lang_samples.parquet").toPandas()
    pairs = list(zip(s.lang, s.text))
    train, held = pairs[::2], [(k, " ".join(w[i : i + 4])) for k, x in pairs[1::2] for w in [x.split()] for i in range(0, len(w), 4)]
    p = langid.Profiles(langid._by_language(train), langid.LangSpec())
    p.calibration = langid.calibrate(train, langid.LangSpec())
    j = p.judge([x for _, x in held])
    right = np.array([p.langs[k] == want for k, (want, _) in zip(j.own, held)])[j.has]
    conf = p.confidence(j.whole)[j.has]
    assert abs(conf.mean() - right.mean()) < 0.05
    sure = conf > 0.97
    assert sure.sum() > 100 and right[sure].mean() > 0.95 > right[~sure].mean()
    assert (np.diff(p.calibration[1]) > 0).all()


def test_distances_by_hand():
    """The out-of-place distance of a sentence, worked out with dictionaries."""
    from collections import Counter

    spec = langid.LangSpec(grams=3, profile=50, text=20)
    samples = {"a": ["abab baba abba"], "b": ["cdcd dcdc cddc xyz"]}
    p = langid.Profiles(samples, spec)

    def counts(text):
        c = Counter()
        for w in text.split():
            v = f" {w} "
            c.update([w[i] for i in range(len(w))] + [v[i : i + n] for n in (2, 3) for i in range(len(v) - n + 1)])
        return c

    def ranked(c, n):
        code = {}
        for g in c:
            x = np.array([ord(k) for k in g], np.uint32)
            code[g] = int(langid._gram_keys(x, np.zeros(len(x), int), 3)[0][-1])
        return sorted(c, key=lambda g: (-c[g], code[g]))[:n]

    text = "abba xyz abd"
    mine = ranked(counts(text), spec.text)
    for i, k in enumerate(p.langs):
        place = {g: r for r, g in enumerate(ranked(counts(" ".join(samples[k])), spec.profile))}
        off = [abs(place[g] - int(r * spec.profile / 4 / len(mine))) if g in place else spec.profile for r, g in enumerate(mine)]
        assert abs(p.distances(langid.pieces([text]))[0, i] - sum(off) / len(mine) / spec.profile) < 1e-9


@needs_data
def test_segments_have_their_places(spark):
    p = langid.fit_profiles(spark.read.parquet(f"{DATA}/lang_samples.parquet"), "lang", "text")
    en = "The manual says that the second fan should be changed every month. It arrived on day two and fits perfectly. "
    de = "Der Kundendienst hat sich erst nach zwei Wochen gemeldet. Wir benutzen ihn ungefähr neun Stunden am Tag."
    nfd = "Cafe\u0301 <b class='x'>"
    docs = [(1, nfd + en + de, None), (2, en, "en"), (3, None, None), (4, "", None), (5, "12 !", None)]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id bigint, text string, lang string, begin int, end string")
    got = sorted(tuple(r) for r in langid.segments(df, "doc_id", "text", "lang", p).select("doc_id", "begin", "end", "lang", "sentences").collect())
    cut = len(nfd + en)
    assert [(d, k, n) for d, _, _, k, n in got] == [(1, "en", 2), (1, "de", 2), (2, "en", 2)]
    assert got[0][1] == 0 and got[0][2] == got[1][1] == cut - 1 and got[1][2] == len(nfd + en + de)  # a sentence holds its end mark


def test_long_tags_and_long_sentences():
    x = langid.pieces([f"one <a href='{'x' * 300} z'> two", "three " * 9000, "a < b. c > d"])
    assert x.words.sum() == 2 + 9000 + 4 and (x.size[x.doc == 1] <= langid.LONG + 10).all() and (x.doc == 1).sum() == 3
    assert langid.pieces([]).doc.tolist() == [] and langid.pieces(["", "1 2"]).doc.tolist() == []


@needs_data
def test_mixed_missing_and_wrong_labels(spark):
    p = langid.fit_profiles(spark.read.parquet(f"{DATA}/lang_samples.parquet"), "lang", "text")
    en = ["The manual says that the second fan should be changed every month.", "It arrived on day two and fits perfectly with everything on the desk.", "I would still buy this again without thinking twice."]
    de = ["Der Kundendienst hat sich erst nach zwei Wochen gemeldet, freundlich, aber ohne Lösung.", "Wir benutzen ihn ungefähr neun Stunden am Tag in einem kleinen Büro."]
    docs = [
        (1, " ".join(en), "en-GB"), (2, " ".join(en), "German"), (3, " ".join(en), None), (4, " ".join(en[:2] + de), "en"), (5, " ".join(en + de[:1]), "EN "), (6, "", "de"), (7, None, None), (8, "!!! 123", "und"),
        (9, " ".join(de), "deu"), (10, " ".join(de).upper(), "unknown"), (11, " ".join(en) + " Schadenfreude", "English"), (12, "説明書には交換すると書いてあります。二週間で動かなくなりました。", " "), (13, "Служба поддержки ответила вежливо, но без всякого решения.", "ru-RU"), (14, " ".join(en), "klingon"),
    ]
    df = spark.createDataFrame([(*d, "clash", 1.0) for d in docs + docs[:0]], "doc_id bigint, text string, lang string, labelled string, confidence double")
    got = sorted((r.doc_id, r.lang) for r in langid.relabelled(df, "doc_id", "text", "lang", p).collect())
    assert got == [(2, "en"), (3, "en"), (4, "de"), (4, "en"), (10, "de"), (12, "ja"), (14, "en")]
    assert all(0 <= r.confidence <= 1 for r in langid.identify(df, "doc_id", "text", "lang", p).collect())
    assert langid.identify(df.limit(0), "doc_id", "text", "lang", p).count() == 0


def test_sentences():
    assert len(langid.pieces(["One. Two!  Three? 3.5 four… five\n\nsix<br>seven。八。"]).doc) == 8
    assert langid.pieces(["...", "A b"]).doc.tolist() == [1]
