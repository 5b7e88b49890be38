"""Texts read in pieces give what they give whole; language and quality models against plain loops."""

import math
import random

import numpy as np
import pytest

from kiln.llm import langid, quality
from kiln.llm import textcodes as X


def long_text(seed, words=400):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "the", "Straße", "naïve", "a", "über-all", "x1", "中文", "end."]) for _ in range(words))


def small_blocks(monkeypatch, limit):
    real = X.blocks
    monkeypatch.setattr(X, "blocks", lambda texts, limit_=limit, ahead=0: real(texts, limit_, ahead))


@pytest.mark.parametrize("seed", range(3))
def test_pieces_lose_nothing(monkeypatch, seed):
    texts = [long_text(seed), "", "the the", long_text(seed + 10, 90), "the " * 300]
    table = np.random.default_rng(1).random(quality._NONE)
    whole, n = quality._sums(texts, table)
    profiles = langid._profiles(texts)
    small_blocks(monkeypatch, 64)
    assert sum(len(b.owner) for b in X.blocks(texts)) > 20
    parts, m = quality._sums(texts, table)
    assert n.tolist() == m.tolist() and parts == pytest.approx(whole)
    for a, b in zip(profiles, langid._profiles(texts)):
        assert (a == b).all()


def letters(text):
    return [unit(c) for c in text]


def unit(c):
    v = int(langid._values()[ord(c)])
    return v, int(X.char_class()[ord(c)]) == X.LETTER


def grams(text):
    """Buckets of all bigrams and trigrams that hold a letter, one by one."""
    u, out, mask = letters(text), [], (1 << 32) - 1
    for i in range(len(u)):
        if i + 1 < len(u):
            two = (u[i][0] * 2654435761 + u[i + 1][0] * 2246822519) & mask
            if u[i][1] or u[i + 1][1]:
                out.append(two >> (32 - langid.BITS))
        if i + 2 < len(u):
            three = (u[i][0] * 2654435761 + u[i + 1][0] * 2246822519 + u[i + 2][0] * 3266489917) & mask
            if u[i][1] or u[i + 1][1] or u[i + 2][1]:
                out.append(three >> (32 - langid.BITS))
    return out


def small_model():
    rng = np.random.default_rng(7)
    grouped, pairs = [["de", "en"], ["es", "fr", "it"]], [("de", "en"), ("es", "fr"), ("es", "it"), ("fr", "it")]
    table = np.zeros((langid._NONE + 1, len(grouped) + len(pairs)), np.float32)
    table[:-1] = rng.normal(size=(langid._NONE, table.shape[1])) * 3
    return langid.Model(grouped, pairs, table, rng.normal(size=table.shape[1]))


TEXTS = ["Hello World", "ça va? 12", "x", "7", "", "The quick brown fox", "été", "a b c d e", "中文 und mehr", long_text(4, 30)]


def test_margins_and_choice_by_hand():
    model = small_model()
    got, has = model.margins(TEXTS)
    for i, t in enumerate(TEXTS):
        g = grams(t)
        want = sum((model.table[b].astype(float) for b in g), np.zeros(model.table.shape[1])) / max(len(g), 1) + model.bias
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-4) and bool(has[i]) == any(c.isalpha() for c in t)
    names, scores = model.decide(got)
    for i in range(len(TEXTS)):
        soft = [math.exp(4 * max(-20, min(20, got[i][f]))) for f in range(2)]
        family = soft.index(max(soft))
        chance = dict.fromkeys(model.families[family], 1.0)
        for k, (a, b) in enumerate(model.pairs):
            if a in chance:
                p = 1 / (1 + math.exp(-4 * max(-20, min(20, got[i][2 + k]))))
                chance[a] *= p
                chance[b] *= 1 - p
        assert names[i] == max(chance, key=chance.get)
        assert scores[i] == pytest.approx(chance[names[i]] / sum(chance.values()) * soft[family] / sum(soft), rel=1e-6)


def features_by_hand(text):
    """All features of a text as (kind, string)."""
    out = [("gram", text[i : i + n]) for n in (3, 4) for i in range(len(text) - n + 1)]
    words = text.split()
    return out + [("word", w) for w in words] + [("again", "") for a, b in zip(words, words[1:]) if a == b]


def test_quality_features_by_hand():
    for t in [*TEXTS, "go go go stop", " lead  the the\tthe\nend"]:
        if not t:
            continue
        got = quality.features(X.Block([t], [0]))
        want = features_by_hand(t)
        assert sum(len(a) for a, _ in got) == len(want)
        assert sum(int((b == quality._REPEAT).sum()) for b in [got[-1][1]]) == sum(k == "again" for k, _ in want)
        seen = {}
        for at, bucket in got[:-1]:  # equal features share a bucket wherever they stand
            for a, b in zip(at.tolist(), bucket.tolist()):
                seen.setdefault((len(got), a), b)


def test_training_step_by_hand():
    """One pass of gradient descent over three documents, written out."""
    rng = np.random.default_rng(3)
    bags = [(np.sort(rng.choice(50, 4, replace=False)).astype(np.int32), np.full(4, 0.25, np.float32)) for _ in range(3)]
    y = np.array([0, 1, 1])
    model = quality.train(bags, y, epochs=1, rate=0.4, dim=3, seed=2)
    gen = np.random.default_rng(2)
    vec = (gen.random((quality._NONE, 3), dtype=np.float32) - 0.5) / 3
    out, bias = np.zeros((3, 2)), np.zeros(2)
    vec = vec.astype(float)
    step = 0
    for i in gen.permutation(3):
        rate = 0.4 * (1 - step / 3)
        idx, share = bags[i]
        mean = share @ vec[idx]
        z = mean @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[i]] -= 1
        back = out @ p
        out -= rate * np.outer(mean, p)
        bias -= 0.1 * rate * p
        vec[idx] -= 50 * rate * share[:, None] * back
        step += 1
    margin = vec @ (out[:, 1] - out[:, 0])
    assert model.table[:50] == pytest.approx(margin[:50], abs=1e-4) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)
