"""Language identification by hierarchical discrimination.

A text is first given a language family, then a language of that family.
One linear support vector machine per family (one against the rest) chooses
the family; one per pair of a family's languages separates those.  All are
linear in the relative frequencies of hashed letter bigrams and trigrams, so
a text's margins are sums of table rows over its n-grams: whole texts are
scored, a block of documents at a time.

Fitting takes at most about ``PER_LANG`` labelled rows of each language, by
hash of the row.  The score is the family's probability times that of the
language within it.

Equal margins go to the family or language that comes first in the model.  Very long texts are read in pieces that overlap by two characters.
A text that is null or has no letter is ``und`` with score 0.  Without any
labelled row every text is ``und``.  Null and repeated ids keep their rows;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm import textcodes as X

UNKNOWN = "und"
PER_LANG = 500
BITS = 12
# Language codes by family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "semitic": ["am", "ar", "he", "mt"],
    "austronesian": ["id", "jv", "ms", "tl"],
    "sinitic": ["yue", "zh"],
}
_NONE = 1 << BITS  # the row of n-grams that don't count


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A random value per code point, the same for both cases; one value for all that is no letter."""
    out = X.mix64(X.lower_code()).astype(np.uint32)
    out[X.char_class() != X.LETTER] = 77
    return out


def ngrams(block: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the bigram and of the trigram at each place (``_NONE``: no letter in it, or it leaves the text); letters."""
    v = np.concatenate((_values()[block.codes], np.full(2, 77, np.uint32)))
    letter = np.concatenate((X.char_class()[block.codes] == X.LETTER, [False, False]))
    two = v[:-2] * np.uint32(2654435761) + v[1:-1] * np.uint32(2246822519)
    three = two + v[2:] * np.uint32(3266489917)
    two = (two >> np.uint32(32 - BITS)).astype(np.int32)
    three = (three >> np.uint32(32 - BITS)).astype(np.int32)
    any2 = letter[:-2] | letter[1:-1]
    any2[block.end] = False
    any3 = any2 | letter[2:]
    any2[block.end - 1] &= block.begin == block.end
    for back in (0, 1, 2):
        at = block.end - back
        any3[at[at >= block.begin]] = False
    at = block.end - 1
    any2[at[at >= block.begin]] = False
    two[~any2], three[~any3] = _NONE, _NONE
    letter = letter[:-2]
    for end, n in zip(block.end[block.ahead > 0].tolist(), block.ahead[block.ahead > 0].tolist()):  # counted with the next piece
        two[end - n : end], three[end - n : end], letter[end - n : end] = _NONE, _NONE, False
    return two, three, letter


def _profiles(texts: list[str]):
    """Counts of the n-gram buckets of each text."""
    out = [np.zeros(_NONE + 1, np.float32) for _ in texts]
    for block in X.blocks(texts, ahead=2):
        two, three, _ = ngrams(block)
        for who, s, e in zip(block.owner.tolist(), block.begin.tolist(), block.end.tolist()):
            out[who] += np.bincount(two[s:e], minlength=_NONE + 1) + np.bincount(three[s:e], minlength=_NONE + 1)
    return [o[:_NONE] for o in out]


def _collect_profiles(batches):
    for b in X.slices(batches, 64):
        idx, val = [], []
        for p in _profiles(b.column(1).to_pylist()):
            on = np.flatnonzero(p)
            idx.append(on.astype(np.int32).tobytes())
            val.append((p[on] / max(p.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(idx, pa.binary()), pa.array(val, pa.binary()), b.column(2)], ["lang", "idx", "val", "place"])


def labelled_profiles(df: DataFrame, id_col: str, text: str, lang: str, per_lang: int):
    """(languages, matrix of relative frequencies) of a bounded sample of labelled rows."""
    rows = df.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("lang")).where("t is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return [], np.zeros((0, _NONE), np.float32)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    place = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 40))
    some = rows.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("lang")) * (1 << 40))
    got = (some.select("lang", "t", "place").mapInArrow(_collect_profiles, "lang string, idx binary, val binary, place long")
           .orderBy("place", "lang").limit(2 * per_lang * len(counts)).toPandas())
    x = np.zeros((len(got), _NONE), np.float32)
    for i, (k, v) in enumerate(zip(got["idx"], got["val"])):
        x[i, np.frombuffer(k, np.int32)] = np.frombuffer(v, np.float32)
    return got["lang"].tolist(), x


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of several linear machines at once: squared hinge loss, accelerated gradient steps.

    ``y`` has a column per machine: 1, -1, or 0 for rows that it does not see; its two sides weigh alike.
    """
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    sides = [np.maximum((y == s).sum(axis=0), 1) for s in (1, -1)]
    weight = np.where(y > 0, 0.5 / sides[0], 0.5 / sides[1]).astype(np.float32) * (y != 0)
    step = (1.0 / (2 * (np.einsum("ij,ij->i", x, x) @ weight) + 2 + l2)).astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = w, b
    for k in range(rounds):
        g = -2 * weight * np.maximum(0, 1 - y * (x @ vw + vb)) * y
        nw, nb = vw - step * (x.T @ g + np.float32(l2) * vw), vb - step * g.sum(axis=0)
        mo = np.float32(k / (k + 3))
        vw, vb, w, b = nw + mo * (nw - w), nb + mo * (nb - b), nw, nb
    return w, b


def group(langs: list[str], families: dict[str, list[str]]) -> list[list[str]]:
    """The learned languages by family; one that no family names is a family of its own."""
    named = [[k for k in members if k in langs] for members in families.values()]
    alone = [[k] for k in langs if not any(k in f for f in named)]
    return [f for f in named if f] + alone


class Model:
    """``table``: a row of margins per bucket; the first columns are families, then pairs of languages."""

    def __init__(self, families: list[list[str]], pairs: list[tuple[str, str]], table: np.ndarray, bias: np.ndarray):
        self.families, self.pairs, self.table, self.bias = families, pairs, table, bias

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = np.clip(margins, -20, 20)
        k = len(self.families)
        soft = np.exp(4 * margins[:, :k])
        soft /= soft.sum(axis=1, keepdims=True)
        langs = [x for f in self.families for x in f]
        out = np.zeros((len(margins), len(langs)))
        for f, members in enumerate(self.families):
            own = np.ones((len(margins), len(members)))
            for c, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = 1 / (1 + np.exp(-4 * margins[:, k + c]))
                    own[:, members.index(a)] *= p
                    own[:, members.index(b)] *= 1 - p
            own /= own.sum(axis=1, keepdims=True)
            at = langs.index(members[0])
            out[:, at : at + len(members)] = own * soft[:, [f]]
            # only the chosen family's languages can win
            out[soft.argmax(axis=1) != f, at : at + len(members)] *= 1e-9
        best = out.argmax(axis=1)
        return [langs[i] for i in best], out[np.arange(len(best)), best]

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of each whole text and whether it has a letter."""
        total = np.zeros((len(texts), self.table.shape[1]))
        n, letters = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for block in X.blocks(texts, ahead=2):
            two, three, letter = ngrams(block)
            s = self.table[two] + self.table[three]
            counted = (two != _NONE).astype(np.int32) + (three != _NONE)
            np.add.at(total, block.owner, np.add.reduceat(s, block.begin, axis=0))
            np.add.at(n, block.owner, np.add.reduceat(counted, block.begin))
            np.logical_or.at(letters, block.owner, np.add.reduceat(letter.astype(np.int32), block.begin) > 0)
        return total / np.maximum(n, 1)[:, None] + self.bias, letters


def fit(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG,
        families: dict[str, list[str]] | None = None) -> Model | None:
    """Learn from the labelled rows of ``df``; None if there is none.  ``families`` defaults to FAMILIES."""
    labels, x = labelled_profiles(df, id_col, text, lang, per_lang)
    langs = sorted(set(labels))
    if not langs:
        return None
    labels = np.array(labels)
    grouped = group(langs, FAMILIES if families is None else families)
    pairs = [(a, b) for f in grouped for i, a in enumerate(f) for b in f[i + 1 :]]
    scale = (1 / np.sqrt(np.mean([x[labels == k].mean(axis=0) for k in langs], axis=0) + 1e-6)).astype(np.float32)
    x *= scale
    sides = [np.where(np.isin(labels, f), 1, -1) for f in grouped] + [(labels == a).astype(int) - (labels == b) for a, b in pairs]
    weights, bias = _fit(x, np.stack(sides, axis=1))
    table = np.zeros((_NONE + 1, weights.shape[1]), np.float32)
    table[:_NONE] = weights * scale[:, None]
    return Model(grouped, pairs, table, bias.astype(float))


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``lang_pred``, ``score``."""
    return tag(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), model, "text").select("doc_id", "lang_pred", "score")


def tag(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with ``lang_pred`` and ``score`` (in place of columns of those names)."""
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in X.slices(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if m is not None:
                margins, letters = m.margins(texts)
                names, score = m.decide(margins)
                names = [k if ok else UNKNOWN for k, ok in zip(names, letters)]
                score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    fields = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(run, fields)


def held_out(id_col: str = "doc_id", mod: int = 3, rest: int = 1):
    """True for documents that take no part in fitting: crc32 of the id as text, modulo ``mod``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def training_rows(df: DataFrame, id_col: str = "doc_id", mod: int = 3, rest: int = 1) -> DataFrame:
    return df.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod != rest)
