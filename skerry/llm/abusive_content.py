"""Abusive, hateful or sexual content: a counterfactually regularised classifier of passages.

Labels stand for documents, of which one passage may be the reason, so training repeats two steps: each positive document gives
its highest passages as positive, every passage of the negative ones is negative; then a logistic regression over hashed words
and word pairs is fitted. Its loss also holds the change of a passage's score when a term for a group of people is swapped for
another or for a neutral word, so naming a group is no sign of abuse by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents to fit on at most; a parameter of every operator here.
SAMPLE = 12_000

#: Of the negative passages of that sample the share that looks most like positive ones is fitted on, and of the others one in so many.
HARD_SHARE, EASY_EVERY = 0.25, 8

#: Places of hashed features.
BITS = 18

#: Score (a probability) from which a document counts as abusive.
THRESHOLD = 0.4

REMEMBERED = 400_000

#: Common insults and sexual words of the languages of the texts; their presence is one more feature.
SEEDS = frozenset(
    "abschaum abruti animal arschloch asshole asqueroso bastard basura bitch brainless braindead cabrón camgirls cerdo clown connard "
    "cretin crétin cunt depp dimwit dirty drecksau dumb dumbass escoria escorts faggot filth filthy fotze fresse fuck fucking gilipollas "
    "gueule halfwit hardcore horny hure hurensohn idiot idiota idiots imbecile imbécil imbécile inútil lice loser losers lowlife maggot "
    "merde miststück moron morons naked nudes nutte parasites pathetic penner pig pigs porc porn porno puta pute raté racaille rat ratas "
    "rats retard salope schlampe schwachkopf schwein scum scumbag sexy shit slut slutty stupid strippers topless trash tramp ugly "
    "ungeziefer useless vermin vermine vollidiot versager whore worthless xxx".split()
)

#: Terms for groups of people. One is as good as another in a neutral sentence.
IDENTITY = (
    "women men girls boys migrants immigrants refugees foreigners muslims jews christians hindus buddhists atheists gays lesbians "
    "blacks whites asians africans europeans americans arabs roma disabled elderly frauen männer juden muslime ausländer flüchtlinge "
    "femmes hommes juifs musulmans étrangers réfugiés mujeres hombres judíos musulmanes extranjeros refugiados"
).split()
NEUTRAL = "people"

_GAPS = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
#: Letters of other alphabets that look Latin.
_LOOKALIKE = str.maketrans("аеорсухіѕјԁһкмтвнгιοραενκτ", "aeopcyxisjdhkmtbhriopaevkt")
_MIXED = re.compile(r"[a-zß-ÿ][Ͱ-ϿЀ-ӿԀ-ԯ]|[Ͱ-ϿЀ-ӿԀ-ԯ][a-zß-ÿ]")
_OTHER = re.compile(r"[^\W\d_]*[Ͱ-ϿЀ-ӿԀ-ԯ][^\W\d_]*")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_SIGNS = str.maketrans("0134578@$!|+", "oieastbasiit")
_LEET = re.compile(r"(?<![^\W_])(?=[^\s]*[a-zß-ÿ])[a-zß-ÿ0-9@$!|+]*(?:[a-zß-ÿ][0-9@$!|+]|[0-9@$|+][a-zß-ÿ])[a-zß-ÿ0-9@$|+]*(?:[@$](?![^\W_]))?")
_STARRED = re.compile(r"(?<![^\W_])([^\W\d_]+)\*{1,4}([^\W\d_]+)(?![^\W_*])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_HINT = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]|" + _MIXED.pattern + r"|[a-zß-ÿ]\*+[a-zß-ÿ]|[0-9@$|+][a-zß-ÿ]|[a-zß-ÿ][@$|+0-9]|([^\W\d_])\1\1|(?<![^\W_])[^\W\d_][ .\-_*·][^\W\d_][ .\-_*·][^\W\d_](?![^\W_])")

#: Marks a word that had to be deciphered.
MARK = "\ue000"
_TOKEN = re.compile(r"[^\W_]+|" + MARK + r"|[.!?\n]")
_STOPS = frozenset(".!?\n")


def decipher(text: str) -> str:
    """Lower-case text with disguised words spelt out, each after a mark."""
    text = text.lower()
    if not _HINT.search(text):
        return text
    text = _GAPS.sub("", text)
    if _MIXED.search(text):
        text = _OTHER.sub(lambda m: MARK + m.group().translate(_LOOKALIKE) if _MIXED.search(m.group()) else m.group(), text)
    text = _SPACED.sub(lambda m: MARK + re.sub(r"[^\w]|_", "", m.group()), text)

    def letters(m: re.Match) -> str:
        word = m.group()
        if sum(c.isdigit() for c in word) > 3 or not any(c.isalpha() for c in word):
            return word
        plain = word.translate(_SIGNS)
        if plain.isalpha() and len(plain) > 2 and not (word.isalnum() and word[-1].isdigit() and word[:-1].isalpha()):
            return MARK + plain
        return word

    text = _LEET.sub(letters, text)
    text = _STARRED.sub(lambda m: MARK + m.group(1) + m.group(2), text)
    return _LONG.sub(r"\1", text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Featurizer:
    """Hashed words and word pairs of the passages of texts."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashed(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            h = self.known[word] = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ~3) | (word in _STOPS) | ((word in SEEDS) << 1)
        return h

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, passage of each feature, text of each passage); passages count from 0 over all texts."""
        return self.of_tokens([_TOKEN.findall(decipher(t)) if t else [] for t in texts])

    def of_tokens(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(t) + 1 for t in tokens], np.int64)
        end = self.hashed(".")
        flat = np.fromiter((h for t in tokens for h in (*map(self.hashed, t), end)), np.uint64, int(lengths.sum()))
        text = np.repeat(np.arange(len(tokens)), lengths)
        stop = (flat & np.uint64(1)) == 1
        passage = np.cumsum(stop) - stop
        pair = _mix(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:])  # also the first and the last word with the stop beside it
        pair_at = np.where(stop[:-1], passage[1:], passage[:-1])
        worded = ~(stop[:-1] & stop[1:])  # two stops in a row say nothing
        pair, pair_at = pair[worded], pair_at[worded]
        seed = ((flat & np.uint64(2)) == 2) & ~stop
        place = np.uint64((1 << BITS) - 2)
        feature = np.concatenate([_mix(flat[~stop]) % place + np.uint64(1), pair % place + np.uint64(1), np.zeros(int(seed.sum()), np.uint64)]).astype(np.int64)
        at = np.concatenate([passage[~stop], pair_at, passage[seed]])
        of = np.zeros(int(passage[-1]) + 2 if len(passage) else 1, np.int64)
        of[passage] = text
        return feature, at, of


def passage_scores(weights: np.ndarray, bias: float, feature: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Logit of each passage; a feature counts as often as it occurs, divided by the root of the passage's length."""
    size = np.maximum(np.bincount(at, minlength=n), 1)
    return bias + np.bincount(at, weights[feature], minlength=n) / np.sqrt(size) * 2


def _swap(tokens: list[str], groups: list[str], rng: np.random.Generator) -> list[str] | None:
    known = set(groups)
    if not known.intersection(tokens):
        return None
    return [(NEUTRAL if rng.random() < 0.5 else groups[rng.integers(len(groups))]) if t in known else t for t in tokens]


def train(texts: list[str | None], labels: list[int], identity: list[str] | None = None, rounds: int = 5, steps: int = 60, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, bias) fitted on labelled texts. Without a label of each kind the seeds alone weigh."""
    weights, bias = np.zeros(1 << BITS), -3.0
    weights[0] = 4.0
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return weights, bias
    groups = list(dict.fromkeys([*IDENTITY, *(identity or [])]))
    rng = np.random.default_rng(11)
    featurize = Featurizer()
    tokens = [_TOKEN.findall(decipher(t)) if t else [] for t in texts]
    feature, at, of = featurize.of_tokens(tokens)
    # Passages with a group and their counterparts, for the penalty.
    twins = [(p, s) for p in _passages(tokens) if (s := _swap(p, groups, rng)) is not None]
    real, real_at, _ = featurize.of_tokens([a for a, _ in twins])
    fake, fake_at, _ = featurize.of_tokens([b for _, b in twins])
    n, m = len(of), max(1, len(twins))
    # First guess: how much more often a feature is in positive texts.
    text_of = of[at]
    once = np.unique(text_of * (1 << BITS) + feature)
    in_text, f = once >> BITS, once & ((1 << BITS) - 1)
    pos = np.bincount(f, (y[in_text] == 1).astype(float), minlength=1 << BITS)
    neg = np.bincount(f, (y[in_text] == 0).astype(float), minlength=1 << BITS)
    odds = np.log((pos + 0.5) / (y == 1).sum()) - np.log((neg + 0.5) / (y == 0).sum())
    guess = np.where(pos + neg >= 2, np.clip(odds, -3, 3), 0.0)
    guess[0] = max(guess[0], 1.0)
    shared = pos + neg >= 2  # what one text alone has says nothing of others
    logit = passage_scores(guess, 0.0, feature, at, n)
    # The easy negative passages are right from the start, so a part of them is enough.
    clean = y[of] == 0
    kept = ~clean | (np.arange(n) % EASY_EVERY == 0)
    kept |= logit >= np.quantile(logit[clean], 1 - HARD_SHARE)
    number = np.cumsum(kept) - 1
    inside = kept[at]
    feature, at, of, logit, n = feature[inside], number[at[inside]], of[kept], logit[kept], int(kept.sum())
    size = np.sqrt(np.maximum(np.bincount(at, minlength=n), 1)) / 2
    m1, m2, b1, b2, t = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0, 0
    real_n, fake_n = np.sqrt(np.maximum(np.bincount(real_at, minlength=m), 1)) / 2, np.sqrt(np.maximum(np.bincount(fake_at, minlength=m), 1)) / 2
    for turn in range(rounds):
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, of, logit)
        chosen = (y[of] == 1) & (logit >= best[of] - (0.0 if turn == 0 else 0.5)) & (np.bincount(at, minlength=n) > 0)
        if turn:
            chosen &= logit > min(0.5, 1.25 * turn - 3.25)  # a positive text without any such passage is a wrong label
        target = chosen.astype(float)
        use = chosen | (y[of] == 0)
        weight = use.astype(float)
        for _ in range(steps):
            t += 1
            p = 1 / (1 + np.exp(-np.clip(passage_scores(weights, bias, feature, at, n), -30, 30)))
            err = weight * (p - target)
            total = max(1.0, target.sum())
            gradient = np.bincount(feature, (err / size)[at], minlength=1 << BITS) / total
            if twins:
                gap = (np.bincount(real_at, weights[real], minlength=m) / real_n - np.bincount(fake_at, weights[fake], minlength=m) / fake_n) * penalty / len(twins)
                gradient += np.bincount(real, (gap / real_n)[real_at], minlength=1 << BITS) - np.bincount(fake, (gap / fake_n)[fake_at], minlength=1 << BITS)
            gradient = (gradient + 2e-4 * weights) * shared
            m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.98 * m2 + 0.02 * gradient**2
            weights -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.98**t)) + 1e-6) * (m1 != 0)
            g = err.sum() / total
            b1, b2 = 0.9 * b1 + 0.1 * g, 0.98 * b2 + 0.02 * g * g
            bias -= 0.1 * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.98**t)) + 1e-6)
        logit = passage_scores(weights, bias, feature, at, n)
    return weights, bias


def _passages(tokens: list[list[str]]) -> Iterator[list[str]]:
    for text in tokens:
        start = 0
        for i, t in enumerate(text):
            if t in _STOPS:
                if i > start:
                    yield text[start:i]
                start = i + 1
        if start < len(text):
            yield text[start:]


def score_texts(featurize: Featurizer, weights: np.ndarray, bias: float, texts: list[str | None]) -> np.ndarray:
    """Each text's greatest passage score, a probability; 0 for texts without words."""
    feature, at, of = featurize(texts)
    logit = passage_scores(weights, bias, feature, at, len(of))
    worded = np.bincount(at, minlength=len(of)) > 0
    out = np.full(len(texts), -np.inf)
    np.maximum.at(out, of[worded], logit[worded])
    empty = np.array([not t or not t.strip() for t in texts], bool)
    return np.where(empty | ~np.isfinite(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -30, 30))))


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str | None], list[int]]:
    """Texts and labels of at most ``sample`` documents by a hash of the id. Ratings of a document are averaged; null ones
    and ties do not count."""
    voted = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("mean")).where("mean <> 0.5")
    drawn = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample is bounded, so its ids may be sent to every task.
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", (F.col("mean") > 0.5).cast("int").alias("label")).limit(2 * sample).toArrow().sort_by([("doc_id", "ascending")])
    return rows.column("text").to_pylist(), rows.column("label").to_pylist()


def score_documents(documents: DataFrame, labels: DataFrame, identity: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, source, score``: a row for each row with an id. The score is that of the document's worst passage.

    Every whole text is scored, in one pass without a shuffle; null, empty and blank texts score 0; a null source stays null. The
    classifier is fitted on the driver on a bounded sample of the labelled documents; without labels of both kinds a list of
    common insults stands in. An empty table gives no rows; other columns are not read.
    """
    weights, bias = train(*labelled_sample(documents, labels, sample), identity)
    shipped = documents.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shipped.value
        featurize = Featurizer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = score_texts(featurize, w, b, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    narrow = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, source string, score double")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """By source: documents, those from the threshold on, and their share."""
    flagged = F.sum((F.col("score") >= threshold).cast("long"))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), flagged.alias("n_abusive"), (flagged / F.count(F.lit(1))).alias("rate"))
